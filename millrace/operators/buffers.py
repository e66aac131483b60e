"""Greedy buffers: consecutive documents gathered until a budget is reached."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.shared import cut, lookup


#: Buffers that begin in one part, and parts, beyond which rows find theirs by a join on their place.
FEW_BOUNDS, MOST_PARTS = 1000, 40_000


def budget(seq_length: int, chars_per_token: float, sequences: int) -> float:
    """Characters of a buffer."""
    if seq_length <= 0 or sequences <= 0:
        raise ValueError("seq_length and sequences must be positive")
    return seq_length * chars_per_token * sequences


def _chain(total: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a buffer that begins before row j: where the next begins (n + 1 if it is still open at the end), and what is open and
    how many have closed by the end. Steps are doubled, so that the work is n log n without a loop over rows."""
    n = len(total) - 1
    following = np.searchsorted(total, total + most, "left")
    following[total[-1] - total < most] = n + 1
    following = np.maximum(following, np.minimum(np.arange(n + 1) + 1, n + 1))
    jump = np.append(following, n + 1)
    closed = np.append((following <= n).astype(np.int64), 0)
    last = np.where(jump > n, np.arange(n + 2), jump)  # the last beginning of a buffer reached from j
    while (jump <= n).any():
        closed = closed + np.where(jump <= n, closed[np.minimum(jump, n + 1)], 0)
        last = last[last]
        jump = jump[np.minimum(jump, n + 1)]
    return following, total[n] - total[last[: n + 1]], closed[: n + 1]


def _steps(df: DataFrame, most: float, by: list[str], order: str) -> DataFrame:
    """For each part: its units, and from the units open when it begins to those open when it ends. What is open only decides with which
    row the buffer at hand is full; buffers that begin at different rows soon close together, so most steps merge."""

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.concatenate((np.zeros(1), np.cumsum(pdf.sort_values(order)["units"].to_numpy())))
        _, left, closed = _chain(total, most)
        at = np.arange(1, min(int(np.searchsorted(total, most, "left")), len(total) - 1) + 1)
        if len(at):
            ends = np.append((left[at][1:] != left[at][:-1]) | (closed[at][1:] != closed[at][:-1]), True)
            at = at[ends]
        return pd.DataFrame({"stream": [key[0]], "part": [key[1]], "total": [total[-1]], "reached": [total[at].tolist()], "left": [left[at].tolist()], "closed": [(closed[at] + 1).tolist()]})

    kind = "stream string, part bigint, total double, reached array<double>, left array<double>, closed array<bigint>"
    return df.groupBy(*by).applyInPandas(steps, kind).orderBy("part")


def assign_buffers(df: DataFrame, most: float, units: str, order: str = "ord", part: str = "part", stream: str | None = None) -> DataFrame:
    """`df` with `buf`: rows in `order` fill buffer 0, 1, ... A row is added while the buffer has fewer than `most` units, so the last
    may go beyond. Null units count as 0; a budget that isn't a number makes one buffer; one of 0 or less raises ValueError.
    Values of `stream`, if given, have buffers of their own, each from 0; then a part must hold rows of one of them.

    `df` must be partitioned in order by `part`, as `with_ordinals` gives it. The reset makes this a sequential fold, so
    each part is first reduced, in parallel, to a step function from the units already open when it begins to those open when it
    ends; the driver takes one part's steps at a time, and then the parts find their first rows of buffers in parallel. Only units
    are shuffled, not texts: a row reads its buffer off the few bounds of its part.
    """
    if most <= 0:
        raise ValueError("the budget of a buffer must be positive")
    if math.isnan(most):
        return df.withColumn("buf", F.lit(0).cast("bigint"))
    spark = df.sparkSession
    label = F.col(stream).cast("string") if stream else F.lit("")
    sizes = df.select(label.alias("stream"), F.col(part).alias("part"), F.col(order).alias("ord"), F.coalesce(units, F.lit(0)).cast("double").alias("units"))
    open_at: dict[str, tuple[float, int]] = {}
    entries = []
    for r in _steps(sizes, most, ["stream", "part"], "ord").toLocalIterator():
        fill, number = open_at.get(r["stream"], (0.0, 0))
        entries.append((r["part"], fill, number))
        if fill + r["total"] < most:
            open_at[r["stream"]] = fill + r["total"], number
        else:
            k = int(np.searchsorted(np.array(r["reached"]), most - fill, "left"))
            open_at[r["stream"]] = r["left"][k], number + r["closed"][k]
    if all(number == 0 for _, number in open_at.values()):  # nothing was ever closed
        return df.withColumn("buf", F.lit(0).cast("bigint"))
    begun = lookup(spark, entries, "part bigint, fill double, number bigint")

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        total = np.concatenate((np.zeros(1), np.cumsum(pdf["units"].to_numpy())))
        n, fill, places = len(pdf), pdf["fill"].iloc[0], pdf["ord"].to_numpy()
        first = []
        j = int(np.searchsorted(total, most - fill, "left")) if fill + total[-1] >= most else n + 1
        following, _, _ = _chain(total, most)
        while j < n:
            first.append(int(places[j]))
            j = int(following[j])
        return pd.DataFrame({part: [pdf["part"].iloc[0]], "_number": [pdf["number"].iloc[0]], "_bounds": [first]})

    starts = sizes.join(begun, "part").groupBy("part").applyInPandas(bounds, f"{part} bigint, _number bigint, _bounds array<bigint>")
    at = F.col(order)
    known = starts.limit(MOST_PARTS + 1).collect() if len(entries) <= MOST_PARTS else []
    if known and sum(len(r["_bounds"]) for r in known) <= MOST_PARTS and max(len(r["_bounds"]) for r in known) <= FEW_BOUNDS:
        few = lookup(spark, known, f"{part} bigint, _number bigint, _bounds array<bigint>")
        return df.join(few, part).withColumn("buf", F.col("_number") + F.size(F.filter("_bounds", lambda b: b <= at))).drop("_number", "_bounds")
    # a budget of few rows: as many buffers as rows, so rows find theirs by joining on their place
    starts = cut(starts, "bounds")
    pairs = starts.withColumn("_b", F.arrays_zip("_bounds", F.expr("transform(_bounds, (x, i) -> _number + i + 1)").alias("_buf"))).select(part, "_number", F.explode_outer("_b").alias("_b"))
    firsts = pairs.select(part, "_number", F.col("_b")["_bounds"].alias("_at"), F.col("_b")["_buf"].alias("_buf"))
    marked = df.select(part, order).join(firsts.select(part, F.col("_at").alias(order), "_buf").where(F.col(order).isNotNull()), [part, order], "left").join(firsts.select(part, "_number").distinct(), part)
    run = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.select(part, order, F.coalesce(F.last("_buf", ignorenulls=True).over(run), "_number").alias("buf"))
    return df.join(numbered, [part, order])
