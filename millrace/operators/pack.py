"""Constant-length windows over end-joined token streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.draws import uniform
from millrace.functions.tokens import SpecialTokens
from millrace.shared import bounded, cut, lookup

#: Tokens of a stretch of windows that a task puts together, about; and least windows of one.
STRETCH, LEAST_WINDOWS = 1 << 18, 16


def stride(seq_length: int, overlap: float = 0.0) -> int:
    if seq_length <= 0:
        raise ValueError("seq_length must be positive")
    return max(1, int(seq_length * (1 - overlap)))


def _running(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """For columns (part, order, n) of the rows of a task: `run`, the order of the first row of the run of rows of one part, and `before`,
    the sum of n over the rows of the run before this one."""
    last, run, total = None, 0, 0
    for part, order, n in parts:
        p, o, x = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (part, order, n))
        runs, before = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)])) if len(p) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if p[a] != last:
                last, run, total = p[a], o[a], 0
            sums = np.cumsum(x[a:b])
            runs[a:b], before[a:b] = run, total + sums - x[a:b]
            total += int(sums[-1])
        yield pa.StructArray.from_arrays([pa.array(runs), pa.array(before)], ["run", "before"])


_running.__annotations__ = {"parts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}


def segments(df: DataFrame, special: SpecialTokens, tokens: str = "tokens", order: str = "ord", part: str | Column = "part") -> DataFrame:
    """`df` with `segment` (the tokens and an end token; only it if they are null or empty) in their place, its length `n`, and `at`,
    the running sum of `n`. Rows of a part must follow one another in order."""
    end = F.array(F.lit(special.eos).cast("bigint"))
    ended = df.withColumn("segment", F.concat(F.coalesce(tokens, F.array().cast("array<bigint>")), end)).drop(tokens).withColumn("n", F.size("segment").cast("bigint"))
    running = F.arrow_udf(_running, "run bigint, before bigint").asNondeterministic()
    return ended.withColumn("at", running(part, F.col(order), F.col("n")))


def placed(written: DataFrame, stream: str | None = None, buf: str = "buf") -> DataFrame:
    """Written rows of `segments` with `buf` to `off`, their place in the stream of their buffer, and `total`, its length. Buffers of
    different values of `stream` are different.

    Sums of runs, one row for each task that wrote them, are added up by the driver; what is joined to the rows is small, and the arrays of
    tokens aren't shuffled. Beyond the bound of a broadcast they are, by buffer, which the windows then make use of.
    """
    runs = sorted((r["run"], r["total"]) for r in written.groupBy(F.col("at.run").alias("run")).agg(F.sum("n").alias("total")).collect())
    upto, starts = 0, []
    for run, total in runs:
        starts.append((run, upto))
        upto += total
    starts = lookup(written.sparkSession, starts, "_run bigint, _upto bigint")
    at = written.withColumn("_run", F.col("at.run")).join(starts, "_run").withColumn("_at", F.col("_upto") + F.col("at.before")).drop("_run", "_upto", "at")
    by = [buf, stream] if stream else [buf]
    each = bounded(at.groupBy(*by).agg(F.min("_at").alias("_first"), F.sum("n").alias("total")), "streams")
    return at.join(each, by).withColumn("off", F.col("_at") - F.col("_first")).drop("_at", "_first")


def offsets(df: DataFrame, special: SpecialTokens, tokens: str = "tokens", order: str = "ord", buf: str = "buf") -> DataFrame:
    """`df` with `segment` instead of the tokens, its length `n`, its place `off` in the stream of its buffer, and the stream's length `total`.

    Rows with a column `part` must follow one another in `order` within each part, parts in order, as `with_ordinals` gives
    them. Without it they may come in any order; then only lengths are windowed, a buffer in a task.
    """
    if "part" in df.columns:
        return placed(cut(segments(df, special, tokens, order), "segments"), buf=buf)
    rows = cut(segments(df, special, tokens, order, F.lit(0)).drop("at"), "segments")
    before = Window.partitionBy(buf).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint")
    return rows.join(rows.select(order, buf, at.alias("off"), F.sum("n").over(Window.partitionBy(buf)).alias("total")), [order, buf])


def _floor_div(x: Column, by: int) -> Column:
    """Whole-number division towards minus infinity, exact for all 64-bit numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by).cast("bigint"))


def windows(placed: DataFrame, seq_length: int, special: SpecialTokens, overlap: float = 0.0, buf: str = "buf") -> DataFrame:
    """Rows of `offsets` to examples: buf, win, input_ids and labels, both of `seq_length`.

    Windows begin every `stride` tokens of a buffer's stream and never cross buffers; short ones are filled with the pad token, and
    labels are the ids with every pad token as -100. With an overlap the last window may lie within the one before; a negative
    overlap leaves gaps. Documents give their pieces to stretches of consecutive windows, so that a token is shuffled little more
    than once, and no stream is ever put together whole: a task holds one stretch of about STRETCH tokens.
    """
    s, size = stride(seq_length, overlap), seq_length
    count = max(LEAST_WINDOWS, STRETCH // max(s, size))
    step, reach = count * s, (count - 1) * s + size
    low = F.greatest(F.lit(0).cast("bigint"), _floor_div(F.col("off") - reach, step) + 1)
    high = F.least(_floor_div(F.col("off") + F.col("n") - 1, step), _floor_div(F.col("total") - 1, step))
    reached = placed.select(buf, "off", "n", "total", "segment", low.alias("low"), high.alias("high")).where("low <= high")
    cut_up = reached.withColumn("stretch", F.explode(F.sequence("low", "high")))
    begin = F.greatest(F.col("off"), F.col("stretch") * step)
    end = F.least(F.col("off") + F.col("n"), F.col("stretch") * step + reach)
    piece = F.slice("segment", (begin - F.col("off") + 1).cast("int"), (end - begin).cast("int"))
    pieces = cut_up.where(begin < end).select(F.col(buf).alias("buf"), "stretch", begin.alias("at"), "total", piece.alias("piece"))
    pad = special.padding

    def together(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        at = table["at"].to_numpy()
        order = np.argsort(at, kind="stable")
        lists = table["piece"].combine_chunks().take(pa.array(order))
        flat = lists.flatten().to_numpy()
        first, total = int(table["stretch"][0].as_py()) * step, int(table["total"][0].as_py())
        n = min(count, -(-(total - first) // s))
        stream = np.full((n - 1) * s + size, pad, np.int64)
        stream[: min(len(flat), len(stream))] = flat[: len(stream)]
        ids = np.lib.stride_tricks.sliding_window_view(stream, size)[::s].copy()
        labels = np.where(ids == pad, -100, ids)
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * size)
        win = np.arange(first // s, first // s + n, dtype=np.int64)
        columns = [pa.array(np.full(n, table["buf"][0].as_py(), np.int64)), pa.array(win), *(pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (ids, labels))]
        return pa.Table.from_arrays(columns, ["buf", "win", "input_ids", "labels"])

    made = pieces.groupBy("buf", "stretch").applyInArrow(together, "buf bigint, win bigint, input_ids array<bigint>, labels array<bigint>")
    return made if buf == "buf" else made.withColumnRenamed("buf", buf)


def shuffled_windows(examples: DataFrame, seed: int = 0, epoch: int = 0, worker: int = 0, buf: str = "buf") -> DataFrame:
    """Examples with `place`, a random order within each buffer that changes with the epoch and the worker."""
    order = Window.partitionBy(buf).orderBy(uniform(seed + 1000 * epoch + worker, "bufshuf", buf, "win"), "win")
    return examples.withColumn("place", F.row_number().over(order).cast("bigint") - 1)


def batches(examples: DataFrame, batch: int = 5, accumulate: int = 2, order: str = "ord") -> DataFrame:
    """Rows with `batch` and `step`, the device batch and the optimizer step, from the place `order`; the last may be short."""
    return examples.withColumn("batch", _floor_div(F.col(order), batch)).withColumn("step", _floor_div(F.col(order), batch * accumulate))
