"""Packing texts into containers of fixed capacity along a space-filling curve.

Each text gets a hashed vector: counts of its byte 3-grams in BUCKETS buckets, square roots, length one. The vectors are projected to the
DIMENSIONS directions in which all texts together vary most, found from sums over all texts. The Hilbert key of the point orders the texts so
that neighbours are alike; the keys are range-sorted, and stretches of the curve are packed in its order: each container takes the next
text and those of the few behind it that fill it best.

All sums and products are of whole numbers, and stretches are counted along the curve, so containers don't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import shingles as S
from millrace.llm.tokenizers import VOCABULARY, counter
from millrace.shared import cut, ship
from millrace.sources.jsonl import with_ordinals

#: Buckets of a vector (a power of two), dimensions and bits of each of a curve's points, whole steps of a vector's unit.
BUCKETS, DIMENSIONS, BITS, UNIT = 256, 6, 10, 4096
#: Texts of a stretch of the curve, which a task packs.
STRETCH = 16384
_ROWS, _COLUMNS = np.triu_indices(BUCKETS)
_FAN = 64


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a container. ahead: texts along the curve that a container chooses from, more only while they
    hold less than two containers. vocabulary: path of the tokenizer."""

    capacity: int = 2048
    ahead: int = 64
    vocabulary: str = VOCABULARY


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The vector of each text of a block of UTF-8 bytes, in whole steps (zeros for a text of under 3 bytes)."""
    n = len(at) - 1
    if len(data) < 3:
        return np.zeros((n, BUCKETS))
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    grams = np.ndarray((len(data),), "<u4", padded, strides=(1,)) & np.uint32(0xFFFFFF)
    grams *= np.uint32(0x9E3779B1)
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x85EBCA6B)
    bucket = (grams >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
    inside = np.ones(len(data), bool)  # a gram that runs into the next text is of none
    for k in (1, 2):
        ends = at[1:] - k
        inside[ends[ends >= at[:-1]]] = False
    row = np.repeat(np.arange(n) * BUCKETS, np.diff(at))
    x = np.sqrt(np.bincount((row + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float))
    return np.rint(x * (UNIT / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)))


def moments(texts: DataFrame) -> np.ndarray:
    """The number of texts with a vector, and the sums of their vectors and of products of every two components, over all rows (id, text).

    Each task gives one row, and rows are added up by trees, 64 at a time; the driver gets the last one. Sums are exact.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + BUCKETS + len(_ROWS))
        for b in it:
            for _, _, data, at in S.blocks(b.column(0)):
                x = vectors(data, at)
                total += np.concatenate(([float((x.sum(1) > 0).sum())], x.sum(0), (x.T @ x)[_ROWS, _COLUMNS]))
        task = TaskContext.get()
        yield pa.RecordBatch.from_pydict({"place": pa.array([task.partitionId() if task else 0], pa.int64()), "sums": pa.array([total.astype(np.int64)], pa.list_(pa.int64()))})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": [pdf["place"].iloc[0] // _FAN], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), 0)]})

    kind = "place bigint, sums array<bigint>"
    rows = texts.select("text").mapInArrow(batches, kind)
    levels = max(1, math.ceil(math.log(max(2, texts.rdd.getNumPartitions()), _FAN)))
    for _ in range(levels):
        rows = rows.groupBy(F.expr(f"place div {_FAN}")).applyInPandas(added, kind)
    found = rows.collect()  # one row
    return np.sum([r["sums"] for r in found], 0) if found else np.zeros(1 + BUCKETS + len(_ROWS), np.int64)


@dataclass(frozen=True)
class Plane:
    """A projection: `axes` in whole steps, and the `centre` and `width` of the points along each axis."""

    axes: np.ndarray
    centre: np.ndarray
    width: np.ndarray

    @staticmethod
    def of(sums: np.ndarray) -> Plane:
        """The directions of most variance, each turned so that its greatest component is positive."""
        n = max(int(sums[0]), 1)
        mean = sums[1 : BUCKETS + 1] / n
        spread = np.zeros((BUCKETS, BUCKETS))
        spread[_ROWS, _COLUMNS] = spread[_COLUMNS, _ROWS] = sums[BUCKETS + 1 :] / n
        values, axes = np.linalg.eigh(spread - np.outer(mean, mean))
        axes, values = axes[:, ::-1][:, :DIMENSIONS], values[::-1][:DIMENSIONS]
        axes = np.rint(axes * np.sign(axes[np.abs(axes).argmax(0), range(DIMENSIONS)]) * UNIT)
        return Plane(axes, mean @ axes, np.sqrt(np.maximum(values, 1e-9)) * UNIT)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Hilbert keys of vectors; three deviations to each side of the centre are told apart."""
        z = np.clip((x @ self.axes - self.centre) / self.width / 6 + 0.5, 0, 1 - 1e-9)
        return hilbert_keys((z * (1 << BITS)).astype(np.int64))


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places on the Hilbert curve of points with DIMENSIONS whole coordinates of BITS bits."""
    x = [points[:, k].astype(np.int64) for k in range(DIMENSIONS)]
    q = 1 << (BITS - 1)
    while q > 1:  # undo the excess turns, from the largest cube down
        low = q - 1
        for k in range(DIMENSIONS):
            high = (x[k] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ t)
            if k:
                x[k] = x[k] ^ t
        q >>= 1
    for k in range(1, DIMENSIONS):  # Gray code
        x[k] = x[k] ^ x[k - 1]
    t = np.zeros(len(points), np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(len(points), np.int64)
    for b in range(BITS - 1, -1, -1):
        for k in range(DIMENSIONS):
            key = key << 1 | ((x[k] ^ t) >> b & 1)
    return key


def keyed(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, key) of the rows (id, text); a null or empty text has no token."""
    plane = Plane.of(moments(documents))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in it:
            n = np.array(count([t or "" for t in b.column(1).to_pylist()]), np.int64)
            for r, e, data, at in S.blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, e - r), pa.array(n[r:e]), pa.array(plane.keys(vectors(data, at)))], ["id", "n_tokens", "key"])

    return documents.select("id", "text").mapInArrow(batches, "id bigint, n_tokens bigint, key bigint")


def filled(sizes: np.ndarray, how: Packing) -> np.ndarray:
    """Rows (place of the item in `sizes`, piece, tokens, container, place in it) for items in the order of the curve.

    An item over the capacity fills containers of its own, and its rest is an item like others. A container always takes the next item; of those
    behind it, it takes the ones that leave the least room, near ones first.
    """
    capacity = how.capacity
    rows: list[tuple[int, int, int, int, int]] = []
    ahead: list[tuple[int, int, int]] = []  # item, piece, size
    container, at, held, n, everything = 0, 0, 0, len(sizes), (1 << (capacity + 1)) - 1
    while True:
        while at < n and (len(ahead) < how.ahead or held < 2 * capacity):
            size, piece = int(sizes[at]), 0
            while size > capacity:
                rows.append((at, piece, capacity, container, 0))
                size, piece, container = size - capacity, piece + 1, container + 1
            ahead.append((at, piece, size))
            held += size
            at += 1
        if not ahead:
            return np.array(rows, np.int64).reshape(-1, 5)
        reached = [1 << ahead[0][2]]  # bit k: the container can hold exactly k tokens of the items so far
        for _, _, size in ahead[1:]:
            reached.append((reached[-1] | reached[-1] << size) & everything)
        left = reached[-1].bit_length() - 1
        k = next(k for k, r in enumerate(reached) if r >> left & 1)
        taken = []
        while k > 0:
            if not reached[k - 1] >> left & 1:
                taken.append(k)
                left -= ahead[k][2]
            k -= 1
        start = 0
        for k in (0, *reversed(taken)):
            item, piece, size = ahead[k]
            rows.append((item, piece, size, container, start))
            start += size
        for k in (*taken, 0):
            held -= ahead[k][2]
            del ahead[k]
        container += 1


def packed(documents: DataFrame, how: Packing = Packing()) -> DataFrame:
    """One row for each piece of each row (id, text): id, piece, piece_tokens, container_id, start_token.

    Only a text of more tokens than the capacity has more than one piece. Rows are items of their own even if they repeat an id or text;
    further columns are ignored; a null or empty text is an item of 0 tokens. Pieces of a container lie side by side:
    start_token is where the piece begins in its container. Only the last container of a stretch of the curve stays open.
    """
    ship(documents.sparkSession)
    keys = cut(keyed(documents.select("id", "text"), how.vocabulary), "keys").withColumn("tie", F.xxhash64("id"))
    order = with_ordinals(keys, ["key", "tie", "id", "n_tokens"]).select("id", "n_tokens", "ord", F.expr(f"ord div {STRETCH}").alias("stretch"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        x = filled(table["n_tokens"].to_numpy(), how)
        ids = table["id"].combine_chunks().take(pa.array(x[:, 0]))
        container = x[:, 3] + (table["stretch"][0].as_py() << 32)
        return pa.Table.from_arrays([ids, pa.array(x[:, 1].astype(np.int32)), pa.array(x[:, 2]), pa.array(container), pa.array(x[:, 4])], ["id", "piece", "piece_tokens", "container_id", "start_token"])

    return order.groupBy("stretch").applyInArrow(pack, "id bigint, piece int, piece_tokens bigint, container_id bigint, start_token bigint")


def fill(placed: DataFrame, capacity: int, label: str | None = None) -> DataFrame:
    """One row: n_items, n_containers, n_tokens, and the share of the containers' room that is used.

    With `label`, a column of `placed`, also alike_share, the share of all pairs of pieces in a container that have the same label, and by_chance,
    the same for pairs of any two pieces; null is a label. Both come from counts, without a row for each pair.
    """
    n = placed.groupBy("container_id").agg(F.sum("piece_tokens").alias("n"), F.count_if(F.col("piece") == 0).alias("items"))
    out = n.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"),
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        (F.sum("n") / F.count("*") / capacity).alias("used_share"),
    )
    if label is None:
        return out
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1))
    each = cut(placed.groupBy("container_id", F.col(label).alias("label")).agg(F.count("*").alias("c")), "labels")
    same, within = each.agg(pairs("c").alias("same")), each.groupBy("container_id").agg(F.sum("c").alias("c")).agg(pairs("c").alias("within"))
    chance = each.groupBy("label").agg(F.sum("c").alias("c")).agg((pairs("c") / (F.sum("c") * (F.sum("c") - 1))).alias("by_chance"))
    for one in (same, within, chance):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out.select("n_items", "n_containers", "n_tokens", "used_share", (F.col("same") / F.col("within")).alias("alike_share"), "by_chance")


def broken(placed: DataFrame, capacity: int) -> DataFrame:
    """One row, of zeros for a right packing: n_over, containers with more than `capacity` tokens; n_apart, pieces that don't begin where
    the one before them in the container ends; n_split, pieces of items that were cut although they fit."""
    side = Window.partitionBy("container_id").orderBy("start_token", "piece_tokens")
    before = F.coalesce(F.lag(F.col("start_token") + F.col("piece_tokens")).over(side), F.lit(0))
    apart = placed.withColumn("apart", F.col("start_token") != before)
    over = apart.groupBy("container_id").agg(F.sum("piece_tokens").alias("n"), F.count_if("apart").alias("apart"), F.count_if((F.col("piece") > 0) & (F.col("piece_tokens") == 0)).alias("split"))
    return over.agg(F.count_if(F.col("n") > capacity).alias("n_over"), F.coalesce(F.sum("apart"), F.lit(0)).alias("n_apart"), F.coalesce(F.sum("split"), F.lit(0)).alias("n_split"))
