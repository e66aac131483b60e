"""Exact comparison of candidate pairs by the sets of their word runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as S
from millrace.llm.bitmaps import bitmap, hashed_ids, id_hashes, within
from millrace.shared import cut


def run_sets(records: DataFrame, length: int, bits: Broadcast | None) -> DataFrame:
    """(id, runs) for rows (id, content) whose id is in the bitmap, or all: `runs` holds the sorted distinct 64-bit hashes of the word runs.

    Two different runs of a pair share a hash with a chance of n * m / 2^64 for texts of n and m runs; at a million runs each that is 5e-8.
    """

    def batches(it):
        for b in it:
            if not b.num_rows:
                continue
            if bits is not None:
                b = b.filter(pa.array(within(bits.value, id_hashes(b.column(0).to_numpy()))))
            ids, column = b.column(0), b.column(1)
            for r, e, data, at in S.blocks(column):
                h, first = S.shingles(S.words(data, at), length)
                u, f = S.distinct(h, first)
                yield pa.RecordBatch.from_arrays([ids.slice(r, e - r), S.binary_column(u, f)], ["id", "runs"])

    return records.select("id", "content").where(F.col("id").isNotNull()).mapInArrow(batches, "id bigint, runs binary")


def with_sets(pairs: DataFrame, records: DataFrame, length: int) -> DataFrame:
    """`pairs` (a, b, ...) with runs_a and runs_b. The scan of the texts keeps those whose id is in a bitmap of the pairs' ids, so texts
    are never shuffled, only the sets of the records in pairs (and of few others). Beyond the ids that a bitmap may hold, texts are
    joined with the ids by partitions instead."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    bits = bitmap(hashed_ids(ids))
    kept = records.select("id", "content") if bits is not None else records.select("id", "content").join(ids, "id", "left_semi")
    sets = run_sets(kept, length, bits).dropDuplicates(["id"])
    return pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b"
    )


def common_runs(pairs: DataFrame, records: DataFrame, length: int) -> DataFrame:
    """`pairs` (a, b) with n_common, n_a and n_b: the numbers of distinct runs in both, in a and in b."""

    def batches(it):
        for batch in it:
            left, right = batch.column("runs_a"), batch.column("runs_b")
            n = np.zeros((3, batch.num_rows), np.int64)
            for k in range(batch.num_rows):
                x = np.frombuffer(left[k].as_buffer(), np.uint64)
                y = np.frombuffer(right[k].as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                n[:, k] = np.count_nonzero(both[1:] == both[:-1]), len(x), len(y)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *map(pa.array, n)], ["a", "b", "n_common", "n_a", "n_b"])

    return with_sets(pairs.select("a", "b"), records, length).mapInArrow(batches, "a bigint, b bigint, n_common bigint, n_a bigint, n_b bigint")
