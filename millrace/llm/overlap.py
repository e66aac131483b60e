"""Records of one split that recur, whole or nearly whole, in another.

The word runs of the evaluation records are hashed. A training record that holds at least `share` of the n distinct
runs of an evaluation record also holds some of any floor((1 - share) * n) + 1 of them, so only that many, the rarest
among the evaluation records, are indexed, plus `spare` more, and a pair must then hit spare + 1 of them. The
scan of the training records passes only the runs whose bit is set in a bitmap of the indexed ones (all runs, where these are too many for
one), and hits are joined with the index by hash, partitioned on both sides. A run on which very many records of both sides
meet is split over tasks. Pairs with enough hits are compared exactly. Texts with equal word
sequences make one class on either side, which takes part once; classes become ids again at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import shingles as S
from millrace.llm.bitmaps import bitmap, within
from millrace.llm.verify import common_runs
from millrace.shared import bounded, cut, looked_up


@dataclass(frozen=True)
class Containment:
    """share: least part of the evaluation record's distinct runs that the other must hold. spare: hits asked for
    beyond the first, as a part of the evaluation record's runs."""

    share: float = 0.8
    run_words: int = 5
    least_words: int = 20
    spare: float = 0.05


def _runs(records: DataFrame, how: Containment, bits: object = None) -> DataFrame:
    """(id, print, n, runs): distinct run hashes of each text with enough words, where `bits` is given only those in the bitmap.

    Texts of equal word sequences have equal `print`; texts without a run left give no row.
    """
    least = max(how.least_words, how.run_words)
    kind = "id bigint, print bigint, n int, runs array<bigint>"

    def batches(it):
        for b in it:
            for r, e, data, at in S.blocks(b.column(1)):
                w = S.words(data, at)
                h, first = S.shingles(w, how.run_words)
                long = w.counts >= least
                keep = np.repeat(long, np.diff(first))
                if bits is not None:
                    keep &= within(bits.value, h)
                at_kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[first]
                u, f = S.distinct(h[keep], at_kept)
                rows = np.flatnonzero(long & (np.diff(f) > 0))
                if not len(rows):
                    continue
                size = np.diff(f)[rows]
                lists = pa.ListArray.from_arrays(np.concatenate((np.zeros(1, np.int64), np.cumsum(size))).astype(np.int32), pa.array(u.view(np.int64)))
                ids = b.column(0).slice(r, e - r).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(S.text_prints(w)[rows]), pa.array(size.astype(np.int32)), lists], ["id", "print", "n", "runs"])

    return records.select("id", "content").where(F.col("content").isNotNull()).mapInArrow(batches, kind)


def _classes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, n, runs), one row for each class of texts with equal word sequences, and the members (rep, id)."""
    classes = runs.groupBy("print").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("runs").alias("runs"))
    classes = cut(classes, "classes")
    members = looked_up(cut(runs.select("print", "id").distinct(), "prints"), classes.select("print", "rep"), "print").select("rep", "id")
    return classes.drop("print"), members


#: Meetings on one run that a task makes, about.
MEETINGS = 1_000_000


def _meetings(hits: DataFrame, index: DataFrame, most: int = MEETINGS) -> DataFrame:
    """`hits` (b, run) joined with `index` (run, a, needed). Runs with more than `most` meetings are split: the hits by hashed ids, the index
    copied for each part."""
    counts = index.groupBy("run").agg(F.count("*").alias("n_a")).join(hits.groupBy("run").agg(F.count("*").alias("n_b")), "run")
    split = bounded(counts.where(F.col("n_a") * F.col("n_b") > most).select("run", F.least("n_b", F.ceil(F.col("n_a") * F.col("n_b") / most)).cast("int").alias("parts")), "split")
    if split.isEmpty():
        return hits.join(index, "run")
    parts = F.coalesce("parts", F.lit(1))
    left = hits.join(split, "run", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    right = index.join(split, "run", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["run", "part"]).drop("part")


def overlaps(evaluation: DataFrame, training: DataFrame, how: Containment = Containment()) -> DataFrame:
    """(eval_id, train_id, n_common, n_eval): all pairs where the training text holds at least `share` of the evaluation
    text's distinct word runs.

    Both sides have `id` (not null) and `content`; further columns are ignored, and rows that repeat an id count once.
    Null, empty and short texts are in no pair. An id may be on both sides; it is not paired with itself.
    """
    own, own_members = _classes(cut(_runs(evaluation, how), "runs"))
    single = own.select(F.col("rep").alias("a"), "n", F.explode("runs").alias("run"))
    common = single.groupBy("run").agg(F.count("*").alias("df"))
    ranked = (
        single.join(common, "run")
        .withColumn("needed", F.greatest(F.lit(1), F.ceil(F.col("n") * how.spare)).cast("int"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("df", "run")))
    )
    least = round(how.share * 10_000)
    # a pair holds at least ceil(share * n) of the n runs, so it misses at most the rest of any choice of them
    chosen = ranked.where(F.expr(f"rank <= n - ceil(n * {least} / 10000) + needed"))
    index = cut(chosen.select("run", "a", "needed"), "index")
    bits = bitmap(index.select("run"))
    others, other_members = _classes(cut(_runs(training, how, bits), "hits"))
    hits = others.select(F.col("rep").alias("b"), F.explode("runs").alias("run"))
    pairs = _meetings(hits, index).groupBy("a", "b").agg(F.count("*").alias("hits"), F.first("needed").alias("needed")).where("hits >= needed").select("a", "b")
    texts = evaluation.select("id", "content").unionByName(training.select("id", "content"))
    found = common_runs(cut(pairs, "candidates"), texts, how.run_words).where(F.col("n_common") * 10_000 >= F.col("n_a") * least)
    return (
        cut(found, "links")
        .join(own_members.select(F.col("rep").alias("a"), F.col("id").alias("eval_id")), "a")
        .join(other_members.select(F.col("rep").alias("b"), F.col("id").alias("train_id")), "b")
        .where("eval_id <> train_id")
        .select("eval_id", "train_id", "n_common", F.col("n_a").alias("n_eval"))
    )
