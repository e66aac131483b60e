"""Near copies by an inverted index over the byte positions of digests.

Each text gets a digest of `places` two-byte places; place k holds 16 bits of the least value that hash
function k takes on the text's word runs, so two texts agree at a place with a chance equal to their
similarity s = |A & B| / |A | B|. The inverted index posts each text under the bytes at its byte positions, `together` places
(four bytes) to a position. Pairs that meet in a list are tallied, position by position, and pairs with fewer than the guaranteed
minimum of shared positions are dropped; the rest are compared exactly.

A position of one place would be shared with the chance s, but texts of one corpus share so many word runs that 19,366 different texts then
meet 46 million times, against 169 thousand times at positions of two places, where unlike texts meet with the chance s squared. The
minimum is set so that a pair with s just at the threshold falls below it with a chance under `missed`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as S
from millrace.llm.verify import common_runs
from millrace.shared import bounded, cut, hot_keys, looked_up

PLACE_BYTES = 2


@dataclass(frozen=True)
class Digest:
    """positions: places of a digest. together: places that one list of the index takes. threshold: least similarity of
    a pair. run_words: words of a run. least_words: texts with fewer words are in no pair. missed: chance that the
    tally drops a pair of just that similarity. long_list: texts beyond which a list is tallied in blocks of about `block`
    texts instead of by a row for each pair; both ways find the same pairs."""

    positions: int = 72
    together: int = 2
    threshold: float = 0.8
    run_words: int = 5
    least_words: int = 20
    missed: float = 1e-6
    long_list: int = 500
    block: int = 8192

    @property
    def lists(self) -> int:
        return self.positions // self.together

    @property
    def minimum(self) -> int:
        """The largest m with P(Binomial(lists, threshold ^ together) < m) <= missed, at least 1."""
        n, p, below = self.lists, self.threshold**self.together, 0.0
        for m in range(n + 1):
            below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
            if below > self.missed:
                return max(m, 1)
        return n


def digests(records: DataFrame, how: Digest) -> DataFrame:
    """(id, print, digest) of the rows (id, content) with enough words; `print` is equal for equal word sequences."""
    rng = np.random.default_rng(20240229)
    factors = (rng.integers(0, 2**32, how.positions, np.uint64) | np.uint64(1)).astype(np.uint32)
    masks = rng.integers(0, 2**32, how.positions, np.uint64).astype(np.uint32)
    least = max(how.least_words, how.run_words)

    def batches(it):
        for b in it:
            ids = b.column(0)
            for r, e, data, at in S.blocks(b.column(1)):
                w = S.words(data, at)
                rows = np.flatnonzero(w.counts >= least)
                if not len(rows):
                    continue
                h, first = S.shingles(w, how.run_words)
                # runs of texts that are left out fall behind the last start or between two; cut them away first
                if len(rows) < len(w.counts):
                    kept = np.repeat(w.counts >= least, np.diff(first))
                    h, starts = h[kept], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(first)[rows])))[:-1]
                else:
                    starts = first[:-1]
                x = (h >> np.uint64(32)).astype(np.uint32)
                y = np.empty_like(x)
                out = np.empty((len(rows), how.positions), np.uint16)
                for k in range(how.positions):
                    np.bitwise_xor(x, masks[k], out=y)
                    np.multiply(y, factors[k], out=y)
                    out[:, k] = (np.minimum.reduceat(y, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
                size = how.positions * PLACE_BYTES
                digest = S.binary_column(out.reshape(-1).view(np.uint8), np.arange(len(rows) + 1) * size)
                yield pa.RecordBatch.from_arrays([ids.slice(r, e - r).take(pa.array(rows)), pa.array(S.text_prints(w)[rows]), digest], ["id", "print", "digest"])

    return records.select("id", "content").where(F.col("content").isNotNull()).mapInArrow(batches, "id bigint, print bigint, digest binary")


def _tallied_blocks(rows: DataFrame, how: Digest) -> DataFrame:
    """Pairs (a, b) with the minimum of shared positions for rows (key, n, rep, digest) of long lists, without a row for each pair that meets.

    A list of n texts is cut by hashed ids into blocks; a task takes two blocks (or one with itself), tallies all their pairs in memory
    and returns those over the minimum. So a list of any length spreads over tasks that each hold at most about 2 * `block` digests.
    """
    blocks = F.ceil(F.col("n") / how.block).cast("int")
    own = rows.withColumn("m", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "digest")
    width = how.together * PLACE_BYTES

    def tally(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        reps, own = pdf["rep"].to_numpy(), pdf["own"].to_numpy()
        bytes_ = np.frombuffer(b"".join(pdf["digest"]), np.uint8).reshape(len(pdf), -1)
        values = np.zeros((len(pdf), how.lists), np.uint64)
        for b in range(width):
            values = values << np.uint64(8) | bytes_[:, b : how.lists * width : width]
        left, right = (np.flatnonzero(own == k) for k in (i, j))
        out: list[np.ndarray] = []
        for start in range(0, len(left), 64):
            part = left[start : start + 64]
            n = np.zeros((len(part), len(right)), np.uint8)
            for k in range(how.lists):
                n += values[part, k][:, None] == values[right, k][None, :]
            x, y = np.nonzero(n >= how.minimum)
            out.append(np.column_stack((reps[part[x]], reps[right[y]])))
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        a, b = found.min(1, initial=2**63 - 1), found.max(1, initial=-(2**63))
        keep = a < b
        return pd.DataFrame({"a": a[keep], "b": b[keep]}).drop_duplicates()

    return met.groupBy("key", "i", "j").applyInPandas(tally, "a bigint, b bigint")


def candidates(classes: DataFrame, how: Digest) -> DataFrame:
    """Pairs (a, b), a < b, of the rows (rep, digest) that share at least the guaranteed minimum of positions.

    Short lists are joined with themselves, and the shared positions of each pair that meets are counted. A pair that meets in a long list is
    tallied there over all its positions, whatever it shares besides.
    """
    width = how.together * PLACE_BYTES
    listed = classes.select("rep", F.explode(F.expr(f"transform(sequence(0, {how.lists - 1}), k -> xxhash64(k, substring(digest, k * {width} + 1, {width})))")).alias("key"))
    lengths = cut(listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    short = listed.join(lengths.where(F.col("n") <= how.long_list).select("key"), "key")
    left, right = short.withColumnRenamed("rep", "a"), short.withColumnRenamed("rep", "b")
    met = left.join(right, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= how.minimum).select("a", "b")
    lists = bounded(lengths.where(F.col("n") > how.long_list), "long")
    if lists.isEmpty():
        return met
    long = listed.join(lists, "key").join(classes.select("rep", "digest"), "rep")
    return met.union(_tallied_blocks(long, how)).distinct()


@dataclass
class NearCopies:
    """members: (id, rep), one row for each id, `rep` being the least id with the same word sequence.
    links: (a, b, n_common, n_union), a < b, pairs of different `rep` that are alike."""

    members: DataFrame
    links: DataFrame


def near_copies(records: DataFrame, how: Digest = Digest()) -> NearCopies:
    """All pairs of texts with |A & B| >= threshold * |A | B| over their distinct word runs.

    `records` has `id` (not null) and `content`; further columns are ignored, and rows that repeat an id count once.
    A null, empty or short text is in no class and no pair. Texts with equal word sequences make one class,
    which takes part in the search once, whatever its size; so a group of copies costs no more than one text.
    """
    digested = cut(digests(records, how), "digests")
    classes = digested.groupBy("print").agg(F.min("id").alias("rep"), F.first("digest").alias("digest"))
    classes = cut(classes, "classes")
    members = cut(looked_up(cut(digested.select("id", "print").distinct(), "prints"), classes.select("print", "rep"), "print").select("id", "rep"), "members")
    pairs = cut(candidates(classes, how), "candidates")
    top, bottom = _ratio(how.threshold)
    links = (
        common_runs(pairs, records, how.run_words)
        .withColumn("n_union", F.expr("n_a + n_b - n_common"))
        .where(F.col("n_common") * bottom >= F.col("n_union") * top)
        .select("a", "b", "n_common", "n_union")
    )
    return NearCopies(members, cut(links, "links"))


def _ratio(x: float) -> tuple[int, int]:
    """A decimal threshold as a ratio of integers, so that a pair just on it is kept."""
    return round(x * 10_000), 10_000


#: Members of a class that are joined with others at a time.
MEMBERS = 1000


def all_pairs(found: NearCopies) -> DataFrame:
    """(record_a, record_b), record_a < record_b: the links between classes and the pairs within a class, by single ids.

    This is as long as there are pairs; members and links say the same in less. Classes are cut by hashed ids into blocks of about MEMBERS, and
    blocks are joined with blocks, so that no task gathers a large class.
    """
    sizes = cut(found.members.groupBy("rep").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m"), F.count("*").alias("n")), "sizes")
    members = cut(looked_up(found.members, sizes, "rep").withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")), "members")
    met = members.where("n > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    met = met.select("rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
    left, right = met.where("own = i").select("rep", "i", "j", F.col("id").alias("x")), met.where("own = j").select("rep", "i", "j", F.col("id").alias("y"))
    within = left.join(right, ["rep", "i", "j"]).where("i < j OR x < y").select("x", "y")
    links = found.links.select("a", "b")
    for side in ("a", "b"):
        links = cut(looked_up(links, sizes.select(F.col("rep").alias(side), F.col("m").alias(f"m_{side}")), side), "sized")
    for side in ("a", "b"):
        links = links.withColumn(f"own_{side}", F.explode(F.sequence(F.lit(0), F.col(f"m_{side}") - 1)))
    one = lambda side, name: members.select(F.col("rep").alias(side), F.col("own").alias(f"own_{side}"), F.col("id").alias(name))
    between = links.join(one("a", "x"), ["a", "own_a"]).join(one("b", "y"), ["b", "own_b"]).select("x", "y")
    return within.unionByName(between).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def groups(found: NearCopies, rounds: int = 60) -> DataFrame:
    """(id, group_id, n_links): connected groups of alike texts; `group_id` is the least id in the group.

    Labels move along links and then jump to their label's label, so the rounds grow with the logarithm of a
    group's diameter. Only classes with a link take part; n_links counts the linked classes of an id's class.
    A class with very many links and a label of very many classes are taken apart from the joins (see `looked_up`).
    Raises RuntimeError if labels still move after `rounds`.
    """
    links = found.links.select("a", "b")
    both = cut(links.union(links.select("b", "a")), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n_links")), "labels")
    hubs = hot_keys(both, "b")
    for _ in range(rounds):
        near = looked_up(both, labels.select(F.col("a").alias("b"), "label"), "b", hubs).groupBy("a").agg(F.min("label").alias("near"))
        moved = cut(labels.join(near, "a"), "moved")
        far = looked_up(moved, labels.select(F.col("a").alias("label"), F.col("label").alias("far")), "label")
        step = cut(far.select("a", F.least("label", "near", "far").alias("new"), "label", "n_links"), "labels")
        labels = step.select("a", F.col("new").alias("label"), "n_links")
        if step.where("new <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"groups are still growing after {rounds} rounds")
    every = found.members.select("rep").distinct().join(labels.withColumnRenamed("a", "rep"), "rep", "left")
    m = looked_up(found.members, every, "rep")
    return m.select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
