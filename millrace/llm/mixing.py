"""Mixing sources to target shares of the tokens.

Entropy balancing: among all document rates between 0 and the source's cap that give each source its tokens, those nearest to the
base rate in entropy are exponentially tilted by the document's tokens, rate = cap / (1 + exp(-(base + tilt * tokens / mean))). The tilts
solve the convex dual, one for each source, by Newton steps kept inside a shrinking bracket. As a rate depends only on source, tokens and tilt, each step is one
aggregation over the counts of documents by source and tokens, with one row for each source coming back.

Rates are rounded to whole copies by a hashed draw for each document, and the rest that rounding leaves in a source is
removed by moving the copies of documents whose draw is nearest to the rounding point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.shared import bounded, cut, lookup


#: Most sources of a mix, one row of each of which is held by the driver; more raise ValueError.
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class Mixing:
    """steps: Newton steps after which a source that is not met raises RuntimeError. close: relative error of a source's tokens
    at which its steps end. bins: fineness of the correction after rounding. seed: of the draws."""

    steps: int = 200
    close: float = 1e-7
    bins: int = 1024
    seed: int = 17


def wanted_tokens(total: float, shares: dict[str, float], reachable: dict[str, float]) -> dict[str, float]:
    """Tokens of each source in a mix of `total` tokens: in proportion to the shares, at most what is reachable; what a source
    can't reach goes to the others in proportion to their shares, as far as they reach."""
    out = {s: 0.0 for s in shares}
    free, left = {s for s, w in shares.items() if w > 0 and reachable.get(s, 0) > 0}, total
    while free and left > 0:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if reachable[s] <= left * shares[s] / weight}
        if not full:
            for s in free:
                out[s] = left * shares[s] / weight
            break
        for s in full:
            out[s] = reachable[s]
            left -= reachable[s]
        free -= full
    return out


def _base(cap: int) -> float:
    """The base at which the rate without tilt is 1 copy; half a copy where a document may be used only once."""
    return -math.log(cap - 1) if cap > 1 else 0.0


def _rate(tokens: Column) -> Column:
    """The rate of a document, as a share of its source's cap, from the columns base, tilt and mean of its source."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("base") + F.col("tilt") * tokens / F.col("mean")))))


def tilts(counts: DataFrame, wanted: dict[str, float], caps: dict[str, int], means: dict[str, float], reachable: dict[str, float], how: Mixing) -> dict[str, float]:
    """The tilt of each source, by distributed Newton steps over `counts` (source, n_tokens, n); infinite where the source is used up.
    Raises RuntimeError if a source isn't met after the most steps."""
    out = {s: (math.inf if w >= reachable[s] * (1 - 1e-12) else 0.0) for s, w in wanted.items() if w > 0}
    todo = {s for s, t in out.items() if t == 0.0}
    low, high = dict.fromkeys(todo, -math.inf), dict.fromkeys(todo, math.inf)
    weight, x = F.col("n") * F.col("n_tokens") * F.col("cap"), F.col("n_tokens") / F.col("mean")
    for _ in range(how.steps):
        if not todo:
            return out
        state = lookup(counts.sparkSession, [(s, float(caps[s]), _base(caps[s]), means[s], out[s]) for s in sorted(todo)], "source string, cap double, base double, mean double, tilt double")
        rated = counts.join(state, "source").withColumn("p", _rate(F.col("n_tokens")))
        rows = rated.groupBy("source").agg(F.sum(weight * F.col("p")).alias("got"), F.sum(weight * F.col("p") * (1 - F.col("p")) * x).alias("slope")).collect()
        for r in rows:
            s, off = r["source"], r["got"] - wanted[r["source"]]
            if abs(off) <= how.close * wanted[s]:
                todo.discard(s)
                continue
            (high if off > 0 else low)[s] = out[s]
            step = out[s] - off / r["slope"] if r["slope"] > 0 else math.nan
            if not low[s] < step < high[s]:
                a, b = low[s], high[s]
                step = (a + b) / 2 if math.isfinite(a + b) else (2 * a + 1 if math.isfinite(a) else 2 * b - 1)
            if step == out[s]:
                todo.discard(s)  # the bracket is as narrow as numbers get
            out[s] = step
    if todo:
        raise RuntimeError(f"{len(todo)} sources are not met after {how.steps} steps")
    return out


def mixed(documents: DataFrame, targets: DataFrame, how: Mixing = Mixing()) -> tuple[DataFrame, DataFrame]:
    """The mix and the report of a table of documents (id, source, n_tokens) to `targets` (source, target_share, max_repeats).

    The mix has a row for each document used, id, source, n_tokens, copies (1 to the source's max_repeats), and in total as many
    tokens as all of `documents`, as far as caps allow; a source that can't reach its share leaves the rest to the others in
    proportion. The report has one row for each target: target_share, n_documents, source_tokens, mix_tokens, mix_share, copies_mean.
    Documents whose source is null or has no target aren't used; null shares count as 0 and null repeats as 1. Targets are one row a
    source, else ValueError; the driver holds one row for each source, and no other.
    """
    spark = documents.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    shares = {r["source"]: float(r["target_share"] or 0) for r in rows if r["source"] is not None}
    caps = {r["source"]: max(int(1 if r["max_repeats"] is None else r["max_repeats"]), 0) for r in rows if r["source"] is not None}
    if len(shares) < len(rows):
        raise ValueError("targets must have one row for each source, and no null source")
    kept = documents.select("id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    total = kept.agg(F.sum("n_tokens")).first()[0] or 0
    named = lookup(spark, [(s,) for s in shares], "source string")
    counts = cut(kept.join(named, "source").groupBy("source", "n_tokens").agg(F.count("*").alias("n")), "counts")
    sums = {r["source"]: (r["tokens"], r["n"]) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("n")).collect()}
    reachable = {s: float(caps[s] * t) for s, (t, _) in sums.items()}
    wanted = wanted_tokens(float(total), shares, reachable)
    means = {s: max(t / n, 1e-9) for s, (t, n) in sums.items()}
    tilt = tilts(counts, wanted, caps, means, reachable, how)

    kind = "source string, cap double, base double, mean double, tilt double, used_up boolean, wanted double"
    state = [(s, float(caps[s]), _base(caps[s]), means[s], max(min(tilt[s], 1e9), -1e9), math.isinf(tilt[s]), w) for s, w in wanted.items() if w > 0]
    draw = F.pmod(F.xxhash64(F.lit(how.seed), "id"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.when(F.col("used_up"), F.col("cap")).otherwise(F.col("cap") * _rate(F.col("n_tokens")))
    rated = kept.join(lookup(spark, state, kind), "source").withColumn("up", rate + draw)
    rated = rated.withColumn("copies", F.least("cap", F.floor("up"))).withColumn("rest", F.col("up") - F.floor("up"))
    binned = rated.withColumn("bin", F.least(F.floor(F.col("rest") * how.bins), F.lit(how.bins - 1)))
    edges = bounded(_edges(binned), "edges")
    more, less = F.col("bin") >= F.col("up_from"), F.col("bin") <= F.col("down_to")
    moved = F.when(more, F.least("cap", F.col("copies") + 1)).when(less, F.greatest(F.lit(0), F.col("copies") - 1)).otherwise(F.col("copies"))
    mix = cut(binned.join(edges, "source").select("id", "source", "n_tokens", moved.cast("bigint").alias("copies")).where("copies > 0"), "mix")
    made = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("n_copies"))
    sizes = counts.groupBy("source").agg(F.sum("n").alias("n_documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("source_tokens"))
    whole = made.agg(F.sum("mix_tokens").alias("whole"))
    zero = F.lit(0).cast("bigint")
    report = (
        targets.select("source", "target_share", "max_repeats")
        .join(sizes, "source", "left")
        .join(made, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "max_repeats", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("source_tokens", zero).alias("source_tokens"), F.coalesce("mix_tokens", zero).alias("mix_tokens"),
            F.coalesce(F.col("mix_tokens") / F.col("whole"), F.lit(0.0)).alias("mix_share"), F.coalesce(F.col("n_copies") / F.col("n_documents"), F.lit(0.0)).alias("copies_mean"),
        )
    )
    return mix, report


def _edges(binned: DataFrame) -> DataFrame:
    """For each source the bins of `rest` that are moved so that its tokens come nearest to what is wanted: `up_from` on, one copy more, or
    up to `down_to`, one copy less. A source has at most as many rows here as there are bins."""
    per = binned.groupBy("source", "bin").agg(
        F.first("wanted").alias("wanted"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("got"),
        F.sum(F.when(F.col("copies") < F.col("cap"), F.col("n_tokens")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("copies") > 0, F.col("n_tokens")).otherwise(0)).alias("less"),
    )
    every = Window.partitionBy("source")
    off = F.col("wanted") - F.sum("got").over(every)
    rows = per.withColumn("off", off).withColumn("n", F.when(F.col("off") > 0, F.col("more")).otherwise(F.col("less"))).withColumn("turn", F.when(F.col("off") > 0, -F.col("bin")).otherwise(F.col("bin")))
    before = every.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.withColumn("middle", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") / 2)
    upto = reached.withColumn("middle", F.max("middle").over(every.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    moves = F.col("middle") <= F.abs("off")
    return upto.groupBy("source").agg(F.min(F.when(moves & (F.col("off") > 0), F.col("bin"))).alias("up_from"), F.max(F.when(moves & (F.col("off") <= 0), F.col("bin"))).alias("down_to"))
