"""Filters and exact-size stratified splits, without a shuffle of whole rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.draws import uniform
from millrace.shared import bounded
from millrace.sources.jsonl import require_columns, with_ordinals

#: File types of the unsupervised path, in the order of its parts.
FILETYPES = ("cry", "saw", "txt")


def of_set(df: DataFrame, name: str, column: str = "set", strict: bool = False) -> DataFrame:
    """Rows of one set; null is in none. If `strict`, a missing column raises ValueError, else it makes no row."""
    if column not in df.columns and not strict:
        return df.where(F.lit(False))
    return require_columns(df, [column]).where(F.col(column) == name)


def of_filetypes(df: DataFrame, types: tuple[str, ...] = FILETYPES, column: str = "filetype") -> DataFrame:
    """Rows of the given types, spelled exactly so; null is in none."""
    return require_columns(df, [column]).where(F.col(column).isin(*types))


def _cut_by_draw(df: DataFrame, group: str, id_column: str, seed: int, purpose: str, first: Column) -> tuple[DataFrame, DataFrame]:
    """`df` with `split_draw` and `_first`, whether a row is among the first k of its group by draw; and the groups (_group, _n, _k).

    `first` is k as an expression of `_n`, the size of the group. Only draws are shuffled, never whole rows: the k-th draw of each
    group is found from counts of 4096 even slices and then from the one slice that holds it, so a group of a third of all
    rows costs no task more than others. Rows with equal draws (repeated ids) are told apart by the order of all their columns' hash.
    """
    drawn = df.withColumn("split_draw", uniform(seed, purpose, id_column))
    slice_of = F.floor(F.col("split_draw") * 4096)
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = drawn.groupBy(F.col(group).alias("_group"), slice_of.alias("_slice")).agg(F.count("*").alias("_c"))
    sized = slices.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy("_group")))
    upto = sized.withColumn("_k", F.least(F.col("_n"), first.cast("bigint")))
    edge = bounded(upto.where("_start < _k AND _k <= _start + _c OR _k < 1 AND _start = 0").select("_group", "_slice", "_start", "_n", "_k"), "edge")
    same = F.col(group).eqNullSafe(F.col("_group"))
    within = drawn.select(group, "split_draw").withColumn("_place", slice_of).join(edge, same & (F.col("_place") == F.col("_slice")))
    each = within.groupBy("_group", "split_draw", "_start", "_k").agg(F.count("*").alias("_tied"))
    under = F.col("_start") + F.coalesce(F.sum("_tied").over(Window.partitionBy("_group").orderBy("split_draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = each.withColumn("_under", under).where("_under < _k AND _k <= _under + _tied")
    last = bounded(last.select("_group", F.col("split_draw").alias("_last"), (F.col("_k") - F.col("_under")).alias("_take"), "_tied"), "last")
    halves = not last.where("_take < _tied").isEmpty()
    groups = edge.select("_group", "_n", "_k")
    joined = drawn.join(last, same, "left").withColumn("_first", F.coalesce(F.col("split_draw") <= F.col("_last"), F.lit(False)))
    done = joined
    if halves:  # a few rows with the very draw at which a group is cut
        on_edge = F.coalesce((F.col("split_draw") == F.col("_last")) & (F.col("_take") < F.col("_tied")), F.lit(False))
        rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.to_json(F.struct(*df.columns)))))
        done = joined.where(~on_edge).unionByName(joined.where(on_edge).withColumn("_first", rank <= F.col("_take")))
    return done.drop("_group", "_last", "_take", "_tied"), groups


def _split(df: DataFrame, id_column: str, seed: int, test_size: float, filetypes: tuple[str, ...], set_name: str | None, set_column: str) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The rows as `split_by_filetype` gives them, and of each type the number of rows and of test rows."""
    rows = of_filetypes(df if set_name is None else of_set(df, set_name, set_column), filetypes)
    out, groups = _cut_by_draw(rows, "filetype", id_column, seed, "split", F.ceil(F.lit(float(test_size)) * F.col("_n")))
    sizes = {r["_group"]: (r["_n"], r["_k"]) for r in groups.collect()}  # one row for each type asked for
    if not sizes:
        raise ValueError("no rows of the set and file types")
    if any(k >= n for n, k in sizes.values()):
        raise ValueError("a file type has no rows left for training")
    places = F.create_map(*[x for t in dict.fromkeys(filetypes) for x in (F.lit(t), F.array(*[F.lit(k) for k, u in enumerate(filetypes) if u == t]))])
    return out.withColumn("split", F.when(F.col("_first"), "test").otherwise("train")).withColumn("place", F.explode(places[F.col("filetype")])).drop("_first"), sizes


def split_by_filetype(df: DataFrame, id_column: str = "id", seed: int = 42, test_size: float = 0.10, filetypes: tuple[str, ...] = FILETYPES, set_name: str | None = "unsupervised", set_column: str = "set") -> DataFrame:
    """Rows of the set and types with `split` ("train" or "test"), `place` (of the type in `filetypes`) and `split_draw`.

    Each type gives ceil(test_size * n) test rows, drawn by seed and id; absent types are skipped. A type named twice has its rows twice.
    Train and test are each in the order of place, split_draw and id. A type of so few rows that it has none for training
    raises ValueError, and so does a result without rows.
    """
    return _split(df, id_column, seed, test_size, filetypes, set_name, set_column)[0]


def _shared_out(strata: list[tuple[int, float, float]], parts: int) -> list[tuple[int, int]]:
    """(first partition, number) of each stratum (rows, least draw, draw beyond the greatest), in proportion to the rows, at least one each."""
    rows = sum(n for n, _, _ in strata) or 1
    out, first = [], 0
    for n, _, _ in strata:
        k = max(1, round(parts * n / rows))
        out.append((first, k))
        first += k
    return out


def _part(draw: Column, low: float, high: float, first: int, number: int) -> Column:
    share = (draw - low) / max(high - low, 1e-12)
    return F.lit(first) + F.greatest(F.lit(0), F.least(F.lit(number - 1), F.floor(share * number).cast("int")))


def split_in_order(df: DataFrame, also: Callable[[DataFrame], DataFrame] | None = None, id_column: str = "id", seed: int = 42, test_size: float = 0.10, filetypes: tuple[str, ...] = FILETYPES, set_name: str | None = "unsupervised", set_column: str = "set") -> DataFrame:
    """`split_by_filetype` written once in the order of its two results, with `part` and `ord`, which counts from 0 in each split.

    As draws are even, the ranges of the partitions follow from the sizes of the types, and no sample is taken: the rows are read, shuffled and
    written once. `also` turns the sorted rows into those to write (see `with_ordinals`); it must keep `split`.
    """
    rows, sizes = _split(df, id_column, seed, test_size, filetypes, set_name, set_column)
    strata = [(s, k, *sizes[t]) for s in ("test", "train") for k, t in enumerate(filetypes) if t in sizes]
    bounds = [(c, 0.0, c / n) if s == "test" else (n - c, c / n, 1.0) for s, _, n, c in strata]
    shares = _shared_out(bounds, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.lit(0)
    for (s, k, _, _), (_, low, high), (first, count) in zip(strata, bounds, shares, strict=True):
        number = F.when((F.col("split") == s) & (F.col("place") == k), _part(F.col("split_draw"), low, high, first, count)).otherwise(number)
    out = with_ordinals(rows, ["split", "place", "split_draw", id_column], also=also or (lambda d: d), placed=(number, sum(c for _, c in shares))).drop("_at")
    n_test = sum(c for s, _, _, c in strata if s == "test")
    return out.withColumn("ord", F.when(F.col("split") == "train", F.col("ord") - n_test).otherwise(F.col("ord")))


def sft_split(df: DataFrame, id_column: str = "id", seed: int = 4371, train_size: float = 0.95, set_name: str | None = "supervised", set_column: str = "set") -> DataFrame:
    """Rows of the set with `split` ("train" or "val"): of each file type, null being one, the first max(1, floor(train_size * n)) by draw."""
    rows = df if set_name is None else of_set(df, set_name, set_column)
    out, _ = _cut_by_draw(rows, "filetype", id_column, seed, "sft", F.greatest(F.lit(1), F.floor(F.lit(float(train_size)) * F.col("_n"))))
    return out.withColumn("split", F.when(F.col("_first"), "train").otherwise("val")).drop("_first", "split_draw")


def shuffled(df: DataFrame, id_column: str = "id", seed: int = 4371, group: str | None = None) -> DataFrame:
    """`df` with `ord`, the place of each row in a random order, from 0; within each value of `group`, of which there are few, if given."""
    drawn = df.withColumn("_draw", uniform(seed, "shuffle", id_column))
    counts = [(r["g"], r["count"]) for r in drawn.groupBy((F.col(group) if group else F.lit(0)).alias("g")).count().collect()]
    counts.sort(key=lambda r: (r[0] is not None, r[0]))
    shares = _shared_out([(n, 0.0, 1.0) for _, n in counts], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number, start, starts = F.lit(0), 0, F.lit(0).cast("bigint")
    for (g, n), (first, count) in zip(counts, shares, strict=True):
        here = F.col(group).eqNullSafe(F.lit(g)) if group else F.lit(True)
        number = F.when(here, _part(F.col("_draw"), 0.0, 1.0, first, count)).otherwise(number)
        starts = F.when(here, F.lit(start).cast("bigint")).otherwise(starts)
        start += n
    keys = ["_draw", id_column]
    out = with_ordinals(drawn, [group, *keys] if group else keys, placed=(number, sum(c for _, c in shares) or 1)).drop("part", "_draw")
    return out.withColumn("ord", F.col("ord") - starts)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first `n` rows by `order`."""
    return df.orderBy(*order).limit(n)
