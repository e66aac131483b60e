"""JSON-lines and table sources, and the JSON-lines sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.shared import cut, lookup

#: The columns of a corpus; a wider schema keeps more.
CORPUS = T.StructType([T.StructField("content", T.StringType()), T.StructField("set", T.StringType()), T.StructField("filetype", T.StringType())])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = CORPUS, strict: bool = True) -> DataFrame:
    """Rows of JSON-lines files; blank lines are skipped and only LF ends a line. A malformed line raises if `strict`,
    else its fields are null. `schema` None infers it, at the cost of a pass over the data."""
    reader = spark.read.option("lineSep", "\n").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """One object a line, null fields kept, other scripts unescaped; in `files` files if given (1 funnels all rows through one task)."""
    (df.coalesce(files) if files else df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """`df`, or ValueError if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_ordinals(df: DataFrame, keys: list[str | Column], name: str = "ord", also: Callable[[DataFrame], DataFrame] | None = None, placed: tuple[Column, int] | None = None) -> DataFrame:
    """`df` with the place of each row, from 0, in the order of `keys` (nulls first); rows equal in all keys come in any order.

    Range-partitioned and written once; only one count for each partition reaches the driver. Also adds `part`, the partition.
    Columns of these two names are replaced. Ranges are found from a sample, for which the source is read a first time; with `placed`, a
    number of the partition under the given count that rises with the keys, they are known and the source is read once.
    `also` turns the sorted rows into those to write, in the same pass; it must keep their number, their order and the column `_at`.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*keys) if placed is None else df.repartitionById(placed[1], placed[0].cast("int"))
    rows = ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed_rows = cut(also(rows) if also else rows, "ordered")
    part = F.shiftright("_at", 33)
    counts = sorted((r["_part"], r["count"]) for r in placed_rows.groupBy(part.alias("_part")).count().collect())
    start, firsts = 0, []
    for p, n in counts:
        firsts.append((p, start))
        start += n
    starts = lookup(spark, firsts, "_part bigint, _start bigint")  # one row for each partition
    numbered = placed_rows.drop(name, "part").withColumn("_part", part).join(starts, "_part")
    out = numbered.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).withColumnRenamed("_part", "part").drop("_start")
    keep = [c for c in placed_rows.columns if c not in (name, "part") and (c != "_at" or also)]
    return out.select(*keep, "part", name)


def replayed(df: DataFrame, epochs: int, order: str = "ord", replicas: int = 1, parts: int = 0) -> DataFrame:
    """`df` once for each epoch, `epoch` from 0, with `order` running on through the epochs, and so the column `part` if it counts
    `parts` partitions; `replicas` repeats each row as workers that don't share the data would (column `replica`). An empty table with more
    than one epoch raises ValueError."""
    if epochs < 1 or replicas < 1:
        raise ValueError("epochs and replicas must be at least 1")
    n = df.agg(F.max(order).alias("m")).first()["m"]
    if n is None:
        if epochs > 1:
            raise ValueError("an empty source cannot be replayed")
        n = -1
    again = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(order, F.col("epoch") * F.lit(n + 1) + F.col(order))
    again = again.withColumn("part", F.col("epoch") * F.lit(parts) + F.col("part")) if parts else again
    return again.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))) if replicas > 1 else again
