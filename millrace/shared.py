"""Lineage cuts and bounded broadcasts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest side, in bytes of rows, that this library itself ever hints for a broadcast.
BROADCAST_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once a context, where they wouldn't find it by themselves."""
    context, home = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_has_millrace", False):
        return
    near = context.master.startswith("local") and str(home.parent) in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if not near:
        archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        context.addPyFile(str(archive))
    context._has_millrace = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a fresh local one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which `release` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_millrace_tables", []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and return the written table.

    A later loss of executors recomputes nothing above the cut, and branches that share the
    table don't repeat the work. Parquet keeps it small and lets each branch read only its columns.
    """
    spark = df.sparkSession
    ship(spark)
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what `cut` and others have written to places of `fresh` in this context, when no result made from them is needed any more; their number."""
    jvm, paths = spark.sparkContext._jvm, spark.sparkContext.__dict__.pop("_millrace_tables", [])
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def small(written: DataFrame, *arrays: str) -> DataFrame:
    """A written table with a hint to broadcast it, where its rows, at 200 bytes and 8 for each item of `arrays`, are under the bound;
    else as it is, for Spark to join by partitions."""
    size = F.count("*") * 200
    for a in arrays:
        size = size + F.coalesce(F.sum(F.size(a)), F.lit(0)) * 8
    return F.broadcast(written) if written.agg(size.alias("bytes")).first()["bytes"] <= BROADCAST_BYTES else written


def local(spark: SparkSession, rows: list[tuple], kind: str | T.StructType) -> DataFrame:
    """A table of rows that the driver holds, part of the plan itself: reading it takes no job."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
    names = fields.fieldNames()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], to_arrow_schema(fields)), fields)


def lookup(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A table of rows that the driver holds, hinted for a broadcast under the same bound; else Spark joins by partitions."""
    df = local(spark, rows, kind)
    return F.broadcast(df) if len(rows) * 200 <= BROADCAST_BYTES else df


def bounded(df: DataFrame, name: str) -> DataFrame:
    """A table of short rows, brought to the driver and hinted for a broadcast if it is under the bound at 200 bytes a row; else
    written, for Spark to join by partitions."""
    most = BROADCAST_BYTES // 200
    rows = df.limit(most + 1).collect()
    return F.broadcast(local(df.sparkSession, rows, df.schema)) if len(rows) <= most else cut(df, name)


#: Rows of one key from which a lookup takes the key apart; least, and as a share of all rows.
HOT_ROWS, HOT_SHARE = 10_000, 1e-4


def hot_keys(left: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame | None:
    """The values of `key` with more than `hot_rows` rows (or HOT_ROWS and HOT_SHARE of all), of which there are few; None for none."""
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    if hot_rows is None:
        hot_rows = HOT_ROWS
        counts = counts.where(F.col("_n") > HOT_ROWS)
    hot = counts.where(F.col("_n") > hot_rows)
    most = BROADCAST_BYTES // 200
    rows = hot.select(key, "_n").limit(most + 1).collect()
    if len(rows) > most:  # more than so many values of so many rows: take those with a share of all
        least = max(hot_rows, int(left.count() * HOT_SHARE))
        rows = hot.where(F.col("_n") > least).collect()
    return local(left.sparkSession, [(r[key],) for r in rows], left.select(key).schema) if rows else None


def looked_up(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | int | None = None) -> DataFrame:
    """`left` joined with `right` on `key`, of which `right` has one row for each value, where any value may hold a large part of `left`.

    The values with many rows, `hot` if `hot_keys` has already told them or by that bound, are few: their rows of `right` are broadcast, so
    that no task gathers them; the others are joined by partitions. `left` should be a written table: it is read more than once.
    """
    if not isinstance(hot, DataFrame):
        hot = hot_keys(left, key, hot)
    if hot is None:
        return left.join(right, key)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return left.join(few, key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
