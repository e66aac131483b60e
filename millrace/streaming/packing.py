"""Packing of a stream of documents, a micro-batch at a time.

Windows never cross buffers, so a micro-batch is a run of buffers of its own and no state is carried over. Batches are limited by files
or bytes at the source. A batch is written under its number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.pipelines import Packer, examples
from millrace.sources.jsonl import with_ordinals


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "json", max_files: int = 1) -> DataFrame:
    """A stream of the files of a folder, at most `max_files` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(format).load(path)


def pack_stream(documents: DataFrame, out: str, checkpoint: str, how: Packer, order: list[str], key: str = "id") -> StreamingQuery:
    """Starts a query that packs each micro-batch of (key, content) in `order` and writes its examples as Parquet under out/batch=N."""

    def pack(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            examples(with_ordinals(batch, order), how, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(pack).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
