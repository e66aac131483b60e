"""Bitmaps over hashes, sized by their number up to a bound: a scan drops most rows that no later join would keep."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as S

#: Bits for each hash, so that one other in 16 passes; least and most bits of a bitmap (as powers of two), the most being 32 MB.
BITS_EACH, LEAST_LOG2, MOST_LOG2 = 16, 20, 28
_BLOCK_LOG2 = 20


def bitmap(hashes: DataFrame, most_log2: int = MOST_LOG2) -> Broadcast | None:
    """The bitmap over the one 64-bit column of `hashes`, by their first bits; made in blocks by the executors, then put together and
    broadcast. None where so many hashes would pass more than one other in four: then rows must be joined by partitions."""
    context = hashes.sparkSession.sparkContext
    n = hashes.count()
    log2 = max(LEAST_LOG2, (BITS_EACH * max(n, 1) - 1).bit_length())
    if log2 > most_log2:
        if 4 * n > 1 << most_log2:
            return None
        log2 = most_log2

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _BLOCK_LOG2, np.uint8)
        bits[pdf["place"].to_numpy() & ((1 << _BLOCK_LOG2) - 1)] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    place = F.shiftrightunsigned(hashes.columns[0], 64 - log2)
    places = hashes.select(place.alias("place")).distinct().withColumn("block", F.shiftright("place", _BLOCK_LOG2))
    out = bytearray(1 << (log2 - 3))
    step = 1 << (_BLOCK_LOG2 - 3)
    for r in places.groupBy("block").applyInPandas(block, "block bigint, bits binary").toLocalIterator():
        out[r["block"] * step : (r["block"] + 1) * step] = r["bits"]
    return context.broadcast(bytes(out))


def within(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    mask = np.frombuffer(bits, np.uint8)
    place = hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (mask[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0


def id_hashes(ids: np.ndarray) -> np.ndarray:
    return S.mixed(ids.astype(np.int64).view(np.uint64))


def hashed_ids(ids: DataFrame) -> DataFrame:
    """One column `hash` for the one column of ids (not null)."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(id_hashes(b.column(0).to_numpy()).view(np.int64))], ["hash"])

    return ids.mapInArrow(batches, "hash bigint")
