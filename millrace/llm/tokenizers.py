"""Token counts under public tokenizers whose vocabulary files lie on every executor."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.shared import ship

#: Default vocabulary; any file of the three kinds that `counter` reads may be given instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of the rank files.
RANK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a `.tiktoken`, `.json` or `.model` file; loaded once a worker.

    Text that looks like a special token is counted as ordinary text, and no special token is added.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [len(encode(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    raise ValueError(f"{path}: neither .tiktoken nor .json nor .model")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """(id, n_tokens) and the columns `keep` of each row (id, text); a null text has 0 tokens."""
    keep = keep or []
    ship(documents.sparkSession)

    def batches(it):
        count = counter(vocabulary)
        for b in it:
            n = count([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *keep)), pa.array(np.array(n, np.int64))], ["id", *keep, "n_tokens"])

    kept = documents.select("id", *keep, "text")
    return kept.mapInArrow(batches, T.StructType([*kept.drop("text").schema.fields, T.StructField("n_tokens", T.LongType())]))
