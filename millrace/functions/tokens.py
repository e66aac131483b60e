"""Tokenizers as expressions or plug-ins, and the registry of special tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the sentinels of fill-in-the-middle, in the order suffix, prefix, middle, pad.
SENTINELS = ("<|fim_suffix|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_pad|>")
#: Ids from here on are beyond every code point.
BEYOND_TEXT = 0x110000


@dataclass(frozen=True)
class SpecialTokens:
    """Ids of the special tokens; `pad` falls back to `eos`, and without suffix, prefix or middle nothing is permuted."""

    eos: int
    pad: int | None = None
    unk: int | None = None
    suffix: int | None = None
    prefix: int | None = None
    middle: int | None = None
    fim_pad: int | None = None

    @property
    def padding(self) -> int:
        return self.eos if self.pad is None else self.pad

    @property
    def can_permute(self) -> bool:
        return None not in (self.suffix, self.prefix, self.middle)

    def sentinels(self) -> tuple[int | None, ...]:
        """(suffix, prefix, middle, pad)."""
        return self.suffix, self.prefix, self.middle, self.fim_pad

    def completed(self, next_id: int) -> SpecialTokens:
        """With new ids from `next_id` on for sentinels that are missing or stand for the unknown token."""
        names, found = ("suffix", "prefix", "middle", "fim_pad"), {}
        for n in names:
            have = getattr(self, n)
            if have is None or have == self.unk:
                found[n], next_id = next_id, next_id + 1
        return replace(self, **found)


#: Special tokens for code point tokens.
BEYOND = SpecialTokens(*(BEYOND_TEXT + k for k in range(7)))


#: The roles of the registry.
ROLES = ("eos", "pad", "unk", "prefix", "middle", "suffix", "fim_pad")


def registry(table: DataFrame) -> SpecialTokens:
    """From rows (token_id, token_role). Rows of other roles are ignored, of a role's ids the least counts, so one row for each
    of the seven roles is collected. Roles without an id stay unset; the end role is required."""
    each = table.where(F.col("token_role").isin(*ROLES)).groupBy("token_role").agg(F.min("token_id").alias("token_id"))
    found = {r["token_role"]: r["token_id"] for r in each.collect()}
    if found.get("eos") is None:
        raise ValueError("no end-of-text token")
    return SpecialTokens(**{k: found.get(k) for k in ROLES})


def resolved(special: SpecialTokens, lookup: Callable[[str], int | None], next_id: int) -> SpecialTokens:
    """`special` with the sentinels that `lookup` (name to id) finds in a vocabulary under their names; those it has not, or has
    only as the unknown token, get new ids from `next_id` on, in the order of SENTINELS."""
    suffix, prefix, middle, pad = map(lookup, SENTINELS)
    return replace(special, suffix=suffix, prefix=prefix, middle=middle, fim_pad=pad).completed(next_id)


def file_special(path: str, eos: str, pad: str | None = None, unk: str | None = None) -> SpecialTokens:
    """The special tokens of a `tokenizers` JSON file: end, pad and unknown token by the names given, sentinels as `resolved`."""
    from tokenizers import Tokenizer as File

    file = File.from_file(path)
    end = file.token_to_id(eos)
    if end is None:
        raise ValueError(f"no token {eos}")
    given = SpecialTokens(end, pad and file.token_to_id(pad), unk and file.token_to_id(unk))
    return resolved(given, file.token_to_id, file.get_vocab_size())


def table_special(table: DataFrame) -> SpecialTokens:
    """As `resolved`, from rows (token_id, token_text, token_role): roles by `registry`, sentinels by their names in token_text."""
    given = registry(table)
    last = table.agg(F.max("token_id")).first()[0]
    named = {r["token_text"]: r["token_id"] for r in table.where(F.col("token_text").isin(*SENTINELS)).groupBy("token_text").agg(F.min("token_id").alias("token_id")).collect()}
    return resolved(given, named.get, last + 1)


Tokenizer = Callable[[Column], Column]


def codepoints(text: Column) -> Column:
    """The code points of a text; an empty or null text has none."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def words(vocabulary: int = 32768) -> Tokenizer:
    """Runs of ASCII letters, digits and `_`, and single other characters, hashed to ids under `vocabulary`; lossless but for the hash."""

    def tokens(text: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_])"), F.lit(1))
        return F.transform(found, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % vocabulary)

    return tokens


def enclosed(tokenizer: Tokenizer, begin: int | None = None, end: int | None = None) -> Tokenizer:
    """With begin and end tokens around every text, also an empty one."""
    edge = [F.array(*[F.lit(x).cast("bigint") for x in ([] if i is None else [i])]).cast("array<bigint>") for i in (begin, end)]
    return lambda text: F.concat(edge[0], tokenizer(text), edge[1])


def _lists(rows: list) -> pa.Array:
    """A column of lists of 64-bit numbers."""
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(r) for r in rows])))
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat, pa.int64()))


def vocabulary_file(path: str, add_special: bool = False, names_are_text: bool = False) -> Tokenizer:
    """A tokenizer plug-in for a `tokenizers` JSON file, in Arrow batches, loaded once a worker; needs the package `tokenizers`.

    `add_special`: with the tokens its post-processor adds. `names_are_text`: names of special tokens in a text are ordinary text.
    A null text has no token of its own.
    """

    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer as File

        file = File.from_file(path)
        file.encode_special_tokens = names_are_text
        for s in batches:
            yield _lists([e.ids for e in file.encode_batch([x or "" for x in s.to_pylist()], add_special_tokens=add_special)])

    tokens.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(tokens, "array<bigint>")
    return lambda text: made(text)


def vocabulary_text(path: str) -> Tokenizer:
    """The way back: texts of token arrays; ids that the file doesn't have give nothing, a null array stays null."""

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer as File

        file = File.from_file(path)
        size = file.get_vocab_size()
        for s in batches:
            yield pa.array([None if x is None else file.decode([i for i in x if i is not None and 0 <= i < size], skip_special_tokens=False) for x in s.to_pylist()], pa.string())

    texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    made = F.arrow_udf(texts, "string")
    return lambda tokens: made(tokens)
