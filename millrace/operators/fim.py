"""Fill-in-the-middle permutation of token arrays, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.draws import uniform
from millrace.functions.tokens import SpecialTokens


def permuted(tokens: Column, low: Column, high: Column, spm: Column, special: SpecialTokens, truncate: bool = False) -> Column:
    """`tokens` cut at low <= high into prefix, middle and suffix, and put together again around sentinels.

    Without `spm`: P prefix S suffix M middle; with it: P S suffix M prefix middle. If `truncate`, the suffix loses three tokens
    so that the length stays, and a suffix of up to three tokens leaves the sample as it is. Parts may be empty.
    """
    n = F.size(tokens)
    prefix, middle = F.slice(tokens, 1, low), F.slice(tokens, low + 1, high - low)
    size = n - high
    suffix = F.slice(tokens, high + 1, F.greatest(size - 3, F.lit(0)) if truncate else size)
    p, s, m = (F.array(F.lit(x).cast("bigint")) for x in (special.prefix, special.suffix, special.middle))
    out = F.when(spm, F.concat(p, s, suffix, m, prefix, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    return F.when(size <= 3, tokens).otherwise(out) if truncate else out


def permute(tokens: Column, key: str | Column, special: SpecialTokens, rate: float = 0.5, spm_rate: float = 0.5, seed: int = 0, truncate: bool = False) -> Column:
    """Each document permuted with chance `rate`, of those `spm_rate` with the suffix first.

    The draws depend on seed and key, not on an epoch. With rate 0, or without sentinels, tokens stay as they are. Null tokens stay null.
    """
    if rate <= 0 or not special.can_permute:
        return tokens
    room = (F.size(tokens) + 1).cast("double")
    one, two = (F.floor(uniform(seed, b, key) * room).cast("int") for b in ("b0", "b1"))
    out = permuted(tokens, F.least(one, two), F.greatest(one, two), uniform(seed, "spm", key) < spm_rate, special, truncate)
    return F.when(tokens.isNotNull() & (uniform(seed, "apply", key) < rate), out).otherwise(tokens)
