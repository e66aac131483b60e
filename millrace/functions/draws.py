"""Counter-based random draws: a hash of seed, purpose and id, the same under every partitioning and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOM = float(1 << 52)


def uniform(seed: int | Column, purpose: str, *ids: str | Column) -> Column:
    """A double in [0, 1) from the first 52 bits of md5('seed:purpose:id...'); a null id is left out of the key."""
    parts = [F.lit(seed) if isinstance(seed, int) else seed, F.lit(purpose), *(F.col(x) if isinstance(x, str) else x for x in ids)]
    digits = F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_ROOM)


def uniform_sql(seed: str | int, purpose: str, *ids: str) -> str:
    """The same draw as text for an SQL engine with md5 and hexadecimal casts."""
    return f"(('0x' || substr(md5(concat_ws(':', {seed}, '{purpose}', {', '.join(ids)})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"
