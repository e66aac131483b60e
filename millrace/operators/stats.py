"""Counts, characters per token and lengths of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.pack import stride


def counts(df: DataFrame, *by: str) -> DataFrame:
    """`n` rows for each combination of `by`, null being a value; one row without `by`."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def chars_token_ratio(df: DataFrame, content: str = "content", tokens: Column | str = "tokens") -> DataFrame:
    """One row: n_chars, n_tokens and ratio, the ratio of sums; NaN without rows, and 0 tokens count as 1. A null text has neither."""
    size = F.coalesce(F.size(F.col(tokens) if isinstance(tokens, str) else tokens), F.lit(0))
    return ratio_of_counts(df.select(F.length(content).alias("c"), F.greatest(size, F.lit(0)).alias("t")), "c", "t")


def ratio_of_counts(df: DataFrame, chars: str, tokens: str) -> DataFrame:
    """The same from counts of characters and tokens; null counts as 0."""
    sums = df.select(F.coalesce(chars, F.lit(0)).cast("bigint").alias("c"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("t")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens")
    )
    ratio = F.col("n_chars").cast("double") / F.greatest(F.col("n_tokens"), F.lit(1))
    return sums.select("n_chars", "n_tokens", F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(ratio).alias("ratio"))


def estimated_length(df: DataFrame, seq_length: int, overlap: float = 0.0, tokens: str = "tokens") -> DataFrame:
    """One row: the estimate of the number of windows, max(1, ceil(tokens / stride)), without end tokens and buffer ends."""
    s = stride(seq_length, overlap)
    total = F.coalesce(F.sum(F.greatest(F.size(tokens), F.lit(0))), F.lit(0)).cast("bigint")
    return df.agg(F.greatest(F.lit(1).cast("bigint"), F.expr("1L") * F.call_function("div", total + (s - 1), F.lit(s).cast("bigint"))).alias("estimated"))


def actual_length(placed: DataFrame, seq_length: int, overlap: float = 0.0, buf: str = "buf") -> DataFrame:
    """One row: the number of windows that `windows` makes of rows of `offsets`."""
    s = stride(seq_length, overlap)
    each = placed.groupBy(buf).agg(F.sum("n").alias("total"))
    return each.agg(F.coalesce(F.sum(F.call_function("div", F.col("total") + (s - 1), F.lit(s).cast("bigint"))), F.lit(0)).cast("bigint").alias("actual"))


def report(df: DataFrame, chars: str, tokens: str, seq_length: int, overlap: float = 0.0) -> DataFrame:
    """Rows (name, value): rows, characters, tokens, chars_per_token and estimated_windows of rows with counts of characters and tokens."""
    s = stride(seq_length, overlap)
    count = lambda c: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0)).cast("double")
    one = df.agg(F.count("*").cast("double").alias("n"), count(chars).alias("c"), count(tokens).alias("t"))
    ratio = F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("c") / F.greatest(F.col("t"), F.lit(1.0)))
    named = {"rows": F.col("n"), "characters": F.col("c"), "tokens": F.col("t"), "chars_per_token": ratio, "estimated_windows": F.greatest(F.lit(1.0), F.ceil(F.col("t") / s).cast("double"))}
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in named.items()])).alias("x")).select("x.name", "x.value")
