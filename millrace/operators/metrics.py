"""Evaluation metrics of training runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.sources.jsonl import with_ordinals


def perplexity(loss: str | Column) -> Column:
    """exp(loss) below 20, else infinite, also for NaN; null for null."""
    c = F.col(loss) if isinstance(loss, str) else loss
    return F.when(c.isNull(), None).when(c < 20, F.exp(c)).otherwise(F.lit(float("inf")))


def final_perplexity(loss: str | Column) -> Column:
    """exp(loss) without a guard, to two decimals."""
    return F.round(F.exp(loss), 2)


def with_perplexity(metrics: DataFrame, loss: str = "eval_loss") -> DataFrame:
    """Rows that have a loss, with `perplexity`."""
    return metrics.where(F.col(loss).isNotNull()).withColumn("perplexity", perplexity(loss))


def best_checkpoints(metrics: DataFrame, run: str = "run_id", step: str = "global_step", loss: str = "eval_loss", keep: int = 2) -> DataFrame:
    """The `keep` steps of least loss of each run with `place` from 1; NaN counts as greater than all, ties go to the earlier step.
    Steps logged twice count once, by their least loss."""
    once = metrics.where(F.col(loss).isNotNull()).groupBy(run, step).agg(F.min(loss).alias(loss))
    order = Window.partitionBy(run).orderBy(loss, step)
    return once.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= keep)


def _carried(df: DataFrame, aggregate: Callable[[Column], Column], value: Column, by: str, name: str, whole: Callable[..., Column], inclusive: bool) -> DataFrame:
    """`df` with `name`, the running aggregate of `value` over the rows of each `by` before each row (and it, if `inclusive`), in the order of
    `ord`. Parts are windowed apart, and what the parts of the same `by` before them give is carried in, so that no task takes a long run whole."""
    inner = Window.partitionBy("part", by).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part", by).agg(aggregate(value).alias("_part")).withColumn("_carry", aggregate(F.col("_part")).over(before))
    return df.withColumn("_own", aggregate(value).over(inner)).join(parts.select("part", by, "_carry"), ["part", by]).withColumn(name, whole("_own", "_carry")).drop("_own", "_carry")


def early_stops(metrics: DataFrame, run: str = "run_id", step: str = "global_step", loss: str = "eval_loss", patience: int = 2, threshold: float = 0.0) -> DataFrame:
    """One row for each run: best_step, best_loss and stop_step, the first step at which `patience` evaluations in a row
    did not go below the best before them by more than `threshold` (null if none). Null losses are no evaluations, NaN never is better;
    a row without a run is of none. Evaluations are ordered once; a run of any length spreads over as many tasks as its rows do."""
    logged = metrics.where(F.col(loss).isNotNull() & F.col(run).isNotNull())
    once = logged.groupBy(F.col(run).alias("_run"), F.col(step).alias("_step")).agg(F.min(loss).alias("loss"))
    rows = with_ordinals(once, ["_run", "_step"])
    number = F.when(F.isnan("loss"), None).otherwise(F.col("loss"))
    seen = _carried(rows, F.min, number, "_run", "before", F.least, False)
    better = F.coalesce(~F.isnan("loss") & (F.col("before").isNull() | (F.col("loss") < F.col("before") - threshold)), F.lit(False))
    last = _carried(seen, F.max, F.when(better, F.col("ord")), "_run", "last", F.greatest, True)
    first = rows.groupBy("_run").agg(F.min("ord").alias("_first"))
    stale = last.join(first, "_run").withColumn("stale", F.col("ord") - F.coalesce("last", F.col("_first") - 1))
    return stale.groupBy(F.col("_run").alias(run)).agg(
        F.min(F.when(~F.isnan("loss"), F.struct("loss", "_step")))["_step"].alias("best_step"),
        F.min(F.when(~F.isnan("loss"), F.col("loss"))).alias("best_loss"),
        F.min(F.when(F.col("stale") >= patience, F.col("_step"))).alias("stop_step"),
    )


def metric_rows(metrics: DataFrame, step: str = "global_step", epoch: str = "train_epoch", loss: str = "eval_loss") -> DataFrame:
    """The logged form: `train/global_step`, `train/epoch`, `eval/loss`, `eval/perplexity`, for rows that have a loss."""
    return with_perplexity(metrics, loss).select(
        F.col(step).alias("train/global_step"), F.col(epoch).alias("train/epoch"), F.col(loss).alias("eval/loss"), F.col("perplexity").alias("eval/perplexity")
    )
