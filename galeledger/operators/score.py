"""Error measures of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import ratio_unless_zero


def error_metrics(df: DataFrame, keys: Sequence[str], truth: str, pred: str, volume: str | None = None, volume_truth: str | None = None) -> DataFrame:
    """RMSE and MAE per key, and the volume error sum(pred * volume - volume_truth)."""
    e = F.col(truth) - F.col(pred)
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]
    if volume:
        aggs.append(F.sum(F.col(pred) * F.col(volume) - F.col(volume_truth)).alias("volume_error"))
    return df.groupBy(*keys).agg(*aggs)


def row_errors(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    error = F.col(estimate) - F.col(truth)
    share = ratio_unless_zero(error, truth)
    return df.na.drop(subset=[truth, estimate]).withColumns(
        {"error": error, "abs_error": F.abs(error), "pct_error": share, "abs_pct_error": F.abs(share)}
    )


def comparison_metrics(df: DataFrame, keys: Sequence[str], truth: str, estimate: str) -> DataFrame:
    """Bias, MAE, RMSE, MAPE, correlation and R2 of two series of the same quantity."""
    rows = row_errors(df, truth, estimate)
    residual = F.sum(F.col("error") * F.col("error"))
    spread = F.count(F.lit(1)) * F.var_pop(truth)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("error").alias("bias"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        (F.avg("abs_pct_error") * 100.0).alias("mape"),
        F.when(F.count(F.lit(1)) > 1, F.corr(truth, estimate)).alias("r"),
        F.when(spread != 0, 1.0 - residual / spread).alias("r2"),
    )
