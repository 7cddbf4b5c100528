"""Grouped measures of the market, cost and telemetry tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import hour_start, month_start
from ..functions.expr import as_col, guarded_ratio, total
from .timeline import FULL_AVAILABILITY_SHARE


def capture_factor(hourly: DataFrame, keys: Sequence[str], time: str, price: str, weight: str) -> DataFrame:
    """Monthly mean price, weight-averaged (capture) price, their ratio and the hours used.

    All measures come from one aggregate, so no monthly frames need aligning.
    """
    known = hourly.na.drop(subset=[time, price, weight])
    out = known.groupBy(*keys, month_start(time).alias("month")).agg(
        F.avg(price).alias("p_market"),
        F.sum(weight).alias("wind_mwh"),
        F.sum(F.col(price) * F.col(weight)).alias("price_x_wind"),
        F.count(F.lit(1)).alias("hours_used"),
    )
    capture = guarded_ratio("price_x_wind", "wind_mwh")
    return out.withColumn("p_capture", capture).withColumn("capture_factor", F.col("p_capture") / F.col("p_market"))


def project_weighted_mean(costs: DataFrame, keys: Sequence[str], value: str, weight: str, total_row: Column | None = None) -> DataFrame:
    """Weighted mean per key. Rows that restate a total are counted like any other
    row unless ``total_row`` marks them for exclusion."""
    rows = costs.na.drop(subset=[value, weight])
    if total_row is not None:
        rows = rows.where(~total_row)
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def development_costs(costs: DataFrame, value: str = "mean_eur_per_kw", weight: str = "projects", include_total_row: bool = True) -> DataFrame:
    """National planning / permitting / total cost and the pre-check residual.

    ``costs`` has (phase, state, value, weight) with phases planning, permitting and total.
    """
    if not include_total_row:
        costs = costs.where(F.col("state") != "Gesamt")
    rows = costs.na.drop(subset=[value, weight])
    mean_of = lambda phase: F.sum(F.when(F.col("phase") == phase, F.col(value) * F.col(weight))) / F.sum(
        F.when(F.col("phase") == phase, F.col(weight))
    )
    wide = rows.agg(mean_of("planning").alias("planning"), mean_of("permitting").alias("permitting"), mean_of("total").alias("total"))
    wide = wide.withColumn("precheck", F.col("total") - F.col("planning") - F.col("permitting"))
    return wide.unpivot([], ["precheck", "planning", "permitting", "total"], "phase", value)


def curtailment_rate(df: DataFrame, keys: Sequence[str], curtailed, produced) -> DataFrame:
    """curtailed / (curtailed + produced) per key; 0 where nothing was produced."""
    out = df.groupBy(*keys).agg(total(curtailed).alias("curtailed_mwh"), total(produced).alias("production_mwh"))
    return out.withColumn(
        "curtailment_rate", guarded_ratio("curtailed_mwh", F.col("curtailed_mwh") + F.col("production_mwh"), 0.0)
    )


def seasonal_profile(df: DataFrame, keys: Sequence[str], season: Column, value: str) -> DataFrame:
    """Mean per season and the same divided by the mean of the season means."""
    means = df.groupBy(*keys, season.alias("season")).agg(F.avg(value).alias("season_mean"))
    return means.withColumn("season_factor", F.col("season_mean") / F.avg("season_mean").over(Window.partitionBy(*keys)))


def spread_by_season(df: DataFrame, keys: Sequence[str], season: Column, value: str) -> DataFrame:
    """Sample standard deviation for each of the 12 months, falling back to the
    key's overall deviation where the month has none or zero."""
    by_month = df.groupBy(*keys, season.alias("season")).agg(F.stddev_samp(value).alias("_sd"))
    overall = df.groupBy(*keys).agg(F.when(F.count(value) > 2, F.stddev_samp(value)).otherwise(0.0).alias("_all"))
    spine = overall.withColumn("season", F.explode(F.sequence(F.lit(1), F.lit(12))))
    usable = F.when((F.col("_sd") != 0) & ~F.isnan("_sd"), F.col("_sd"))
    return spine.join(by_month, [*keys, "season"], "left").select(*keys, "season", F.coalesce(usable, F.col("_all")).alias("sigma"))


def quantile_bands(df: DataFrame, keys: Sequence[str], value: str, probs=(0.1, 0.5, 0.9)) -> DataFrame:
    """P10/P50/P90 over simulations; the group size is the number of simulations."""
    bands = F.percentile(value, [float(p) for p in probs])
    names = [f"p{round(p * 100)}" for p in probs]
    return df.groupBy(*keys).agg(bands.alias("_q")).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def null_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, null_fraction) from one pass over the table."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n_{i}") for i, c in enumerate(columns)],
    )
    listed = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n_{i}").alias("nulls"), (F.col(f"_n_{i}") / F.col("_rows")).alias("null_fraction"))
        for i, c in enumerate(columns)
    ]))
    return counts.select(listed.alias("_r")).select("_r.*")


def net_export(df: DataFrame, net: str | None, exports: Sequence[str], imports: Sequence[str], file_keys: Sequence[str], time: str) -> DataFrame:
    """Net export per row. The stated net column is used unless more than 90 % of it
    is missing in the file; then exports minus imports, unknowns counting as 0."""
    rebuilt = reduce(lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0.0)) for c in exports], F.lit(0.0)) - reduce(
        lambda a, b: a + b, [F.coalesce(as_col(c), F.lit(0.0)) for c in imports], F.lit(0.0)
    )
    if net is None:
        return df.select(*file_keys, time, F.lit(0.0).alias("net_export"))
    share = df.groupBy(*file_keys).agg(F.avg(F.col(net).isNull().cast("double")).alias("_missing"))
    joined = df.join(share, list(file_keys))
    value = F.when(F.col("_missing") > 0.9, rebuilt).otherwise(F.col(net))
    return joined.select(*file_keys, time, value.alias("net_export"))


# --- telemetry ---------------------------------------------------------------

def hourly_measures(static: Sequence[str] = ()) -> list[Column]:
    """Shared by the batch and the streaming roll-up: ten-minute rows to one hour."""
    return [
        F.avg(F.col("is_available").cast("double")).alias("availability_fraction"),
        (F.sum("power_kw") / 6.0).alias("energy_kwh"),
        F.avg("wind_speed_ms").alias("wind_speed_ms"),
        *[F.first(c, ignorenulls=False).alias(c) for c in static],
    ]


def keep_available_hours(hourly: DataFrame) -> DataFrame:
    """Hours with at least 2/3 of samples available and no unknown measure."""
    return hourly.where(F.col("availability_fraction") >= FULL_AVAILABILITY_SHARE).na.drop()


def telemetry_hourly(df: DataFrame, keys: Sequence[str] = ("site_id", "turbine_id"), static: Sequence[str] = ()) -> DataFrame:
    """Ten-minute rows (ts, power_kw, wind_speed_ms, is_available) to sparse hours."""
    hourly = df.groupBy(*keys, hour_start("ts").alias("ts")).agg(*hourly_measures(static))
    return keep_available_hours(hourly)


def park_hourly(df: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Mean over the turbines of a park; the park counts as available from 2/3 up."""
    out = df.groupBy(*keys, "ts").agg(
        F.avg("wind_speed_ms").alias("wind_speed_ms_mean"),
        F.avg("energy_kwh").alias("energy_kwh_mean"),
        F.avg(F.col("is_available").cast("double")).alias("availability_fraction"),
    )
    return out.withColumn("is_available", F.col("availability_fraction") >= FULL_AVAILABILITY_SHARE)
