"""Telemetry to hours, climate features, ML matrix and monthly energy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import cyclical
from ..functions.wind import air_density, at_hub, direction_from, shear_exponent, specific_power, speed
from ..operators.aggregate import park_hourly
from ..operators.asof import asof_nearest
from ..operators.curves import curve_points, expected_power, rated_speed
from ..operators.grid import interpolate_grid
from ..operators.intervals import open_interval_count
from ..operators.learn import predict_energy
from ..operators.timeline import FULL_AVAILABILITY_SHARE, hourly_dense, monthly_if_complete, ten_minute_timeline
from ..sources.climate import OPTIONAL, REQUIRED
from ..sources.telemetry import FULL_PERFORMANCE

MERGE_TOLERANCE_S = 45 * 60
MIN_ABOVE_CUT_IN, MAX_SHARE_OF_RATED, MIN_EXPECTED_KWH = 0.5, 0.90, 50.0


def availability(power, wind, cut_in) -> Column:
    """Not negative, not unknown, and not idle while the wind is above cut-in.

    An unknown wind speed alone does not make a sample unavailable.
    """
    power, wind = F.col(power), F.col(wind)
    idle = F.coalesce((wind >= F.col(cut_in)) & (power <= 0), F.lit(False))
    return F.when(power.isNull() | (power < 0), False).otherwise(~idle)


def within_bounds(df: DataFrame, measure: str, low: float, high: float | None) -> DataFrame:
    """Known values inside [low, high]."""
    keep = F.col(measure) >= low
    return df.where(keep if high is None else keep & (F.col(measure) <= high))


def plain_hourly(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dense hours between a turbine's first and last sample: empty hours carry
    energy 0 and unknown wind."""
    return hourly_dense(
        df, keys, "ts",
        {"wind_speed_ms": F.avg("wind_speed_ms"), "energy_kwh": F.coalesce(F.sum("power_kw"), F.lit(0.0)) / 6.0},
        {"energy_kwh": 0.0},
    )


def status_ticks(status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ts, is_available) every ten minutes over the span of the status log;
    unavailable inside any interval that is not full performance (or has no category)."""
    known = status.na.drop(subset=["start_ts", "end_ts"])
    ticks = ten_minute_timeline(known, keys, "start_ts", "end_ts")
    bad = known.where(~F.coalesce(F.col("iec_category") == FULL_PERFORMANCE, F.lit(False)))
    return open_interval_count(ticks, bad, keys, "start_ts", "end_ts", 10).select(*keys, "ts", (F.col("n_open") <= 0).alias("is_available"))


def status_hourly(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = ticks.groupBy(*keys, F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.avg(F.col("is_available").cast("double")).alias("availability_fraction")
    )
    return out.withColumn("is_available", F.col("availability_fraction") >= FULL_AVAILABILITY_SHARE)


def turbine_hourly(telemetry: DataFrame, status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain hours with the status flag; an hour outside the status log is unavailable."""
    flags = status_hourly(status_ticks(status, keys), keys)
    joined = plain_hourly(telemetry, keys).join(flags, [*keys, "ts"], "left")
    return joined.withColumn("is_available", F.coalesce("is_available", F.lit(False)))


def park_from_turbines(turbines: DataFrame, site: str = "site_id") -> DataFrame:
    return park_hourly(turbines, [site])


def climate_features(df: DataFrame, time: str = "time", prefix: str = "era5_") -> DataFrame:
    """Feature columns from interpolated variables; needs hub_height_m."""
    ws10, ws100 = speed("u10", "v10"), speed("u100", "v100")
    out = df.withColumns({f"{prefix}ws_10m": ws10, f"{prefix}ws_100m": ws100})
    out = out.withColumn(f"{prefix}shear_alpha", shear_exponent(f"{prefix}ws_10m", f"{prefix}ws_100m"))
    return out.withColumns({
        f"{prefix}ws_hub": at_hub(f"{prefix}ws_10m", "hub_height_m", f"{prefix}shear_alpha"),
        f"{prefix}wd_10m": direction_from("u10", "v10"),
        f"{prefix}wd_100m": direction_from("u100", "v100"),
        f"{prefix}t2m_K": F.col("t2m"), f"{prefix}d2m_K": F.col("d2m"), f"{prefix}sp_Pa": F.col("sp"),
        f"{prefix}air_density_kgm3": air_density("sp", "t2m", "d2m"),
        f"{prefix}friction_velocity_ms": F.col("zust"), f"{prefix}surface_roughness_m": F.col("fsr"),
        **cyclical(time),
    }).drop(*REQUIRED, *OPTIONAL)


FEATURE_COLUMNS = [
    "era5_ws_10m", "era5_ws_100m", "era5_shear_alpha", "era5_ws_hub", "era5_wd_10m", "era5_wd_100m", "era5_t2m_K", "era5_d2m_K",
    "era5_sp_Pa", "era5_air_density_kgm3", "era5_friction_velocity_ms", "era5_surface_roughness_m", "hour_sin", "hour_cos", "doy_sin", "doy_cos",
]


def site_climate(sites: DataFrame, grid: DataFrame, key: str, step: float) -> DataFrame:
    """(key, ts, features...) at every site and grid time. ``sites``: key, lat, lon, hub_height_m."""
    values = interpolate_grid(sites, grid, [key], [*REQUIRED, *OPTIONAL], step)
    rows = values.join(sites.select(key, "hub_height_m"), key)
    return climate_features(rows).withColumnRenamed("time", "ts").drop("hub_height_m")


def training_matrix(telemetry: DataFrame, climate: DataFrame, catalogue: DataFrame, key: str = "turbine_id", tolerance_s: int = MERGE_TOLERANCE_S) -> DataFrame:
    """Standard hourly telemetry with climate features, expected energy and targets.

    telemetry: key, ts (unique per key), energy_kwh, turbine_type and turbine constants;
    climate: key, ts, features.
    """
    merged = asof_nearest(telemetry, climate, [key], "ts", FEATURE_COLUMNS, tolerance_s, unique=True)
    points = curve_points(catalogue)
    merged = expected_power(merged, points, "era5_ws_hub", "expected_energy_kwh")
    limits = catalogue.select("turbine_type", "cut_in_ws").join(
        rated_speed(points, catalogue.select("turbine_type", "rated_power_kw")), "turbine_type"
    ).withColumnRenamed("cut_in_ws", "_cut_in").withColumnRenamed("rated_ws", "_rated_ws")
    return with_targets(merged.join(limits, "turbine_type", "left")).drop("_cut_in", "_rated_ws")


def with_targets(df: DataFrame) -> DataFrame:
    """Validity mask, correction factor where valid, its log where positive."""
    c = F.col
    valid = (
        c("energy_kwh").isNotNull() & c("expected_energy_kwh").isNotNull()
        & (c("era5_ws_hub") >= F.coalesce(c("_cut_in"), F.lit(3.5)) + MIN_ABOVE_CUT_IN)
        & (c("era5_ws_hub") <= MAX_SHARE_OF_RATED * c("_rated_ws"))
        & (c("expected_energy_kwh") >= MIN_EXPECTED_KWH)
    )
    out = df.withColumn("target_is_valid", F.coalesce(valid, F.lit(False)))
    out = out.withColumn("target_correction_factor", F.when(c("target_is_valid"), c("energy_kwh") / c("expected_energy_kwh")))
    return out.withColumn("target_log_correction_factor", F.when(c("target_correction_factor") > 0, F.log("target_correction_factor")))


def historical_monthly_energy(sites: DataFrame, grid: DataFrame, catalogue: DataFrame, model: PipelineModel, step: float, key: str = "site_id", min_hours: int = 24 * 28) -> DataFrame:
    """(key, year, month, energy_kwh): climate at the site, curve, model correction,
    month sums of sufficiently complete months. ``sites``: key, lat, lon, hub_height_m, turbine_type."""
    spec = catalogue.select("turbine_type", "rated_power_kw", "rotor_diameter_m")
    static = sites.join(spec, "turbine_type").withColumn("specific_power_wpm2", specific_power("rated_power_kw", "rotor_diameter_m"))
    hours = site_climate(sites, grid, key, step).join(static, key)
    hours = expected_power(hours, curve_points(catalogue), "era5_ws_hub", "expected_energy_kwh")
    scored = predict_energy(hours, model)
    monthly = monthly_if_complete(scored, [key], "ts", "pred_energy_kwh", min_hours)
    return monthly.select(key, F.year("month").alias("year"), F.month("month").alias("month"), F.col("pred_energy_kwh").alias("energy_kwh"))
