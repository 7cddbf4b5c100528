"""Deterministic forecasts. A recursion along one series' horizon stays inside that series' row,
as an array; series are what scales out.

Fits read a monthly table several times. Such a table holds at most one row per series
and month, so it is settled first: the raw data behind it is scanned once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import importable, settle
from ..functions.calendar import month_index, months_between_starts
from ..functions.expr import as_col, clip
from .aggregate import seasonal_profile
from .ols import fit_within, season_map
from .ordered import lag_row, trailing_mean

DEFAULT_HORIZON = 240


def drift(month, anchor, mu0, growth, offset=0.0) -> Column:
    """Log-level path mu0 + years * log(1 + growth) (+ an offset used in history only)."""
    mu0 = mu0 if isinstance(mu0, Column) else F.lit(float(mu0))
    rate = F.log1p(growth) if isinstance(growth, Column) else F.lit(math.log(1.0 + growth))
    return mu0 + months_between_starts(month, anchor) / 12.0 * rate + F.lit(float(offset))


def _recursions(start: pa.Array, phi: pa.Array, inputs: pa.Array) -> pa.Array:
    """Paths of one batch. Steps are affine maps z -> phi * z + u, which compose; doubling the stretch that a map stands for
    gives all of them in log2(steps) passes over a matrix with paths as rows."""
    known = ~inputs.is_null().to_numpy(zero_copy_only=False)
    inputs = inputs.fill_null([]) if not known.all() else inputs
    size = np.diff(inputs.offsets.to_numpy())
    values = inputs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    z0, rate = (x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (start, phi))
    out = np.empty_like(values)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        cells = at[rows][:, None] + np.arange(n)
        z = values[cells]
        power = rate[rows][:, None]
        z[:, :1] += power * z0[rows][:, None]
        reach = 1
        while reach < n:
            z[:, reach:] += power * z[:, :-reach]
            power = power * power
            reach *= 2
        out[cells] = z
    known &= np.isfinite(z0) & np.isfinite(rate)
    path = pa.array(out, mask=np.isnan(out))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), path, mask=pa.array(~known))


def ar_path(start, phi, inputs) -> Column:
    """z_t = phi * z_(t-1) + inputs_t as an array. NULL without start or phi; NULL from an unknown input on.

    Arrow batches of whole paths: a fold over the array would copy the path at every step.
    """
    importable(SparkSession.active())
    paths = F.arrow_udf(_recursions, "array<double>")
    return paths(as_col(start).cast("double"), as_col(phi).cast("double"), as_col(inputs).cast("array<double>"))


def horizon_months(last_month, n) -> Column:
    """The ``n`` months after ``last_month``."""
    start = F.add_months(as_col(last_month), 1)
    n = n if isinstance(n, Column) else F.lit(int(n))
    return F.sequence(start, F.add_months(start, n - 1), F.expr("interval 1 month"))


def fit_price_model(
    monthly: DataFrame, keys: Sequence[str], price: str, anchor: Column, *,
    month: str = "month", shift: float = 200.0, growth: float = 0.01, mu0: Column | float = 10.0, history_offset: float = 0.15,
) -> DataFrame:
    """AR(1) with month effects around a drifting log level; one row per key.

    ``anchor`` is the anchor month (a date column or literal). The defaults are the
    published parameter set, where the level is fixed and not estimated.
    """
    z = F.log(F.col(price) + shift) - drift(F.col(month), anchor, mu0, growth, history_offset)
    rows = monthly.withColumn("z", z).withColumn("season", F.month(month))
    rows = settle(rows.withColumn("z_lag", lag_row("z", keys, month)), "price-rows")
    fit = season_map(fit_within(rows, keys, "season", "z", ["z_lag"]), keys, "season", ["b_z_lag"])
    last = rows.groupBy(*keys).agg(F.max(month).alias("last_month"), F.max_by("z", month).alias("z_last"))
    return fit.join(last, list(keys)).withColumnRenamed("b_z_lag", "phi")


def forecast_price(
    model: DataFrame, keys: Sequence[str], anchor: Column, n: int = DEFAULT_HORIZON, *,
    shift: float = 200.0, growth: float = 0.01, mu0: Column | float = 10.0,
) -> DataFrame:
    """Monthly price path from :func:`fit_price_model`; (keys, month, mu, log level, price)."""
    months = horizon_months("last_month", n)
    effect = lambda d: F.coalesce(F.try_element_at("season_intercepts", F.month(d)), F.col("base_intercept"))
    paths = model.withColumn("_months", months).withColumn("_z", ar_path("z_last", "phi", F.transform("_months", effect)))
    rows = paths.select("*", F.explode_outer(F.arrays_zip("_months", "_z")).alias("_p")).where("_p is not null")
    rows = rows.withColumn("month", F.col("_p._months"))
    mu = drift("month", anchor, mu0, growth)
    return rows.select(*keys, "month", mu.alias("mu_log"), (mu + F.col("_p._z")).alias("log_level")).withColumn(
        "price_forecast", F.exp("log_level") - shift
    )


def fit_capture_model(monthly: DataFrame, keys: Sequence[str], *, month="month", cf="capture_factor", wind="wind_mwh") -> DataFrame:
    """log CF on its own lag, log wind and month effects; phi clamped to be stable."""
    rows = monthly.na.drop(subset=[cf, wind]).where(F.col(cf) > 0)
    rows = rows.withColumn("z", F.log(cf)).withColumn("log_wind", F.log(F.greatest(F.col(wind), F.lit(1.0)))).withColumn("season", F.month(month))
    rows = settle(rows.withColumn("z_lag", lag_row("z", keys, month)), "capture-rows")
    fit = season_map(fit_within(rows, keys, "season", "z", ["z_lag", "log_wind"]), keys, "season", ["b_z_lag", "b_log_wind"])
    last = rows.groupBy(*keys).agg(F.max(month).alias("last_month"), F.max_by("z", month).alias("z_last"))
    return fit.join(last, list(keys)).withColumn("phi", clip("b_z_lag", 0.0, 0.98))


def seasonal_growth(level, season_factor, growth, periods, per_year: int) -> Column:
    """level * season * (1 + growth) ** (periods / per_year); the horizon may be negative."""
    growth = growth if isinstance(growth, Column) else F.lit(float(growth))
    return as_col(level) * as_col(season_factor) * F.pow(1.0 + growth, as_col(periods) / float(per_year))


def forecast_capture(
    model: DataFrame, wind_season: DataFrame, keys: Sequence[str], anchor: Column, scenarios: dict[str, float],
    n: int = DEFAULT_HORIZON, floor: float = 0.55, cap: float = 1.15,
) -> DataFrame:
    """CF path per growth scenario: (keys, scenario, month, wind_mwh, capture_factor).

    ``wind_season`` is (keys, season, season_mean) over the reference window; wind
    grows from the anchor month.
    """
    profile = wind_season.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("season", "season_mean"))).alias("_wind"))
    fan = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(float(g)).alias("growth")) for s, g in scenarios.items()]))
    rows = model.join(profile, list(keys)).select("*", fan.alias("_s")).select("*", "_s.scenario", "_s.growth")
    rows = rows.withColumn("_months", horizon_months("last_month", n))
    wind = lambda d: seasonal_growth(
        F.try_element_at("_wind", F.month(d)), F.lit(1.0), F.col("growth"), month_index(d) - month_index(anchor), 12
    )
    rows = rows.withColumn("_w", F.transform("_months", wind))
    inputs = F.zip_with(
        "_months", "_w",
        lambda d, w: F.coalesce(F.try_element_at("season_intercepts", F.month(d)), F.col("base_intercept"))
        + F.col("b_log_wind") * F.log(F.greatest(w, F.lit(1.0))),
    )
    rows = rows.withColumn("_z", ar_path("z_last", "phi", inputs))
    out = rows.select(*keys, "scenario", F.explode_outer(F.arrays_zip("_months", "_w", "_z")).alias("_p")).where("_p is not null")
    return out.select(
        *keys, "scenario", F.col("_p._months").alias("month"), F.col("_p._w").alias("wind_mwh"),
        clip(F.exp(F.col("_p._z")), floor, cap).alias("capture_factor"),
    )


def project_quarters(
    quarterly: DataFrame, keys: Sequence[str], value: str, growth, horizon_start: Column, horizon_end: Column,
    base_quarter: Column | None = None, level_rows: int = 8,
) -> DataFrame:
    """Level of the last 8 quarters x seasonal factor x growth over a fixed horizon.

    Growth counts quarters from ``base_quarter`` (default: the last one observed
    over all keys), backwards as well, so early horizon quarters shrink.
    """
    level = trailing_mean(quarterly, keys, "quarter", value, level_rows)
    season = seasonal_profile(quarterly, keys, F.quarter("quarter"), value).select(*keys, "season", "season_factor")
    season = season.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("season", "season_factor"))).alias("_season"))
    if base_quarter is None:
        base_quarter = quarterly.agg(F.max("quarter")).scalar()
    rows = level.join(season, list(keys)).withColumn("_base", base_quarter)
    rows = rows.withColumn("quarter", F.explode(F.sequence(horizon_start, horizon_end, F.expr("interval 3 month"))))
    ordinal = lambda c: F.year(c) * 4 + F.quarter(c)
    factor = F.coalesce(F.try_element_at("_season", F.quarter("quarter")), F.lit(1.0))
    return rows.select(
        *keys, "quarter",
        seasonal_growth("level", factor, growth, ordinal("quarter") - ordinal("_base"), 4).alias(value),
    )


def markup(month, anchor, m0, floor: float = 1.02, half_life_years: float = 12.0) -> Column:
    """Mark-up over market: m0 up to the anchor, then halving its excess over ``floor``
    every ``half_life_years``."""
    m0 = m0 if isinstance(m0, Column) else F.lit(float(m0))
    years = months_between_starts(month, anchor) / 12.0
    decayed = floor + (m0 - floor) * F.exp(-math.log(2.0) / half_life_years * years)
    return F.when(years > 0, decayed).otherwise(m0)


def flat_baselines(panel: DataFrame, keys: Sequence[str], month: str, price: str, strike: str) -> DataFrame:
    """Flat forward levels: 36-month mean price, last known and 24-row mean strike.

    Strike rows are the panel's months with a known (forward-filled) strike.
    """
    price_level = trailing_mean(panel, keys, month, price, 36, "price_36m")
    known = panel.where(F.col(strike).isNotNull())
    recent = trailing_mean(known, keys, month, strike, 24, "strike_24m")
    last = known.groupBy(*keys).agg(F.max_by(strike, month).alias("strike_last"))
    return price_level.join(recent, list(keys), "left").join(last, list(keys), "left")
