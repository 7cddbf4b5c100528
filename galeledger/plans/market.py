"""Market jobs: capture history, curtailment panel, strike path, price simulation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import month_index
from ..functions.expr import clip
from ..operators.aggregate import capture_factor, spread_by_season
from ..operators.forecast import drift, markup, project_quarters
from ..operators.ols import fit_ar_residual, fit_fourier, fit_line
from ..operators.ordered import filled, lag_row, rolling_mean, trailing_mean
from ..operators.reshape import union_all
from ..operators.timeline import month_horizon
from ..session import settle
from ..sources.catalogue import LOAD_GROWTH, PRICE_DRIFTS, WIND_GROWTH


def capture_history(prices: DataFrame, generation: DataFrame, keys: Sequence[str], time: str = "ts") -> DataFrame:
    """Hourly price joined to hourly generation, rolled up per month."""
    both = prices.join(generation, [*keys, time])
    return capture_factor(both, keys, time, "price_eur_mwh", "wind_mwh")


def curtailment_forecast(panel: DataFrame, start: Column, end: Column, tso: str = "tso", cap: float = 0.30) -> DataFrame:
    """(tso, quarter, wind_mwh, load_mwh, S, cr_hat).

    ``panel`` has tso, quarter, cr, wind_mwh, load_mwh. The rate is a line in
    S = wind / load per operator; wind and load are projected seasonally.
    """
    panel = settle(panel, "curtailment-panel")
    hist = panel.withColumn("S", F.col("wind_mwh") / F.col("load_mwh"))
    fit = fit_line(hist, [tso], "cr", "S")
    wind = project_quarters(panel, [tso], "wind_mwh", WIND_GROWTH, start, end)
    load = project_quarters(panel, [tso], "load_mwh", LOAD_GROWTH, start, end)
    future = wind.join(load, [tso, "quarter"]).withColumn("S", F.col("wind_mwh") / F.col("load_mwh")).join(fit, tso)
    return future.select(tso, "quarter", "wind_mwh", "load_mwh", "S", clip(F.col("intercept") + F.col("b_S") * F.col("S"), 0.0, cap).alias("cr_hat"))


def auction_months(auctions: DataFrame, keys: Sequence[str], date: str, strike: str) -> DataFrame:
    return auctions.na.drop(subset=[date, strike]).groupBy(*keys, F.trunc(date, "MM").alias("date")).agg(F.avg(strike).alias("strike"))


def strike_path(market: DataFrame, auctions_by_month: DataFrame, keys: Sequence[str], m0: float | None = 1.15, reference_price: float = 70.0) -> DataFrame:
    """History of strikes, then mark-up times market price on the market's months.

    Without ``m0`` the mark-up is the last strike over ``reference_price``.
    """
    last = auctions_by_month.groupBy(*keys).agg(F.max("date").alias("_anchor"), F.max_by("strike", "date").alias("_last"))
    rows = market.join(last, list(keys)) if keys else market.withColumn("_a", last.select(F.struct("_anchor", "_last")).scalar()).select("*", "_a.*")
    start = F.lit(float(m0)) if m0 is not None else F.col("_last") / reference_price
    rows = rows.withColumn("markup_path", markup("date", "_anchor", start))
    future = rows.select(
        *keys, "date", F.col("price").alias("market_price"), "markup_path", (F.col("markup_path") * F.col("price")).alias("eeg_strike_eur_mwh")
    ).withColumn("eeg_strike_used", F.col("eeg_strike_eur_mwh"))
    return union_all(auctions_by_month.select(*keys, "date", F.col("strike").alias("eeg_strike_used")), future)


def markup_from_overlap(market: DataFrame, strikes: DataFrame, keys: Sequence[str], n: int = 24) -> DataFrame:
    """(keys, m0, anchor): mean strike / market ratio of the last ``n`` months both exist."""
    both = market.join(strikes, [*keys, "date"], "left").withColumn("markup_hist", F.col("strike") / F.col("price"))
    both = both.where(F.col("markup_hist").isNotNull())
    level = trailing_mean(both, keys, "date", "markup_hist", n, "m0")
    return level.join(both.groupBy(*keys).agg(F.max("date").alias("anchor")), list(keys))


def monthly_strike_series(auctions_by_month: DataFrame, keys: Sequence[str], start: Column, n_months: int, roll: int | None = 24) -> DataFrame:
    """Strike per calendar month: optional rolling mean over auction rows, then forward fill."""
    value = rolling_mean("strike", keys, "date", roll) if roll else F.col("strike")
    rolled = auctions_by_month.withColumn("strike", value)
    spine = month_horizon(rolled.select(*keys).distinct().withColumn("_start", start), "_start", n_months, "date").drop("_start")
    return spine.join(rolled, [*keys, "date"], "left").withColumn("strike", filled("strike", keys, "date", backward=False))


def price_simulation_models(
    monthly: DataFrame, series: str, anchor_from: Column, anchor_to: Column, drifts: dict[str, float] = PRICE_DRIFTS,
    shrink: float = 0.25, harmonics: int = 1, fit_scenario: str = "base", price: str = "price",
) -> DataFrame:
    """Inputs of :func:`simulate_ar_paths`, one row per (series, scenario).

    Level = median price in the anchor window, anchor = its last month; harmonics give
    the damped season; AR(1) and month-wise spread come from what is left under the
    base drift.
    """
    rows = settle(monthly.where(F.col(price) > 0).withColumn("log_price", F.log(price)).withColumn("season", F.month("month")), "prices")
    inside = F.col("month").between(anchor_from, anchor_to)
    anchor = rows.where(inside).groupBy(series).agg(F.median(price).alias("_level"), F.max("month").alias("_anchor"))
    season = settle(fit_fourier(rows, [series], "season", "log_price", harmonics, shrink), "season")
    rows = rows.join(anchor, series).join(season, [series, "season"])
    rows = rows.withColumn("deseasoned", F.col("log_price") - F.col("season_effect"))
    mu = drift("month", "_anchor", F.log("_level"), drifts[fit_scenario])
    rows = rows.withColumn("resid", F.col("deseasoned") - mu).withColumn("resid_lag", lag_row("resid", [series], "month"))
    rows = settle(rows, "residuals")
    ar = fit_ar_residual(rows, [series], "resid", "resid_lag").select(series, "phi", F.col("sigma").alias("sigma_global"))
    sigma = spread_by_season(rows, [series], F.col("season"), "resid")
    maps = sigma.groupBy(series).agg(F.map_from_entries(F.collect_list(F.struct("season", "sigma"))).alias("sigma"))
    waves = season.groupBy(series).agg(F.map_from_entries(F.collect_list(F.struct("season", "season_effect"))).alias("season"))
    last = rows.groupBy(series).agg(
        F.max("month").alias("last_month"), F.max_by("deseasoned", "month").alias("_y"), F.first("_level").alias("_level"), F.first("_anchor").alias("_anchor")
    )
    base = last.join(ar, series).join(maps, series).join(waves, series)
    fan = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(math.log(1.0 + g)).alias("_rate")) for s, g in drifts.items()]))
    base = base.select("*", fan.alias("_s")).select("*", "_s.*")
    mu_start = F.log("_level") + (month_index("last_month") - month_index("_anchor")) / 12.0 * F.col("_rate")
    return base.select(
        series, "scenario", "last_month", "phi", "sigma_global", "sigma", "season",
        mu_start.alias("mu_start"), (F.col("_rate") / 12.0).alias("mu_step"), (F.col("_y") - mu_start).alias("y_last"),
    )
