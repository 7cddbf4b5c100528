"""Monthly revenue of many project scenarios in one job.

Market price, capture factor, curtailment and strike depend only on the grid
operator and the commissioning month, not on the scenario. They are resolved once
per distinct (tso, cod) on a panel of horizon months, a table bounded by operators x
start months x horizon; scenarios then meet the panel in one equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import month_index, project_month, project_year
from ..functions.expr import clip, floored_price, support_premium
from ..operators.checks import first_missing
from ..operators.ordered import filled, monthly_steps
from ..operators.timeline import month_horizon, quarter_to_months
from ..session import settle

FORECAST_MONTHS = 240
CF_BOUNDS = (0.50, 1.05)
CR_BOUNDS = (0.00, 0.30)
PANEL_KEYS = ["tso", "cod"]


def driver_panel(
    scenarios: DataFrame, market: DataFrame, capture: DataFrame, curtailment: DataFrame, strikes: DataFrame, months: int = FORECAST_MONTHS,
) -> DataFrame:
    """(tso, cod, date, p_market, cf, cr, strike_series) over each distinct horizon.

    market (date, p_market); capture (date, cf_raw); curtailment (tso, quarter, cr_hat);
    strikes (date, strike).

    All series are calendar tables by month start. The distinct starts are written
    once, so that no join below scans the scenario table again. Settle the result when it is used more
    than once; it is small, and its file sizes let the planner broadcast it.
    """
    starts = settle(scenarios.select(*PANEL_KEYS).distinct(), "starts")
    until = starts.agg(F.add_months(F.max("cod"), months)).scalar()
    panel = month_horizon(starts, "cod", months, "date")
    panel = panel.join(market.select("date", "p_market"), "date", "left")
    cf = monthly_steps(capture.select("date", "cf_raw"), [], "date", ["cf_raw"], until)
    panel = panel.join(cf, "date", "left").withColumn("cf", clip("cf_raw", *CF_BOUNDS))
    cr = quarter_to_months(curtailment, ["tso"], "quarter", "cr_hat", "mean").withColumnRenamed("month", "date")
    panel = panel.join(cr, ["tso", "date"], "left").withColumn("cr", clip(filled("cr_hat", PANEL_KEYS, "date"), *CR_BOUNDS))
    at_start = monthly_steps(strikes.select(F.col("date").alias("cod"), F.col("strike").alias("strike_series")), [], "cod", ["strike_series"], until)
    panel = panel.join(at_start, "cod", "left")
    return panel.select(*PANEL_KEYS, "date", "p_market", "cf", "cr", "strike_series")


def rejected_scenarios(scenarios: DataFrame, production: DataFrame | None, panel: DataFrame, key: str = "scenario_id", months: int = FORECAST_MONTHS) -> DataFrame:
    """(key, reject_reason, first_missing): no operator or start, incomplete production, market price or strike."""
    nameless = scenarios.where("tso IS NULL OR cod IS NULL").select(key, F.lit("operator or start missing").alias("reject_reason"), F.col("cod").alias("first_missing"))
    scenarios = scenarios.where("tso IS NOT NULL AND cod IS NOT NULL")
    price = first_missing(panel, PANEL_KEYS, "date", "p_market").withColumn("reject_reason", F.lit("market price missing"))
    no_price = scenarios.join(price, PANEL_KEYS).select(key, "reject_reason", "first_missing")
    curtail = panel.groupBy(*PANEL_KEYS).agg(F.count("cr").alias("_n")).where("_n = 0")
    no_rate = scenarios.join(curtail, PANEL_KEYS).select(key, F.lit("no curtailment rate for operator").alias("reject_reason"), F.col("cod").alias("first_missing"))
    strike = panel.select(*PANEL_KEYS, "strike_series").distinct().where("strike_series IS NULL")
    no_strike = scenarios.where("eeg_on = 1 AND manual_eeg_strike IS NULL").join(strike, PANEL_KEYS)
    no_strike = no_strike.select(key, F.lit("no strike at or before start").alias("reject_reason"), F.col("cod").alias("first_missing"))
    out = nameless.unionByName(no_price).unionByName(no_rate).unionByName(no_strike)
    if production is not None:
        # A scenario's known months fit in one small array, so production is shuffled once
        # (combined on the map side) and no horizon spine is built.
        have = production.where("mwh IS NOT NULL").groupBy(key).agg(F.collect_set(month_index("date")).alias("_have"))
        first = month_index("cod")
        wanted = F.sequence(first, first + (months - 1))
        gap = F.array_min(F.array_except(wanted, F.coalesce("_have", F.array().cast("array<int>"))))
        gaps = scenarios.join(have.hint("merge"), key, "left").withColumn("_gap", gap).where("_gap IS NOT NULL")
        missing = F.make_date(F.floor(F.col("_gap") / 12).cast("int"), F.col("_gap") % 12 + 1, F.lit(1))
        out = out.unionByName(gaps.select(key, F.lit("production month missing").alias("reject_reason"), missing.alias("first_missing")))
    return out


def monthly_revenue(
    scenarios: DataFrame, panel: DataFrame, production: DataFrame | None = None, key: str = "scenario_id", carry: Sequence[str] = (),
) -> DataFrame:
    """One row per (scenario, horizon month).

    scenarios: key, tso, cod, eeg_on, manual_eeg_strike, and ``mwh_constant`` unless a
    monthly ``production`` (key, date, mwh) is given. The strike is fixed at the start
    month for the whole horizon.
    """
    if production is not None:
        # Production meets its scenario first: one shuffle by key, which the yearly sums reuse. It has a row for every month, but the planner may take it
        # for as small as the table it was exploded from and broadcast it through the driver; the hint forbids that.
        rows = scenarios.join(production.select(key, "date", F.col("mwh").alias("mwh_gross_park")).hint("merge"), key).join(panel, [*PANEL_KEYS, "date"])
    else:
        rows = scenarios.join(panel, PANEL_KEYS).withColumn("mwh_gross_park", F.col("mwh_constant"))
    on = F.col("eeg_on") == 1
    rows = rows.withColumns({
        "strike_cod_fixed": F.when(on, F.coalesce("manual_eeg_strike", "strike_series")),
        "strike_source": F.when(~on, "off").when(F.col("manual_eeg_strike").isNotNull(), "manual").otherwise("from_series_asof"),
        "mwh_delivered": F.col("mwh_gross_park") * (1.0 - F.col("cr")),
        "p_wind_merchant": F.col("p_market") * F.col("cf"),
        "project_month": project_month("date", "cod"),
        "project_year": project_year("date", "cod"),
    })
    rows = rows.withColumn("p_wind_realised", floored_price("p_wind_merchant", "strike_cod_fixed", "eeg_on"))
    rows = rows.withColumns({
        "revenue_eur": F.col("mwh_delivered") * F.col("p_wind_realised"),
        "eeg_premium_eur": support_premium("p_wind_merchant", "strike_cod_fixed", "eeg_on") * F.col("mwh_delivered"),
    })
    return rows.select(
        key, *carry, "date", "project_month", "project_year", "mwh_gross_park", "cr", "mwh_delivered", "p_market", "cf", "p_wind_merchant",
        "eeg_on", "strike_cod_fixed", "p_wind_realised", "revenue_eur", "eeg_premium_eur", "strike_source",
    )
