"""A table of requests in, a table of answers out: every scenario valued, or rejected with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .finance import cash_flows, financed, valued
from .revenue import FORECAST_MONTHS, driver_panel, monthly_revenue, rejected_scenarios


def answered(
    scenarios: DataFrame, market: DataFrame, capture: DataFrame, curtailment: DataFrame, strikes: DataFrame, production: DataFrame | None = None,
    key: str = "scenario_id", months: int = FORECAST_MONTHS,
) -> DataFrame:
    """One row per scenario: its columns, cost, financing, cash flow and valuation, and ``reject_reasons``.

    A scenario that the drivers or its production cannot serve keeps its columns and has its reasons; what depends on revenue is NULL then.
    ``production`` (key, date, mwh) replaces the constant monthly energy of the scenarios.
    """
    panel = settle(driver_panel(scenarios, market, capture, curtailment, strikes, months), "panel")
    rejects = rejected_scenarios(scenarios, production, panel, key, months)
    reasons = settle(rejects.groupBy(key).agg(F.array_sort(F.collect_set("reject_reason")).alias("reject_reasons"), F.min("first_missing").alias("first_missing")), "rejects")
    served = scenarios.join(reasons, key, "left_anti")
    monthly = monthly_revenue(served, panel, production, key)
    flows = cash_flows(financed(scenarios), monthly, key, months // 12)
    out = valued(flows).join(reasons, key, "left")
    return out.withColumn("flow_reason", F.when(F.col("reject_reasons").isNull(), F.col("flow_reason")))
