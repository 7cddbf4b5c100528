"""P*: filters, masks, clips and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import clip, floored_price, guarded_ratio, ratio_unless_zero, support_premium
from ..operators import checks
from ..plans.costs import opex_rate
from ..plans.energy import availability, with_targets, within_bounds
from ..sources.market import price_by_regime
from .base import Tables, query, r, sql


@query("p1_drop_nulls", "SELECT event_id, value FROM events WHERE event_type <> 'error'")
def p1(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rows.na.drop(subset=["value"])


@query("p2_time_range", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1998-12-01' GROUP BY ALL")
def p2(t: Tables) -> DataFrame:
    inside = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1998-12-01").cast("timestamp_ntz"))
    return t.orders.where(inside).groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("p3_dimension_filter", sql("SELECT zone, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region_orders WHERE tso = 'ASIA' GROUP BY ALL", "region_orders"))
def p3(t: Tables) -> DataFrame:
    return t.region_orders().where(F.col("tso") == "ASIA").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("p4_positive_only", sql("SELECT event_type, count(*) AS n FROM telemetry WHERE power_kw > 0 GROUP BY ALL", "telemetry"))
def p4(t: Tables) -> DataFrame:
    return t.telemetry().where(F.col("power_kw") > 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p5_quality_filter", sql("""SELECT turbine_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS removed,
    round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS removed_pct FROM telemetry GROUP BY ALL""", "telemetry"))
def p5(t: Tables) -> DataFrame:
    flag = F.when(F.col("event_type") == "error", 0).otherwise(1)
    _, stats = checks.quality_filter(t.telemetry().withColumn("qc", flag), ["turbine_id"], "qc")
    return stats.withColumn("removed_pct", r("removed_pct"))


@query("p6_sanity_bounds", sql("SELECT turbine_id, count(*) AS n, round(sum(power_kw), 2) AS power FROM telemetry WHERE power_kw BETWEEN 0 AND 1500 GROUP BY ALL", "telemetry"))
def p6(t: Tables) -> DataFrame:
    rows = within_bounds(t.telemetry(), "power_kw", 0.0, 1500.0)
    return rows.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("power_kw"), 2).alias("power"))


AVAILABLE = "NOT (power_kw IS NULL OR power_kw < 0 OR coalesce(wind_speed_ms >= cut_in_ws AND power_kw <= 0, false))"


@query("p7_availability", sql(f"SELECT event_id, {AVAILABLE} AS is_available FROM telemetry JOIN spec USING (turbine_type)", "telemetry", "spec"))
def p7(t: Tables) -> DataFrame:
    rows = t.telemetry().join(t.catalogue().select("turbine_type", "cut_in_ws"), "turbine_type")
    return rows.select("event_id", availability("power_kw", "wind_speed_ms", "cut_in_ws").alias("is_available"))


@query("p8_clip", "SELECT event_id, CASE WHEN event_type <> 'error' THEN greatest(10.0::DOUBLE, least(90.0::DOUBLE, value)) END AS v FROM events")
def p8(t: Tables) -> DataFrame:
    return t.events.select("event_id", clip(F.when(F.col("event_type") != "error", F.col("value")), 10, 90).alias("v"))


@query("p9_floor_price", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value WHEN event_type = 'error' THEN NULL ELSE greatest(value, 60) END AS realised,
    CASE WHEN user_id % 2 = 0 THEN 0 WHEN event_type = 'error' THEN NULL ELSE round(greatest(0, 60 - value), 6) END AS premium FROM events""")
def p9(t: Tables) -> DataFrame:
    strike = F.when(F.col("event_type") != "error", 60.0)
    rows = t.events.withColumn("on", F.col("user_id") % 2)
    return rows.select("event_id", floored_price("value", strike, "on").alias("realised"), r(support_premium("value", strike, "on")).alias("premium"))


@query("p10_regime_switch", "SELECT o_orderkey, CASE WHEN o_orderdate < '1998-10-01' THEN o_totalprice ELSE -o_totalprice END AS price FROM orders")
def p10(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", price_by_regime("o_orderdate", F.col("o_totalprice"), -F.col("o_totalprice"), "1998-10-01").alias("price"))


@query("p11_step_rate", "SELECT p_partkey, CAST(CASE WHEN p_size <= 10 THEN 53 ELSE 55 END AS DOUBLE) AS rate FROM part")
def p11(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", opex_rate("p_size").alias("rate"))


_TARGETS = """SELECT event_id, coalesce(e IS NOT NULL AND x IS NOT NULL AND w >= 3 + 0.5 AND w <= 0.9 * 20 AND x >= 50, false) AS valid, e, x FROM (
    SELECT event_id, CASE WHEN event_type <> 'error' THEN power_kw END AS e, CASE WHEN event_type <> 'view' THEN (power_kw + 20) * 0.9::DOUBLE END AS x, wind_speed_ms AS w FROM telemetry)"""


def _masked(t: Tables) -> DataFrame:
    rows = t.telemetry().select(
        "event_id", F.when(F.col("event_type") != "error", F.col("power_kw")).alias("energy_kwh"), F.col("wind_speed_ms").alias("era5_ws_hub"),
        F.when(F.col("event_type") != "view", (F.col("power_kw") + 20) * 0.9).alias("expected_energy_kwh"),
        F.lit(3.0).alias("_cut_in"), F.lit(20.0).alias("_rated_ws"),
    )
    return with_targets(rows)


@query("p12_validity_mask", sql("SELECT event_id, valid AS target_is_valid FROM m", "telemetry", m=_TARGETS))
def p12(t: Tables) -> DataFrame:
    return _masked(t).select("event_id", "target_is_valid")


@query("p13_conditional_columns", sql("""SELECT event_id, round(CASE WHEN valid THEN e / x END, 6) AS factor,
    round(CASE WHEN valid AND e / x > 0 THEN ln(e / x) END, 6) AS log_factor FROM m""", "telemetry", m=_TARGETS))
def p13(t: Tables) -> DataFrame:
    return _masked(t).select("event_id", r("target_correction_factor").alias("factor"), r("target_log_correction_factor").alias("log_factor"))


@query("p14_fallback_chain", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN o_orderpriority = '5-LOW' THEN 7 ELSE 1 END AS v FROM orders")
def p14(t: Tables) -> DataFrame:
    known = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    spec = F.when(F.col("o_orderpriority") == "5-LOW", 7.0)
    return t.orders.select("o_orderkey", F.coalesce(known, spec, F.lit(1.0)).alias("v"))


@query("p15_default_on_missing", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS v, o_orderstatus = 'P' AS flag FROM orders")
def p15(t: Tables) -> DataFrame:
    missing = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    flag = F.when(F.col("o_orderstatus") == "P", True)
    return t.orders.select("o_orderkey", F.coalesce(missing, F.lit(0.0)).alias("v"), F.coalesce(flag, F.lit(False)).alias("flag"))


@query("p16_guarded_ratio", """SELECT event_id, CASE WHEN value - 20 > 0 THEN round(value / (value - 20), 6) ELSE 0 END AS share,
    CASE WHEN user_id % 3 <> 0 THEN round(value / (user_id % 3), 6) END AS pct FROM events""")
def p16(t: Tables) -> DataFrame:
    return t.events.select("event_id", r(guarded_ratio("value", F.col("value") - 20, 0.0)).alias("share"), r(ratio_unless_zero("value", F.col("user_id") % 3)).alias("pct"))
