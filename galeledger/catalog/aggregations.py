"""A*: grouped measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import month_start, quarter_start
from ..functions.expr import row_sum, total, weighted_mean
from ..operators import aggregate, quantiles, simulate
from ..operators.ordered import trailing_mean
from ..plans import costs
from ..plans.energy import availability, plain_hourly, status_hourly, status_ticks, turbine_hourly
from ..plans.market import auction_months, capture_history
from .base import Tables, query, r, rounded, sql
from .calendars import DENSE, SPARSE
from .joins import _TICKS


@query("a1_monthly_mean", sql("SELECT zone, CAST(date_trunc('month', ts) AS DATE) AS month, round(avg(price_eur_mwh), 6) AS price FROM zone_hourly GROUP BY ALL", "zone_hourly"))
def a1(t: Tables) -> DataFrame:
    return t.zone_hourly().groupBy("zone", month_start("ts").alias("month")).agg(r(F.avg("price_eur_mwh")).alias("price"))


@query("a2_sums_by_period", sql("""SELECT tso, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(year(o_orderdate) AS INT) AS year,
    round(coalesce(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN o_totalprice END), 0), 2) AS v FROM region_orders GROUP BY ALL""", "region_orders"))
def a2(t: Tables) -> DataFrame:
    part = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), F.col("o_totalprice"))
    return t.region_orders().groupBy("tso", quarter_start("o_orderdate").alias("quarter"), F.year("o_orderdate").alias("year")).agg(r(total(part), 2).alias("v"))


CAPTURE_SQL = sql("""SELECT zone, CAST(date_trunc('month', ts) AS DATE) AS month, round(avg(price_eur_mwh), 6) AS p_market, round(sum(wind_mwh), 2) AS wind_mwh,
    round(sum(price_eur_mwh * wind_mwh), 2) AS price_x_wind, count(*) AS hours_used, round(sum(price_eur_mwh * wind_mwh) / sum(wind_mwh), 6) AS p_capture,
    round(sum(price_eur_mwh * wind_mwh) / sum(wind_mwh) / avg(price_eur_mwh), 6) AS capture_factor FROM zone_hourly GROUP BY ALL""", "zone_hourly")


@query("a3_capture_factor", CAPTURE_SQL)
def a3(t: Tables) -> DataFrame:
    out = aggregate.capture_factor(t.zone_hourly(), ["zone"], "ts", "price_eur_mwh", "wind_mwh")
    out = rounded(out, ["p_market", "p_capture", "capture_factor"])
    return rounded(out, ["wind_mwh", "price_x_wind"], 2)


@query("a3_capture_history", sql("""SELECT zone, CAST(date_trunc('month', ts) AS DATE) AS month, round(avg(p), 6) AS p_market, round(sum(p * w) / sum(w), 6) AS p_capture, count(*) AS hours_used
    FROM (SELECT zone, ts, avg(price_eur_mwh) AS p, sum(wind_mwh) AS w FROM zone_hourly GROUP BY ALL) GROUP BY ALL""", "zone_hourly"))
def a3b(t: Tables) -> DataFrame:
    z = t.zone_hourly()
    prices = z.groupBy("zone", "ts").agg(F.avg("price_eur_mwh").alias("price_eur_mwh"))
    wind = z.groupBy("zone", "ts").agg(F.sum("wind_mwh").alias("wind_mwh"))
    out = capture_history(prices, wind, ["zone"])
    return out.select("zone", "month", r("p_market").alias("p_market"), r("p_capture").alias("p_capture"), "hours_used")


@query("a4_weighted_mean", """SELECT user_id, round(CASE WHEN sum(w) > 0 THEN sum(value * w) / sum(w) END, 6) AS m FROM (
    SELECT user_id, CASE WHEN event_type <> 'click' THEN value END AS value, coalesce(CASE WHEN event_type <> 'error' THEN CAST(event_id % 3 AS DOUBLE) END, 0) AS w FROM events) GROUP BY ALL""")
def a4(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.when(F.col("event_type") != "click", F.col("value")).alias("v"), F.when(F.col("event_type") != "error", (F.col("event_id") % 3).cast("double")).alias("w"))
    return rows.groupBy("user_id").agg(r(weighted_mean("v", "w")).alias("m"))


_COSTS = """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'planning' WHEN 'MACHINERY' THEN 'permitting' ELSE 'total' END AS phase, n_name AS state,
    avg(c_acctbal) AS mean, CAST(count(*) AS DOUBLE) AS projects FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


def _costs(t: Tables) -> DataFrame:
    phase = F.when(F.col("c_mktsegment") == "BUILDING", "planning").when(F.col("c_mktsegment") == "MACHINERY", "permitting").otherwise("total")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(phase.alias("phase"), F.col("n_name").alias("state")).agg(F.avg("c_acctbal").alias("mean_eur_per_kw"), F.count(F.lit(1)).cast("double").alias("projects"))


DEVELOPMENT_SQL = sql("""SELECT phase, round(v, 4) AS mean_eur_per_kw FROM (SELECT t - p - q AS precheck, p AS planning, q AS permitting, t AS total FROM (
    SELECT sum(mean * projects) FILTER (phase = 'planning') / sum(projects) FILTER (phase = 'planning') AS p, sum(mean * projects) FILTER (phase = 'permitting') / sum(projects) FILTER (phase = 'permitting') AS q,
    sum(mean * projects) FILTER (phase = 'total') / sum(projects) FILTER (phase = 'total') AS t FROM costs)) UNPIVOT (v FOR phase IN (precheck, planning, permitting, total))""", costs=_COSTS)


@query("a5_development_costs", DEVELOPMENT_SQL)
def a5(t: Tables) -> DataFrame:
    return rounded(aggregate.development_costs(_costs(t)), ["mean_eur_per_kw"], 4)


@query("a6_curtailment_rate", sql("SELECT tso, quarter, round(curt_mwh, 2) AS curtailed_mwh, round(prod_mwh, 2) AS production_mwh, round(cr, 6) AS curtailment_rate FROM tso_quarter", "tso_quarter"))
def a6(t: Tables) -> DataFrame:
    full = F.col("o_orderstatus") == "F"
    rows = t.region_orders().withColumn("quarter", quarter_start("o_orderdate"))
    out = aggregate.curtailment_rate(rows, ["tso", "quarter"], F.when(full, F.col("o_totalprice")), F.when(~full, F.col("o_totalprice")))
    return rounded(rounded(out, ["curtailed_mwh", "production_mwh"], 2), ["curtailment_rate"])


@query("a7_auction_mean", sql("SELECT tso, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice / 6.997::DOUBLE), 4) AS strike FROM region_orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL", "region_orders"))
def a7(t: Tables) -> DataFrame:
    rows = t.region_orders().select("tso", F.col("o_orderdate").cast("date").alias("d"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 6.997).alias("s"))
    return rounded(auction_months(rows, ["tso"], "d", "s"), ["strike"], 4)


@query("a8_opex_by_year", sql("""SELECT scenario_id, CAST(y AS INT) AS project_year, round(n_turbines * CASE turbine_type_id WHEN 0 THEN 6.0::DOUBLE WHEN 1 THEN 5.6::DOUBLE ELSE 4.2::DOUBLE END * 1000 * rate / 12 * m, 2) AS annual_opex_eur,
    CAST(rate AS DOUBLE) AS opex_eur_per_kw_year, CAST(m AS BIGINT) AS months_in_year FROM scenarios, (SELECT y, CASE WHEN y <= 10 THEN 53 ELSE 55 END AS rate, least(12, 230 - (y - 1) * 12) AS m FROM range(1, 21) AS h(y))""", "scenarios"))
def a8(t: Tables) -> DataFrame:
    return rounded(costs.opex_by_year(costs.with_capex(t.scenarios()), ["scenario_id"], 230), ["annual_opex_eur"], 2)


def available_telemetry(t: Tables) -> DataFrame:
    rows = t.telemetry().join(t.catalogue().select("turbine_type", "cut_in_ws"), "turbine_type")
    return rows.withColumn("is_available", availability("power_kw", "wind_speed_ms", "cut_in_ws"))


@query("a9_hourly_two_thirds", sql("""SELECT site_id, turbine_id, ts, round(energy_kwh, 6) AS energy_kwh, turbine_type FROM (
    SELECT h.*, CASE CAST(substr(turbine_id, 2) AS INT) % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS turbine_type FROM h) WHERE availability_fraction >= 2.0::DOUBLE / 3""", "telemetry", "spec", h=SPARSE))
def a9(t: Tables) -> DataFrame:
    out = aggregate.telemetry_hourly(available_telemetry(t), static=["turbine_type"])
    return out.select("site_id", "turbine_id", "ts", r("energy_kwh").alias("energy_kwh"), "turbine_type")


@query("a10_hourly_plain", sql(f"SELECT turbine_id, count(*) AS hours, count(*) FILTER (energy_kwh = 0 AND wind_speed_ms IS NULL) AS empty_hours, round(sum(energy_kwh), 2) AS energy_kwh FROM d GROUP BY ALL", "telemetry", d=DENSE))
def a10(t: Tables) -> DataFrame:
    out = plain_hourly(t.telemetry(), ["site_id", "turbine_id"])
    return out.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("hours"), F.count_if((F.col("energy_kwh") == 0) & F.col("wind_speed_ms").isNull()).alias("empty_hours"), r(F.sum("energy_kwh"), 2).alias("energy_kwh"))


FLAGS = """SELECT turbine_id, ts, b.ts IS NULL AS ok FROM ticks LEFT JOIN (SELECT DISTINCT turbine_id, k.ts FROM telemetry e JOIN ticks k USING (turbine_id)
    WHERE e.event_type = 'error' AND k.ts >= e.ts AND k.ts < e.ts + INTERVAL 30 MINUTE) b USING (turbine_id, ts)"""
STATUS_HOURS = "SELECT turbine_id, date_trunc('hour', ts) AS ts, avg(CAST(ok AS INT)) AS f FROM flags GROUP BY ALL"


def _status(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") != "error", "Full Performance")
    return t.telemetry().select("turbine_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 30 minutes")).alias("end_ts"), kind.alias("iec_category"))


@query("a11_status_hourly", sql("SELECT turbine_id, ts, round(f, 6) AS availability_fraction, f >= 2.0::DOUBLE / 3 AS is_available FROM sh", "telemetry", ticks=_TICKS, flags=FLAGS, sh=STATUS_HOURS))
def a11(t: Tables) -> DataFrame:
    return rounded(status_hourly(status_ticks(_status(t), ["turbine_id"]), ["turbine_id"]), ["availability_fraction"])


@query("a12_park_hourly", sql("""SELECT site_id, ts, round(avg(wind_speed_ms), 6) AS wind_speed_ms_mean, round(avg(energy_kwh), 6) AS energy_kwh_mean, round(avg(CAST(ok AS INT)), 6) AS availability_fraction,
    avg(CAST(ok AS INT)) >= 2.0::DOUBLE / 3 AS is_available FROM (SELECT d.*, coalesce(sh.f >= 2.0::DOUBLE / 3, false) AS ok FROM d LEFT JOIN sh USING (turbine_id, ts)) GROUP BY ALL""", "telemetry", d=DENSE, ticks=_TICKS, flags=FLAGS, sh=STATUS_HOURS))
def a12(t: Tables) -> DataFrame:
    status = _status(t).withColumn("site_id", F.concat(F.lit("S"), (F.substring("turbine_id", 2, 9).cast("int") % 2).cast("string")))
    keys = ["site_id", "turbine_id"]
    turbines = turbine_hourly(t.telemetry(), status, keys)
    return rounded(aggregate.park_hourly(turbines), ["wind_speed_ms_mean", "energy_kwh_mean", "availability_fraction"])


@query("a13_p95_per_quarter", "SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY ALL")
def a13(t: Tables) -> DataFrame:
    rows = t.lineitem.select(quarter_start("l_shipdate").alias("quarter"), "l_extendedprice")
    return rounded(quantiles.exact_quantiles(rows, ["quarter"], "l_extendedprice", {"p95": 0.95}), ["p95"], 4)


@query("a13_quantiles_large_groups", "SELECT l_returnflag AS k, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY ALL")
def a13b(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_returnflag").alias("k"), "l_extendedprice")
    out = quantiles.exact_quantiles(rows, ["k"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return rounded(out, ["p10", "p50", "p95"], 4)


@query("a14_seasonal_profile", sql("SELECT tso, CAST(s AS INT) AS season, round(m, 4) AS season_mean, round(m / avg(m) OVER (PARTITION BY tso), 6) AS season_factor FROM (SELECT tso, quarter(quarter) AS s, avg(wind_mwh) AS m FROM tso_quarter GROUP BY ALL)", "tso_quarter"))
def a14(t: Tables) -> DataFrame:
    out = aggregate.seasonal_profile(t.tso_quarter(), ["tso"], F.quarter("quarter"), "wind_mwh")
    return rounded(rounded(out, ["season_factor"]), ["season_mean"], 4)


@query("a15_trailing_level", sql("SELECT tso, round(avg(wind_mwh), 4) AS level FROM (SELECT * FROM tso_quarter QUALIFY row_number() OVER (PARTITION BY tso ORDER BY quarter DESC) <= 8) GROUP BY ALL", "tso_quarter"))
def a15(t: Tables) -> DataFrame:
    return rounded(trailing_mean(t.tso_quarter(), ["tso"], "quarter", "wind_mwh", 8), ["level"], 4)


@query("a16_monthly_spread", sql("""SELECT a.tso, CAST(k AS INT) AS season, round(coalesce(CASE WHEN sd <> 0 THEN sd END, al), 6) AS sigma FROM (SELECT tso, stddev_samp(price) AS al FROM rm GROUP BY ALL) a CROSS JOIN range(1, 13) AS h(k)
    LEFT JOIN (SELECT tso, month(month) AS s, stddev_samp(price) AS sd FROM rm GROUP BY ALL) b ON a.tso = b.tso AND b.s = k""", "region_month", rm="SELECT * FROM region_month WHERE month(month) <> 7"))
def a16(t: Tables) -> DataFrame:
    rows = t.region_month().where("month(month) <> 7")
    return rounded(aggregate.spread_by_season(rows, ["tso"], F.month("month"), "price"), ["sigma"])


@query("a17_window_median", sql("SELECT tso, round(median(price), 6) AS level, max(month) AS anchor FROM region_month WHERE month BETWEEN '1996-01-01' AND '1999-12-01' GROUP BY ALL", "region_month"))
def a17(t: Tables) -> DataFrame:
    rows = t.region_month().where("month BETWEEN date'1996-01-01' AND date'1999-12-01'")
    return rows.groupBy("tso").agg(r(F.median("price")).alias("level"), F.max("month").alias("anchor"))


@query("a18_percentile_bounds", sql("SELECT tso, round(quantile_cont(capture_factor, 0.01), 6) AS lo, round(quantile_cont(capture_factor, 0.99), 6) AS hi FROM region_month GROUP BY ALL", "region_month"))
def a18(t: Tables) -> DataFrame:
    out = aggregate.quantile_bands(t.region_month(), ["tso"], "capture_factor", (0.01, 0.99))
    return out.select("tso", r("p1").alias("lo"), r("p99").alias("hi"))


SIMS = """SELECT tso, s.sim, b.y, b.m, h.v AS energy_kwh FROM (SELECT tso, unnest(range(500)) AS sim FROM (SELECT DISTINCT tso FROM region_month)) s CROSS JOIN
    (SELECT y, m FROM range(2026, 2046) AS a(y), range(1, 13) AS c(m)) b
    JOIN (SELECT tso, month(month) AS m, wind_mwh AS v, row_number() OVER (PARTITION BY tso, month(month) ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY tso, month(month)) AS n FROM region_month) h USING (tso, m)
    WHERE h.i = CAST('0x' || substr(md5('42|' || tso || '|' || s.sim || '|' || b.y || '|' || b.m), 1, 8) AS BIGINT) % h.n"""


def simulated(t: Tables) -> DataFrame:
    hist = t.region_month().select("tso", F.year("month").alias("year"), F.month("month").alias("month"), F.col("wind_mwh").alias("energy_kwh"))
    return simulate.bootstrap_by_month(hist, ["tso"], 500, 2026, 20, 42)


@query("a19_quantile_bands", sql("SELECT tso, make_date(y, m, 1) AS ts, " + ", ".join(f"round(quantile_cont(energy_kwh, {p / 100}), 4) AS p{p}" for p in (10, 50, 90)) + " FROM sims GROUP BY ALL", "region_month", sims=SIMS))
def a19(t: Tables) -> DataFrame:
    return rounded(aggregate.quantile_bands(simulated(t), ["tso", "ts"], "energy_kwh"), ["p10", "p50", "p90"], 4)


REPRESENTATIVE = """SELECT tso, sim, total, md FROM (SELECT *, median(total) OVER (PARTITION BY tso) AS md FROM (SELECT tso, sim, sum(energy_kwh) AS total FROM sims GROUP BY ALL))
    QUALIFY row_number() OVER (PARTITION BY tso ORDER BY round(abs(total - md), 6), sim) = 1"""


@query("a20_representative_sim", sql("SELECT tso, CAST(sim AS INT) AS sim, round(total, 2) AS total, round(md, 2) AS median_total FROM rep", "region_month", sims=SIMS, rep=REPRESENTATIVE))
def a20(t: Tables) -> DataFrame:
    return rounded(simulate.representative_sim(simulated(t), ["tso"]), ["total", "median_total"], 2)


@query("a21_horizon_totals", sql("""SELECT tso, round(sum(load_mwh), 2) AS total, round(sum(load_mwh) / 20, 2) AS per_year, round(avg(cr), 6) AS mean_cr, min(quarter) AS q0, max(quarter) AS q1, count(*) AS n, round(stddev_samp(cr), 6) AS sd FROM tso_quarter GROUP BY ALL""", "tso_quarter"))
def a21(t: Tables) -> DataFrame:
    return t.tso_quarter().groupBy("tso").agg(
        r(F.sum("load_mwh"), 2).alias("total"), r(F.sum("load_mwh") / 20, 2).alias("per_year"), r(F.avg("cr")).alias("mean_cr"), F.min("quarter").alias("q0"),
        F.max("quarter").alias("q1"), F.count(F.lit(1)).alias("n"), r(F.stddev_samp("cr")).alias("sd"),
    )


@query("a22_null_report", """SELECT 'value' AS "column", count(*) FILTER (event_type = 'error') AS nulls, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS null_fraction FROM events
    UNION ALL SELECT 'ts', 0, 0 FROM (SELECT count(*) FROM events)""")
def a22(t: Tables) -> DataFrame:
    rows = t.events.select(F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "ts")
    return rounded(aggregate.null_report(rows), ["null_fraction"])


@query("a23_distinct", "SELECT DISTINCT user_id % 10 AS k, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events")
def a23(t: Tables) -> DataFrame:
    return t.events.select((F.col("user_id") % 10).alias("k"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("ts")).distinct()


@query("a24_net_export", """SELECT l_orderkey, l_linenumber, round(CASE WHEN f > 0.9 THEN coalesce(a, 0) + l_quantity - coalesce(c, 0) ELSE l_tax END, 6) AS net_export FROM (
    SELECT *, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice END AS a, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_discount END AS c,
    avg(CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_returnflag) AS f FROM lineitem) WHERE f > 0.9 OR l_linenumber > 1""")
def a24(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("file"), "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ts"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 1), F.col("l_tax")).alias("net"),
        F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("e1"), F.col("l_quantity").alias("e2"), F.when(F.col("l_linestatus") != "F", F.col("l_discount")).alias("i1"),
    )
    out = aggregate.net_export(rows, "net", ["e1", "e2"], ["i1"], ["file"], F.struct("l_orderkey", "l_linenumber").alias("k"))
    return out.where("net_export IS NOT NULL").select("k.*", r("net_export").alias("net_export"))


@query("a24_row_sum", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END + l_tax, 6) AS s FROM lineitem")
def a24b(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", r(row_sum([F.when(F.col("l_returnflag") != "A", F.col("l_quantity")), "l_tax"])).alias("s"))
