"""J*: equi, as-of, interval, range, spatial, semi, anti and outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import month_start
from ..operators import aggregate, asof, checks, curves, grid, timeline
from ..plans.energy import status_ticks
from ..sources.catalogue import attach_turbines
from .base import GRID_STEP, Tables, query, r, rounded, sql


@query("j1_equi_join", sql("""SELECT zone, ts, count(*) AS n, round(sum(price_eur_mwh * o) / 1000000, 4) AS v FROM zone_hourly
    JOIN (SELECT o_orderdate AS ts, sum(o_totalprice) AS o FROM orders GROUP BY ALL) USING (ts) GROUP BY ALL""", "zone_hourly"))
def j1(t: Tables) -> DataFrame:
    load = t.orders.groupBy(F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("o"))
    return t.zone_hourly().join(load, "ts").groupBy("zone", "ts").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("price_eur_mwh") * F.col("o")) / 1_000_000, 4).alias("v"))


@query("j2_panel_join", sql("""SELECT tso, q.quarter, round(wind_mwh / load_mwh, 6) AS s, round(w, 2) AS w, round(x, 6) AS export FROM tso_quarter q
    JOIN (SELECT tso, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, sum(o_totalprice) AS w FROM region_orders WHERE o_orderstatus = 'F' GROUP BY ALL) f USING (tso, quarter)
    JOIN (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, avg(l_discount) AS x FROM lineitem GROUP BY ALL) e ON e.quarter = q.quarter""", "tso_quarter"))
def j2(t: Tables) -> DataFrame:
    q = F.trunc(F.col("o_orderdate").cast("date"), "QUARTER").alias("quarter")
    full = t.region_orders().where("o_orderstatus = 'F'").groupBy("tso", q).agg(F.sum("o_totalprice").alias("w"))
    export = t.lineitem.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "QUARTER").alias("quarter")).agg(F.avg("l_discount").alias("x"))
    rows = t.tso_quarter().join(full, ["tso", "quarter"]).join(export, "quarter")
    return rows.select("tso", "quarter", r("S").alias("s"), r("w", 2).alias("w"), r("x").alias("export"))


@query("j3_completeness_guard", sql("""SELECT scenario_id, min(date) AS first_missing, count(*) AS n_missing FROM (
    SELECT scenario_id, CAST(cod + INTERVAL (k) MONTH AS DATE) AS date FROM scenarios, range(240) AS h(k)) LEFT JOIN market_actual USING (date) WHERE p IS NULL GROUP BY ALL""", "scenarios", "market_actual"))
def j3(t: Tables) -> DataFrame:
    spine = timeline.month_horizon(t.scenarios().select("scenario_id", "cod"), "cod", 240, "date")
    actual = t.orders.groupBy(month_start("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("p"))
    return checks.first_missing(spine.join(actual, "date", "left"), ["scenario_id"], "date", "p")


@query("j4_missing_months", sql("""SELECT zone, min(date) AS first_missing, count(*) AS n_missing FROM (SELECT zone, CAST(DATE '1995-01-01' + INTERVAL (k) MONTH AS DATE) AS date
    FROM (SELECT DISTINCT n_name AS zone FROM nation), range(84) AS h(k)) s WHERE NOT EXISTS (SELECT 1 FROM zone_hourly z WHERE z.zone = s.zone AND date_trunc('month', z.ts) = s.date)
    GROUP BY ALL""", "zone_hourly"))
def j4(t: Tables) -> DataFrame:
    spine = timeline.month_horizon(t.nation.select(F.col("n_name").alias("zone"), F.lit("1995-01-01").cast("date").alias("a")), "a", 84, "date")
    have = t.zone_hourly().select("zone", month_start("ts").alias("date"))
    return checks.missing_from_spine(spine.select("zone", "date"), have, ["zone"], "date")


@query("j5_asof_backward", sql("SELECT o_orderkey, s.strike FROM orders ASOF LEFT JOIN (SELECT l_suppkey % 4 AS k, l_shipdate, round(max(l_extendedprice) FILTER (l_quantity > 40), 2) AS strike FROM lineitem GROUP BY ALL HAVING strike IS NOT NULL) s ON s.k = o_custkey % 4 AND s.l_shipdate <= o_orderdate"))
def j5(t: Tables) -> DataFrame:
    dear = F.when(F.col("l_quantity") > 40, F.col("l_extendedprice"))  # days without one have no strike and are passed over
    strikes = t.lineitem.groupBy((F.col("l_suppkey") % 4).alias("k"), F.col("l_shipdate").alias("ts")).agg(r(F.max(dear), 2).alias("strike"))
    probes = t.orders.select("o_orderkey", (F.col("o_custkey") % 4).alias("k"), F.col("o_orderdate").alias("ts"))
    return asof.asof_backward(probes, strikes, ["k"], "ts", ["strike"]).select("o_orderkey", "strike")


_NEAR = """SELECT p.event_id, v.event_id AS hit, v.value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), v.ts) AS rn
    FROM (SELECT * FROM events WHERE event_type = 'view') p LEFT JOIN
    (SELECT user_id % 10 AS k, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) v
    ON v.k = p.user_id % 10 AND v.ts BETWEEN p.ts - INTERVAL 45 MINUTE AND p.ts + INTERVAL 45 MINUTE"""


@query("j6_asof_nearest", sql("SELECT event_id, hit, value FROM m WHERE rn = 1", m=_NEAR))
def j6(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.col("user_id") % 10)
    right = rows.where("event_type = 'click'").select("k", "ts", F.col("event_id").alias("hit"), "value")
    left = rows.where("event_type = 'view'").select("event_id", "k", "ts")
    return asof.asof_nearest(left, right, ["k"], "ts", ["hit", "value"], 45 * 60, tie=["hit"]).select("event_id", "hit", "value")


@query("j7_full_outer", sql("""SELECT coalesce(a.d, b.d) AS d, round(a.v, 2) AS view, round(b.v, 2) AS error FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS d, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) a
    FULL JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS d, sum(value) AS v FROM events WHERE event_type = 'error' GROUP BY ALL) b ON a.d = b.d"""))
def j7(t: Tables) -> DataFrame:
    # Long rows and one pivoted aggregate give the outer-joined columns without a join.
    rows = t.events.where("event_type IN ('view', 'error')").select(F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("d"), "event_type", "value")
    return rounded(rows.groupBy("d").pivot("event_type", ["view", "error"]).agg(F.sum("value")), ["view", "error"], 2)


_TICKS = """SELECT turbine_id, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, min(ts)), time_bucket(INTERVAL 10 MINUTE, max(ts + INTERVAL 30 MINUTE) + INTERVAL 599999999 MICROSECOND), INTERVAL 10 MINUTE)) AS ts
    FROM telemetry GROUP BY turbine_id"""


@query("j8_interval_flag", sql("""SELECT turbine_id, ts, b.ts IS NULL AS is_available FROM ticks LEFT JOIN
    (SELECT DISTINCT turbine_id, k.ts FROM telemetry e JOIN ticks k USING (turbine_id) WHERE e.event_type = 'error' AND k.ts >= e.ts AND k.ts < e.ts + INTERVAL 30 MINUTE) b USING (turbine_id, ts)""", "telemetry", ticks=_TICKS))
def j8(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") != "error", "Full Performance")
    status = t.telemetry().select("turbine_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 30 minutes")).alias("end_ts"), kind.alias("iec_category"))
    return status_ticks(status, ["turbine_id"])


@query("j9_lookup_with_failure", sql("""SELECT event_id, turbine_type, CAST(rated_power_kw AS DOUBLE) AS rated_power_kw, CAST(90 + 10 * CAST(substr(turbine_id, 2) AS INT) AS DOUBLE) AS hub_height_m, 50.0::DOUBLE AS lat FROM telemetry JOIN spec USING (turbine_type)""", "telemetry", "spec"))
def j9(t: Tables) -> DataFrame:
    meta = t.telemetry().select("turbine_id", "turbine_type").distinct().withColumns({
        "hub_height_m": 90.0 + 10 * F.substring("turbine_id", 2, 9).cast("int"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double"),
    })
    checks.assert_none(meta.join(t.catalogue(), "turbine_type", "left_anti"), "turbine type not in catalogue")
    rows = attach_turbines(t.telemetry().drop("turbine_type"), meta, t.catalogue(), site_lat=50.0, site_lon=10.0)
    return rows.select("event_id", "turbine_type", "rated_power_kw", "hub_height_m", "lat")


@query("j10_season_default", sql("""SELECT q.tso, q.quarter, round(coalesce(f, 1.0), 6) AS factor FROM tso_quarter q LEFT JOIN (
    SELECT tso, s, m / avg(m) OVER (PARTITION BY tso) AS f FROM (SELECT tso, quarter(quarter) AS s, avg(wind_mwh) AS m FROM tso_quarter WHERE quarter(quarter) <> 2 GROUP BY ALL)) p
    ON p.tso = q.tso AND p.s = quarter(q.quarter)""", "tso_quarter"))
def j10(t: Tables) -> DataFrame:
    q = t.tso_quarter()
    profile = aggregate.seasonal_profile(q.where("quarter(quarter) <> 2"), ["tso"], F.quarter("quarter"), "wind_mwh")
    rows = q.withColumn("season", F.quarter("quarter")).join(profile, ["tso", "season"], "left")
    return rows.select("tso", "quarter", r(F.coalesce("season_factor", F.lit(1.0))).alias("factor"))


@query("j11_fan_out", sql("""SELECT tso, scenario, count(*) AS n, round(sum(load_mwh * g), 2) AS v FROM tso_quarter, (VALUES ('low', 0.005::DOUBLE), ('base', 0.015::DOUBLE), ('high', 0.03::DOUBLE)) AS s(scenario, g) GROUP BY ALL""", "tso_quarter"))
def j11(t: Tables) -> DataFrame:
    from ..sources.catalogue import WIND_SCENARIOS

    # A fan-out by a fixed parameter list is an explode, not a join.
    fan = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(g).alias("g")) for s, g in WIND_SCENARIOS.items()]))
    rows = t.tso_quarter().select("tso", "load_mwh", fan.alias("s")).select("tso", "load_mwh", "s.*")
    return rows.groupBy("tso", "scenario").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("load_mwh") * F.col("g")), 2).alias("v"))


EXPECTED = """SELECT event_id, CASE WHEN w < (SELECT min(v) FROM curve c WHERE c.turbine_type = e.turbine_type) THEN 0
    WHEN w > (SELECT max(v) FROM curve c WHERE c.turbine_type = e.turbine_type) THEN (SELECT max(p) FROM curve c WHERE c.turbine_type = e.turbine_type)
    ELSE (SELECT max(p0 + (w - v0) * (p1 - p0) / (v1 - v0)) FROM (SELECT turbine_type, v AS v0, p AS p0, lead(v) OVER s AS v1, lead(p) OVER s AS p1, lead(v, 2) OVER s AS v2 FROM curve WINDOW s AS (PARTITION BY turbine_type ORDER BY i)) g
      WHERE g.turbine_type = e.turbine_type AND v1 IS NOT NULL AND w >= v0 AND (w < v1 OR (v2 IS NULL AND w = v1))) END AS x
    FROM (SELECT event_id, turbine_type, CASE WHEN event_type <> 'error' THEN CAST(event_id % 120 AS DOUBLE) / 4 END AS w FROM telemetry) e"""


@query("j12_power_curve", sql("SELECT event_id, round(x, 6) AS expected_kwh FROM m", "telemetry", "curve", m=EXPECTED))
def j12(t: Tables) -> DataFrame:
    speed = F.when(F.col("event_type") != "error", (F.col("event_id") % 120).cast("double") / 4)
    rows = t.telemetry().select("event_id", "turbine_type", speed.alias("w"))
    return curves.expected_power(rows, curves.curve_points(t.catalogue()), "w").select("event_id", r("expected_kwh").alias("expected_kwh"))


@query("j13_bilinear", sql("SELECT site_id, time, round(u10, 6) AS u10, round(t2m, 6) AS t2m FROM site_grid", "site_grid"))
def j13(t: Tables) -> DataFrame:
    return rounded(grid.interpolate_grid(t.sites(), t.climate(), ["site_id"], ["u10", "t2m"], GRID_STEP), ["u10", "t2m"])


@query("j14_yearly_zero_fill", """SELECT n_name AS zone, CAST(h.y AS INT) AS year, round(coalesce(v, 0), 2) AS revenue, round(coalesce(w, 0), 2) AS opex, round(coalesce(v, 0) - coalesce(w, 0), 2) AS surplus
    FROM nation CROSS JOIN range(1995, 2003) AS h(y) LEFT JOIN (SELECT s_nationkey AS k, year(l_shipdate) AS y, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) a
    ON a.k = n_nationkey AND a.y = h.y LEFT JOIN (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(o_totalprice) / 6.997::DOUBLE AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) b
    ON b.k = n_nationkey AND b.y = h.y""")
def j14(t: Tables) -> DataFrame:
    spine = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("zone"), F.explode(F.sequence(F.lit(1995), F.lit(2002))).alias("year"))
    revenue = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("k"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("v"))
    opex = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 6.997).alias("w"))
    rows = spine.join(revenue, ["k", "year"], "left").join(opex, ["k", "year"], "left").na.fill(0.0, ["v", "w"])
    return rows.select("zone", "year", r("v", 2).alias("revenue"), r("w", 2).alias("opex"), r(F.col("v") - F.col("w"), 2).alias("surplus"))


@query("j15_left_panel", sql("""SELECT m.tso, m.month, round(m.price, 6) AS price, round(s.strike, 6) AS strike, round(s.strike / m.price, 6) AS markup FROM region_month m
    LEFT JOIN strike_series s ON s.date = m.month""", "region_month", "strike_series"))
def j15(t: Tables) -> DataFrame:
    rows = t.region_month().join(t.strike_series().withColumnRenamed("date", "month"), "month", "left")
    return rows.select("tso", "month", r("price").alias("price"), r("strike").alias("strike"), r(F.col("strike") / F.col("price")).alias("markup"))


@query("j16_semi_join", sql("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) IN (SELECT date FROM strike_series WHERE strike IS NOT NULL)", "strike_series"))
def j16(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("date", month_start("o_orderdate")).join(t.strike_series().where("strike IS NOT NULL"), "date", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("j17_aligned_measures", sql("SELECT zone, CAST(date_trunc('month', ts) AS DATE) AS month, round(avg(price_eur_mwh), 6) AS p, round(sum(wind_mwh), 2) AS w FROM zone_hourly GROUP BY ALL", "zone_hourly"))
def j17(t: Tables) -> DataFrame:
    return t.zone_hourly().groupBy("zone", month_start("ts").alias("month")).agg(r(F.avg("price_eur_mwh")).alias("p"), r(F.sum("wind_mwh"), 2).alias("w"))
