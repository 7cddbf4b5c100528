"""D*: calendar keys, horizons, expansion and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal
from ..operators import checks, timeline
from ..plans.energy import plain_hourly
from ..operators.aggregate import telemetry_hourly
from .base import Tables, query, r, rounded, sql
from .projections import AVAILABLE


@query("d1_month_start", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def d1(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", cal.month_start("o_orderdate").alias("month"))


@query("d2_quarter_key", """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(quarter(o_orderdate) AS INT) AS qn,
    CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INT) AS ord, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label FROM orders""")
def d2(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", cal.quarter_start(d).alias("q"), F.quarter(d).alias("qn"), cal.quarter_ordinal(d).alias("ord"), cal.quarter_name(d).alias("label"))


@query("d3_month_distance", """SELECT l_orderkey, l_linenumber, CAST((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS INT) AS months,
    round(((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate)) / 12, 6) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def d3(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", cal.months_between_starts("l_shipdate", "o_orderdate").alias("months"), r(cal.years_ahead("l_shipdate", "o_orderdate")).alias("years")
    )


_MOFF = "((year(l_shipdate) - year(DATE '1995-03-01')) * 12 + month(l_shipdate) - month(DATE '1995-03-01'))"


@query("d4_project_year", f"SELECT l_orderkey, l_linenumber, CAST({_MOFF} + 1 AS INT) AS pm, CAST(floor({_MOFF} / 12) + 1 AS INT) AS py FROM lineitem")
def d4(t: Tables) -> DataFrame:
    cod = F.lit("1995-03-01").cast("date")
    return t.lineitem.select("l_orderkey", "l_linenumber", cal.project_month("l_shipdate", cod).alias("pm"), cal.project_year("l_shipdate", cod).alias("py"))


@query("d5_month_horizon", sql("SELECT scenario_id, CAST(cod + INTERVAL (k) MONTH AS DATE) AS month FROM scenarios, range(240) AS h(k)", "scenarios"))
def d5(t: Tables) -> DataFrame:
    return timeline.month_horizon(t.scenarios().select("scenario_id", "cod"), "cod", 240).select("scenario_id", "month")


@query("d6_quarter_horizon", sql("""SELECT tso, CAST(q AS DATE) AS quarter FROM (SELECT tso, unnest(generate_series(min(quarter)::TIMESTAMP, TIMESTAMP '2046-10-01', INTERVAL 3 MONTH)) AS q
    FROM tso_quarter GROUP BY tso)""", "tso_quarter"))
def d6(t: Tables) -> DataFrame:
    starts = t.tso_quarter().groupBy("tso").agg(F.min("quarter").alias("a"))
    return timeline.quarter_horizon(starts, "a", F.lit("2046-10-01").cast("date")).select("tso", "quarter")


_Q3 = "SELECT tso, CAST(quarter + INTERVAL (k) MONTH AS DATE) AS month, quarter, {v} AS v FROM {src}, range(3) AS h(k)"
_QZ = """SELECT tso, zone, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, sum(o_totalprice) AS v FROM region_orders GROUP BY ALL"""


def _zone_quarters(t: Tables) -> DataFrame:
    return t.region_orders().groupBy("tso", "zone", cal.quarter_start("o_orderdate").alias("quarter")).agg(F.sum("o_totalprice").alias("v"))


@query("d7_quarter_to_months_mean", sql("SELECT tso, month, round(avg(v), 4) AS v FROM m GROUP BY ALL", "region_orders", z=_QZ, m=_Q3.format(v="v", src="z")))
def d7a(t: Tables) -> DataFrame:
    return rounded(timeline.quarter_to_months(_zone_quarters(t), ["tso"], "quarter", "v", "mean"), ["v"], 4)


@query("d7_quarter_to_months_split", sql("SELECT tso, month, round(sum(v / 3), 4) AS v FROM m GROUP BY ALL", "region_orders", z=_QZ, m=_Q3.format(v="v", src="z")))
def d7b(t: Tables) -> DataFrame:
    return rounded(timeline.quarter_to_months(_zone_quarters(t), ["tso"], "quarter", "v", "split"), ["v"], 4)


@query("d7_quarter_to_months_first", sql("SELECT tso, month, round(arg_min(v, zone), 4) AS v FROM m GROUP BY ALL", "region_orders", z=_QZ,
    m="SELECT tso, zone, CAST(quarter + INTERVAL (k) MONTH AS DATE) AS month, v FROM z, range(3) AS h(k)"))
def d7c(t: Tables) -> DataFrame:
    return rounded(timeline.quarter_to_months(_zone_quarters(t), ["tso"], "quarter", "v", "first", order="zone"), ["v"], 4)


@query("d8_ten_minute_timeline", sql("""SELECT turbine_id, ts FROM (SELECT turbine_id, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, min(ts)),
    CASE WHEN time_bucket(INTERVAL 10 MINUTE, max(ts)) = max(ts) THEN max(ts) ELSE time_bucket(INTERVAL 10 MINUTE, max(ts)) + INTERVAL 10 MINUTE END, INTERVAL 10 MINUTE)) AS ts
    FROM telemetry GROUP BY turbine_id)""", "telemetry"))
def d8(t: Tables) -> DataFrame:
    return timeline.ten_minute_timeline(t.telemetry(), ["turbine_id"], "ts", "ts")


DENSE = """SELECT s.site_id, s.turbine_id, s.ts, h.wind AS wind_speed_ms, coalesce(h.power, 0) / 6 AS energy_kwh FROM (
    SELECT site_id, turbine_id, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR)) AS ts FROM (SELECT site_id, turbine_id, min(ts) AS a, max(ts) AS b FROM telemetry GROUP BY ALL)) s
    LEFT JOIN (SELECT site_id, turbine_id, date_trunc('hour', ts) AS ts, avg(wind_speed_ms) AS wind, sum(power_kw) AS power FROM telemetry GROUP BY ALL) h
    USING (site_id, turbine_id, ts)"""


@query("d9_hourly_dense", sql("SELECT site_id, turbine_id, ts, round(wind_speed_ms, 6) AS wind_speed_ms, round(energy_kwh, 6) AS energy_kwh FROM d", "telemetry", d=DENSE))
def d9(t: Tables) -> DataFrame:
    return rounded(plain_hourly(t.telemetry(), ["site_id", "turbine_id"]), ["wind_speed_ms", "energy_kwh"])


SPARSE = f"""SELECT site_id, turbine_id, date_trunc('hour', ts) AS ts, avg(CASE WHEN {AVAILABLE} THEN 1 ELSE 0 END) AS availability_fraction,
    sum(power_kw) / 6 AS energy_kwh, avg(wind_speed_ms) AS wind_speed_ms FROM telemetry JOIN spec USING (turbine_type) GROUP BY ALL"""


@query("d10_hourly_sparse", sql("""SELECT site_id, turbine_id, ts, round(availability_fraction, 6) AS availability_fraction, round(energy_kwh, 6) AS energy_kwh,
    round(wind_speed_ms, 6) AS wind_speed_ms FROM h WHERE availability_fraction >= 2.0::DOUBLE / 3""", "telemetry", "spec", h=SPARSE))
def d10(t: Tables) -> DataFrame:
    from .aggregations import available_telemetry

    return rounded(telemetry_hourly(available_telemetry(t)), ["availability_fraction", "energy_kwh", "wind_speed_ms"])


@query("d11_month_min_count", """SELECT 'T' || (user_id % 10) AS turbine_id, CAST(date_trunc('month', ts) AS DATE) AS month, round(sum(value), 4) AS value
    FROM events WHERE event_type <> 'error' GROUP BY ALL HAVING count(*) >= 72""")
def d11(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("turbine_id"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rounded(timeline.monthly_if_complete(rows, ["turbine_id"], "ts", "value", 72), ["value"], 4)


@query("d12_time_zone", "SELECT event_id, CASE WHEN ts < '2024-03-31 01:00:00' THEN ts + INTERVAL 1 HOUR ELSE ts + INTERVAL 2 HOUR END AS local_ts FROM events")
def d12(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Berlin").cast("timestamp_ntz").alias("local_ts"))


@query("d13_cyclical", """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_cos,
    round(sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) + 0 AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 6) + 0 AS doy_cos FROM events""")
def d13(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[(r(c) + 0).alias(n) for n, c in cal.cyclical("ts").items()])


@query("d14_dummies", "SELECT o_orderkey, " + ", ".join(f"CASE WHEN quarter(o_orderdate) = {k} THEN 1.0::DOUBLE ELSE 0 END AS m_{k}" for k in (2, 3, 4)) + " FROM orders")
def d14(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in cal.season_dummies(F.quarter("o_orderdate"), range(1, 5)).items()])


@query("d15_cadence", sql("""SELECT turbine_id, round(m, 6) AS median_minutes, CASE WHEN m BETWEEN 5 AND 15 THEN '10min' WHEN m BETWEEN 45 AND 75 THEN 'hourly' ELSE 'unclassified' END AS cadence
    FROM (SELECT turbine_id, quantile_cont(d, 0.5) AS m FROM (SELECT turbine_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY turbine_id ORDER BY ts))) / 60e6 AS d FROM telemetry)
    GROUP BY ALL)""", "telemetry"))
def d15(t: Tables) -> DataFrame:
    return checks.cadence(t.telemetry(), ["turbine_id"], "ts").select("turbine_id", r("median_minutes").alias("median_minutes"), "cadence")
