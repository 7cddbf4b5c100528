"""W*, O*, R*, U*: ordered operators, limits, reshaping and union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import month_start
from ..operators import ordered, reshape
from .base import Tables, query, r, rounded, sql


@query("w1_lag_row", sql("SELECT tso, month, round(lag(price) OVER (PARTITION BY tso ORDER BY month), 6) AS price_lag FROM region_month", "region_month"))
def w1(t: Tables) -> DataFrame:
    return t.region_month().select("tso", "month", r(ordered.lag_row("price", ["tso"], "month")).alias("price_lag"))


@query("w1_lag_raw", sql("SELECT event_id, lag(value) OVER (PARTITION BY user_id % 3 ORDER BY ts, value) AS prev FROM events"))
def w1b(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("user_id") % 3).alias("k"), "ts", "value")
    return ordered.lag_raw(rows, ["k"], "ts", "value", "prev").select("event_id", "prev")


@query("w1_month_gaps", sql("""SELECT zone, month, CAST(step - 1 AS INT) AS gap_months FROM (SELECT zone, month, date_diff('month', lag(month) OVER (PARTITION BY zone ORDER BY month), month) AS step
    FROM (SELECT zone, CAST(date_trunc('month', ts) AS DATE) AS month FROM zone_hourly GROUP BY ALL HAVING sum(CASE WHEN wind_mwh > 49 THEN 1 ELSE 0 END) > 0)) WHERE step > 1""", "zone_hourly"))
def w1c(t: Tables) -> DataFrame:
    # A month of a zone is known where an hour of it exceeds 49 MWh.
    known = t.zone_hourly().groupBy("zone", month_start("ts").alias("month")).agg(F.count_if(F.col("wind_mwh") > 49).alias("n"))
    rows = known.where("n > 0").select("zone", "month")
    return ordered.month_gaps(rows, ["zone"], "month").select("zone", "month", F.col("gap_months").cast("int").alias("gap_months"))


@query("w2_keep_last", "SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderpriority DESC, o_orderkey DESC) = 1")
def w2(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    return ordered.keep_last(rows, ["o_custkey", "o_orderdate"], ["o_orderpriority", "o_orderkey"]).drop("o_orderpriority")


@query("w3_rolling_12", sql("SELECT tso, month, round(avg(price) OVER (PARTITION BY tso ORDER BY month ROWS 11 PRECEDING), 6) AS roll FROM region_month", "region_month"))
def w3(t: Tables) -> DataFrame:
    return t.region_month().select("tso", "month", r(ordered.rolling_mean("price", ["tso"], "month", 12)).alias("roll"))


@query("w4_rolling_24_filled", sql("""SELECT m.tso, m.month, round(last_value(roll IGNORE NULLS) OVER (PARTITION BY m.tso ORDER BY m.month), 6) AS strike FROM region_month m
    LEFT JOIN (SELECT tso, month, avg(price) OVER (PARTITION BY tso ORDER BY month ROWS 23 PRECEDING) AS roll FROM region_month WHERE month(month) IN (2, 5, 8, 11)) a USING (tso, month)""", "region_month"))
def w4(t: Tables) -> DataFrame:
    months = t.region_month()
    sparse = months.where(F.month("month").isin(2, 5, 8, 11)).select("tso", "month", ordered.rolling_mean("price", ["tso"], "month", 24).alias("roll"))
    return months.select("tso", "month").join(sparse, ["tso", "month"], "left").select("tso", "month", r(ordered.filled("roll", ["tso"], "month", backward=False)).alias("strike"))


@query("w5_fill_both_ways", sql("""SELECT tso, month, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY tso ORDER BY month),
    first_value(v IGNORE NULLS) OVER (PARTITION BY tso ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v
    FROM (SELECT tso, month, CASE WHEN month(month) IN (3, 7, 11) THEN price END AS v FROM region_month)""", "region_month"))
def w5(t: Tables) -> DataFrame:
    rows = t.region_month().select("tso", "month", F.when(F.month("month").isin(3, 7, 11), F.col("price")).alias("v"))
    return rows.select("tso", "month", r(ordered.filled("v", ["tso"], "month")).alias("v"))


@query("w6_row_trend", sql("SELECT tso, month, CAST(row_number() OVER (PARTITION BY tso ORDER BY month) - 1 AS INT) AS trend FROM region_month", "region_month"))
def w6(t: Tables) -> DataFrame:
    return t.region_month().select("tso", "month", ordered.row_trend(["tso"], "month").alias("trend"))


@query("w6_row_number_raw", "SELECT event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS pos FROM events")
def w6b(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("user_id") % 3).alias("k"), "ts")
    return ordered.row_number_raw(rows, ["k"], "ts", "pos", tie=["event_id"]).select("event_id", "pos")


@query("w7_group_mean", sql("SELECT tso, month, round(price / avg(price) OVER (PARTITION BY tso), 6) AS share FROM region_month", "region_month"))
def w7(t: Tables) -> DataFrame:
    return t.region_month().select("tso", "month", r(F.col("price") / F.avg("price").over(Window.partitionBy("tso"))).alias("share"))


@query("w8_last_and_first", sql("SELECT tso, max(month) AS last_month, round(arg_max(price, month), 6) AS last_price, round(arg_min(price, month), 6) AS first_price FROM region_month GROUP BY ALL", "region_month"))
def w8(t: Tables) -> DataFrame:
    return t.region_month().groupBy("tso").agg(F.max("month").alias("last_month"), r(F.max_by("price", "month")).alias("last_price"), r(F.min_by("price", "month")).alias("first_price"))


@query("w9_first_over_threshold", """SELECT k, coalesce(min(l_quantity) FILTER (p >= 0.99::DOUBLE * top), max(l_quantity)) AS speed FROM (
    SELECT *, max(p) OVER (PARTITION BY k) AS top FROM (SELECT l_suppkey AS k, l_quantity, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL)) GROUP BY k""")
def w9(t: Tables) -> DataFrame:
    from ..operators.curves import rated_speed

    points = t.lineitem.groupBy(F.col("l_suppkey").alias("turbine_type"), F.col("l_quantity").alias("v")).agg(F.max("l_extendedprice").alias("p"))
    rated = points.groupBy("turbine_type").agg(F.max("p").alias("rated_power_kw"))
    return rated_speed(points.withColumn("i", F.col("v")), rated).select(F.col("turbine_type").alias("k"), F.col("rated_ws").alias("speed"))


@query("o1_sort", sql("SELECT tso, quarter, round(cr, 6) AS cr FROM tso_quarter ORDER BY tso, quarter", "tso_quarter"))
def o1(t: Tables) -> DataFrame:
    return t.tso_quarter().select("tso", "quarter", r("cr").alias("cr")).orderBy("tso", "quarter")


@query("o2_head_per_key", sql("SELECT zone, ts, l FROM (SELECT n_name AS zone, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS l FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts, l) <= 24"))
def o2(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("zone"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("l"))
    return ordered.first_rows(rows, ["zone"], [F.col("ts"), F.col("l")], 24)


@query("o3_tail_per_key", sql("SELECT tso, quarter, round(wind_mwh, 2) AS wind_mwh FROM tso_quarter QUALIFY row_number() OVER (PARTITION BY tso ORDER BY quarter DESC) <= 8", "tso_quarter"))
def o3(t: Tables) -> DataFrame:
    return rounded(ordered.last_rows(t.tso_quarter().select("tso", "quarter", "wind_mwh"), ["tso"], "quarter", 8), ["wind_mwh"], 2)


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("r1_melt", sql("SELECT tso, quarter, measure, round(v, 2) AS v FROM (SELECT tso, quarter, wind_mwh, load_mwh FROM tso_quarter) UNPIVOT (v FOR measure IN (wind_mwh, load_mwh))", "tso_quarter"))
def r1(t: Tables) -> DataFrame:
    return rounded(reshape.melt(t.tso_quarter(), ["tso", "quarter"], ["wind_mwh", "load_mwh"], "measure", "v"), ["v"], 2)


@query("r2_melt_measures", sql("""SELECT quarter, tso, round(cr, 6) AS cr, round(prod_mwh, 2) AS prod, round(curt_mwh, 2) AS curt FROM tso_quarter""", "tso_quarter"))
def r2(t: Tables) -> DataFrame:
    parts = [("_curtailment_rate", "cr"), ("_production_mwh", "prod_mwh"), ("_curtailed_mwh", "curt_mwh")]
    groups = _REGIONS
    wide = t.tso_quarter().groupBy("quarter").agg(*[F.max(F.when(F.col("tso") == g, F.col(c))).alias(g + s) for g in groups for s, c in parts])
    long = reshape.melt_measures(wide, ["quarter"], groups, {"cr": "_curtailment_rate", "prod": "_production_mwh", "curt": "_curtailed_mwh"}, "tso")
    return long.where("prod IS NOT NULL").select("quarter", "tso", r("cr").alias("cr"), r("prod", 2).alias("prod"), r("curt", 2).alias("curt"))


@query("r3_pivot_sum", sql("SELECT quarter, " + ", ".join(f"round(sum(load_mwh) FILTER (tso = '{g}'), 2) AS \"load_mwh_{g}\"" for g in _REGIONS) + " FROM tso_quarter GROUP BY ALL", "tso_quarter"))
def r3(t: Tables) -> DataFrame:
    wide = reshape.pivot_sum(t.tso_quarter(), ["quarter"], "tso", _REGIONS, "load_mwh", "load_mwh_")
    return rounded(wide, [f"load_mwh_{g}" for g in _REGIONS], 2)


@query("r4_rename", 'SELECT event_id AS id, value AS "nt_eur_mwh" FROM events')
def r4(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value").withColumnsRenamed({"event_id": "id", "value": "nt_eur_mwh"})


@query("u1_union_all", sql("SELECT tso, month, round(price, 6) AS price, NULL::DOUBLE AS fc FROM region_month UNION ALL SELECT tso, CAST(month + INTERVAL 240 MONTH AS DATE), NULL, round(wind_mwh, 4) FROM region_month", "region_month"))
def u1(t: Tables) -> DataFrame:
    m = t.region_month()
    future = m.select("tso", F.add_months("month", 240).alias("month"), r("wind_mwh", 4).alias("fc"))
    return reshape.union_all(m.select("tso", "month", r("price").alias("price")), future)
