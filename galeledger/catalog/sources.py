"""S*: files derived from the driver's tables are written to the shared folder and
read back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import month_start
from ..functions.parse import german_number, quarter_label, thousands_comma_number
from ..session import scratch_path
from ..sources import catalogue as cat, climate, market, telemetry
from .base import GRID_STEP, Tables, query, r, sql

CENTS = "CAST(round({c} * 100) AS BIGINT)"
MONTHS_DE = ["Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"]


def cents(c) -> F.Column:
    return F.round(F.col(c) * 100).cast("bigint")


def us_text(c):
    """Cents to ``1,234.56``."""
    return F.concat(F.format_number(F.floor(c / 100), 0), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def german_text(c):
    """Cents to ``1.234,56``."""
    return F.concat(F.replace(F.format_number(F.floor(c / 100), 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


def _export(t: Tables) -> str:
    path = scratch_path(t.spark, "export")
    t.orders.select(
        F.date_format("o_orderdate", "MMM d, yyyy h:mm a").alias(market.START), us_text(cents("o_totalprice")).alias(market.WIND_VALUE),
        F.lit("-").alias("Other"), F.concat_ws("_", F.lit("Tennet"), F.col("o_orderstatus")).alias("part"),
    ).write.partitionBy("part").options(sep=";", header=True).csv(path)
    return path


@query("s1_market_export", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS value
    FROM orders GROUP BY ALL""")
def s1(t: Tables) -> DataFrame:
    raw = market.read_export(t.spark, _export(t) + "/*/*.csv", [market.START, market.WIND_VALUE], [market.START, market.WIND_VALUE])
    rows = raw.select(month_start(market.export_time(F.col(f"`{market.START}`"))).alias("month"), thousands_comma_number(F.col(f"`{market.WIND_VALUE}`")).alias("v"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), r(F.sum("v"), 2).alias("value"))


@query("s2_quoted_decimal_comma", sql("""SELECT tso, quarter, sum(c) / 100 AS gwh FROM (
    SELECT tso, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM region_orders) GROUP BY ALL""", "region_orders"))
def s2(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "quarterly")
    rows = t.region_orders().groupBy("tso", F.trunc(F.col("o_orderdate").cast("date"), "QUARTER").alias("q")).agg(F.sum(cents("o_totalprice")).alias("c"))
    label = F.concat(F.lit("Q"), F.quarter("q").cast("string"), F.lit(" "), F.year("q").cast("string"))
    rows.select(label.alias("Quarter"), "tso", german_text(F.col("c")).alias("Value")).write.options(header=True, quoteAll=True).csv(path)
    raw = market.read_quarterly_wide(t.spark, path, ["Quarter", "tso", "Value"])
    return raw.select("tso", quarter_label("Quarter").alias("quarter"), german_number("Value").alias("gwh"))


@query("s3_multi_file_scan", "SELECT o_orderstatus AS folder, count(*) AS n FROM orders GROUP BY ALL")
def s3(t: Tables) -> DataFrame:
    raw = market.read_export(t.spark, _export(t) + "/*/*.csv", [market.START])
    return raw.groupBy(F.regexp_extract("source_file", r"part=Tennet_(.)", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_attribute_from_name", sql("""SELECT CASE tso WHEN 'AFRICA' THEN 'TenneT' WHEN 'AMERICA' THEN 'Amprion' WHEN 'ASIA' THEN '50Hertz' ELSE 'TransnetBW' END AS tso,
    count(*) AS n FROM region_orders GROUP BY ALL""", "region_orders"))
def s4(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "tso")
    stem = F.when(F.col("tso") == "AFRICA", "Tennet1518").when(F.col("tso") == "AMERICA", "AMPRION_a").when(F.col("tso") == "ASIA", "50Hertz1925").otherwise("TransnetBw")
    t.region_orders().select("o_orderkey", stem.alias("stem")).write.partitionBy("stem").parquet(path)
    rows = t.spark.read.option("basePath", path).parquet(path).select(F.col("_metadata.file_path").alias("source_file"))
    folder = F.element_at(F.split("source_file", "/"), -2)
    return rows.groupBy(market.tso_of_file(folder).alias("tso")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_numbered_turbines", """SELECT o_orderpriority AS site, o_orderstatus AS source_file,
    o_orderpriority || '_T' || lpad(CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS VARCHAR), 2, '0') AS turbine_id, count(*) AS n
    FROM orders GROUP BY o_orderpriority, o_orderstatus""")
def s4b(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("site"), F.col("o_orderstatus").alias("source_file"))
    return market.numbered_turbines(rows, "site").groupBy("site", "source_file", "turbine_id").agg(F.count(F.lit(1)).alias("n"))


@query("s5_transposed_report", """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(CAST(sum(l_quantity) AS BIGINT) / 100, 2) AS value
    FROM lineitem GROUP BY ALL""")
def s5(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    q = t.lineitem.groupBy(F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    by_year = q.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("m", "q"))).alias("v"))
    months = F.sequence(F.lit(1), F.lit(12))
    name = lambda m: F.element_at(F.array(*[F.lit(x) for x in MONTHS_DE]), m)
    text = lambda v: F.concat(F.floor(v / 1000).cast("string"), F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0"))
    head = F.concat_ws(";", F.lit("Bezeichnung"), F.transform(months, lambda m: F.concat(name(m), F.lit(" "), F.col("y").cast("string"))))
    line = F.concat_ws(";", F.lit("MW Wind an Land"), F.transform(months, lambda m: F.coalesce(F.concat(F.lit(" "), text(F.try_element_at("v", m))), F.lit("-"))))
    page = F.concat_ws("\r\n", head, F.lit("; ; ;"), F.concat(F.lit("MW Wasser"), F.repeat(F.lit("; 1,0"), 12)), line)
    by_year.select("y", page.alias("value")).repartition("y").write.partitionBy("y").text(path)
    return market.read_transposed_report(t.spark, path + "/*/*.txt").where("value IS NOT NULL").select("month", r("value", 2).alias("value"))


def _logs(t: Tables, rows: DataFrame, comments: list[str], label: str) -> str:
    """Text files per ``file`` with the comment lines first."""
    path = scratch_path(t.spark, label)
    heads = rows.select("file").distinct().select("file", F.posexplode(F.array(*[F.lit(c) for c in comments])).alias("o", "value"))
    body = rows.select("file", F.lit(len(comments)).alias("o"), "value")
    both = heads.unionByName(body).repartition("file").sortWithinPartitions("file", "o")
    both.select("file", "value").write.partitionBy("file").text(path)
    return path


@query("s6_commented_header", """SELECT 'T' || (user_id % 10) AS turbine_id, count(*) AS n, round(sum(value), 2) AS power, round(avg(CAST(event_id % 25 AS DOUBLE)), 6) AS wind,
    date_trunc('second', min(ts)) AS first_ts FROM events GROUP BY ALL""")
def s6(t: Tables) -> DataFrame:
    tid = F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string"))
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("x"), F.col("value").cast("string"), (F.col("event_id") % 25).cast("string"))
    rows = t.events.select(F.concat(F.lit("Turbine_Data_"), tid, F.lit("_2024.csv")).alias("file"), line.alias("value"))
    path = _logs(t, rows, ["# Export", "# Date and time,Power (kW) min,Power (kW),Wind speed (m/s)"], "scada")
    out = telemetry.read_telemetry(t.spark, path + "/*/*.txt")
    return out.groupBy("turbine_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("power_kw"), 2).alias("power"), r(F.avg("wind_speed_ms")).alias("wind"), F.min("ts").cast("timestamp_ntz").alias("first_ts"),
    )


@query("s7_status_log", """SELECT 'T' || (user_id % 10) AS turbine_id, CASE event_type WHEN 'view' THEN 'Full Performance' WHEN 'click' THEN NULL ELSE event_type END AS iec_category,
    count(*) AS n, max(date_trunc('second', ts) + INTERVAL 30 MINUTE) AS last_end FROM events GROUP BY ALL""")
def s7(t: Tables) -> DataFrame:
    tid = F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string"))
    kind = F.when(F.col("event_type") == "view", "Full Performance").when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws(",", kind, fmt("ts"), F.lit('"a, b"'), fmt(F.col("ts") + F.expr("interval 30 minutes")))
    rows = t.events.select(F.concat(F.lit("Status_"), tid, F.lit("_2024.csv")).alias("file"), line.alias("value"))
    path = _logs(t, rows, ["# status", "", "one,comma", " IEC category ,Timestamp start,Message,Timestamp end"], "status")
    out = telemetry.read_status(t.spark, path + "/*/*.txt")
    return out.groupBy("turbine_id", "iec_category").agg(F.count(F.lit(1)).alias("n"), F.max("end_ts").cast("timestamp_ntz").alias("last_end"))


@query("s8_column_pruned", "SELECT event_type AS kind, count(*) AS n, round(sum(value), 2) AS power_kw FROM events GROUP BY ALL")
def s8(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("kind"), F.col("value").alias("power_kw"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r(F.sum("power_kw"), 2).alias("power_kw"))


@query("s9_turbine_catalogue", """SELECT p_brand AS turbine_type, CAST(max(p_size) * 100 AS DOUBLE) AS rated_power_kw, CAST(min(p_size) AS DOUBLE) AS cut_in_ws,
    count(DISTINCT p_size) AS n_points, CAST(sum(DISTINCT p_size) AS DOUBLE) AS speed_sum FROM part GROUP BY ALL""")
def s9(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "catalogue")
    pairs = F.transform(F.array_sort(F.collect_set("p_size")), lambda s: F.array(s.cast("double"), s * 10.0))
    entry = t.part.groupBy("p_brand").agg(F.struct(
        F.col("p_brand").alias("name"), (F.max("p_size") * 100).alias("rated_power_kw"), F.lit(90).alias("rotor_diameter_m"),
        F.min("p_size").alias("Cut-in wind speed"), pairs.alias("power_curve"),
    ).alias("s"))
    entry.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "s")))).alias("value")).write.text(path)
    rows = cat.read_catalogue(t.spark, path + "/*.txt")
    return rows.select(
        "turbine_type", "rated_power_kw", "cut_in_ws", F.size("power_curve").cast("bigint").alias("n_points"),
        F.aggregate("power_curve", F.lit(0.0), lambda a, p: a + p[0]).alias("speed_sum"),
    )


@query("s10_climate_grid", sql("""SELECT lat_i, lon_i, count(*) AS n, round(avg(u10), 6) AS u10, round(avg(CASE WHEN day(time) <= 15 THEN d2m END), 6) AS d2m
    FROM climate GROUP BY ALL""", "climate"))
def s10(t: Tables) -> DataFrame:
    main, dew = scratch_path(t.spark, "grid"), scratch_path(t.spark, "dew")
    g = t.climate().withColumn("latitude", F.col("lat_i") * GRID_STEP).withColumn("longitude", F.col("lon_i") * GRID_STEP)
    climate.write_grid(g.drop("d2m", "lat_i", "lon_i"), main)
    g.where(F.dayofmonth("time") <= 15).select(F.col("time").alias("valid_time"), "latitude", "longitude", "d2m").write.parquet(dew)
    both = climate.combine_grids(climate.read_grid(t.spark, main), climate.read_grid(t.spark, dew))
    rows = climate.indexed_grid(both, GRID_STEP)
    return rows.groupBy("lat_i", "lon_i").agg(F.count(F.lit(1)).alias("n"), r(F.avg("u10")).alias("u10"), r(F.avg("d2m")).alias("d2m"))


@query("s11_typed_series", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 2) AS total
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def s11(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "series")
    t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price")
    ).write.option("header", True).csv(path)
    rows = market.read_series(t.spark, path, ["date", "price"], "date", "price", "p_market", "yyyy-MM-dd")
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("n"), r(F.sum("p_market"), 2).alias("total"))


@query("s12_parameter_tables", sql("""SELECT tso, CASE turbine_type_id WHEN 0 THEN 'LOW_WIND' WHEN 1 THEN 'BALANCED' ELSE 'HIGH_WIND' END AS turbine_type,
    count(*) AS n, round(sum(n_turbines * CASE turbine_type_id WHEN 0 THEN 6.0 WHEN 1 THEN 5.6 ELSE 4.2 END)::DOUBLE, 6) AS park_mw FROM scenarios GROUP BY ALL""", "scenarios"))
def s12(t: Tables) -> DataFrame:
    rows = t.scenarios().drop("tso")
    rows = rows.join(F.broadcast(cat.tso_table(t.spark)), "tso_id").join(F.broadcast(cat.archetype_table(t.spark)), "turbine_type_id")
    return rows.groupBy("tso", "turbine_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("n_turbines") * F.col("p_mw"))).alias("park_mw"))
