"""N*: texts are built from table columns and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import parse, units
from ..operators import checks
from .base import Tables, query, r, sql
from .sources import MONTHS_DE, cents, german_text, us_text

_LOCALE = """CASE l_linenumber % 7 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice WHEN 2 THEN floor(l_extendedprice) / 1000 WHEN 3 THEN NULL
    WHEN 4 THEN NULL WHEN 5 THEN -l_extendedprice ELSE l_extendedprice END"""


@query("n1_sniffed_number", f"SELECT l_orderkey, l_linenumber, round({_LOCALE}, 3) AS v FROM lineitem")
def n1(t: Tables) -> DataFrame:
    c, k = cents("l_extendedprice"), F.col("l_linenumber") % 7
    whole = F.floor(F.col("l_extendedprice"))
    text = (
        F.when(k == 0, german_text(c)).when(k == 1, us_text(c))
        # One comma only: a decimal comma, whatever its distance from the end.
        .when(k == 2, F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
        .when(k == 3, "-").when(k == 4, "–").when(k == 5, F.concat(F.lit("-"), german_text(c)))
        .otherwise(F.concat(F.lit(" "), us_text(c), F.lit(" €")))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", r(parse.sniffed_number(text), 3).alias("v"))


@query("n2_thousands_comma", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def n2(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 0, "-").otherwise(us_text(cents("o_totalprice")))
    return t.orders.select("o_orderkey", parse.thousands_comma_number(text).alias("v"))


@query("n3_german_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def n3(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 != 0, german_text(cents("o_totalprice")))
    return t.orders.select("o_orderkey", parse.german_number(text).alias("v"))


@query("n4_cents_per_kwh", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN NULL ELSE round(l_quantity / 100, 2) END AS eur_mwh FROM lineitem")
def n4(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    text = F.when(F.col("l_linenumber") == 2, " - ").otherwise(F.concat(F.lit(" 0, "), F.lpad(q.cast("string"), 3, "0")))
    return t.lineitem.select("l_orderkey", "l_linenumber", r(parse.cents_per_kwh(text), 2).alias("eur_mwh"))


@query("n5_units", "SELECT event_id, round(value * 1000, 6) AS mwh, round(value / 6, 6) AS kwh, round(value * 1000, 6) AS kw, round(value / 12, 6) AS monthly FROM events")
def n5(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", r(units.gwh_to_mwh("value")).alias("mwh"), r(units.ten_minute_kw_to_kwh("value")).alias("kwh"),
        r(units.mw_to_kw("value")).alias("kw"), r(units.yearly_to_monthly("value")).alias("monthly"),
    )


@query("n6_numeric_coercion", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events")
def n6(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "NaN").when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", parse.number(text).alias("v"))


@query("n7_export_time", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('minute', ts) END AS ts FROM events")
def n7(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "Smarch 1, 2024").otherwise(F.date_format("ts", "MMM d, yyyy h:mm a"))
    return t.events.select("event_id", parse.export_time(text).alias("ts"))


@query("n8_any_time", """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ts FROM events""")
def n8(t: Tables) -> DataFrame:
    kind, out = F.col("event_type"), lambda f: F.date_format("ts", f)
    text = (
        F.when(kind == "error", "soon").when(kind == "view", out("dd.MM.yyyy HH:mm")).when(kind == "click", out("dd/MM/yyyy HH:mm:ss"))
        .when(kind == "signup", out("yyyy-MM-dd'T'HH:mm:ss")).otherwise(out("yyyy-MM-dd HH:mm:ss"))
    )
    return t.events.select("event_id", parse.any_time(text).cast("timestamp_ntz").alias("ts"))


@query("n9_day_first_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def n9(t: Tables) -> DataFrame:
    fmt = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    return t.orders.select("o_orderkey", parse.day_first_date(fmt).alias("d"))


@query("n10_german_month", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders")
def n10(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS_DE]), F.month("o_orderdate"))
    name = F.when((name == "Mär") & (F.col("o_orderkey") % 2 == 0), "Mrz").otherwise(name)
    text = F.when(F.col("o_orderkey") % 9 == 0, "Foo 1999").otherwise(F.concat(F.lit(" "), name, F.lit(" "), F.year("o_orderdate").cast("string")))
    return t.orders.select("o_orderkey", parse.german_month(text).alias("month"))


@query("n11_quarter_label", "SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders")
def n11(t: Tables) -> DataFrame:
    y, q, k = F.year("o_orderdate").cast("string"), F.quarter("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.concat(F.lit("Q"), q, F.lit(" "), y)).when(k == 1, F.concat(y, F.lit("Q"), q))
        .when(k == 2, F.concat(y, F.lit("-q"), q)).otherwise(F.concat(y, F.lit(" Q"), q))
    )
    return t.orders.select("o_orderkey", parse.quarter_label(text).alias("quarter"))


@query("n12_tidy_names", "SELECT event_id, value FROM events")
def n12(t: Tables) -> DataFrame:
    odd = t.events.select(F.col("event_id").alias(" event_id "), F.col("value").alias(" value"))
    return checks.tidy_names(odd)


@query("n13_unique_names", 'SELECT event_id AS a, user_id AS "a.1", value AS b FROM events')
def n13(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "value").toDF(*checks.unique_names(["a", "a", "b"]))


@query("n14_drop_empty", "SELECT event_id, value FROM events")
def n14(t: Tables) -> DataFrame:
    wide = t.events.select("event_id", "value", F.lit(None).cast("string").alias("blank"), F.col("user_id").alias("Unnamed: 3"))
    return checks.drop_empty_columns(wide)


@query("n15_detect_columns", """SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(sum(value), 2) AS wind FROM events GROUP BY ALL""")
def n15(t: Tables) -> DataFrame:
    odd = t.events.select("props", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.col("value").cast("string").alias("Wind out"))
    when, value = checks.detect_time_column(odd), checks.detect_number_column(odd, ["onshore", "wind"])
    return odd.groupBy(parse.any_time(when).cast("date").alias("day")).agg(r(F.sum(parse.number(value)), 2).alias("wind"))


@query("n15_column_profile", """SELECT 'a' AS "column", count(*) AS known, 1.0::DOUBLE AS numeric_share FROM events
    UNION ALL SELECT 'b', count(*) FILTER (event_type <> 'view'), 0.0::DOUBLE FROM events""")
def n15b(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("value").alias("a"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("b"))
    return checks.column_profile(rows).select("column", "known", "numeric_share")


@query("n16_first_existing", "SELECT event_id, value AS mwh FROM events")
def n16(t: Tables) -> DataFrame:
    return checks.rename_first(t.events.select("event_id", F.col("value").alias("MWh_gross")), ["mwh_gross", "MWh", "MWh_gross"], "mwh")


@query("n17_required_columns", "SELECT event_id, value FROM events")
def n17(t: Tables) -> DataFrame:
    return checks.require_columns(t.events, ["event_id", "value"]).select("event_id", "value")


@query("n18_scenario_validation", sql("""SELECT CASE WHEN n_turbines - 2 < 1 THEN 'n_turbines' WHEN hub_height_m - 100 <= 0 THEN 'hub_height_m'
    WHEN equity_eur IS NULL THEN 'equity_eur' WHEN tso_id = 3 THEN 'tso_id' ELSE 'valid' END AS reject_reason, count(*) AS n FROM scenarios GROUP BY ALL""", "scenarios"))
def n18(t: Tables) -> DataFrame:
    rows = t.scenarios().withColumns({
        "n_turbines": F.col("n_turbines") - 2, "hub_height_m": F.col("hub_height_m") - 100, "tso_id": F.when(F.col("tso_id") == 3, 9).otherwise(F.col("tso_id")),
    })
    good, bad = checks.split_valid(rows, checks.scenario_rules())
    both = good.withColumn("reject_reason", F.lit("valid")).unionByName(bad)
    return both.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
