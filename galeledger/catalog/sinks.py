"""K*: results are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import month_start
from ..operators import learn
from ..session import scratch_path
from ..sources import sinks
from .base import Tables, query, r, sql
from .finance import NAMES, PANEL, revenue_of

MONTHLY = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders GROUP BY ALL"""


def _monthly(t: Tables) -> DataFrame:
    return t.orders.groupBy(month_start("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )


@query("k1_csv_table", MONTHLY)
def k1(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "k1")
    sinks.write_csv(_monthly(t), path)
    return t.spark.read.schema("month date, n bigint, cents bigint").option("header", True).csv(path)


@query("k2_partitioned", "SELECT 'T' || (user_id % 10) AS turbine_id, count(*) AS n, round(sum(value), 2) AS power FROM events GROUP BY ALL")
def k2(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "k2")
    rows = t.events.select(F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("turbine_id"), "ts", "value")
    sinks.write_by_key(rows, ["turbine_id"], path)
    back = t.spark.read.parquet(path)
    return back.groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("power"))


@query("k3_idempotent", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def k3(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "k3")
    rows = t.events.select("event_type", "event_id")
    sinks.append_new_keys(rows.where("event_type IN ('view', 'error')"), ["event_type"], path)
    sinks.append_new_keys(rows, ["event_type"], path)
    sinks.append_new_keys(rows, ["event_type"], path)
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("k4_json_safe", """SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, o_orderkey AS id,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN NULL ELSE o_totalprice END AS price FROM orders""")
def k4(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "k4")
    bad = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).when(F.col("o_orderstatus") == "P", F.lit(float("-inf"))).otherwise(F.col("o_totalprice"))
    sinks.write_json(t.orders.select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), bad.alias("price")), path)
    return t.spark.read.schema("at string, id bigint, price double").json(path)


@query("k5_revenue_summary", sql("""SELECT scenario_id, metric, value FROM (
    SELECT scenario_id, max(tso) AS TSO, CAST(max(eeg_on) AS VARCHAR) AS EEG_ON, CAST(min(date) AS VARCHAR) AS COD,
    printf('%.4f', max(st)) AS EEG_strike_fixed_eur_mwh, printf('%.2f', sum(revenue_eur)) AS Total_revenue_eur, printf('%.2f', sum(revenue_eur) / (count(*) / 12)) AS Average_annual_revenue_eur
    FROM rev GROUP BY scenario_id)
    UNPIVOT INCLUDE NULLS (value FOR metric IN (TSO, EEG_ON, COD, EEG_strike_fixed_eur_mwh, Total_revenue_eur, Average_annual_revenue_eur))""", *NAMES, **PANEL))
def k5(t: Tables) -> DataFrame:
    return sinks.revenue_summary(revenue_of(t), ["scenario_id"])


@query("k6_model_artifact")
def k6(t: Tables) -> DataFrame:
    from .models import FEATS, ml_rows, tree_settings

    rows = ml_rows(t)
    path = scratch_path(t.spark, "k6")
    learn.save_model(learn.fit_correction(rows, FEATS, **tree_settings()), path)
    again = learn.load_model(path)
    return learn.predict_energy(rows, again).groupBy("turbine_id").agg(F.count(F.lit(1)).alias("n"), F.avg("pred_energy_kwh").alias("mean_pred"))
