"""ST1: the streaming roll-up, run over everything available, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import floor_to
from ..session import scratch_path
from ..streaming.corrections import PROVIDER, corrected_hours, open_hours, write_corrected
from ..streaming.hourly import stream_hourly, write_hours
from .base import Tables, query, rounded, sql


@query("st1_stream_hourly", sql("""SELECT turbine_id, ts, round(f, 6) AS availability_fraction, round(e, 6) AS energy_kwh, round(w, 6) AS wind_speed_ms FROM (
    SELECT 'T' || (user_id % 10) AS turbine_id, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS f, sum(value * 10) / 6 AS e, avg(value % 25) AS w FROM events GROUP BY ALL)
    WHERE f >= 2.0::DOUBLE / 3 AND ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""))
def st1(t: Tables) -> DataFrame:
    spark, c = t.spark, F.col
    rows = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = rows.select(
        F.concat(F.lit("T"), (c("user_id") % 10).cast("string")).alias("turbine_id"), c("ts").cast("timestamp").alias("ts"),
        (c("value") * 10).alias("power_kw"), (c("value") % 25).alias("wind_speed_ms"), (c("event_type") != "error").alias("is_available"),
    )
    out, state = scratch_path(spark, "hours"), scratch_path(spark, "hours-state")
    write_hours(stream_hourly(rows, ["turbine_id"]), out, state).awaitTermination()
    back = spark.read.schema("turbine_id string, ts timestamp, availability_fraction double, energy_kwh double, wind_speed_ms double").parquet(out)
    return rounded(back.withColumn("ts", c("ts").cast("timestamp_ntz")), ["availability_fraction", "energy_kwh", "wind_speed_ms"])


@query("st1_stream_corrections", """SELECT turbine_id, date_trunc('hour', b)::TIMESTAMP AS ts, round(avg(ok), 6) AS availability_fraction, round(sum(p) / 6, 6) AS energy_kwh, round(avg(w), 6) AS wind_speed_ms FROM (
    SELECT 'T' || (user_id % 10) AS turbine_id, time_bucket(INTERVAL 10 MINUTE, ts::TIMESTAMP) AS b, arg_max(value * 10, event_id) AS p, arg_max(value % 25, event_id) AS w, arg_max(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id) AS ok
    FROM events GROUP BY ALL) GROUP BY ALL HAVING avg(ok) >= 2.0::DOUBLE / 3""")
def st1b(t: Tables) -> DataFrame:
    """Events of one turbine within ten minutes are versions of one sample; hours closed by the stream and those still open at its end."""
    spark, c = t.spark, F.col
    rows = spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = rows.select(
        F.concat(F.lit("T"), (c("user_id") % 10).cast("string")).alias("turbine_id"), floor_to("ts", 10).alias("ts"), c("event_id").alias("version"),
        (c("value") * 10).alias("power_kw"), (c("value") % 25).alias("wind_speed_ms"), (c("event_type") != "error").alias("is_available"),
    )
    out, state = scratch_path(spark, "hours"), scratch_path(spark, "hours-state")
    before = spark.conf.get(PROVIDER)
    try:
        write_corrected(corrected_hours(rows, ["turbine_id"], "version"), out, state).awaitTermination()
        closed = spark.read.schema("turbine_id string, ts timestamp_ntz, availability_fraction double, energy_kwh double, wind_speed_ms double").parquet(out)
        return rounded(closed.unionByName(open_hours(spark, state, ["turbine_id"]).select(*closed.columns)), ["availability_fraction", "energy_kwh", "wind_speed_ms"])
    finally:
        spark.conf.set(PROVIDER, before)
