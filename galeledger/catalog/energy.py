"""E*: wind physics, expected energy and static attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import wind
from ..operators import curves
from ..plans import energy
from ..sources.catalogue import attach_turbines
from .base import GRID_STEP, TYPES, Tables, query, r, rounded, sql
from .joins import EXPECTED
from .models import turbine_meta


@query("e1_wind_speed", sql("SELECT time, lat_i, lon_i, round(sqrt(u10 * u10 + v10 * v10), 6) AS ws10, round(sqrt(u100 * u100 + v100 * v100), 6) AS ws100 FROM climate", "climate"))
def e1(t: Tables) -> DataFrame:
    return t.climate().select("time", "lat_i", "lon_i", r(wind.speed("u10", "v10")).alias("ws10"), r(wind.speed("u100", "v100")).alias("ws100"))


@query("e2_wind_direction", sql("SELECT time, lat_i, lon_i, round((degrees(atan2(-u10, -v10)) + 360) % 360, 6) AS wd10 FROM climate", "climate"))
def e2(t: Tables) -> DataFrame:
    return t.climate().select("time", "lat_i", "lon_i", r(wind.direction_from("u10", "v10")).alias("wd10"))


_WS = "SELECT *, sqrt(u10 * u10 + v10 * v10) AS w10, sqrt(u100 * u100 + v100 * v100) AS w100 FROM {src}"


@query("e3_shear", sql("SELECT time, lat_i, lon_i, round(ln((w100 + 1e-6) / (w10 + 1e-6)) / ln(10), 6) AS alpha FROM w", "climate", w=_WS.format(src="climate")))
def e3(t: Tables) -> DataFrame:
    return t.climate().select("time", "lat_i", "lon_i", r(wind.shear_exponent(wind.speed("u10", "v10"), wind.speed("u100", "v100"))).alias("alpha"))


@query("e4_hub_height", sql("SELECT time, lat_i, lon_i, round(w10 * pow(120 / 10, ln((w100 + 1e-6) / (w10 + 1e-6)) / ln(10)), 6) AS ws_hub FROM w", "climate", w=_WS.format(src="climate")))
def e4(t: Tables) -> DataFrame:
    ws10 = wind.speed("u10", "v10")
    alpha = wind.shear_exponent(ws10, wind.speed("u100", "v100"))
    return t.climate().select("time", "lat_i", "lon_i", r(wind.at_hub(ws10, F.lit(120.0), alpha)).alias("ws_hub"))


_E = "611.2::DOUBLE * exp(17.67::DOUBLE * (d2m - 273.15::DOUBLE) / (d2m - 29.65::DOUBLE))"
_DENSITY = f"coalesce(sp / (287.05::DOUBLE * (t2m * (1 + 0.61::DOUBLE * (0.622::DOUBLE * ({_E}) / (sp - 0.378::DOUBLE * ({_E})))))), sp / (287.05::DOUBLE * t2m))"


@query("e5_air_density", sql(f"SELECT time, lat_i, lon_i, round({_DENSITY}, 6) AS rho FROM c", "climate", c="SELECT time, lat_i, lon_i, sp, t2m, CASE WHEN day(time) % 3 <> 0 THEN d2m END AS d2m FROM climate"))
def e5(t: Tables) -> DataFrame:
    rows = t.climate().withColumn("d2m", F.when(F.dayofmonth("time") % 3 != 0, F.col("d2m")))
    return rows.select("time", "lat_i", "lon_i", r(wind.air_density("sp", "t2m", "d2m")).alias("rho"))


@query("e6_specific_power", "SELECT p_partkey, round(p_retailprice * 1000 / (pi() * (p_size / 2) * (p_size / 2)), 6) AS wpm2 FROM part")
def e6(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", r(wind.specific_power("p_retailprice", "p_size")).alias("wpm2"))


@query("e7_rated_speed", sql("""SELECT turbine_type, count(*) AS n, max(ws) AS rated_ws, max(cut_in_ws) AS cut_in_ws FROM telemetry JOIN spec USING (turbine_type) JOIN (
    SELECT turbine_type, coalesce(arg_min(v, i) FILTER (p >= 0.99 * rated_power_kw), max(v)) AS ws FROM curve JOIN spec USING (turbine_type) GROUP BY ALL) USING (turbine_type) GROUP BY ALL""", "telemetry", "spec", "curve"))
def e7(t: Tables) -> DataFrame:
    cat = t.catalogue()
    speeds = curves.rated_speed(curves.curve_points(cat), cat).join(cat.select("turbine_type", "cut_in_ws"), "turbine_type")
    return t.telemetry().join(speeds, "turbine_type").groupBy("turbine_type").agg(F.count(F.lit(1)).alias("n"), F.max("rated_ws").alias("rated_ws"), F.max("cut_in_ws").alias("cut_in_ws"))


@query("e8_expected_and_targets", sql("""SELECT event_id, round(x, 6) AS expected_energy_kwh, coalesce(ok, false) AS target_is_valid, round(CASE WHEN ok THEN e / x END, 6) AS factor, round(CASE WHEN ok AND e / x > 0 THEN ln(e / x) END, 6) AS log_factor
    FROM (SELECT m.event_id, x, power_kw AS e, w >= cut_in_ws + 0.5 AND w <= 0.9::DOUBLE * rw AND x >= 50 AS ok FROM m JOIN (SELECT *, CASE WHEN event_type <> 'error' THEN CAST(event_id % 120 AS DOUBLE) / 4 END AS w FROM telemetry) t ON t.event_id = m.event_id
    JOIN spec USING (turbine_type) JOIN (SELECT turbine_type, coalesce(arg_min(v, i) FILTER (p >= 0.99 * rated_power_kw), max(v)) AS rw FROM curve JOIN spec USING (turbine_type) GROUP BY ALL) USING (turbine_type))""", "telemetry", "curve", "spec", m=EXPECTED))
def e8(t: Tables) -> DataFrame:
    cat = t.catalogue()
    points = curves.curve_points(cat)
    speed = F.when(F.col("event_type") != "error", (F.col("event_id") % 120).cast("double") / 4)
    rows = t.telemetry().select("event_id", "turbine_type", F.col("power_kw").alias("energy_kwh"), speed.alias("era5_ws_hub"))
    rows = curves.expected_power(rows, points, "era5_ws_hub", "expected_energy_kwh")
    limits = cat.select("turbine_type", F.col("cut_in_ws").alias("_cut_in")).join(curves.rated_speed(points, cat).withColumnRenamed("rated_ws", "_rated_ws"), "turbine_type")
    out = energy.with_targets(rows.join(limits, "turbine_type"))
    return out.select("event_id", r("expected_energy_kwh").alias("expected_energy_kwh"), "target_is_valid", r("target_correction_factor").alias("factor"), r("target_log_correction_factor").alias("log_factor"))


@query("e9_static_attributes", sql("""SELECT event_id, round(50 + (k % 5) * 0.1::DOUBLE, 6) AS lat, CAST(90 + 5 * k AS DOUBLE) AS hub_height_m, round(rated_power_kw * 1000 / (pi() * (rotor_diameter_m / 2) * (rotor_diameter_m / 2)), 6) AS specific_power_wpm2
    FROM (SELECT *, CAST(substr(turbine_id, 2) AS INT) AS k FROM telemetry) JOIN spec USING (turbine_type)""", "telemetry", "spec"))
def e9(t: Tables) -> DataFrame:
    rows = attach_turbines(t.telemetry().drop("turbine_type"), turbine_meta(t), t.catalogue())
    return rows.select("event_id", r("lat").alias("lat"), "hub_height_m", r(wind.specific_power("rated_power_kw", "rotor_diameter_m")).alias("specific_power_wpm2"))


@query("e_site_climate_features", sql(f"""SELECT site_id, time AS ts, round(w10, 6) AS era5_ws_10m, round(w10 * pow(hub_height_m / 10, ln((w100 + 1e-6) / (w10 + 1e-6)) / ln(10)), 6) AS era5_ws_hub, round({_DENSITY}, 6) AS rho
    FROM w JOIN sites USING (site_id)""", "site_grid", w=_WS.format(src="site_grid")))
def e_site(t: Tables) -> DataFrame:
    out = energy.site_climate(t.sites(), t.climate(), "site_id", GRID_STEP)
    return out.select("site_id", "ts", r("era5_ws_10m").alias("era5_ws_10m"), r("era5_ws_hub").alias("era5_ws_hub"), r("era5_air_density_kgm3").alias("rho"))


_JOB_ROWS = """SELECT t, CASE WHEN t >= 8 THEN TIMESTAMP '2024-01-01' + INTERVAL (i) HOUR ELSE TIMESTAMP '2024-01-01' + INTERVAL (i * 10) MINUTE END AS ts, p, w, CASE t % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS turbine_type FROM (
    SELECT user_id % 10 AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS i, CASE WHEN event_type <> 'error' THEN value * 10 / 0.997::DOUBLE - 20 END AS p, value / 0.997::DOUBLE % 25 AS w FROM events)"""
_JOB_SQL = """SELECT 'S' AS site_id, 'T' || t AS turbine_id, ts, round(e, 6) AS energy_kwh, round(w, 6) AS wind_speed_ms, 50 + t * 0.5::DOUBLE AS lat, 10.0::DOUBLE AS lon, CASE WHEN t % 2 = 0 THEN 95.0::DOUBLE ELSE h END AS hub_height_m,
    rated_power_kw, rotor_diameter_m, round(rated_power_kw * 1000 / (pi() * (rotor_diameter_m / 2) * (rotor_diameter_m / 2)), 6) AS specific_power_wpm2, turbine_type FROM (
    SELECT t, ts, p AS e, w, turbine_type FROM j WHERE t >= 8 AND p BETWEEN 0 AND 900
    UNION ALL SELECT t, date_trunc('hour', ts), sum(p) / 6, avg(w), turbine_type FROM j JOIN spec USING (turbine_type) WHERE t < 8 AND p BETWEEN 0 AND 900 GROUP BY ALL HAVING avg(CASE WHEN w >= cut_in_ws AND p <= 0 THEN 0 ELSE 1 END) >= 2.0::DOUBLE / 3)
    JOIN spec USING (turbine_type) JOIN (VALUES ('alpha', 100.0::DOUBLE), ('beta', 120.0::DOUBLE), ('gamma', 80.0::DOUBLE)) AS d(turbine_type, h) USING (turbine_type)"""


@query("e_telemetry_job", sql(_JOB_SQL, "spec", j=_JOB_ROWS))
def e_telemetry_job(t: Tables) -> DataFrame:
    """Files of ten turbines, eight by ten minutes and two by hours, through the whole job."""
    from pyspark.sql import Window

    from ..plans.telemetry import Labels, read_site, standard_hours
    from .sources import _logs

    k = F.col("user_id") % 10
    place = F.row_number().over(Window.partitionBy(k).orderBy("event_id"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.date_format(start + F.make_dt_interval(mins=place * F.when(k >= 8, 60).otherwise(10)), "yyyy-MM-dd HH:mm:ss")
    power = F.when(F.col("event_type") != "error", F.col("value") * 10 / 0.997 - 20)
    name = F.concat(F.lit("T"), k.cast("string"))
    line = F.concat_ws(",", ts, name, F.coalesce(power.cast("string"), F.lit("")), (F.col("value") / 0.997 % 25).cast("string"))
    path = _logs(t, t.events.select(name.alias("file"), line.alias("value")), ["Time,Turbine,Power,Wind"], "site")
    meta = t.spark.range(10).select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("turbine_id"), F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("id") % 3 + 1).cast("int")).alias("turbine_type"),
        (50 + F.col("id") * 0.5).alias("lat"), F.lit(None).cast("double").alias("lon"), F.when(F.col("id") % 2 == 0, 95.0).alias("hub_height_m"),
    )
    sites = t.spark.range(1).select(F.lit("S").alias("site_id"), F.lit(1.0).alias("lat"), F.lit(10.0).alias("lon"), F.lit(70.0).alias("hub_height_m"))
    rows = read_site(t.spark, path + "/*/*.txt", "S", Labels("Time", "Power", "Wind", "Turbine"))
    return rounded(standard_hours(rows, meta, t.catalogue(), sites, max_power=900.0), ["energy_kwh", "wind_speed_ms", "specific_power_wpm2"])
