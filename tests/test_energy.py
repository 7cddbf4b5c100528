"""Telemetry roll-ups, curves, grid, validation, model, stream and raster."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from galeledger.operators import aggregate, checks, curves, grid, learn, raster, timeline
from galeledger.plans import energy, heatmap
from galeledger.streaming import hourly

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def samples(spark):
    data = []
    for hour, n in enumerate((6, 4, 3, 0, 6)):
        for i in range(6):
            bad = i >= n
            data.append(("S", "T1", at(60 * hour + 10 * i), -5.0 if bad else 60.0, 8.0))
    data = [d for d in data if d[2].hour != 3]
    data += [("S", "T2", at(0), None, 8.0), ("S", "T2", at(10), 0.0, 2.0), ("S", "T2", at(20), 0.0, 9.0), ("S", "T2", at(30), 0.0, None)]
    return spark.createDataFrame(data, "site_id string, turbine_id string, ts timestamp_ntz, power_kw double, wind_speed_ms double").withColumn("cut_in", F.lit(3.0))


def test_availability_rules(samples):
    got = rows(samples.where("turbine_id = 'T2'").withColumn("a", energy.availability("power_kw", "wind_speed_ms", "cut_in")).select("a", "ts"), "ts")
    # Unknown power; idle below cut-in is fine; idle above cut-in is not; unknown wind alone does not count against.
    assert [r[0] for r in got] == [False, True, False, True]


def test_two_thirds_rule_and_dense_hours(samples):
    t1 = samples.where("turbine_id = 'T1'").withColumn("is_available", energy.availability("power_kw", "wind_speed_ms", "cut_in"))
    got = rows(aggregate.telemetry_hourly(t1).select("ts", "availability_fraction", "energy_kwh"), "ts")
    assert [(r[0].hour, round(r[1], 4), r[2]) for r in got] == [(0, 1.0, 60.0), (1, 0.6667, (240 - 10) / 6), (4, 1.0, 60.0)]
    # Removing bad rows first leaves partial hours, still divided by six.
    kept = energy.within_bounds(t1, "power_kw", 0.0, None)
    assert [(r[0].hour, r[1]) for r in rows(aggregate.telemetry_hourly(kept).select("ts", "energy_kwh"), "ts")] == [(0, 60.0), (1, 40.0), (2, 30.0), (4, 60.0)]
    dense = rows(energy.plain_hourly(t1, ["turbine_id"]).select("ts", "energy_kwh", "wind_speed_ms"), "ts")
    assert len(dense) == 5 and dense[3] == (at(180), 0.0, None)


def test_status_mask(spark):
    data = [("a", at(5), at(42), "Full Performance"), ("a", at(10), at(20), "Stop"), ("a", at(15), at(25), None), ("a", at(30), at(30), "Stop"), ("a", None, at(500), "Stop")]
    status = spark.createDataFrame(data, "turbine_id string, start_ts timestamp_ntz, end_ts timestamp_ntz, iec_category string")
    got = rows(energy.status_ticks(status, ["turbine_id"]).select("ts", "is_available"), "ts")
    assert got == [(at(m), m not in (10, 20)) for m in range(0, 60, 10)]
    hours = rows(energy.status_hourly(energy.status_ticks(status, ["turbine_id"]), ["turbine_id"]))
    assert hours == [("a", T0, 4 / 6, True)]
    telemetry = spark.createDataFrame([("a", at(0), 6.0, 5.0), ("a", at(120), 6.0, 5.0)], "turbine_id string, ts timestamp_ntz, power_kw double, wind_speed_ms double")
    turbine = energy.turbine_hourly(telemetry, status, ["turbine_id"])
    assert [r[0] for r in rows(turbine.select("is_available", "ts"), "ts")] == [True, False, False]
    park = aggregate.park_hourly(turbine.withColumn("site_id", F.lit("S")))
    assert park.count() == 3


CURVE = [(3.0, 0.0), (5.0, 200.0), (12.0, 2000.0), (25.0, 2000.0), (25.5, 0.0)]


def test_curve_matches_interp(spark):
    speeds = [0.0, 2.99, 3.0, 4.0, 5.0, 7.77, 12.0, 25.2, 25.5, 25.51, 40.0]
    points = spark.createDataFrame([("a", i, v, p) for i, (v, p) in enumerate(CURVE)], "turbine_type string, i int, v double, p double")
    df = spark.createDataFrame([("a", s) for s in speeds] + [("a", None), ("zz", 5.0)], "turbine_type string, s double")
    v, p = zip(*CURVE)
    got = {(r[0], r[1]): r[2] for r in rows(curves.expected_power(df, points, "s"))}
    assert np.allclose([got["a", s] for s in speeds], np.interp(speeds, v, p, left=0, right=max(p)))
    assert got["a", None] is None and got["zz", 5.0] is None and len(got) == len(speeds) + 2
    off = {r[1]: r[2] for r in rows(curves.expected_power(df.where("turbine_type = 'a'"), points, "s", cut_out=True))}
    assert off[25.51] == 0.0 and off[5.0] == 200.0
    rated = spark.createDataFrame([("a", 2000.0)], "turbine_type string, rated_power_kw double")
    assert curves.rated_speed(points, rated).first()["rated_ws"] == 12.0
    assert curves.rated_speed(points, rated.withColumn("rated_power_kw", F.lit(9999.0))).first()["rated_ws"] == 25.5


def test_bilinear(spark):
    f = lambda y, x: 2 * y + 3 * x + y * x
    cells = [(T0, i, j, f(i * 0.25, j * 0.25) if (i, j) != (2, 2) else None) for i in range(3) for j in range(3)]
    g = spark.createDataFrame(cells, "time timestamp_ntz, lat_i int, lon_i int, v double")
    sites = [("node", 0.25, 0.25), ("edge", 0.25, 0.1), ("cell", 0.1, 0.2), ("hole", 0.3, 0.3), ("out", 0.6, 0.1), ("rim", 0.5, 0.0)]
    s = spark.createDataFrame(sites, "site string, lat double, lon double")
    got = {r["site"]: r["v"] for r in grid.interpolate_grid(s, g, ["site"], ["v"], 0.25).collect()}
    for name, y, x in sites[:3] + sites[5:]:
        assert math.isclose(got[name], f(y, x), rel_tol=1e-9), name
    assert got["hole"] is None and got.get("out") is None
    weights = grid.site_cells(s, ["site"], 0.25).select((F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3")).alias("w"))
    assert weights.where("abs(w - 1) > 1e-9").count() == 0


def test_bilinear_per_time_and_without_shuffle_of_sites(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    nodes = {(h, i, j): (None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal())) for h in range(4) for i in range(5) for j in range(5) if rng.random() > 0.15}
    g = spark.createDataFrame([(T0 + dt.timedelta(hours=h), i, j, *v) for (h, i, j), v in nodes.items()], "time timestamp_ntz, lat_i int, lon_i int, a double, b double")
    sites = [(k, float(rng.integers(0, 9)) / 2 if k % 3 == 0 else float(rng.random() * 4), float(rng.random() * 4)) for k in range(60)] + [(99, None, 1.0)]
    df = grid.interpolate_grid(spark.createDataFrame(sites, "site int, lat double, lon double"), g, ["site"], ["a", "b"], 1.0)
    want = {}
    for site, y, x in sites[:-1]:
        for h in range(4):
            corners = [((h, int(y) + dy, int(x) + dx), (y - int(y) if dy else 1 - y + int(y)) * (x - int(x) if dx else 1 - x + int(x))) for dy in (0, 1) for dx in (0, 1)]
            found = [(nodes.get(n), w) for n, w in corners if w > 0]
            if any(v for v, _ in found):
                want[site, h] = tuple(None if any(v is None or v[m] is None for v, _ in found) else sum(w * v[m] for v, w in found) for m in (0, 1))
    got = {(r["site"], r["time"].hour): (r["a"], r["b"]) for r in df.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][m] is want[k][m] is None or math.isclose(got[k][m], want[k][m], abs_tol=1e-9) for k in want for m in (0, 1))
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above and "Repartition" not in above


def test_month_needs_enough_hours(spark):
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), 1.0 if h != 5 else None) for h in range(700)], "k string, ts timestamp_ntz, v double")
    assert timeline.monthly_if_complete(df, ["k"], "ts", "v").first()["v"] == 699.0
    assert timeline.monthly_if_complete(df.limit(671), ["k"], "ts", "v").count() == 0


def test_cadence_classes(spark):
    data = [(k, at(step * i)) for k, step in (("a", 10), ("b", 60), ("c", 25)) for i in range(50)]
    data += [("d", at(10 * (i // 4))) for i in range(80)]  # four copies of each time: three steps of zero, one of ten
    got = {r[0]: r[1:] for r in rows(checks.cadence(spark.createDataFrame(data, "k string, ts timestamp_ntz"), ["k"], "ts").select("k", "cadence", "median_minutes"))}
    assert {k: v[0] for k, v in got.items()} == {"a": "10min", "b": "hourly", "c": "unclassified", "d": "unclassified"} and got["d"][1] == 0.0


def test_validation_report(spark):
    base = dict(energy_kwh=10.0, expected_energy_kwh=20.0, target_correction_factor=0.5, target_is_valid=True, rated_power_kw=100.0, target_log_correction_factor=-0.7, site_id="s", hub_height_m=90.0, turbine_type="x")
    df = spark.range(40).select(
        F.when(F.col("id") < 20, "good").otherwise("bad").alias("turbine_id"), (F.lit(T0) + F.make_interval(hours=F.col("id") % 20)).cast("timestamp_ntz").alias("ts"),
        *[F.lit(v).alias(k) for k, v in base.items()], *[F.lit(5.0).alias(c) for c in checks.CLIMATE_REQUIRED],
    )
    bad = F.col("turbine_id") == "bad"
    df = df.withColumns({
        "energy_kwh": F.when(bad, F.when(F.col("ts") == F.lit(T0), -1.0).otherwise(200.0)).otherwise(10.0), "target_is_valid": ~bad | (F.col("ts") == F.lit(T0)),
        "target_correction_factor": F.when(bad, float("inf")).otherwise(0.5), "era5_ws_hub": F.when(bad & (F.hour("ts") < 3), None).when(bad, 50.0).otherwise(5.0),
    })
    got = {r["turbine_id"]: r for r in checks.validate_dataset(df).collect()}
    assert got["good"]["errors"] == [] and got["good"]["warnings"] == ["almost all rows valid"] and got["good"]["rows"] == 20
    assert got["bad"]["errors"] == ["negative energy", "non-finite correction factor"]
    assert got["bad"]["warnings"] == ["energy over rated", "wind over 40 m/s", "few valid rows", "climate gaps"]
    worse = df.withColumns({"target_log_correction_factor": F.lit(float("nan")), "site_id": F.when(bad, "s")})
    more = {r["turbine_id"]: r["errors"] for r in checks.validate_dataset(worse).collect()}
    assert more["good"] == ["non-finite log target in a valid row", "missing turbine metadata"] and "non-finite log target in a valid row" in more["bad"]
    for name in ("era5_ws_hub", "hub_height_m"):
        with pytest.raises(ValueError):
            checks.validate_dataset(df.drop(name))


def test_learned_correction_and_folds(spark, tmp_path):
    df = spark.range(3000).select(
        F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("turbine_id"), F.col("id"), (F.col("id") % 100 / 100.0).alias("x1"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 37).cast("double")).alias("x2"), (F.col("id") % 5 > 0).alias(learn.VALID), F.lit(100.0).alias("expected_energy_kwh"),
    ).withColumn(learn.TARGET, F.col("x1") * 2 - 1).withColumn("energy_kwh", F.col("expected_energy_kwh") * F.exp(learn.TARGET))
    small = {"max_iter": 8, "max_depth": 3, "step": 0.4, "subsample": 1.0}
    cv = learn.leave_one_group_out(df, "turbine_id", ["id"], ["x1", "x2"], **small).orderBy("fold").collect()
    assert [r["held_out"] for r in cv] == ["t0", "t1", "t2"] and all(r["n_train"] + r["n_test"] == 2400 and r["r2_logcf"] > 0.8 for r in cv)
    model = learn.fit_correction(df, ["x1", "x2"], **small)
    learn.save_model(model, str(tmp_path / "model"))
    a, b = (learn.energy_metrics(learn.predict_energy(df, m)).first() for m in (model, learn.load_model(str(tmp_path / "model"))))
    assert a == b and a["r2"] > 0.8 and a["n"] == 2400
    assert [learn.validation_size(n) for n in (1000, 6000, 12000, 100000)] == [1000, 1200, 2000, 10000]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    base = spark.range(600).select(
        F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("turbine_id"), (F.lit(T0).cast("timestamp") + F.make_interval(mins=F.col("id") * 5)).alias("ts"),
        (F.col("id") % 50).cast("double").alias("power_kw"), F.lit(7.0).alias("wind_speed_ms"), (F.col("id") % 9 > 2).alias("is_available"),
    )
    run = lambda: hourly.write_hours(hourly.stream_hourly(spark.readStream.schema(base.schema).parquet(src), ["turbine_id"]), out, state).awaitTermination()
    base.where("ts < timestamp'2024-01-02'").write.parquet(src)
    run()
    base.where("ts >= timestamp'2024-01-02'").write.mode("append").parquet(src)
    run()
    want = aggregate.telemetry_hourly(base, ["turbine_id"]).where("ts + interval 1 hour <= timestamp_ntz'2024-01-02 23:55:00'")
    got = spark.read.parquet(out).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*want.columns)
    assert want.count() > 30 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_raster_matches_loops(spark):
    frame = raster.frame_of(0.0, 0.0, 1.0, 1.0, 40)
    pts = [(0.5, 0.5, 2.0), (0.5, 0.5001, 1.0), (0.01, 0.99, 1.0)]
    df = spark.createDataFrame(pts, "lat double, lng double, value double")
    pix = {(r["lat"], r["lng"], r["value"]): (r["x"], r["y"]) for r in raster.to_pixels(df, frame).collect()}
    want, radius = np.zeros((frame["height"], 40)), 6
    for p in pts:
        x, y = pix[p]
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                px, py = math.floor(x + dx), math.floor(y + dy)
                if 0 <= px < 40 and 0 <= py < frame["height"] and math.hypot(dx, dy) <= radius:
                    want[py][px] += p[2] * (1 - math.hypot(dx, dy) / radius)
    cells = raster.density_raster(df, frame, radius)
    got = np.zeros_like(want)
    for r in cells.collect():
        got[r["py"]][r["px"]] = r["intensity"]
    assert np.allclose(got, want)
    colours = {(r["px"], r["py"]): r for r in raster.coloured(cells).collect()}
    top = max(colours.values(), key=lambda r: r["norm"])
    assert top["norm"] == 1.0 and (top["r"], top["g"], top["b"]) == (255, 0, 0)


def test_mask_respects_holes_and_parts(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b]]
    polygons = spark.createDataFrame([(0, [square(0.0, 1.0), square(0.25, 0.75)]), (1, [square(0.4, 0.6)])], "poly_id int, rings array<array<array<double>>>")
    vertices = raster.ring_vertices(polygons)
    frame = heatmap.frame_for(vertices, 100)
    cells = spark.range(100 * frame["height"]).select((F.col("id") % 100).alias("px"), F.floor(F.col("id") / 100).alias("py"))
    inside = {(r["px"], r["py"]) for r in raster.mask_polygon(cells, vertices, frame).collect()}
    in_square = lambda p, a, b: a * 100 <= p + 0.5 < b * 100
    for px in range(0, 100, 3):
        for py in range(0, frame["height"], 3):
            hit = lambda a, b: in_square(px, a, b) and in_square(py, a, b)
            if abs(py - 50) < 48 and all(abs(py - e) > 1 for e in (25, 40, 60, 75)):
                assert ((px, py) in inside) == ((not hit(0.25, 0.75)) or hit(0.4, 0.6)), (px, py)
