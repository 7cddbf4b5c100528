"""Rows with NULL keys or times, odd file names and split scans lose nothing and hide nothing."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeledger.operators import asof, ordered, simulate
from galeledger.operators.checks import unique_names
from galeledger.plans import finance, revenue
from galeledger.sources import lines, market, sinks, telemetry


@pytest.fixture
def splits(spark):
    yield lambda n: spark.conf.set("spark.sql.files.minPartitionNum", str(n))
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_header_scan_and_data_scan_may_be_split_differently(spark, splits, tmp_path):
    for k in range(4):
        (tmp_path / f"e{k}.csv").write_text("Start date;Value\n" + "".join(f"d{k};{i}\n" for i in range(20_000)))
    counts = []
    for first, then in ((2, 2), (4, 16), (16, 4), (40, 2)):
        splits(first)
        rows = lines.numbered_lines(spark, str(tmp_path)).where(F.length(F.trim("line")) > 0)
        heads = lines.header_of_files(rows, F.col("source_block") == 0)
        splits(then)
        counts.append(lines.pick_columns(lines.numbered_lines(spark, str(tmp_path)), heads, {"Value": "v"}, ";").where("v is not null").count())
    assert counts == [80_000] * 4


def test_file_without_header_raises(spark, tmp_path):
    (tmp_path / "Turbine_Data_A_1.csv").write_text("# note\n2020-01-01 00:00:00,1,2\n")
    with pytest.raises(Exception, match="no header|not found"):
        telemetry.read_telemetry(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name,turbine", [
    ("Turbine_Data_Kelmarsh_1_2016-01-03_-_2017-01-01_228.csv", "Kelmarsh_1"), ("Turbine_Data_Penmanshiel_02_2019-01-01_-_2020-01-01_1042.csv", "Penmanshiel_02"),
    ("Turbine_Data_X1_228.csv", "X1"),
])
def test_turbine_of_real_names(spark, name, turbine):
    df = spark.createDataFrame([(f"file:/data/{name}",)], "source_file string")
    assert df.select(telemetry.turbine_of_file("Turbine_Data")).first()[0] == turbine


def test_unknown_operator_and_unreadable_reports_raise(spark):
    raw = spark.createDataFrame([("file:/x/unknown.csv", "Jan 1, 2020", "1")], ["source_file", market.START, market.LOAD_VALUE])
    with pytest.raises(Exception, match="no grid operator"):
        market.monthly_grid_load(raw).collect()
    page = lambda text: spark.createDataFrame([(text, "wp.csv")], "value string, source_file string")
    with pytest.raises(Exception, match="wanted row is missing"):
        market.transposed_report_rows(page(";Jan 2015;Feb 2015\nother;1,0;2,0")).collect()
    with pytest.raises(Exception, match="cannot read month"):
        market.transposed_report_rows(page(";Jan 2015;Nonsense\nMW Wind Onshore;1,0;2,0")).collect()


def test_appended_keys_keep_their_type_and_null(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *keys: spark.createDataFrame([(k, 1) for k in keys], "k string, v int")
    sinks.append_new_keys(df("007", None), ["k"], path)
    for _ in range(2):
        sinks.append_new_keys(df("7", None, "007"), ["k"], path)
    got = spark.read.schema("k string, v int").parquet(path)
    assert sorted(str(r.k) for r in got.collect()) == ["007", "7", "None"]


def test_null_keys_and_times_stay_in_raw_operators(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [("a", t(1), 1.0), ("a", t(3), 2.0), (None, t(1), 3.0), (None, t(2), 4.0), ("a", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    by = lambda out, c: sorted(((r.k, r.ts, r[c]) for r in out.collect()), key=repr)
    key = lambda x: sorted(x, key=repr)
    assert by(ordered.lag_raw(df, ["k"], "ts", "v", "p"), "p") == key([("a", t(1), None), ("a", t(3), 1.0), (None, t(1), None), (None, t(2), 3.0), ("a", None, None)])
    assert by(ordered.running_total_raw(df, ["k"], "ts", "v", "s"), "s") == key([("a", t(1), 1.0), ("a", t(3), 3.0), (None, t(1), 3.0), (None, t(2), 7.0), ("a", None, None)])
    assert by(ordered.row_number_raw(df, ["k"], "ts", "n"), "n") == key([("a", t(1), 0), ("a", t(3), 1), (None, t(1), 0), (None, t(2), 1), ("a", None, None)])


@pytest.mark.parametrize("days", [1, 30, 3000])
def test_as_of_answer_does_not_depend_on_the_slice(spark, days):
    left = spark.createDataFrame([(None, dt.datetime(2020, 6, 1)), ("a", dt.datetime(2020, 6, 1))], "k string, ts timestamp_ntz")
    right = spark.createDataFrame([(None, dt.datetime(2020, 1, 1), 7.0)], "k string, ts timestamp_ntz, v double")
    got = asof.asof_backward(left, right, ["k"], "ts", ["v"], slice_seconds=days * 86_400).collect()
    assert {r.k: r.v for r in got} == {None: 7.0, "a": None}


def test_scenarios_without_operator_or_start_are_rejected(spark):
    panel = spark.createDataFrame([("x", dt.date(2020, 1, 1), dt.date(2020, 1, 1), 1.0, 1.0, 0.1, 1.0)], "tso string, cod date, date date, p_market double, cf double, cr double, strike_series double")
    scenarios = spark.createDataFrame(
        [(1, "x", dt.date(2020, 1, 1)), (2, None, dt.date(2020, 1, 1)), (3, "x", None)], "scenario_id int, tso string, cod date"
    ).withColumns({"eeg_on": F.lit(1), "manual_eeg_strike": F.lit(1.0)})
    got = revenue.rejected_scenarios(scenarios, None, panel, months=1).collect()
    assert {(r.scenario_id, r.reject_reason) for r in got} == {(2, "operator or start missing"), (3, "operator or start missing")}


def test_bootstrap_without_a_month_raises(spark):
    hist = spark.createDataFrame([("a", 2020, m, 1.0) for m in range(1, 12)], "k string, year int, month int, energy_kwh double")
    with pytest.raises(Exception, match="without history"):
        simulate.bootstrap_by_month(hist, ["k"], 2, 2026, 1, 1).collect()


@pytest.mark.parametrize("flow", [[-1e6, 2.15e6, -1.125e6], [-1000.0, 3600.0, -4310.0, 1716.0], [-100.0, 60.0, 60.0], [100.0, -250.0, 154.0]])
def test_irr_is_the_root_nearest_to_zero(spark, flow):
    real = [r.real - 1 for r in np.roots(flow) if abs(r.imag) < 1e-9 and -0.99 < r.real - 1 < 5]
    got = spark.createDataFrame([(flow,)], "f array<double>").select(finance.irr("f").alias("r")).first().r
    assert got.reason == "ok" and abs(got.rate - min(real, key=abs)) < 1e-6


def test_unique_names_never_repeat():
    assert unique_names(["a", "a", "b"]) == ["a", "a.1", "b"]
    assert unique_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert unique_names([]) == []


def test_grid_reader_prunes_months(spark, tmp_path):
    from galeledger.sources import climate
    rows = [(dt.datetime(2020, m, d), 50.0, 10.0, 1.0 * m) for m in range(1, 7) for d in (1, 15)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, latitude double, longitude double, u10 double")
    climate.write_grid(df, str(tmp_path / "g"))
    part = climate.read_grid(spark, str(tmp_path / "g"), "2020-02-10", "2020-04-01")
    assert sorted((r.time.month, r.time.day) for r in part.collect()) == [(2, 15), (3, 1), (3, 15)]
    assert len(part.inputFiles()) >= 1 and "ym" in part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert climate.read_grid(spark, str(tmp_path / "g")).count() == 12


def test_grids_of_two_precisions_meet(spark):
    from galeledger.sources import climate
    at = dt.datetime(2020, 1, 1)
    main = spark.createDataFrame([(at, 50.1, 10.3, 1.0)], "time timestamp_ntz, latitude double, longitude double, u10 double")
    other = spark.createDataFrame([(at, 50.1, 10.3, 2.0), (at, 50.2, 10.3, 3.0)], "time timestamp_ntz, latitude float, longitude float, d2m double")
    got = sorted((round(r.latitude, 4), r.u10, r.d2m) for r in climate.combine_grids(main, other).collect())
    assert got == [(50.1, 1.0, 2.0), (50.2, None, 3.0)]
