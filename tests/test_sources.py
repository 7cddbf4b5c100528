"""File readers and writers on small hand-written files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from galeledger.functions.parse import EXPORT_DAY_FORMAT, thousands_comma_number
from galeledger.operators import checks
from galeledger.sources import catalogue, climate, market, sinks, telemetry

TS = dt.datetime


def write(path, text, **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8", **kw)
    return str(path)


def test_price_export_regime_overlap_and_bom(spark, tmp_path):
    old, new = market.PRICE_OLD, market.PRICE_NEW
    write(tmp_path / "eh1.csv", f"﻿Start date;End date;{old};{new}\nSep 30, 2018 11:00 PM;x;40.5;-\nOct 1, 2018 12:00 AM;x;99;1.041,25\nbad;x;1;1\n")
    write(tmp_path / "eh2.csv", f"﻿Start date;{new}\nOct 1, 2018 12:00 AM;42,5\nOct 28, 2018 2:00 AM;1\nOct 28, 2018 2:00 AM;2\nOct 1, 2018 1:00 AM;-\n")
    raw = market.read_export(spark, str(tmp_path / "eh*.csv"), [market.START, old, new])
    got = rows(market.hourly_prices(raw), "ts")
    assert got == [(TS(2018, 9, 30, 23), 40.5), (TS(2018, 10, 1), 42.5), (TS(2018, 10, 28, 2), 2.0)]


def test_daily_series_per_operator(spark, tmp_path):
    for name, v in (("Tennet_1.csv", "29,339.75"), ("Amprion_1.csv", "-")):
        write(tmp_path / name, f"Start date;{market.WIND_VALUE}\nJan 1, 2015;{v}\nJan 2, 2015;1,000\n")
    raw = market.read_export(spark, str(tmp_path / "*.csv"), [market.START, market.WIND_VALUE]).withColumn("tso", market.tso_of_file(market.file_name()))
    got = rows(market.export_series(raw, market.WIND_VALUE, "mwh", thousands_comma_number, EXPORT_DAY_FORMAT, ["tso"]), "tso", "ts")
    assert got == [("Amprion", TS(2015, 1, 2), 1000.0), ("TenneT", TS(2015, 1, 1), 29339.75), ("TenneT", TS(2015, 1, 2), 1000.0)]


def test_missing_required_column_and_empty_glob(spark, tmp_path):
    write(tmp_path / "a.csv", "Start date;x\nJan 1, 2015;1\n")
    with pytest.raises(ValueError, match="grid load"):
        market.read_export(spark, str(tmp_path / "*.csv"), [market.START, market.LOAD_VALUE], [market.LOAD_VALUE])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        market.read_export(spark, str(tmp_path / "none*.csv"), [market.START]).count()


def test_large_file_is_split_and_keeps_row_order(spark, tmp_path):
    lines = "".join(f"Jan 1, 2015 {i % 12 + 1}:00 AM;{i}\n" for i in range(20000))
    write(tmp_path / "big.csv", f"Start date;{market.WIND_VALUE}\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        raw = market.read_export(spark, str(tmp_path / "big.csv"), [market.START, market.WIND_VALUE])
        assert raw.rdd.getNumPartitions() > 3 and raw.count() == 20000
        got = [r[1] for r in rows(market.export_series(raw, market.WIND_VALUE, "v"))]
        assert sorted(got) == [float(i) for i in range(19988, 20000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_transposed_report(spark, tmp_path):
    de = "Jan Feb Mrz Apr Mai Jun Jul Aug Sep Okt Nov Dez".split()
    head = ";".join(["in ct/kWh", *[f"{m} 2016" for m in de]])
    write(tmp_path / "wp16.csv", "﻿" + head + "\n; ; ;\nMW Wind auf See;" + ";".join(["9,9"] * 12) + "\n mw  wind  onshore ;" + ";".join([f" {i},5" for i in range(11)] + ["-"]) + "\nMW Wind Onshore;" + ";".join(["8"] * 12) + "\n")
    got = rows(market.read_transposed_report(spark, str(tmp_path / "wp*.csv")).select("month", "value"), "month")
    assert got[0] == (dt.date(2016, 1, 1), 5.0) and got[2] == (dt.date(2016, 3, 1), 25.0) and got[11] == (dt.date(2016, 12, 1), None) and len(got) == 12


def test_quoted_decimal_comma(spark, tmp_path):
    write(tmp_path / "c.csv", 'Quarter,TenneT\nQ1 2015,"1.863,24"\n')
    assert rows(market.read_quarterly_wide(spark, str(tmp_path / "c.csv"), ["Quarter", "TenneT"])) == [("Q1 2015", "1.863,24")]


def test_telemetry_header_is_the_first_comment_with_comma(spark, tmp_path):
    text = "# exported\n# a note\n# Date and time,Power (kW),Extra,Power (kW),Wind speed (m/s)\n2020-01-01 00:00:00,100,\"x, y\",7,5.5\n2020-01-01 00:10:00,,z,8,NaN\nbroken,1,2,3,4\n"
    write(tmp_path / "Turbine_Data_K_1_2020.csv", text)
    got = rows(telemetry.read_telemetry(spark, str(tmp_path / "Turbine_Data_*.csv")), "ts")
    assert [(r[0], r[2], r[3]) for r in got] == [("K_1", 100.0, 5.5), ("K_1", None, None)]


def test_status_header_and_null_times(spark, tmp_path):
    text = "# log\n\nintro, only one\nTimestamp start , Timestamp end,Status,IEC category\n2020-01-01 00:00:00,2020-01-01 01:00:00,Run,Full Performance\n2020-01-01 01:00:00,-,Stop,\n"
    write(tmp_path / "Status_K1_2020.csv", text)
    got = rows(telemetry.read_status(spark, str(tmp_path / "*.csv")), "start_ts")
    assert [(r[0], r[2] is None, r[3]) for r in got] == [("K1", False, "Full Performance"), ("K1", True, None)]


def test_catalogue_and_attachment(spark, tmp_path):
    doc = {"A": {"rated_power_kw": 2000, "rotor_diameter_m": 90, "default_hub_height_m": 80, "Cut-in wind speed": 3, "power_curve": [[3, 0], [12, 2000]]}, "B": {"rated_power_kw": 1, "rotor_diameter_m": 1, "power_curve": []}}
    cat = catalogue.read_catalogue(spark, write(tmp_path / "c.json", json.dumps(doc, indent=1)))
    assert cat.where("turbine_type = 'A'").first()["power_curve"] == [[3.0, 0.0], [12.0, 2000.0]]
    meta = spark.createDataFrame([("t1", "A", 50.0, None, None), ("t2", "A", None, 9.0, 99.0)], "turbine_id string, turbine_type string, lat double, lon double, hub_height_m double")
    got = rows(catalogue.attach_turbines(meta.select("turbine_id"), meta, cat, site_lat=1.0, site_lon=2.0).select("turbine_id", "lat", "lon", "hub_height_m", "cut_in_ws"), "turbine_id")
    assert got == [("t1", 50.0, 2.0, 80.0, 3.0), ("t2", 1.0, 9.0, 99.0, 3.0)]
    catalogue.check_turbines(meta, cat)
    with pytest.raises(ValueError, match="not in catalogue"):
        catalogue.check_turbines(meta.withColumn("turbine_type", F.lit("Z")), cat)
    with pytest.raises(ValueError, match="cut-in"):
        catalogue.check_turbines(meta.withColumn("turbine_type", F.lit("B")), cat)


def test_grids_merge_outer_and_turn_nan_to_null(spark, tmp_path):
    main = spark.createDataFrame([(TS(2020, 1, 1), 50.0, 10.0, float("nan"))], "valid_time timestamp_ntz, latitude double, longitude double, u10 double")
    dew = spark.createDataFrame([(TS(2020, 1, 1), 50.0, 10.0, 280.0), (TS(2020, 1, 2), 50.0, 10.0, 281.0)], "time timestamp_ntz, latitude double, longitude double, d2m double")
    got = rows(climate.combine_grids(main, dew).select("time", "u10", "d2m"), "time")
    assert got == [(TS(2020, 1, 1), None, 280.0), (TS(2020, 1, 2), None, 281.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, float("nan")), ("b", 2, 1.5)], "k string, n int, x double")
    path = str(tmp_path / "out")
    assert sinks.append_new_keys(df.where("k = 'a'"), ["k"], path).count() == 1
    sinks.append_new_keys(df, ["k"], path)
    sinks.append_new_keys(df.withColumn("n", F.col("n") + 10), ["k"], path)
    assert rows(spark.read.parquet(path).select("k", "n"), "k") == [("a", 1), ("b", 2)]
    by_key = str(tmp_path / "keys")
    sinks.write_by_key(df, ["k"], by_key)
    sinks.write_by_key(df.where("k = 'b'").withColumn("n", F.lit(9)), ["k"], by_key)
    assert rows(spark.read.parquet(by_key).select("k", "n"), "k") == [("a", 1), ("b", 9)]
    assert [r[0] for r in rows(sinks.json_rows(df), "record")] == ['{"k":"a","n":1,"x":null}', '{"k":"b","n":2,"x":1.5}']


def test_schema_helpers(spark):
    df = spark.createDataFrame([("1", None, "2020-01-01", "x")], "a string, b string, when string, `Unnamed: 3` string")
    assert checks.drop_empty_columns(df).columns == ["a", "when"]
    assert checks.unique_names(["x", "y", "x", "x"]) == ["x", "y", "x.1", "x.2"]
    assert checks.detect_time_column(df.drop("b")) == "when" and checks.detect_number_column(df.drop("b"), ["price"]) == "a"
    assert checks.first_existing(df, ["q", "when"]) == "when"
    for call in (lambda: checks.first_existing(df, ["q"]), lambda: checks.require_columns(df, ["q"]), lambda: checks.detect_number_column(df.select("when"), [])):
        with pytest.raises(ValueError):
            call()
