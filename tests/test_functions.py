"""Parsers, calendar and null handling on edge values."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from galeledger.functions import calendar as cal, draws, expr, parse, wind

D = dt.date


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize("text, value", [
    ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1,234", 1.234), ("1.234", 1.234), ("-", None), ("–", None), ("", None), ("nan", None), ("None", None),
    ("1 234,5", 1234.5), (" 12,5 €", 12.5), ("-3,5", -3.5), ("9,399,413", None), ("1.234.567,8", 1234567.8), ("12", 12.0), (None, None), ("1-2", None),
])
def test_sniffed_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(parse.sniffed_number("x")).first()[0] == value


@pytest.mark.parametrize("text, value", [("9,399,413.00", 9399413.0), ("1,234", 1234.0), ("-", None), (" ", None), ("nan", None), ("29339.75", 29339.75)])
def test_thousands_comma(spark, text, value):
    assert one(spark, parse.thousands_comma_number("x"), x=text) == value


@pytest.mark.parametrize("text, value", [("863,24", 863.24), ("1.863,24", 1863.24), ("x", None)])
def test_german_number(spark, text, value):
    assert one(spark, parse.german_number("x"), x=text) == value


@pytest.mark.parametrize("text, value", [(" 4,645", 46.45), ("-", None), ("  ", None), ("0, 5", 5.0)])
def test_cents(spark, text, value):
    got = one(spark, parse.cents_per_kwh("x"), x=text)
    assert got is None if value is None else math.isclose(got, value)


@pytest.mark.parametrize("text, value", [("Mär 2017", D(2017, 3, 1)), ("Mrz 2017", D(2017, 3, 1)), ("Dez 2020", D(2020, 12, 1)), ("Xyz 2020", None), ("2020", None)])
def test_german_month(spark, text, value):
    assert one(spark, parse.german_month("x"), x=text) == value


@pytest.mark.parametrize("text, value", [("Q1 2015", D(2015, 1, 1)), ("2015Q4", D(2015, 10, 1)), ("2015-q2", D(2015, 4, 1)), ("2015 Q3", D(2015, 7, 1)), ("2015Q5", None)])
def test_quarter_label(spark, text, value):
    assert one(spark, parse.quarter_label("x"), x=text) == value


@pytest.mark.parametrize("text, value", [
    ("Oct 1, 2018 1:00 AM", dt.datetime(2018, 10, 1, 1)), ("Oct 1, 2018 12:00 AM", dt.datetime(2018, 10, 1)), ("Oct 1, 2018 12:00 PM", dt.datetime(2018, 10, 1, 12)), ("10/1/2018", None)])
def test_export_time(spark, text, value):
    assert one(spark, parse.export_time("x"), x=text) == value


def test_any_time_is_day_first(spark):
    assert one(spark, parse.any_time("x").cast("timestamp_ntz"), x="02/03/2020 10:20") == dt.datetime(2020, 3, 2, 10, 20)
    assert one(spark, parse.any_time("x").cast("timestamp_ntz"), x="2020-03-02T10:20:00+02:00") == dt.datetime(2020, 3, 2, 8, 20)


def test_unknown_strike_makes_price_unknown(spark):
    df = spark.createDataFrame([(50.0, None, 1), (50.0, 60.0, 1), (70.0, 60.0, 1), (50.0, None, 0)], "m double, s double, on int")
    got = rows(df.select(expr.floored_price("m", "s", "on"), expr.support_premium("m", "s", "on")))
    assert got == [(None, None), (60.0, 10.0), (70.0, 0.0), (50.0, 0.0)]


def test_clip_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (float("inf"),)], "x double")
    assert rows(df.select(expr.clip(expr.null_if_nan("x"), 0, 1), expr.finite("x"))) == [(None, None), (None, None), (1.0, 2.0), (1.0, None)]


def test_weighted_mean_counts_weight_of_unknown_values(spark):
    df = spark.createDataFrame([(10.0, 1.0), (None, 1.0), (30.0, None)], "v double, w double")
    assert df.agg(expr.weighted_mean("v", "w")).first()[0] == 5.0
    assert df.where("w IS NULL").agg(expr.weighted_mean("v", "w")).first()[0] is None


def test_project_year_and_leap_day(spark):
    df = spark.createDataFrame([(D(2026, 1, 1),), (D(2026, 12, 1),), (D(2027, 1, 1),), (D(2045, 12, 1),)], "d date")
    got = rows(df.select(cal.project_month("d", F.lit(D(2026, 1, 1))), cal.project_year("d", F.lit(D(2026, 1, 1)))))
    assert got == [(1, 1), (12, 1), (13, 2), (240, 20)]
    assert one(spark, cal.month_start("x"), x=dt.datetime(2024, 2, 29, 23)) == D(2024, 2, 1)


def test_floor_and_ceil_to_ten_minutes(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10),), (dt.datetime(2024, 1, 1, 0, 10, 1),)], "t timestamp_ntz")
    got = rows(df.select(cal.floor_to("t", 10), cal.ceil_to("t", 10)))
    assert got == [(dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 0, 10)), (dt.datetime(2024, 1, 1, 0, 10), dt.datetime(2024, 1, 1, 0, 20))]


def test_wind_direction_quadrants(spark):
    df = spark.createDataFrame([(0.0, -1.0), (-1.0, 0.0), (0.0, 1.0), (1.0, 0.0)], "u double, v double")
    assert [round(r[0], 6) for r in rows(df.select(wind.direction_from("u", "v")))] == [0.0, 90.0, 180.0, 270.0]


def test_dry_air_without_dew_point(spark):
    dry = 101325 / (287.05 * 288.15)
    df = spark.createDataFrame([(101325.0, 288.15, None), (101325.0, 288.15, 283.15)], "sp double, t double, d double")
    got = [r[0] for r in rows(df.select(wind.air_density("sp", "t", "d")))]
    assert math.isclose(got[0], dry) and got[1] < got[0]


def test_draws_do_not_depend_on_partitioning(spark):
    def draw(n):
        df = spark.range(0, 5000, 1, n).select("id", draws.standard_normal(F.lit(7), F.col("id")).alias("z"))
        return df

    a, b = draw(1), draw(13)
    assert a.exceptAll(b).count() == 0
    mean, sd = a.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.05 and abs(sd - 1) < 0.05
