"""Ordered, as-of, interval and quantile operators against pandas, on hot keys and thin slices."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from galeledger.operators import asof, intervals, ordered, quantiles, timeline

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows on one key."""
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"k": key, "ts": pd.to_datetime(T0) + pd.to_timedelta(rng.permutation(n) * 7, unit="min"), "v": rng.random(n).round(6)})


def spark_df(spark, pdf, schema):
    plain = lambda x: None if x is None or x != x else (x.to_pydatetime() if isinstance(x, pd.Timestamp) else x)
    return spark.createDataFrame([tuple(plain(x) for x in r) for r in pdf.itertuples(index=False)], schema)


def test_keep_last_prefers_later_file_and_row(spark):
    df = spark.createDataFrame([(at(0), 1.0, "a", 5), (at(0), 2.0, "b", 1), (at(0), 3.0, "b", 0), (at(60), 4.0, "a", 9)], "ts timestamp_ntz, v double, f string, n int")
    assert rows(ordered.keep_last(df, ["ts"], ["f", "n"]).select("v"), "v") == [(2.0,), (4.0,)]


@pytest.mark.parametrize("slice_s", [600, 6 * 3600, 30 * 86400])
def test_raw_lag_running_total_and_position_match_pandas(spark, skewed, slice_s):
    pdf = skewed.sort_values(["k", "ts"])
    pdf["prev"] = pdf.groupby("k").v.shift(1)
    pdf["run"] = pdf.groupby("k").v.cumsum()
    pdf["pos"] = pdf.groupby("k").cumcount()
    df = spark_df(spark, skewed, "k long, ts timestamp_ntz, v double")
    got = ordered.lag_raw(df, ["k"], "ts", "v", "prev", slice_s)
    got = ordered.running_total_raw(got, ["k"], "ts", "v", "run", slice_s)
    got = ordered.row_number_raw(got, ["k"], "ts", "pos", seconds=slice_s).toPandas().sort_values(["k", "ts"])
    assert np.allclose(got.prev.to_numpy(float), pdf.prev.to_numpy(float), equal_nan=True)
    assert np.allclose(got.run, pdf.run) and (got.pos.to_numpy() == pdf.pos.to_numpy()).all()


def test_fill_both_ways_and_gaps(spark):
    months = [dt.date(2020, m, 1) for m in (1, 2, 4, 5)]
    df = spark.createDataFrame([("a", months[0], None), ("a", months[1], 2.0), ("a", months[2], None), ("a", months[3], 5.0), ("b", months[0], None)], "k string, month date, v double")
    got = rows(df.select("k", "month", ordered.filled("v", ["k"], "month").alias("f"), ordered.filled("v", ["k"], "month", backward=False).alias("g")), "k", "month")
    assert [r[2:] for r in got] == [(2.0, None), (2.0, 2.0), (2.0, 2.0), (5.0, 5.0), (None, None)]
    assert rows(ordered.month_gaps(df, ["k"], "month").select("k", "month", "gap_months")) == [("a", months[2], 1)]


def test_rolling_mean_has_short_start(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "t int, v double").withColumn("k", F.lit(1))
    assert [r[0] for r in rows(df.orderBy("t").select(ordered.rolling_mean("v", ["k"], "t", 3)))] == [0.0, 0.5, 1.0, 2.0, 3.0]


@pytest.mark.parametrize("slice_s, unique", [(900, False), (86400, True), (30 * 86400, False), (900, True)])
def test_asof_backward_matches_pandas(spark, skewed, slice_s, unique):
    right = skewed.sample(frac=0.2, random_state=1).rename(columns={"v": "w"}).sort_values("ts")
    right.loc[right.index[::5], "w"] = np.nan
    left = skewed.sort_values("ts")
    want = pd.merge_asof(left, right.dropna(), on="ts", by="k", direction="backward").sort_values(["k", "ts"])
    l, r = spark_df(spark, left, "k long, ts timestamp_ntz, v double"), spark_df(spark, right, "k long, ts timestamp_ntz, w double")
    got = asof.asof_backward(l, r, ["k"], "ts", ["w"], slice_seconds=slice_s, unique=unique).toPandas().sort_values(["k", "ts"])
    assert len(got) == len(want) and np.allclose(got.w.to_numpy(float), want.w.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("slice_s, unique", [(60, False), (7200, True), (86400, False), (86400, True)])
def test_asof_nearest_matches_pandas(spark, skewed, slice_s, unique):
    right = skewed.sample(frac=0.3, random_state=2).rename(columns={"v": "w"}).sort_values("ts")
    left = skewed.sort_values("ts")
    want = pd.merge_asof(left, right, on="ts", by="k", direction="nearest", tolerance=pd.Timedelta("45min")).sort_values(["k", "ts"])
    l, r = spark_df(spark, left, "k long, ts timestamp_ntz, v double"), spark_df(spark, right, "k long, ts timestamp_ntz, w double")
    got = asof.asof_nearest(l, r, ["k"], "ts", ["w"], 45 * 60, slice_seconds=slice_s, unique=unique).toPandas().sort_values(["k", "ts"])
    assert np.allclose(got.w.to_numpy(float), want.w.to_numpy(float), equal_nan=True)


def test_asof_nearest_edges(spark):
    left = spark.createDataFrame([("a", at(0)), ("b", at(0)), ("c", at(0)), ("d", at(0)), ("e", at(0)), ("f", None)], "k string, ts timestamp_ntz")
    right = spark.createDataFrame(
        [("a", at(-30), 1.0), ("a", at(30), 2.0), ("b", at(45), 3.0), ("c", at(45) + dt.timedelta(seconds=1), 4.0), ("d", at(0), None), ("e", at(-10), 6.0), ("e", at(5), 7.0)],
        "k string, ts timestamp_ntz, v double",
    )
    got = dict((r[0], r[2]) for r in rows(asof.asof_nearest(left, right, ["k"], "ts", ["v"], 45 * 60)))
    assert got == dict((r[0], r[2]) for r in rows(asof.asof_nearest(left, right, ["k"], "ts", ["v"], 45 * 60, unique=True)))
    # Tie: earlier row. 45:00 matches, 45:01 does not. A matched row may itself be unknown.
    assert got == {"a": 1.0, "b": 3.0, "c": None, "d": None, "e": 7.0, "f": None}


def test_asof_keeps_repeated_probes(spark):
    left = spark.createDataFrame([("a", at(5), i) for i in range(50)], "k string, ts timestamp_ntz, i int")
    right = spark.createDataFrame([("a", at(0), 1.0), ("a", at(0), 2.0)], "k string, ts timestamp_ntz, v double")
    got = asof.asof_backward(left, right, ["k"], "ts", ["v"], tie=["v"])
    assert got.count() == 50 and got.where("v = 2.0").count() == 50


def test_monthly_steps_equal_asof(spark):
    series = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0), (dt.date(2020, 4, 1), None), (dt.date(2020, 6, 1), 3.0)], "d date, v double")
    got = dict(rows(ordered.monthly_steps(series, [], "d", ["v"], F.lit(dt.date(2020, 8, 1)))))
    assert got == {dt.date(2020, m, 1): 1.0 if m < 6 else 3.0 for m in range(1, 9)}


@pytest.mark.parametrize("slice_s", [3600, 30 * 86400])
def test_interval_count_matches_brute_force(spark, slice_s):
    rng = np.random.default_rng(5)
    spans = [("a" if i % 3 else "b", float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 2000, 60), rng.integers(0, 900, 60)))]
    spans += [("a", 100.0, 110.0), ("a", 110.0, 110.0), ("b", 103.5, 130.0)]
    ticks = [(k, 10 * i) for k in "ab" for i in range(300)]
    want = {(k, m): sum(1 for kk, s, e in spans if kk == k and s <= m < e) for k, m in ticks}
    t = spark.createDataFrame([(k, at(m)) for k, m in ticks], "k string, ts timestamp_ntz")
    iv = spark.createDataFrame([(k, at(s), at(e)) for k, s, e in spans], "k string, s timestamp_ntz, e timestamp_ntz")
    got = rows(intervals.open_interval_count(t, iv, ["k"], "s", "e", 10, slice_seconds=slice_s).select("k", "ts", "n_open"))
    assert {(k, int((ts - T0).total_seconds() // 60)): n for k, ts, n in got} == want


@pytest.mark.parametrize("stretch, parts", [(1 << 20, 1 << 20), (10, 1 << 20), (3, 2)])
def test_exact_quantiles_match_numpy(spark, skewed, monkeypatch, stretch, parts):
    monkeypatch.setattr(quantiles, "STRETCH", stretch)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    monkeypatch.setattr(quantiles, "PER_FOLD", 2 if parts == 2 else 4096)
    pdf = skewed.assign(v=skewed.v.where(skewed.index % 3 > 0, 0.5) - 0.25)  # a third of the values are equal
    df = spark_df(spark, pdf, "k long, ts timestamp_ntz, v double")
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r[0]: r[1:] for r in rows(quantiles.exact_quantiles(df, ["k"], "v", probs))}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.percentile(g.v, [0, 37, 50, 95, 100]))
    counted = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    again = {r[0]: r[1] for r in rows(quantiles.exact_quantiles(counted, ["k"], "v", {"p": 0.37}, weight="n"))}
    assert all(np.isclose(again[k], got[k][1]) for k in got)


def test_exact_quantiles_of_odd_values_and_null_keys(spark):
    inf, nan = float("inf"), float("nan")
    data = [("a", None, v) for v in (1.0, -0.0, 0.0, 1e-300, -1e300, 1e300, inf, -inf)] + [(None, 1, float(v)) for v in range(5)] + [(None, None, 7.0), ("n", 2, nan), ("n", 2, 1.0), ("x", 1, None)]
    df = spark.createDataFrame(data, "k string, j int, v double").repartition(3)
    got = {(r.k, r.j): (r.lo, r.mid, r.hi) for r in quantiles.exact_quantiles(df, ["k", "j"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert got.keys() == {("a", None), (None, 1), (None, None), ("n", 2)}
    assert got["a", None] == (-inf, 5e-301, inf) and got[None, 1] == (0.0, 2.0, 4.0) and got[None, None] == (7.0, 7.0, 7.0)
    assert got["n", 2][0] == 1.0 and math.isnan(got["n", 2][2])
    assert quantiles.exact_quantiles(df.where("false"), ["k"], "v", {"p": 0.5}).count() == 0


def test_timeline_spans_days(spark):
    df = spark.createDataFrame([("a", at(5), at(3000)), ("b", at(0), at(0))], "k string, s timestamp_ntz, e timestamp_ntz")
    got = timeline.ten_minute_timeline(df, ["k"], "s", "e")
    assert rows(got.groupBy("k").agg(F.count("ts"), F.min("ts"), F.max("ts"), F.count_distinct("ts")), "k") == [("a", 301, at(0), at(3000), 301), ("b", 1, at(0), at(0), 1)]


def test_quarter_expansion(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 4, 1), 3.0), ("a", dt.date(2020, 4, 1), 9.0)], "k string, q date, v double")
    want = lambda x: [("a", dt.date(2020, m, 1), x) for m in (4, 5, 6)]
    for how, value in (("mean", 6.0), ("split", 4.0), ("first", 3.0)):
        assert rows(timeline.quarter_to_months(df, ["k"], "q", "v", how, order="v"), "month") == want(value)
    with pytest.raises(ValueError):
        timeline.quarter_to_months(df, ["k"], "q", "v", "median")
