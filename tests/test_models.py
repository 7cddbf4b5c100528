"""Fits and forecasts against explicit design matrices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from galeledger.operators import aggregate, forecast, ols, score, simulate
from galeledger.plans import market


def months(n, start=(2010, 1)):
    y, m = start
    return [dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    return {k: 60 + 10 * np.sin(np.arange(100) / 6) + rng.normal(0, 5, 100) for k in ("a", "b")}


@pytest.fixture(scope="module")
def monthly(spark, series):
    return spark.createDataFrame([(k, d, float(v), 1000.0 + i) for k, vs in series.items() for i, (d, v) in enumerate(zip(months(100), vs))], "k string, month date, price double, w double")


def dummy_fit(y, xs, season):
    levels = sorted(set(season))
    X = np.column_stack([np.ones(len(y)), *xs, *[(season == lv).astype(float) for lv in levels[1:]]])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    return beta[1:1 + len(xs)], {lv: beta[0] + (beta[1 + len(xs) + i - 1] if i else 0) for i, lv in enumerate(levels)}


def test_within_season_fit_equals_dummies(spark, series, monthly):
    df = monthly.withColumn("s", F.month("month")).withColumn("x2", F.col("w") % 7)
    fit = ols.fit_within(df, ["k"], "s", "price", ["w", "x2"])
    for k, v in series.items():
        w = 1000.0 + np.arange(100)
        slopes, icpt = dummy_fit(v, [w, w % 7], np.array([d.month for d in months(100)]))
        got = {r["s"]: r for r in fit.where(F.col("k") == k).collect()}
        assert np.allclose([got[1]["b_w"], got[1]["b_x2"]], slopes)
        assert np.allclose([got[s]["intercept"] for s in sorted(icpt)], [icpt[s] for s in sorted(icpt)])


def test_unseen_season_uses_base(spark, monthly):
    df = monthly.withColumn("s", F.month("month"))
    fit = ols.fit_within(df.where("s <> 5"), ["k"], "s", "price", ["w"])
    got = ols.predict_within(df.where("s IN (1, 5)").withColumn("w", F.lit(0.0)), fit, ["k"], "s", ["w"])
    per_key = rows(got.groupBy("k").agg(F.count_distinct(F.round("pred", 6))))
    assert all(n == 1 for _, n in per_key)


def test_constant_regressor_has_no_slope(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "k string, x double, y double")
    assert ols.fit_within(df, ["k"], None, "y", ["x"]).first()["b_x"] is None


def test_common_slope_equals_pooled_design(spark):
    rng = np.random.default_rng(1)
    data = [(k, rng.random(), rng.random(), 0.0) for k in "abc" for _ in range(20)]
    data = [(k, x, z, 2 + ord(k) * x + 0.7 * z + rng.normal()) for k, x, z, _ in data]
    K, X, Z, Y = map(np.array, zip(*data))
    design = np.column_stack([c for k in "abc" for c in ((K == k).astype(float), (K == k) * X)] + [Z])
    beta = np.linalg.lstsq(design, Y, rcond=None)[0]
    got = {r["k"]: r for r in ols.fit_common_slope(spark.createDataFrame([(a, float(b), float(c), float(d)) for a, b, c, d in data], "k string, x double, z double, y double"), ["k"], "y", "x", "z").collect()}
    assert np.allclose([got["a"]["b_z"], got["a"]["intercept"], got["a"]["b_x"], got["c"]["b_x"]], [beta[-1], beta[0], beta[1], beta[5]])


@pytest.mark.parametrize("k", [1, 2, 3])
def test_fourier_matches_least_squares(spark, series, monthly, k):
    got = ols.fit_fourier(monthly.withColumn("m", F.month("month")), ["k"], "m", "price", k, 0.25)
    m = np.array([d.month for d in months(100)], float)
    basis = lambda t: np.column_stack([np.ones(len(t))] + [f(2 * np.pi * j * t / 12) for j in range(1, k + 1) for f in (np.sin, np.cos)])
    for key, v in series.items():
        fitted = basis(np.arange(1, 13.0)) @ np.linalg.lstsq(basis(m), v, rcond=None)[0]
        want = 0.25 * (fitted - fitted.mean())
        assert np.allclose([r["season_effect"] for r in got.where(F.col("k") == key).orderBy("season").collect()], want)


def test_ar_residual(spark, series, monthly):
    from galeledger.operators.ordered import lag_row

    df = monthly.withColumn("z", F.col("price") - 60).withColumn("zl", lag_row("z", ["k"], "month"))
    got = {r["k"]: r for r in ols.fit_ar_residual(df, ["k"], "z", "zl").collect()}
    for k, v in series.items():
        z = v - 60
        phi = (z[1:] * z[:-1]).sum() / (z[:-1] ** 2).sum()
        assert np.allclose([got[k]["phi_raw"], got[k]["sigma"]], [phi, np.std(z[1:] - phi * z[:-1], ddof=1)])


def test_price_forecast_matches_loop(spark, series, monthly):
    anchor = F.lit(dt.date(2016, 12, 1))
    model = forecast.fit_price_model(monthly, ["k"], "price", anchor)
    got = {k: [r["price_forecast"] for r in forecast.forecast_price(model, ["k"], anchor, 30).where(F.col("k") == k).orderBy("month").collect()] for k in series}
    ds, fut = months(100), months(130)[100:]
    off = lambda d: ((d.year - 2016) * 12 + d.month - 12) / 12 * np.log(1.01)
    for k, v in series.items():
        z = np.log(v + 200) - (10 + np.array([off(d) for d in ds]) + 0.15)
        (phi,), icpt = dummy_fit(z[1:], [z[:-1]], np.array([d.month for d in ds])[1:])
        prev, want = z[-1], []
        for d in fut:
            prev = phi * prev + icpt[d.month]
            want.append(np.exp(10 + off(d) + prev) - 200)
        assert np.allclose(got[k], want)


def test_growth_runs_backwards_too(spark):
    df = spark.createDataFrame([("a", d, 100.0) for d in months(12)[::3]], "k string, quarter date, v double")
    got = forecast.project_quarters(df, ["k"], "v", 0.21, F.lit(dt.date(2009, 10, 1)), F.lit(dt.date(2011, 10, 1)))
    by = {r["quarter"]: r["v"] for r in got.collect()}
    assert np.isclose(by[dt.date(2010, 10, 1)], 100) and np.isclose(by[dt.date(2011, 10, 1)], 121) and np.isclose(by[dt.date(2009, 10, 1)], 100 / 1.21)


def test_markup_is_flat_before_anchor_and_halves_after(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2025, 1, 1),), (dt.date(2037, 1, 1),)], "d date")
    got = [r[0] for r in rows(df.orderBy("d").select(forecast.markup("d", F.lit(dt.date(2025, 1, 1)), 1.22, 1.02, 12.0)))]
    assert np.allclose(got, [1.22, 1.22, 1.12])


def test_markup_without_manual_value(spark):
    market_df = spark.createDataFrame([(dt.date(2025, 1, 1), 50.0)], "date date, price double")
    auctions = spark.createDataFrame([(dt.date(2025, 1, 1), 84.0)], "date date, strike double")
    got = market.strike_path(market_df, auctions, [], m0=None).where("market_price IS NOT NULL").first()
    assert np.isclose(got["markup_path"], 84 / 70) and np.isclose(got["eeg_strike_used"], 60.0)


def test_bootstrap_draws_only_history_and_is_stable(spark):
    hist = spark.createDataFrame([("a", y, m, float(1000 * m + y)) for y in range(2000, 2021) for m in range(1, 13)], "k string, year int, month int, energy_kwh double")
    one = simulate.bootstrap_by_month(hist, ["k"], 40, 2026, 20, 42)
    two = simulate.bootstrap_by_month(hist.repartition(5), ["k"], 40, 2026, 20, 42)
    assert one.count() == 40 * 240 and one.exceptAll(two).count() == 0
    odd = one.where(F.floor((F.col("energy_kwh") - 2000) / 1000) != F.month("ts")).count()
    assert odd == 0 and one.select("energy_kwh").distinct().count() > 200
    path = simulate.representative_path(one, ["k"])
    assert path.count() == 240 and path.select("sim").distinct().count() == 1
    assert simulate.months_without_history(hist.where("month <> 3"), ["k"]).collect()[0]["month"] == 3


def test_stochastic_paths_center_on_drift(spark, monthly):
    models = market.price_simulation_models(monthly, "k", F.lit(dt.date(2014, 1, 1)), F.lit(dt.date(2018, 4, 1)))
    paths = simulate.simulate_ar_paths(models, "k", 300, 12, 42)
    assert paths.count() == 2 * 3 * 300 * 12
    bands = aggregate.quantile_bands(paths, ["k", "scenario", "month"], "price")
    assert bands.where("p10 < p50 AND p50 < p90").count() == 72 and bands.where("p50 BETWEEN 40 AND 90").count() == 72


def test_metrics(spark):
    df = spark.createDataFrame([(1, 10.0, 12.0), (1, 20.0, 19.0), (1, 0.0, 1.0), (1, None, 5.0)], "k int, t double, e double")
    m = score.comparison_metrics(df, ["k"], "t", "e").first()
    e = np.array([2, -1, 1.0])
    assert m["n"] == 3 and np.isclose(m["bias"], e.mean()) and np.isclose(m["rmse"], np.sqrt((e ** 2).mean())) and np.isclose(m["mape"], 100 * np.mean([0.2, 0.05]))
    assert np.isclose(m["r2"], 1 - (e ** 2).sum() / 200)


def test_total_rows_count_as_a_state_unless_excluded(spark):
    data = [(p, s, v, n) for p in ("planning", "permitting", "total") for s, v, n in (("A", 10.0, 1.0), ("B", 20.0, 3.0), ("Gesamt", 40.0, 4.0), ("C", None, 9.0))]
    df = spark.createDataFrame(data, "phase string, state string, mean_eur_per_kw double, projects double")
    get = lambda flag: dict(rows(aggregate.development_costs(df, include_total_row=flag)))
    assert get(True)["planning"] == 230 / 8 and get(False)["planning"] == 70 / 4 and get(True)["precheck"] == -230 / 8


def test_path_recursion_equals_the_step_by_step_form(spark):
    rng = np.random.default_rng(8)
    data = []
    for k in range(80):
        n = int(rng.choice([0, 1, 2, 7, 240]))
        data.append((k, float(rng.normal()), float(rng.choice([0.0, 0.98, -0.5, 1.0])), [float(x) for x in rng.normal(size=n)]))
    data += [(100, None, 0.5, [1.0]), (101, 1.0, None, [1.0]), (102, 1.0, 0.5, None), (103, 2.0, 0.5, [1.0, None, 3.0])]
    df = spark.createDataFrame(data, "k int, z double, phi double, u array<double>").repartition(3)
    got = {r["k"]: r["p"] for r in df.select("k", forecast.ar_path("z", "phi", "u").alias("p")).collect()}
    for k, z, phi, u in data[:-4]:
        path = []
        for x in u:
            z = phi * z + x
            path.append(z)
        assert np.allclose(got[k], path, rtol=1e-12, atol=1e-12) and len(got[k]) == len(u)
    assert got[100] is got[101] is got[102] is None and got[103] == [2.0, None, None]


def test_robust_errors_equal_the_explicit_design(spark):
    rng = np.random.default_rng(12)
    data = [(k, float(rng.normal(j)), float(rng.normal()), float(rng.normal(k == "b"))) for k, n in (("a", 30), ("b", 11), ("c", 5)) for j in range(n)]
    data = [(k, 0.3 * x - 0.8 * z + (k == "b") + e * (1 + abs(x)), x, z) for k, e, x, z in data]
    got = {r["k"]: r for r in ols.common_slope_errors(spark.createDataFrame(data, "k string, y double, x double, z double").repartition(3), ["k"], "y", "x", "z").collect()}
    names = ["a", "b", "c"]
    design = np.array([[*(float(k == n) for n in names), *(x * (k == n) for n in names), z] for k, _, x, z in data])
    y = np.array([r[1] for r in data])
    inv = np.linalg.inv(design.T @ design)
    beta = inv @ design.T @ y
    h = np.einsum("ij,jk,ik->i", design, inv, design)
    u = ((y - design @ beta) / (1 - h)) ** 2
    se = np.sqrt(np.diag(inv @ (design.T * u) @ design @ inv))
    for i, n in enumerate(names):
        assert np.allclose([got[n]["intercept"], got[n]["b_x"], got[n]["b_z"]], [beta[i], beta[3 + i], beta[6]], rtol=1e-9)
        assert np.allclose([got[n]["se_intercept"], got[n]["se_x"], got[n]["se_z"]], [se[i], se[3 + i], se[6]], rtol=1e-9)
