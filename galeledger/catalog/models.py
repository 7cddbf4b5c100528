"""M*: fits, predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import clip
from ..operators import checks, forecast, learn, ols, score
from ..operators.aggregate import telemetry_hourly
from ..operators.ordered import lag_row, row_trend
from ..plans import energy
from ..functions.wind import specific_power
from ..sources.catalogue import attach_turbines
from .base import GRID_STEP, Tables, query, r, rounded, sql

FEATS = learn.FEATURES
ANCHOR = "1996-12-01"


def fit_ctes(src: str, key: str, season: str | None, y: str, xs: list[str], p: str = "f") -> dict[str, str]:
    """Within-season least squares written with row deviations: <p>_d, <p>_b, <p>_a."""
    part = f"PARTITION BY {key}, {season}" if season else f"PARTITION BY {key}"
    known = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    dev = ", ".join(f"{c} - avg({c}) OVER ({part}) AS d{i}" for i, c in enumerate([y, *xs]))
    if len(xs) == 1:
        slopes = f"sum(d0 * d1) / sum(d1 * d1) AS b_{xs[0]}"
    else:
        det = "(sum(d1 * d1) * sum(d2 * d2) - sum(d1 * d2) * sum(d1 * d2))"
        slopes = (
            f"(sum(d0 * d1) * sum(d2 * d2) - sum(d0 * d2) * sum(d1 * d2)) / {det} AS b_{xs[0]}, "
            f"(sum(d0 * d2) * sum(d1 * d1) - sum(d0 * d1) * sum(d1 * d2)) / {det} AS b_{xs[1]}"
        )
    by = f"{key}, {season}" if season else key
    icpt = f"avg({y})" + "".join(f" - any_value(b_{x}) * avg({x})" for x in xs)
    return {
        f"{p}_d": f"SELECT *, {dev} FROM {src} WHERE {known}",
        f"{p}_b": f"SELECT {key}, {slopes} FROM {p}_d GROUP BY {key}",
        f"{p}_a": f"SELECT {by}, {icpt} AS a FROM {p}_d JOIN {p}_b USING ({key}) GROUP BY {by}",
    }


MONTHS_FROM = "((year(month) - 1996) * 12 + month(month) - 12)"
Z_ROWS = f"""SELECT tso, month, month(month) AS s, ln(price + 200) - (10 + {MONTHS_FROM} / 12 * ln(1.01::DOUBLE) + 0.15) AS z FROM region_month"""
Z_LAGGED = "SELECT *, lag(z) OVER (PARTITION BY tso ORDER BY month) AS zl FROM zr"
PRICE_FIT = {"zr": Z_ROWS, "zz": Z_LAGGED, **fit_ctes("zz", "tso", "s", "z", ["zl"])}
CF_ROWS = "SELECT tso, month, month(month) AS s, ln(capture_factor) AS z, ln(greatest(wind_mwh, 1)) AS lw FROM region_month WHERE capture_factor > 0"
CF_FIT = {"zr": CF_ROWS, "zz": Z_LAGGED, **fit_ctes("zz", "tso", "s", "z", ["zl", "lw"])}


def price_model(t: Tables) -> DataFrame:
    return forecast.fit_price_model(t.region_month(), ["tso"], "price", F.lit(ANCHOR).cast("date"))


def _by_season(model: DataFrame, *cols: str) -> DataFrame:
    return model.select("tso", *cols, F.explode("season_intercepts").alias("season", "intercept"))


@query("m1_price_ar", sql("SELECT tso, CAST(s AS INT) AS season, round(b_zl, 6) AS phi, round(a, 6) AS intercept FROM f_a JOIN f_b USING (tso)", "region_month", **PRICE_FIT))
def m1(t: Tables) -> DataFrame:
    return rounded(_by_season(price_model(t), "phi"), ["phi", "intercept"])


@query("m2_capture_ar", sql("SELECT tso, CAST(s AS INT) AS season, round(greatest(0, least(0.98, b_zl)), 6) AS phi, round(b_lw, 6) AS b_log_wind, round(a, 6) AS intercept FROM f_a JOIN f_b USING (tso)", "region_month", **CF_FIT))
def m2(t: Tables) -> DataFrame:
    model = forecast.fit_capture_model(t.region_month(), ["tso"])
    return rounded(_by_season(model, "phi", "b_log_wind"), ["phi", "b_log_wind", "intercept"])


@query("m3_rate_per_operator", sql("SELECT tso, round(regr_slope(cr, S), 6) AS slope, round(regr_intercept(cr, S), 6) AS intercept FROM tso_quarter GROUP BY ALL", "tso_quarter"))
def m3(t: Tables) -> DataFrame:
    fit = ols.fit_line(t.tso_quarter(), ["tso"], "cr", "S")
    return fit.select("tso", r("b_S").alias("slope"), r("intercept").alias("intercept"))


def _interaction_rows(t: Tables) -> DataFrame:
    return t.tso_quarter().withColumn("S_logW", F.col("S") * F.log(F.greatest(F.col("wind_mwh"), F.lit(1.0))))


INTERACTION = "SELECT tso, quarter, cr, S, S * ln(greatest(wind_mwh, 1)) AS S_logW, prod_mwh, curt_mwh FROM tso_quarter"


@query("m4_rate_two_regressors", sql("SELECT tso, round(b_S, 4) AS b_s, round(b_S_logW, 4) AS b_slogw, round(a, 4) AS intercept FROM f_a JOIN f_b USING (tso)", "tso_quarter", i=INTERACTION, **fit_ctes("i", "tso", None, "cr", ["S", "S_logW"])))
def m4(t: Tables) -> DataFrame:
    fit = ols.fit_within(_interaction_rows(t), ["tso"], None, "cr", ["S", "S_logW"])
    return fit.select("tso", r("b_S", 4).alias("b_s"), r("b_S_logW", 4).alias("b_slogw"), r("intercept", 4).alias("intercept"))


STRESS = "SELECT q.*, x.stress FROM tso_quarter q JOIN (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, quantile_cont(l_extendedprice, 0.95) / 100000 AS stress FROM lineitem GROUP BY ALL) x USING (quarter)"
COMMON = {
    "st": STRESS, "u": "SELECT tso, regr_slope(cr, S) AS b1, regr_intercept(cr, S) AS a1, regr_slope(stress, S) AS b2, regr_intercept(stress, S) AS a2 FROM st GROUP BY tso",
    "e": "SELECT tso, cr - (a1 + b1 * S) AS ey, stress - (a2 + b2 * S) AS ex FROM st JOIN u USING (tso)", "g": "SELECT sum(ey * ex) / sum(ex * ex) AS g FROM e",
}


@query("m5_common_slope", sql("SELECT tso, round(g, 6) AS b_stress, round(b1 - g * b2, 6) AS b_s, round(a1 - g * a2, 6) AS intercept FROM u, g", "tso_quarter", **COMMON))
def m5(t: Tables) -> DataFrame:
    from ..operators.quantiles import exact_quantiles

    rows = t.lineitem.select(F.trunc(F.col("l_shipdate").cast("date"), "QUARTER").alias("quarter"), "l_extendedprice")
    stress = exact_quantiles(rows, ["quarter"], "l_extendedprice", {"p": 0.95}).select("quarter", (F.col("p") / 100000).alias("stress"))
    fit = ols.fit_common_slope(t.tso_quarter().join(stress, "quarter"), ["tso"], "cr", "S", "stress")
    return fit.select("tso", r("b_stress").alias("b_stress"), r("b_S").alias("b_s"), r("intercept").alias("intercept"))


_HC3 = {
    **COMMON, "rs": "SELECT sum(ex * ex) AS rss FROM e",
    "km": "SELECT tso, count(*) AS n, avg(S) AS mx, avg(stress) AS mz, sum(S * S) - count(*) * avg(S) * avg(S) AS sxx FROM st GROUP BY tso",
    "w": """SELECT st.tso, n, mx, mz, b2, rss, (S - mx) / sxx AS p, stress - (a2 + b2 * S) AS r, cr - (a1 - g * a2) - (b1 - g * b2) * S - g * stress AS er, 1.0 / n + (S - mx) * (S - mx) / sxx + (stress - (a2 + b2 * S)) * (stress - (a2 + b2 * S)) / rss AS h
        FROM st JOIN u USING (tso) JOIN km USING (tso), g, rs""",
    "uu": "SELECT *, (er / (1 - h)) * (er / (1 - h)) AS q, 1.0 / n - mx * p AS s0 FROM w",
    "tot": "SELECT sum(r * r * q) AS a FROM uu",
}


@query("m5_robust_errors", sql("""SELECT tso, round(sqrt(sum((p - b2 / rss * r) * (p - b2 / rss * r) * q) + any_value(b2 / rss * b2 / rss) * (any_value(a) - sum(r * r * q))), 6) AS se_s, round(any_value(sqrt(a) / rss), 6) AS se_stress,
    round(sqrt(sum((s0 + (mx * b2 - mz) / rss * r) * (s0 + (mx * b2 - mz) / rss * r) * q) + any_value((mx * b2 - mz) / rss * (mx * b2 - mz) / rss) * (any_value(a) - sum(r * r * q))), 6) AS se_intercept FROM uu, tot GROUP BY tso""", "tso_quarter", **_HC3))
def m5b(t: Tables) -> DataFrame:
    from ..operators.quantiles import exact_quantiles

    rows = t.lineitem.select(F.trunc(F.col("l_shipdate").cast("date"), "QUARTER").alias("quarter"), "l_extendedprice")
    stress = exact_quantiles(rows, ["quarter"], "l_extendedprice", {"p": 0.95}).select("quarter", (F.col("p") / 100000).alias("stress"))
    out = ols.common_slope_errors(t.tso_quarter().join(stress, "quarter"), ["tso"], "cr", "S", "stress")
    return out.select("tso", r("se_S").alias("se_s"), r("se_stress").alias("se_stress"), r("se_intercept").alias("se_intercept"))


TREND = "SELECT tso, month, month(month) AS s, row_number() OVER (PARTITION BY tso ORDER BY month) - 1 AS trend, ln(greatest(wind_mwh, 1)) AS lw, ln(capture_factor) AS u FROM region_month"
_NO_JULY = "SELECT * FROM tr WHERE s <> 7"


@query("m6_trend_model", sql("""SELECT tr.tso, tr.month, round(b_trend * trend + b_lw * lw + coalesce(f_a.a, base.a), 6) AS pred FROM tr JOIN f_b USING (tso) LEFT JOIN f_a ON f_a.tso = tr.tso AND f_a.s = tr.s
    JOIN (SELECT tso, arg_min(a, s) AS a FROM f_a GROUP BY tso) base ON base.tso = tr.tso""", "region_month", tr=TREND, nj=_NO_JULY, **fit_ctes("nj", "tso", "s", "u", ["trend", "lw"])))
def m6(t: Tables) -> DataFrame:
    rows = t.region_month().select(
        "tso", "month", F.month("month").alias("season"), row_trend(["tso"], "month").alias("trend"),
        F.log(F.greatest(F.col("wind_mwh"), F.lit(1.0))).alias("lw"), F.log("capture_factor").alias("u"),
    )
    fit = ols.fit_within(rows.where("season <> 7"), ["tso"], "season", "u", ["trend", "lw"])
    return ols.predict_within(rows, fit, ["tso"], "season", ["trend", "lw"]).select("tso", "month", r("pred").alias("pred"))


QTREND = "SELECT tso, quarter, quarter(quarter) AS s, row_number() OVER (PARTITION BY tso ORDER BY quarter) - 1 AS trend, ln(greatest(wind_mwh, 1)) AS lw, cr FROM tso_quarter"


@query("m7_quarterly_model", sql("""SELECT tso, CAST(s AS INT) AS season, round(b_trend, 6) AS b_trend, round(b_lw, 6) AS b_lw, round(a, 6) AS intercept FROM f_a JOIN f_b USING (tso)""", "tso_quarter", q=QTREND, **fit_ctes("q", "tso", "s", "cr", ["trend", "lw"])))
def m7(t: Tables) -> DataFrame:
    rows = t.tso_quarter().select(
        "tso", F.quarter("quarter").alias("season"), row_trend(["tso"], "quarter").alias("trend"), F.log(F.greatest(F.col("wind_mwh"), F.lit(1.0))).alias("lw"), "cr"
    )
    fit = ols.fit_within(rows, ["tso"], "season", "cr", ["trend", "lw"])
    return rounded(fit.select("tso", "season", "b_trend", "b_lw", "intercept"), ["b_trend", "b_lw", "intercept"])


CF_LINEAR = "SELECT tso, month, month(month) AS s, row_number() OVER (PARTITION BY tso ORDER BY month) - 1 AS t, wind_mwh / 1000 AS w, capture_factor AS y FROM region_month"


@query("m8_capture_linear", sql("""SELECT tso, round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae FROM (
    SELECT c.*, a + b_t * t + b_w * w AS p, avg(y) OVER (PARTITION BY tso) AS m FROM c JOIN f_b USING (tso) JOIN f_a USING (tso, s)) GROUP BY tso""", "region_month", c=CF_LINEAR, **fit_ctes("c", "tso", "s", "y", ["t", "w"])))
def m8(t: Tables) -> DataFrame:
    rows = t.region_month().select("tso", F.month("month").alias("season"), row_trend(["tso"], "month").alias("t"), (F.col("wind_mwh") / 1000).alias("w"), F.col("capture_factor").alias("y"))
    fit = ols.fit_within(rows, ["tso"], "season", "y", ["t", "w"])
    scored = ols.predict_within(rows, fit, ["tso"], "season", ["t", "w"])
    return rounded(score.comparison_metrics(scored, ["tso"], "y", "pred").select("tso", "r2", "mae"), ["r2", "mae"])


WAVE = "SELECT tso, ln(price) AS y, sin(2 * pi() * month(month) / 12) AS sn, cos(2 * pi() * month(month) / 12) AS cs FROM region_month"


@query("m9_fourier", sql("SELECT tso, CAST(k AS INT) AS season, round(0.25 * (b_sn * sin(2 * pi() * k / 12) + b_cs * cos(2 * pi() * k / 12)), 6) AS season_effect FROM f_b, range(1, 13) AS h(k)", "region_month", w=WAVE, **fit_ctes("w", "tso", None, "y", ["sn", "cs"])))
def m9(t: Tables) -> DataFrame:
    rows = t.region_month().select("tso", F.month("month").alias("m"), F.log("price").alias("y"))
    return rounded(ols.fit_fourier(rows, ["tso"], "m", "y", 1, 0.25), ["season_effect"])


@query("m9_fourier_two_harmonics")
def m9b(t: Tables) -> DataFrame:
    rows = t.region_month().select("tso", F.month("month").alias("m"), F.log("price").alias("y"))
    return rounded(ols.fit_fourier(rows, ["tso"], "m", "y", 2, 0.25), ["season_effect"])


DEV = "SELECT tso, month, ln(price) - avg(ln(price)) OVER (PARTITION BY tso) AS z FROM region_month"


@query("m10_ar_residual", sql("""SELECT tso, round(phi, 6) AS phi_raw, round(greatest(0, least(0.98, phi)), 6) AS phi, round(sd, 6) AS sigma, n FROM (
    SELECT tso, any_value(phi) AS phi, stddev_samp(z - phi * zl) AS sd, count(*) AS n FROM zz JOIN (SELECT tso, sum(z * zl) / sum(zl * zl) AS phi FROM zz WHERE zl IS NOT NULL GROUP BY tso) USING (tso) WHERE zl IS NOT NULL GROUP BY tso)""", "region_month", zr=DEV, zz=Z_LAGGED))
def m10(t: Tables) -> DataFrame:
    mean = t.region_month().groupBy("tso").agg(F.avg(F.log("price")).alias("m"))
    rows = t.region_month().join(mean, "tso").select("tso", "month", (F.log("price") - F.col("m")).alias("z"))
    rows = rows.withColumn("zl", lag_row("z", ["tso"], "month"))
    return rounded(ols.fit_ar_residual(rows, ["tso"], "z", "zl"), ["phi_raw", "phi", "sigma"])


SPLIT = "1999-10-01"
BACKTEST = {
    "tr": f"SELECT * FROM tso_quarter WHERE quarter <= '{SPLIT}'", "fit": "SELECT tso, regr_slope(cr, S) AS b, regr_intercept(cr, S) AS a FROM tr GROUP BY tso",
    "pr": f"SELECT q.*, CASE WHEN quarter <= '{SPLIT}' THEN 'train' ELSE 'test' END AS split, greatest(0, least(0.35, a + b * S)) AS pred FROM tso_quarter q JOIN fit USING (tso)",
}


def _backtest(t: Tables) -> DataFrame:
    q = t.tso_quarter()
    cut = F.lit(SPLIT).cast("date")
    fit = ols.fit_line(q.where(F.col("quarter") <= cut), ["tso"], "cr", "S")
    rows = ols.predict_within(q, fit, ["tso"], None, ["S"], "raw")
    return rows.withColumn("pred", clip("raw", 0.0, 0.35)).withColumn("split", F.when(F.col("quarter") <= cut, "train").otherwise("test"))


@query("m11_predict_clip", sql("SELECT tso, quarter, split, round(pred, 6) AS pred FROM pr", "tso_quarter", **BACKTEST))
def m11(t: Tables) -> DataFrame:
    return _backtest(t).select("tso", "quarter", "split", r("pred").alias("pred"))


@query("m12_error_metrics", sql("SELECT split, tso, round(sqrt(avg((cr - pred) * (cr - pred))), 6) AS rmse, round(avg(abs(cr - pred)), 6) AS mae, round(sum(pred * prod_mwh - curt_mwh), 2) AS volume_error FROM pr GROUP BY ALL", "tso_quarter", **BACKTEST))
def m12(t: Tables) -> DataFrame:
    out = score.error_metrics(_backtest(t), ["split", "tso"], "cr", "pred", "prod_mwh", "curt_mwh")
    return rounded(rounded(out, ["rmse", "mae"]), ["volume_error"], 2)


@query("m13_series_comparison", sql("""SELECT zone, count(*) AS n, round(avg(b - a), 6) AS bias, round(avg(abs(b - a)), 6) AS mae, round(sqrt(avg((b - a) * (b - a))), 6) AS rmse, round(avg(abs((b - a) / a)) * 100, 6) AS mape,
    round(corr(a, b), 6) AS r, round(1 - sum((b - a) * (b - a)) / (count(*) * var_pop(a)), 6) AS r2 FROM (
    SELECT zone, date_trunc('month', ts) AS m, avg(price_eur_mwh) AS a, sum(price_eur_mwh * wind_mwh) / sum(wind_mwh) AS b FROM zone_hourly GROUP BY ALL) GROUP BY ALL""", "zone_hourly"))
def m13(t: Tables) -> DataFrame:
    from ..operators.aggregate import capture_factor

    monthly = capture_factor(t.zone_hourly(), ["zone"], "ts", "price_eur_mwh", "wind_mwh")
    return rounded(score.comparison_metrics(monthly, ["zone"], "p_market", "p_capture"), ["bias", "mae", "rmse", "mape", "r", "r2"])


# --- learned correction: metrics depend on the learner, so there is no SQL twin -----

def tree_settings() -> dict:
    """Small trees for the driver's check; the defaults of the library are larger."""
    return {"max_iter": 4, "max_depth": 3, "step": 0.3, "subsample": 1.0}


def turbine_meta(t: Tables) -> DataFrame:
    i = F.substring("turbine_id", 2, 9).cast("int")
    return t.telemetry().select("turbine_id", "turbine_type").distinct().select(
        "turbine_id", "turbine_type", (50 + (i % 5) * 0.1).alias("lat"), (10 + (i % 4) * 0.1).alias("lon"), (90.0 + 5 * i).alias("hub_height_m")
    )


def ml_rows(t: Tables) -> DataFrame:
    """Hourly telemetry with climate features, expected energy and targets."""
    meta, cat = turbine_meta(t), t.catalogue()
    rows = t.telemetry().withColumn("is_available", F.col("power_kw") >= 0).drop("turbine_type")
    hourly = attach_turbines(telemetry_hourly(rows), meta, cat)
    hourly = hourly.withColumn("specific_power_wpm2", specific_power("rated_power_kw", "rotor_diameter_m")).drop("cut_in_ws")
    climate = energy.site_climate(meta, t.climate(), "turbine_id", GRID_STEP)
    return energy.training_matrix(hourly, climate, cat, tolerance_s=12 * 3600)


@query("m14_correction_trees")
def m14(t: Tables) -> DataFrame:
    rows = ml_rows(t)
    model = learn.fit_correction(rows, FEATS, **tree_settings())
    return learn.log_metrics(model.transform(learn.training_rows(rows)))


@query("m15_median_imputer", sql("SELECT round(median(value), 6) AS med, round(avg(CASE WHEN event_type = 'error' THEN (SELECT median(value) FROM events WHERE event_type <> 'error') ELSE value END), 6) AS mean_filled FROM events WHERE event_type <> 'error' OR true"))
def m15(t: Tables) -> DataFrame:
    # The exact median; the pipeline's Imputer uses Spark ML's approximate one.
    from ..operators.quantiles import exact_quantiles

    rows = t.events.select(F.lit(1).alias("k"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    med = exact_quantiles(rows, ["k"], "v", {"med": 0.5})
    everything = exact_quantiles(t.events.select(F.lit(1).alias("k"), F.col("value").alias("v")), ["k"], "v", {"m": 0.5}).select("m").scalar()
    filled = rows.join(F.broadcast(med), "k").agg(r(F.avg(F.coalesce("v", "med"))).alias("mean_filled"))
    return filled.select(r(everything).alias("med"), "mean_filled")


@query("m15_fold_medians", """SELECT f.fold, count(*) AS n_train, true AS near_half FROM events JOIN (SELECT DISTINCT 'T' || (user_id % 10) AS fold FROM events) f ON 'T' || (user_id % 10) <> f.fold
    WHERE event_type <> 'error' GROUP BY f.fold""")
def m15b(t: Tables) -> DataFrame:
    """The medians of each fold's training rows, by merged summaries: half a percent of ranks around the middle at most."""
    from ..operators.impute import fold_medians

    c = F.col
    rows = t.events.select(F.concat(F.lit("T"), (c("user_id") % 10).cast("string")).alias("fold"), F.when(c("event_type") != "error", c("value")).alias("v"))
    medians = fold_medians(rows, "fold", ["v"]).select(c("fold").alias("left_out"), c("medians")[0].alias("m"))
    both = rows.where("v is not null").join(F.broadcast(medians), c("fold") != c("left_out"))  # ten folds
    share = F.avg(F.when(c("v") < c("m"), 1.0).when(c("v") == c("m"), 0.5).otherwise(0.0))
    return both.groupBy(c("left_out").alias("fold")).agg(F.count(F.lit(1)).alias("n_train"), share.between(0.495, 0.505).alias("near_half"))


@query("m16_leave_one_group_out")
def m16(t: Tables) -> DataFrame:
    return learn.leave_one_group_out(ml_rows(t), "turbine_type", ["turbine_id", "ts"], FEATS, **tree_settings())


@query("m17_validation_split", sql("SELECT CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) + 0.5::DOUBLE < 4294967296.0::DOUBLE * (SELECT least(0.5, least(greatest(2000, CAST(floor(0.1::DOUBLE * n) AS BIGINT)), greatest(1000, n // 5)) / n) FROM (SELECT count(*) AS n FROM events)) AS validate, count(*) AS n FROM events GROUP BY ALL"))
def m17(t: Tables) -> DataFrame:
    rows = t.events.select("event_id")
    marked = learn.mark_validation(rows, ["event_id"], rows.count())
    return marked.groupBy(F.col("_validate").alias("validate")).agg(F.count(F.lit(1)).alias("n"))


@query("m18_energy_metrics", """SELECT count(*) AS n, round(sqrt(avg((e - p) * (e - p))), 4) AS rmse_kwh, round(avg(abs(e - p)), 4) AS mae_kwh, round(1 - sum((e - p) * (e - p)) / (count(*) * var_pop(e)), 6) AS r2
    FROM (SELECT value * 10 AS e, (value * 8 + 30) * exp(user_id % 5 / 10) AS p FROM events WHERE event_type <> 'error')""")
def m18(t: Tables) -> DataFrame:
    c = F.col
    rows = t.events.select(
        (c("value") * 10).alias("energy_kwh"), (c("value") * 8 + 30).alias("expected_energy_kwh"), (c("user_id") % 5 / 10).alias("pred_log_cf"), (c("event_type") != "error").alias(learn.VALID)
    )
    scored = rows.withColumn("pred_energy_kwh", c("expected_energy_kwh") * F.exp("pred_log_cf"))
    return rounded(rounded(learn.energy_metrics(scored), ["rmse_kwh", "mae_kwh"], 4), ["r2"])


@query("m19_batch_inference")
def m19(t: Tables) -> DataFrame:
    rows = ml_rows(t)
    model = learn.fit_correction(rows, FEATS, **tree_settings())
    return learn.predict_energy(rows, model).select("turbine_id", "ts", "energy_kwh", "expected_energy_kwh", "pred_energy_kwh")


@query("m20_dataset_validation", """SELECT turbine_id, count(*) AS rows, round(avg(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS valid_fraction, min(ts) AS time_start, max(ts) AS time_end,
    concat_ws(';', CASE WHEN turbine_id = 'T1' THEN 'negative energy' END, CASE WHEN bool_or(user_id % 3 = 0 AND user_id % 11 = 0) THEN 'non-finite log target in a valid row' END,
    CASE WHEN turbine_id = 'T2' THEN 'missing turbine metadata' END) AS errors, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 6) AS max_missing_fraction
    FROM (SELECT *, 'T' || (user_id % 10) AS turbine_id FROM events) GROUP BY turbine_id""")
def m20(t: Tables) -> DataFrame:
    c = F.col
    rows = t.events.withColumn("turbine_id", F.concat(F.lit("T"), (c("user_id") % 10).cast("string"))).select(
        "turbine_id", "ts", F.when(c("turbine_id") == "T1", -c("value") - 1).otherwise(c("value")).alias("energy_kwh"), c("value").alias("expected_energy_kwh"),
        F.lit(1.0).alias("target_correction_factor"), F.when(c("user_id") % 11 != 0, 0.0).alias("target_log_correction_factor"), (c("user_id") % 3 == 0).alias("target_is_valid"),
        F.lit(2000.0).alias("rated_power_kw"), F.lit("s").alias("site_id"), F.lit(100.0).alias("hub_height_m"), F.when(c("turbine_id") != "T2", "x").alias("turbine_type"),
        F.when(c("event_type") != "error", c("value")).alias("era5_ws_hub"), *[c("value").alias(x) for x in checks.CLIMATE_REQUIRED[1:]],
    )
    out = checks.validate_dataset(rows)
    return out.select("turbine_id", "rows", r("valid_fraction").alias("valid_fraction"), "time_start", "time_end", F.concat_ws(";", "errors").alias("errors"), r("max_missing_fraction").alias("max_missing_fraction"))
