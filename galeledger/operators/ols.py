"""Least squares per key from grouped moments.

Seasonal dummies are never materialised. Fitting y on regressors plus a dummy per
season equals fitting on deviations from the season means, and the sums of those
deviations are ``n * covar_pop`` of the season's rows: one partial aggregate over
the data, then arithmetic on at most a dozen rows per key. Spark's covariance is
merged with a stable update, so no precision is lost to large means.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.expr import clip
from ..session import settle

PHI_BOUNDS = (0.0, 0.98)


def _moments(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    rows = df.na.drop(subset=[y, *xs])
    n = F.count(F.lit(1)).cast("double")
    aggs = [n.alias("_n"), F.avg(y).alias("_my")]
    for i, x in enumerate(xs):
        aggs += [F.avg(x).alias(f"_m{i}"), (n * F.covar_pop(x, y)).alias(f"_s{i}y")]
        aggs += [(n * F.covar_pop(x, xs[j])).alias(f"_s{i}{j}") for j in range(i, len(xs))]
    return rows.groupBy(*by).agg(*aggs)


def _solve(s: dict[str, Column], k: int) -> list[Column]:
    """Slopes of one or two regressors from centred second moments."""
    if k == 1:
        return [F.when(s["00"] != 0, s["0y"] / s["00"])]
    det = s["00"] * s["11"] - s["01"] * s["01"]
    return [
        F.when(det != 0, (s["0y"] * s["11"] - s["1y"] * s["01"]) / det),
        F.when(det != 0, (s["1y"] * s["00"] - s["0y"] * s["01"]) / det),
    ]


def fit_within(df: DataFrame, keys: Sequence[str], season: str | None, y: str, xs: Sequence[str]) -> DataFrame:
    """OLS of y on one or two regressors with an intercept per season.

    Returns one row per (key, season): slopes ``b_<x>``, that season's ``intercept``
    and ``base_intercept`` of the key's first season, which is what a season unseen
    in training falls back to.
    """
    if len(xs) not in (1, 2):
        raise ValueError("one or two regressors; use fit_fourier for more")
    by = [*keys, season] if season else list(keys)
    m = _moments(df, by, y, xs)
    over = Window.partitionBy(*keys)
    names = [f"{i}y" for i in range(len(xs))] + [f"{i}{j}" for i in range(len(xs)) for j in range(i, len(xs))]
    sums = {n: (F.sum(f"_s{n}").over(over) if season else F.col(f"_s{n}")) for n in names}
    slopes = _solve(sums, len(xs))
    m = m.select("*", *[b.alias(f"b_{x}") for b, x in zip(slopes, xs)])
    intercept = F.col("_my")
    for i, x in enumerate(xs):
        intercept = intercept - F.col(f"b_{x}") * F.col(f"_m{i}")
    m = m.withColumn("intercept", intercept)
    base = F.min_by("intercept", season).over(over) if season else F.col("intercept")
    return m.select(*by, *[f"b_{x}" for x in xs], "intercept", base.alias("base_intercept"), F.col("_n").cast("bigint").alias("n"))


def season_map(fit: DataFrame, keys: Sequence[str], season: str, slopes: Sequence[str]) -> DataFrame:
    """One row per key: slopes, map season -> intercept (at most 12 entries), base intercept."""
    return fit.groupBy(*keys).agg(
        *[F.first(b).alias(b) for b in slopes],
        F.map_from_entries(F.collect_list(F.struct(season, "intercept"))).alias("season_intercepts"),
        F.first("base_intercept").alias("base_intercept"),
    )


def predict_within(df: DataFrame, fit: DataFrame, keys: Sequence[str], season: str | None, xs: Sequence[str], name: str = "pred") -> DataFrame:
    """Score rows with a fit of :func:`fit_within`; unseen seasons use the base intercept."""
    slopes = [f"b_{x}" for x in xs]
    if season:
        per_key = season_map(fit, keys, season, slopes)
        joined = df.join(per_key, list(keys), "left")
        a = F.coalesce(F.try_element_at("season_intercepts", F.col(season)), F.col("base_intercept"))
    else:
        joined = df.join(fit.select(*keys, *slopes, "intercept"), list(keys), "left")
        a = F.col("intercept")
    for x in xs:
        a = a + F.col(f"b_{x}") * F.col(x)
    return joined.select(*df.columns, a.alias(name))


def fit_line(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """One straight line per key; a saturated ``x * C(key)`` model is exactly this."""
    rows = df.na.drop(subset=[y, x])
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias(f"b_{x}"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def fit_common_slope(df: DataFrame, keys: Sequence[str], y: str, x: str, common: str) -> DataFrame:
    """y ~ x * C(key) + common: own line per key, one shared slope on ``common``.

    The shared slope comes from the parts of y and ``common`` that x leaves
    unexplained within each key, summed over keys. A key whose x does not vary
    contributes its plain deviations.
    """
    m = _moments(df, keys, y, [x, common])
    resid = lambda a, b, ab: ab - F.when(F.col("_s00") != 0, a * b / F.col("_s00")).otherwise(0.0)
    shared = m.agg(
        (
            F.sum(resid(F.col("_s01"), F.col("_s0y"), F.col("_s1y")))
            / F.sum(resid(F.col("_s01"), F.col("_s01"), F.col("_s11")))
        ).alias("g")
    ).scalar()
    g = F.col(f"b_{common}")
    out = m.withColumn(f"b_{common}", shared)
    out = out.withColumn(f"b_{x}", F.when(F.col("_s00") != 0, (F.col("_s0y") - g * F.col("_s01")) / F.col("_s00")).otherwise(0.0))
    return out.select(
        *keys, f"b_{x}", f"b_{common}",
        (F.col("_my") - F.col(f"b_{x}") * F.col("_m0") - g * F.col("_m1")).alias("intercept"),
        F.col("_n").cast("bigint").alias("n"),
    )


def common_slope_errors(df: DataFrame, keys: Sequence[str], y: str, x: str, common: str) -> DataFrame:
    """Fit of :func:`fit_common_slope` with standard errors from the covariance HC3: ``se_<x>``, ``se_<common>``, ``se_intercept``.

    Every coefficient is a weighted sum of y, so its variance is the sum of squared weights times e^2 / (1 - h)^2, with
    residual e and leverage h of a row. The weights of a key's own rows and those by way of the shared slope are summed apart:
    one aggregate per key, and one number over all keys. A row that alone decides a coefficient (h = 1) leaves the errors NULL.
    """
    m = _moments(df, keys, y, [x, common]).withColumn("_k", F.when(F.col("_s00") != 0, F.col("_s01") / F.col("_s00")).otherwise(0.0))
    fit = fit_common_slope(df, keys, y, x, common)
    rss = m.agg(F.sum(F.col("_s11") - F.col("_k") * F.col("_s01"))).scalar()
    per_key = settle(m.join(fit.drop("n"), list(keys)).withColumn("_rss", rss), "line-fits")
    rows = df.na.drop(subset=[y, x, common]).select(*keys, F.col(y).alias("_y"), F.col(x).alias("_x"), F.col(common).alias("_z")).join(per_key, list(keys))
    c = F.col
    p = F.when(c("_s00") != 0, (c("_x") - c("_m0")) / c("_s00")).otherwise(0.0)  # weight in the key's own slope
    rest = (c("_z") - c("_m1")) - c("_k") * (c("_x") - c("_m0"))
    e = c("_y") - c("intercept") - c(f"b_{x}") * c("_x") - c(f"b_{common}") * c("_z")
    h = 1.0 / c("_n") + p * (c("_x") - c("_m0")) + rest * rest / c("_rss")
    u = F.when(h < 1 - 1e-12, (e / (1 - h)) * (e / (1 - h)))
    s = 1.0 / c("_n") - c("_m0") * p  # weight in the key's own intercept
    rows = rows.select(*keys, p.alias("_p"), s.alias("_s"), rest.alias("_r"), u.alias("_u"))
    whole = lambda v: F.when(F.count("_u") == F.count(F.lit(1)), F.sum(v * c("_u")))
    sums = rows.groupBy(*keys).agg(*[whole(v).alias(n) for n, v in (("_pp", c("_p") * c("_p")), ("_pr", c("_p") * c("_r")), ("_ss", c("_s") * c("_s")), ("_sr", c("_s") * c("_r")), ("_rr", c("_r") * c("_r")))])
    sums = settle(sums, "line-errors")
    shared = sums.agg(F.when(F.count("_rr") == F.count(F.lit(1)), F.sum("_rr"))).scalar()
    out = per_key.join(sums, list(keys)).withColumn("_all", shared)
    by_slope, by_level = c("_k") / c("_rss"), (c("_m0") * c("_k") - c("_m1")) / c("_rss")
    return out.select(
        *fit.columns[:-1], c("_n").cast("bigint").alias("n"),
        F.sqrt(c("_pp") - 2 * by_slope * c("_pr") + by_slope * by_slope * c("_all")).alias(f"se_{x}"), (F.sqrt("_all") / c("_rss")).alias(f"se_{common}"),
        F.sqrt(c("_ss") + 2 * by_level * c("_sr") + by_level * by_level * c("_all")).alias("se_intercept"),
    )


def fit_ar_residual(df: DataFrame, keys: Sequence[str], y: str, lag: str) -> DataFrame:
    """AR(1) without intercept: phi clamped to a stable range, and the sample
    deviation of the innovations, both from one pass of moments."""
    rows = df.na.drop(subset=[y, lag])
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col(y) * F.col(lag)).alias("_yl"), F.sum(F.col(lag) * F.col(lag)).alias("_ll"),
        F.var_samp(y).alias("_vy"), F.var_samp(lag).alias("_vl"), F.covar_samp(y, lag).alias("_cyl"),
    )
    raw = F.when(F.col("_ll") != 0, F.col("_yl") / F.col("_ll")).otherwise(0.0)
    m = m.withColumn("phi_raw", raw)
    variance = F.col("_vy") + F.col("phi_raw") * F.col("phi_raw") * F.col("_vl") - 2 * F.col("phi_raw") * F.col("_cyl")
    sigma = F.when(F.col("_n") > 2, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)
    return m.select(*keys, "phi_raw", clip("phi_raw", *PHI_BOUNDS).alias("phi"), sigma.alias("sigma"), F.col("_n").alias("n"))


def fit_fourier(df: DataFrame, keys: Sequence[str], month: str, y: str, k: int = 1, shrink: float = 1.0) -> DataFrame:
    """Smooth month-of-year profile: harmonics 1..k, centred over the 12 months.

    The regressors depend on the month number only, so 12 counts and means per key
    carry all the information. One harmonic is solved in closed form; more are
    solved for whole batches of keys at once.
    """
    angle = lambda m, j=1: 2.0 * np.pi * j / 12.0 * m
    if k == 1:
        wave = df.withColumn("_sin", F.sin(angle(F.col(month)))).withColumn("_cos", F.cos(angle(F.col(month))))
        fit = fit_within(wave, keys, None, y, ["_sin", "_cos"])
        months = fit.withColumn("season", F.explode(F.sequence(F.lit(1), F.lit(12))))
        # The sine and cosine of the 12 months each sum to zero, so the profile is centred already.
        value = F.col("b__sin") * F.sin(angle(F.col("season"))) + F.col("b__cos") * F.cos(angle(F.col("season")))
        return months.select(*keys, "season", (shrink * value).alias("season_effect"))
    stats = df.na.drop(subset=[y]).groupBy(*keys, month).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(y).alias("_m"))
    packed = stats.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(month, F.struct("_n", "_m")))).alias("_by_month")
    )
    slot = lambda f: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.try_element_at("_by_month", m)[f], F.lit(0.0)))
    packed = packed.select(*keys, slot("_n").alias("_n"), slot("_m").alias("_m"))
    months = np.arange(1, 13, dtype=float)
    design = np.column_stack([np.ones(12)] + [f(angle(months, j)) for j in range(1, k + 1) for f in (np.sin, np.cos)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights, means = np.stack(pdf["_n"].to_numpy()), np.stack(pdf["_m"].to_numpy())
            root = np.sqrt(weights)
            beta = np.linalg.pinv(root[:, :, None] * design[None]) @ (root * means)[:, :, None]
            fitted = (design[None] @ beta)[:, :, 0]
            effect = shrink * (fitted - fitted.mean(axis=1, keepdims=True))
            yield pdf[list(keys)].assign(_effect=list(effect))

    schema = T.StructType([packed.schema[c] for c in keys] + [T.StructField("_effect", T.ArrayType(T.DoubleType()))])
    solved = packed.mapInPandas(solve, schema)
    return solved.select(*keys, F.posexplode("_effect").alias("_i", "season_effect")).select(
        *keys, (F.col("_i") + 1).alias("season"), "season_effect"
    )
