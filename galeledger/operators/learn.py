"""Correction-factor model: median imputer and gradient-boosted trees on Spark ML.

Differences from a single-machine fit, on purpose: the imputer is fitted inside each
fold, and the rows used for early stopping are not trained on.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.draws import uniform
from ..functions.expr import finite
from ..session import scratch_path
from .checks import require_columns
from .impute import fold_medians, median_fill, median_imputer

# The feature columns, in model order.
FEATURES = [
    "era5_ws_10m", "era5_ws_100m", "era5_ws_hub", "era5_wd_10m", "era5_wd_100m", "era5_shear_alpha",
    "era5_t2m_K", "era5_d2m_K", "era5_sp_Pa", "era5_air_density_kgm3",
    "era5_surface_roughness_m", "era5_friction_velocity_ms",
    "hour_sin", "hour_cos", "doy_sin", "doy_cos",
    "hub_height_m", "rated_power_kw", "rotor_diameter_m", "specific_power_wpm2", "lat", "lon",
]
TARGET = "target_log_correction_factor"
VALID = "target_is_valid"
MOST_FOLDS = 1000


def training_rows(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    require_columns(df, [*features, TARGET, VALID])
    return df.where(F.col(VALID) & finite(TARGET).isNotNull())


def validation_size(n: int) -> int:
    """Rows held back for early stopping: a tenth but at least 2000, at most a fifth or 1000."""
    return min(max(2000, int(0.1 * n)), max(1000, n // 5))


def mark_validation(df: DataFrame, keys: Sequence[str], n_rows: int, seed: int = 42, most: float = 0.5) -> DataFrame:
    """Boolean ``_validate`` by a hash of the row keys; the expected share is
    validation_size / n, and at most ``most`` so that something is left to train on."""
    share = min(most, validation_size(n_rows) / max(n_rows, 1))
    return df.withColumn("_validate", uniform(F.lit(seed), *[F.col(k) for k in keys]) < share)


def build_pipeline(
    features: Sequence[str] = FEATURES, *, max_iter: int = 200, max_depth: int = 6, step: float = 0.03, subsample: float = 0.8, columns: float = 0.8,
    seed: int = 42, early_stop: bool = True, medians: Sequence[float] | None = None,
) -> Pipeline:
    """Median imputer (fitted, or with given medians), assembler and trees; each tree sees a sample of rows, each split a sample of columns."""
    imputed = [f"_imp_{f}" for f in features]
    trees = GBTRegressor(
        featuresCol="_features", labelCol=TARGET, predictionCol="pred_log_cf",
        maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, featureSubsetStrategy="all" if columns >= 1 else str(columns), seed=seed,
    )
    if early_stop:
        trees.setValidationIndicatorCol("_validate")
    fill = median_imputer(features) if medians is None else median_fill(features, medians)
    return Pipeline(stages=[fill, VectorAssembler(inputCols=imputed, outputCol="_features"), trees])


def fit_correction(df: DataFrame, features: Sequence[str] = FEATURES, **params) -> PipelineModel:
    """Final model on all valid rows."""
    return build_pipeline(features, early_stop=False, **params).fit(training_rows(df, features))


def log_metrics(scored: DataFrame, truth: str = TARGET, pred: str = "pred_log_cf") -> DataFrame:
    e = F.col(truth) - F.col(pred)
    spread = F.count(F.lit(1)) * F.var_pop(truth)
    return scored.agg(
        F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse_logcf"), F.avg(F.abs(e)).alias("mae_logcf"),
        F.when(spread != 0, 1 - F.sum(e * e) / spread).alias("r2_logcf"),
    )


def leave_one_group_out(
    df: DataFrame, group: str, row_keys: Sequence[str], features: Sequence[str] = FEATURES, n_folds: int | None = None, side_by_side: int = 4, **params,
) -> DataFrame:
    """One fold per group: train on the others, score on the group.

    The rows are written once, in a folder per fold, so a fit skips the files of its fold and scoring reads no others. The medians of all folds come from
    one pass. Each fold is a distributed fit; ``side_by_side`` of them run at a time, each in a scheduler pool of its own. With many
    groups, ``n_folds`` hashes whole groups into that many folds; without it every group is its own fold, up to ``MOST_FOLDS``.
    """
    spark = df.sparkSession
    label = F.col(group).cast("string") if n_folds is None else F.pmod(F.xxhash64(group), F.lit(n_folds)).cast("string")
    path = scratch_path(spark, "folds")
    training_rows(df, features).withColumn("_fold", F.coalesce(label, F.lit("(none)"))).write.partitionBy("_fold").parquet(path)
    rows = spark.read.option("basePath", path).schema(spark.read.parquet(path).drop("_fold").schema.add("_fold", "string")).parquet(path)
    found = rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).limit(MOST_FOLDS + 1).collect()
    if len(found) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} groups: name a number of folds")
    counts = {r["_fold"]: r["n"] for r in found}
    if len(counts) < 2:
        raise ValueError("leave-one-group-out needs at least two groups")
    medians = {r["_fold"]: r["medians"] for r in fold_medians(rows, "_fold", features).collect()}
    n_all = sum(counts.values())

    def one_fold(i: int, fold: str) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{i % side_by_side}")
        n_train = n_all - counts[fold]
        train = mark_validation(rows.where(F.col("_fold") != fold), row_keys, n_train)
        model = build_pipeline(features, medians=medians[fold], **params).fit(train)
        scored = model.transform(rows.where(F.col("_fold") == fold))
        return log_metrics(scored).select(
            F.lit(i).alias("fold"), F.lit(fold).alias("held_out"), F.lit(n_train).alias("n_train"),
            "n_test", "rmse_logcf", "mae_logcf", "r2_logcf", F.lit(model.stages[-1].getNumTrees).alias("best_iteration"),
        )

    with ThreadPoolExecutor(side_by_side) as pool:
        out = list(pool.map(inheritable_thread_target(spark)(one_fold), range(1, len(counts) + 1), sorted(counts)))
    return reduce(DataFrame.unionByName, out)


def predict_energy(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``pred_log_cf`` and ``pred_energy_kwh`` = expected * exp(pred_log_cf)."""
    scored = model.transform(df).select(*df.columns, "pred_log_cf")
    return scored.withColumn("pred_energy_kwh", F.col("expected_energy_kwh") * F.exp("pred_log_cf"))


def energy_metrics(scored: DataFrame) -> DataFrame:
    """RMSE, MAE and R2 of predicted energy on valid rows."""
    rows = scored.where(F.col(VALID) & finite("pred_log_cf").isNotNull()).na.drop(subset=["energy_kwh", "expected_energy_kwh"])
    e = F.col("energy_kwh") - F.col("pred_energy_kwh")
    spread = F.count(F.lit(1)) * F.var_pop("energy_kwh")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse_kwh"), F.avg(F.abs(e)).alias("mae_kwh"),
        F.when(spread != 0, 1 - F.sum(e * e) / spread).alias("r2"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Writes imputer, feature order (assembler inputs) and trees together."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
