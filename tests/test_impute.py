"""Median stages and fold-wise training against exact medians."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from galeledger.operators import learn
from galeledger.operators.impute import fold_medians, median_imputer


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        fold = "hot" if i % 3 else f"f{int(rng.integers(0, 6))}"
        rows.append((i, fold, None if rng.random() < 0.1 else float(rng.normal(i % 7)), float("nan") if rng.random() < 0.2 else float(rng.exponential()), 1.0 if fold == "f0" else None))
    return rows, spark.createDataFrame(rows, "id long, fold string, a double, b double, c double").repartition(5)


def test_medians_of_the_other_folds(table):
    rows, df = table
    got = {r.fold: r.medians for r in fold_medians(df, "fold", ["a", "b", "c"]).collect()}
    assert set(got) == {r[1] for r in rows}
    for fold, medians in got.items():
        for k in (0, 1):
            values = np.sort([r[2 + k] for r in rows if r[1] != fold and r[2 + k] is not None and not math.isnan(r[2 + k])])
            assert abs(np.searchsorted(values, medians[k]) / len(values) - 0.5) < 0.005
        assert medians[2] == (0.0 if fold == "f0" else 1.0)


def test_stage_fills_saves_and_loads(table, tmp_path):
    rows, df = table
    model = Pipeline(stages=[median_imputer(["a", "b"]), VectorAssembler(inputCols=["_imp_a", "_imp_b"], outputCol="v")]).fit(df)
    known = np.array([r[3] for r in rows if not math.isnan(r[3])])
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        out = {r.id: r for r in m.transform(df).collect()}
        fill = {out[r[0]]._imp_b for r in rows if math.isnan(r[3])}
        assert len(fill) == 1 and abs((known < fill.pop()).mean() - 0.5) < 0.005
        assert all(out[r[0]]._imp_a == r[2] for r in rows if r[2] is not None)


def test_folds_are_pruned_and_fitted_side_by_side(spark):
    df = spark.range(600).select(
        "id", F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("turbine_id"), (F.col("id") % 50).cast("double").alias("x1"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 37).cast("double")).alias("x2"), F.lit(True).alias(learn.VALID),
    ).withColumn(learn.TARGET, F.col("x1") * 2 - 1)
    cv = learn.leave_one_group_out(df, "turbine_id", ["id"], ["x1", "x2"], max_iter=3, max_depth=3, step=0.5, side_by_side=2)
    plan = cv._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(_fold") >= 4
    got = cv.orderBy("fold").collect()
    assert [(r.fold, r.held_out, r.n_train, r.n_test) for r in got] == [(k + 1, f"t{k}", 450, 150) for k in range(4)]
    assert all(r.rmse_logcf < 25 for r in got)
