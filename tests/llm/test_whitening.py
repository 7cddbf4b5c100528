import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeledger.llm.whitening import Real, fit, one_sided_jacobi, pivoted_cholesky, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, d, most=8):
    """n, deviations by id, covariance in whole numbers, eigenvalues and vectors by the library."""
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v, *_ in rows
            if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    n, s = len(good), [sum(x[k] for _, x in good) for k in range(d)]
    dev = {i: sum((n * x[k] - s[k]) ** 2 for k in range(d)) for i, x in good}
    y = np.array([[(n * x[k] - s[k]) / n for k in range(d)] for _, x in good])
    e, u = np.linalg.eigh(y.T @ y / n)
    return n, dev, {i: r for (i, _), r in zip(good, y)}, e[::-1][:most], u[:, ::-1].T[:most]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(12)]
    rows = []
    for i in range(400):
        z = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((i, [sum(a * b for a, b in zip(z, base[k])) + rng.gauss(0, 0.1 * (k + 1)) - 2 for k in range(12)], 0))
    rows += [(500 + i, [0.5] * 12, 1) for i in range(130)]  # one vector many times
    rows += [(700, None, 1), (701, [], 1), (702, [1.0] * 11 + [None], 1), (703, [1.0] * 11 + [float("nan")], 1), (704, [float("inf")] + [0.0] * 11, 1), (705, [1.0, 2.0], 1)]
    return rows


def test_rows_against_brute_force(spark, vectors):
    n, dev, y, e, u = brute(vectors, 12)
    df = spark.createDataFrame(vectors, SCHEMA).repartition(5).withColumns({"n": F.lit("x"), "whitened": F.lit("x"), "v": F.lit(1), "k": F.lit(1)})
    got = whitened(df).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, k + 1) for i in dev for k in range(8))
    sign = {r.component: np.sign(r.whitened * (y[r.vec_id] @ u[r.component - 1])) for r in got if r.vec_id == 0}
    total = np.trace(np.cov(np.array(list(y.values())).T, bias=True))
    for r in got:
        assert r.n == n and r.deviation == dev[r.vec_id]
        assert r.explained == pytest.approx(e[r.component - 1] / total, rel=1e-9)
        assert r.whitened == pytest.approx(sign[r.component] * (y[r.vec_id] @ u[r.component - 1]) / math.sqrt(e[r.component - 1]), rel=1e-7, abs=1e-7)
        assert r.identity_error < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (2, 2), (7, 7), (9, 4), (32, 32)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
        v = (a @ a.T).astype(Real)
        factor = pivoted_cholesky(v)
        if rank == d:
            assert factor.shape[1] == rank
        assert np.abs(factor @ factor.T - v).max() < 1e-14
        e, u = one_sided_jacobi(factor)
        want = np.linalg.svd(a)[1] ** 2
        assert np.allclose(e[:rank].astype(float), want, rtol=1e-7)
        assert np.abs((u[:rank] @ u[:rank].T).astype(float) - np.eye(rank)).max() < 1e-12


def test_little_or_nothing(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5, SCHEMA)).count() == 0
    line = whitened(spark.createDataFrame([(None, [0.0, 0.0], 0), (1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert [r.component for r in line] == [1, 1, 1] and sorted(r.vec_id or 0 for r in line) == [0, 1, 1]
    assert all(r.explained == pytest.approx(1) for r in line)


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [float(i * 3_000_017), float(-i), 5e8 * (i % 3)], 0) for i in range(40)]
    n, dev, *_ = brute(rows, 3)
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    wide = {i: [math.floor(1024 * c) for c in v] for i, v, _ in rows}
    s = [sum(x[k] for x in wide.values()) for k in range(3)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i: sum((n * x[k] - s[k]) ** 2 for k in range(3)) for i, x in wide.items()}


def test_partition_count_changes_nothing(spark, vectors):
    models = [fit(spark.createDataFrame(vectors, SCHEMA).repartition(k)) for k in (1, 7)]
    assert models[0].sums == models[1].sums and (models[0].components == models[1].components).all()
