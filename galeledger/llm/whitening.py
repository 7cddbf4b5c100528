"""Whitening of embeddings: exact scatter by partial sums, pivoted Cholesky of it, one-sided Jacobi directly on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import ready

SCALE = 1024
FAR = 1 << 40  # whole numbers beyond it count as it
HALF = 20  # bits of the lower part of a number; products of parts stay below 2^40
BLOCK = 8192  # rows of one product: sums below 2^53 are exact in doubles
FLUSH = 1 << 21  # rows after which partial sums leave the task, below 2^63
Real = np.longdouble


@dataclass
class Whitening:
    """Fitted on n vectors: mean of floor(1024 c), components (one a row) by falling eigenvalue, eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(1024 c) of them) per vector length; null vectors and those with null or non-finite entries are left out."""
    lists = batch.column("v")
    values = lists.values.to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy().astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    size = np.diff(at)
    good = (bad[at[1:]] == bad[at[:-1]]) & (size > 0) & ~lists.is_null().to_numpy(zero_copy_only=False)
    for d in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == d))
        c = values[at[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            yield rows, np.clip(np.floor(c * SCALE), -FAR, FAR).astype(np.int64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out(d: int) -> pa.RecordBatch:
        n, s, hh, hl, ll = held.pop(d)
        i, j = np.triu_indices(d)
        mixed = hl + hl.T
        none = np.zeros(d + 1, dtype=np.int64)
        columns = [np.concatenate([[-1], np.arange(d), i]), np.concatenate([none - 1, j]), np.concatenate([none, hh[i, j]]), np.concatenate([none, mixed[i, j]]), np.concatenate([[n], s, ll[i, j]])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), d)), *map(pa.array, columns)], ["d", "i", "j", "hh", "hl", "ll"])

    for batch in batches:
        for _, x in whole(batch):
            d = x.shape[1]
            for start in range(0, len(x), BLOCK):
                part = x[start:start + BLOCK]
                n, s, hh, hl, ll = held.get(d) or [0, *(np.zeros(k, dtype=np.int64) for k in (d, (d, d), (d, d), (d, d)))]
                hi, lo = (part >> HALF).astype(np.float64), (part & ((1 << HALF) - 1)).astype(np.float64)
                held[d] = [n + len(part), s + part.sum(axis=0), hh + (hi.T @ hi).astype(np.int64), hl + (hi.T @ lo).astype(np.int64), ll + (lo.T @ lo).astype(np.int64)]
                if held[d][0] >= FLUSH:
                    yield out(d)
    for d in list(held):
        yield out(d)


def real(x: Fraction) -> Real:
    near = float(x)
    return Real(near) + Real(float(x - Fraction(near)))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with v = L L^T up to rounding, one column per positive pivot, largest first; rows stay in the order of v, so L is triangular up to a permutation."""
    left, factor = np.diag(v).copy(), np.zeros(v.shape, dtype=v.dtype)
    least = left.max(initial=0) * len(v) * Real(2) ** -60
    rank = 0
    done = np.zeros(len(v), dtype=bool)
    while rank < len(v):
        pivot = int(np.argmax(np.where(done, -1, left)))
        if done[pivot] or left[pivot] <= least:
            break
        column = (v[:, pivot] - factor[:, :rank] @ factor[pivot, :rank]) / np.sqrt(left[pivot])
        column[done] = 0
        column[pivot] = np.sqrt(left[pivot])
        factor[:, rank] = column
        done[pivot] = True
        left = left - column * column
        rank += 1
    return factor[:, :rank]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms of the rotated, mutually orthogonal columns by falling size, and these columns at unit length (one a row).

    Disjoint pairs of columns are rotated side by side, every pair once in a sweep.
    """
    a = np.concatenate([factor, np.zeros((len(factor), factor.shape[1] % 2), dtype=factor.dtype)], axis=1)
    r = a.shape[1]
    seats = np.arange(r)
    tiny = np.finfo(a.dtype).eps * 4
    for _ in range(sweeps if r > 1 else 0):
        worst = Real(0)
        for _ in range(r - 1):
            p, q = seats[:r // 2], seats[:r // 2 - 1:-1]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            scale = np.sqrt(xx * yy)
            turn = np.abs(xy) > tiny * scale
            worst = max(worst, (np.abs(xy[turn]) / scale[turn]).max(initial=0))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= tiny * 16:
            break
    e = (a * a).sum(axis=0)
    order = np.argsort(-e, kind="stable")[:factor.shape[1]]
    unit = (a[:, order] / np.sqrt(e[order])).T
    sign = np.where(unit[np.arange(len(unit)), np.abs(unit).argmax(axis=1)] < 0, -1, 1) if len(unit) else np.ones(0)
    return e[order], unit * sign[:, None]


def fit(vectors: DataFrame, vector: str = "embedding", most: int = 8) -> Whitening | None:
    """Whitening fitted on all vectors of the most frequent length (of equals the longer); None without any.

    Sums of x, and of products of its upper and lower 20 bits, are whole numbers, so the covariance is exact however rows are
    dealt; only d (d + 3) / 2 sums reach the driver. Factor and rotations are computed in extended precision.
    """
    ready(vectors.sparkSession)
    part = vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(_moments, "d long, i long, j long, hh long, hl long, ll long")
    total = lambda c: F.sum(F.col(c).cast("decimal(20, 0)")).alias(c)
    sums = settle(part.groupBy("d", "i", "j").agg(total("hh"), total("hl"), total("ll")), "moments")
    top = sums.where("i = -1").agg(F.max(F.struct("ll", "d")).alias("t")).first()["t"]
    if top is None:
        return None
    n, d = int(top["ll"]), top["d"]
    s, products = [0] * d, {}
    for r in sums.where(F.col("d") == d).where("i >= 0").collect():
        if r["j"] < 0:
            s[r["i"]] = int(r["ll"])
        else:
            products[r["i"], r["j"]] = (int(r["hh"]) << 2 * HALF) + (int(r["hl"]) << HALF) + int(r["ll"])
    v, trace = np.zeros((d, d), dtype=Real), 0
    for (i, j), q in products.items():
        centred = n * q - s[i] * s[j]
        v[i, j] = v[j, i] = real(Fraction(centred, n * n))
        trace += centred if i == j else 0
    e, units = one_sided_jacobi(pivoted_cholesky(v))
    return Whitening(n, s, units[:most].astype(np.float64), e[:most].astype(np.float64), float(Fraction(trace, n * n)))


def transformed(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, deviation decimal(38, 0), whitened array) of every vector of the model's length."""
    ready(vectors.sparkSession)
    kind = vectors.schema[vec_id].dataType.simpleString()
    n, sums, d = model.n, np.array(model.sums, dtype=object), len(model.sums)
    mean, rest = (sums // n).astype(np.int64), (sums % n / n).astype(np.float64)
    onto = (model.components / np.sqrt(model.eigenvalues)[:, None]).T
    widest = max(map(abs, model.sums))

    def deviation(x: np.ndarray) -> pa.Array:
        if d * (n * int(np.abs(x).max()) + widest) ** 2 < 1 << 62:
            return pa.array(((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
        return pa.array([Decimal(k) if k < 10 ** 38 else None for k in exact.tolist()], type=pa.decimal128(38, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole(batch):
                if x.shape[1] != d:
                    continue
                for start in range(0, len(rows), BLOCK):
                    part = x[start:start + BLOCK]
                    w = ((part - mean) - rest) @ onto
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows[start:start + BLOCK])), deviation(part), lists], ["vec_id", "deviation", "whitened"])

    got = vectors.select(F.col(vec_id).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return got.mapInArrow(project, f"vec_id {kind}, deviation decimal(38, 0), whitened array<double>")


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) of every usable vector and up to ``most`` components.

    Entries c count as floor(1024 c) (at most 2^40 in size). Vectors that are null, empty, hold null or non-finite entries, or have another length than
    most vectors give no rows; a null id stays; repeated rows count and return each. Components without variance do not exist: fewer than ``most``
    where the covariance has a lower rank, none (and so no rows) for an empty table, a single vector or equal vectors. Eigenvectors of equal
    eigenvalues are any orthogonal ones; the largest entry of each is positive. A deviation beyond 38 digits is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    model = fit(vectors, vector, most)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = vectors.schema[vec_id].dataType.simpleString()
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38, 0), whitened double, explained double, identity_error double").withColumnRenamed("vec_id", vec_id)
    rows = settle(transformed(vectors, model, vec_id, vector), "whitened")
    k = len(model.eigenvalues)
    at = lambda a: F.get("whitened", F.lit(a))
    got = rows.agg(*(F.avg(at(a)).alias(f"m{a}") for a in range(k)), *(F.avg(at(a) * at(b)).alias(f"p{a}_{b}") for a in range(k) for b in range(a, k))).first()
    error = max(abs(got[f"p{a}_{b}"] - got[f"m{a}"] * got[f"m{b}"] - (a == b)) for a in range(k) for b in range(a, k))
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error")).select(*names).withColumnRenamed("vec_id", vec_id)
