"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Two passes over the distinct vectors gather sums, then the centred scatter. Tasks reduce their rows to
one matrix each; its entries are summed by place, so nothing that grows with the rows meets in one
task. What the driver gets is d x d numbers. With P V P' = L L' from the pivoted Cholesky, Jacobi
rotations make the columns of L orthogonal: L J = U S. Then V = P' U S^2 U' P, so the squared norms of the
rotated columns are eigenvalues and the normalised columns are components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import stored

#: Components at most, and the fixed point of the entries: x = floor(SCALE * c) + SHIFT.
COMPONENTS, SCALE, SHIFT = 16, 64.0, 1_000_000
#: Rotations stop when all columns are orthogonal to so much of their norms.
TOLERANCE, SWEEPS = 1e-15, 60


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): V[order][:, order] = L L' with the greatest remaining diagonal entry first at each step.

    L has as many columns as V has rank to double precision.
    """
    a, d = v.astype(np.float64).copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = d * np.finfo(np.float64).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= floor:
            return factor[:, :k], order
        order[[k, p]], factor[[k, p]] = order[[p, k]], factor[[p, k]]
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs: one column stands, the others move round."""
    ring, out = list(range(n + n % 2)), []
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if max(a, b) < n]
        out.append((np.array([min(p) for p in pairs], np.intp), np.array([max(p) for p in pairs], np.intp)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as columns) of ``factor @ factor.T``, by rotating columns of the factor.

    The disjoint pairs of a round are rotated together.
    """
    g = factor.copy()
    if not g.shape[1]:
        return np.zeros(0), g
    for _ in range(SWEEPS):
        turned = 0.0
        for p, q in _rounds(g.shape[1]):
            if not len(p):
                continue
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.abs(c) > TOLERANCE * size
            turned = max(turned, float((np.abs(c[off]) / size[off]).max(initial=0.0)))
            zeta = (b - a) / np.where(off, 2.0 * c, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = np.where(off, 1.0 / np.hypot(1.0, t), 1.0)
            sin = np.where(off, cos * t, 0.0)
            g[:, p], g[:, q] = cos * x - sin * y, sin * x + cos * y
        if turned <= 8 * TOLERANCE:
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S, and unit components (columns) with eigenvalues and share of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def fixed_point(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): entries as longs; without rows whose vector is null, empty, or holds null or non-finite entries.

    Only rows of the commonest length stay (the longest of equally common ones): others live in another space.
    """
    entry = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    fine = vectors.filter(entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda c: F.coalesce(finite(c), F.lit(False))))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    rows = fine.select(F.col(id_col).alias("id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count()
    common = sizes.agg(F.max_by("d", F.struct("count", "d"))).first()[0]  # one number
    return rows.filter(F.size("x") == F.lit(common))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


ENTRIES = StructType([StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("v", DoubleType())])


def _scatter(rows: DataFrame, made) -> np.ndarray:
    """The mean of outer products of ``made(matrix of x)`` over all rows: one matrix a task, summed entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                z = made(_matrix(batch, 0))
                total = z.T @ z if total is None else total + z.T @ z
                n += len(z)
        if n:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(total[i, j], n), pa.float64())], ENTRIES.names)

    summed = rows.mapInArrow(run, ENTRIES).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # d (d + 1) / 2 numbers
    if summed.empty:
        return np.zeros((0, 0))
    n, cells = summed.v[summed.i < 0].iloc[0], summed[summed.i >= 0]
    d = int(cells.i.max()) + 1
    out = np.zeros((d, d))
    out[cells.i, cells.j] = cells.v
    out[cells.j, cells.i] = cells.v
    return out / n


def fit(distinct: DataFrame) -> Whitening:
    """The whitening of distinct vectors ``x`` (array of longs)."""
    wide = StructType([StructField("j", IntegerType()), StructField("s", LongType()), StructField("n", LongType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in batches:
            if batch.num_rows:
                total, n = total + _matrix(batch, 0).sum(0, dtype=np.int64), n + batch.num_rows
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(total, pa.int64()), pa.array(np.full(d, n), pa.int64())], wide.names)

    found = distinct.select("x").mapInArrow(sums, wide).groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("j").toPandas()  # d rows
    if found.empty:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    n, s = int(found.n.iloc[0]), found.s.to_numpy(np.int64)
    v = _scatter(distinct.select("x"), lambda x: (n * x - s) / n)
    factor, order = pivoted_cholesky(v)
    values, turned = one_sided_jacobi(factor)
    components = np.zeros_like(turned)
    components[order] = turned
    return Whitening(n, s, components, values, float(np.trace(v)))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    Components are numbered from 1 by falling eigenvalue, ``most`` at most and no more than the rank
    of the covariance: vectors that are all equal have none, and an empty table gives an empty one.
    Equal vectors count once in the fit; repeated rows each give their rows. Equal eigenvalues may come
    in any order. Which rows are left out says ``fixed_point``. Other columns are ignored. An error is
    raised where n * x or the deviation leaves the range of a long.
    """
    kind = vectors.schema[id_col].dataType
    rows = stored(fixed_point(vectors, id_col=id_col, vector_col=vector_col))
    distinct = stored(rows.select("x").distinct())
    w = fit(distinct)
    n, s, e = w.n, w.sums, w.eigenvalues[:most]
    project = w.components[:, : len(e)] / np.sqrt(e)
    off = np.abs(_scatter(distinct, lambda x: (n * x - s) / n @ project) - np.eye(len(e))) if len(e) else np.zeros((1, 1))
    out = StructType([StructField("id", kind), StructField("deviation", LongType()), StructField("z", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, 1)
            if np.abs(x).max() > 2**62 // max(n, 1):
                raise OverflowError("n * x does not fit a long")
            d = n * x - s
            if (d.astype(np.float64) ** 2).sum(1).max() > 2.0**62:
                raise OverflowError("the deviation does not fit a long")
            z = d / n @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((d * d).sum(1), pa.int64()), lists], out.names)

    share = F.lit((e / w.trace).tolist()) if len(e) else F.array().cast("array<double>")
    scored = rows.select("id", "x").mapInArrow(run, out).select("id", "deviation", F.posexplode("z").alias("_k", "whitened"))
    return scored.select(
        F.col("id").alias(id_col), (F.col("_k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_k")).alias("explained"), F.lit(float(off.max(initial=0.0))).alias("identity_error"),
    )
