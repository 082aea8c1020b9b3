"""Embedding whitening: distributed centred covariance, and eigenvectors by bisection and inverse iteration.

1. The fit list is each distinct vector once. One pass sums it; a second one sums the products of the vectors less the
   rounded mean, in integers, so neither order nor partitioning changes a bit. What the rounding left out of the centre is
   taken off exactly. Tasks send one matrix per batch, summed before and after the shuffle.
2. On the driver, for a matrix of dimension x dimension: Householder tridiagonalisation, bisection by Sturm counts for the
   leading eigenvalues, inverse iteration for their vectors, with reorthogonalisation within clusters.
3. The projection, dimension x components numbers, is broadcast, and every row is projected where it lies. One more pass
   over the fit list measures the covariance of what came out.

The dimension of the vectors bounds everything that reaches the driver; the number of rows does not.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, with_fields

SCALE, SHIFT = 64, 1_000_000
EXACT = 1 << 53  # integers up to this are exact in a double
CLUSTER = 1e-3  # eigenvalues closer than this share of the norm are reorthogonalised together


class Whitening(NamedTuple):
    n: int  # vectors of the fit list
    sums: list[int]  # per dimension
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # dimension x components
    trace: float


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal Q with Q T Q' = matrix, by Householder reflections."""
    a = matrix.astype(np.float64).copy()
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        if scale == 0 or not np.any(x[1:]):
            continue
        v = x / scale
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        # Both sides of the trailing block at once: A - v w' - w v'.
        block = a[k + 1 :, k + 1 :]
        p = 2 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def sturm_count(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """For every x, the number of eigenvalues below it: the negative pivots of T - x."""
    pivot = diagonal[0] - x
    count = (pivot < 0).astype(np.int64)
    for d, s in zip(diagonal[1:].tolist(), squares.tolist(), strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - x - s / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bracket cannot be halved."""
    n = len(diagonal)
    radius = np.abs(np.concatenate((off, [0]))) + np.abs(np.concatenate(([0], off)))
    lowest, highest = float((diagonal - radius).min()), float((diagonal + radius).max())
    norm = max(abs(lowest), abs(highest))
    tiny = max(np.finfo(float).tiny, np.finfo(float).eps * np.finfo(float).eps * norm)
    pad = 2 * np.finfo(float).eps * n * norm + tiny
    low, high = np.full(k, lowest - pad), np.full(k, highest + pad)
    below = n - np.arange(k)  # of the i-th largest: that many eigenvalues are below any x above it
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return middle
        above = sturm_count(diagonal, off * off, middle, tiny) >= below
        high, low = np.where(open_ & above, middle, high), np.where(open_ & ~above, middle, low)


def shifted_solve(diagonal: np.ndarray, off: np.ndarray, x: float, rhs: np.ndarray, tiny: float) -> np.ndarray:
    """(T - x) y = rhs by elimination with row exchanges; zero pivots become tiny."""
    n = len(diagonal)
    d, u, v, y = (diagonal - x).tolist(), [*off.tolist(), 0.0], [0.0] * n, rhs.tolist()
    low = off.tolist()
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            pivot = d[i] = d[i] if abs(d[i]) > tiny else tiny
            f = low[i] / pivot
            d[i + 1] -= f * u[i]
            y[i + 1] -= f * y[i]
        else:
            f = d[i] / low[i]
            d[i], u[i], d[i + 1], v[i], u[i + 1] = low[i], d[i + 1], u[i] - f * d[i + 1], u[i + 1], -f * u[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    if abs(d[-1]) <= tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        rest = y[i] - (u[i] * y[i + 1] if i + 1 < n else 0) - (v[i] * y[i + 2] if i + 2 < n else 0)
        y[i] = rest / d[i]
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix by inverse iteration, orthogonal also within clusters."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0)) or 1.0
    tiny = np.finfo(float).eps * norm
    rng = np.random.default_rng(1)
    out = np.zeros((n, len(values)))
    start, used = 0, np.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > CLUSTER * norm:
            start = j
        # Equal eigenvalues get slightly different shifts, so that their solutions differ.
        used = min(value, used - 4 * tiny) if j > start else value
        x = rng.uniform(-1, 1, n)
        for _ in range(5):
            x = shifted_solve(diagonal, off, used, x / np.abs(x).max(), tiny)
            for _ in range(2):
                x -= out[:, start:j] @ (out[:, start:j].T @ x)
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    diagonal, off, q = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = q @ leading_vectors(diagonal, off, values)
    return values, vectors / np.sqrt((vectors * vectors).sum(0))


def matrix_of(lists: pa.Array, dimension: int) -> np.ndarray:
    """The rows as one matrix of longs; shorter rows end in SHIFT, the integer of 0."""
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.full((len(lists), dimension), SHIFT, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten())
    return out


def gram(x: np.ndarray) -> np.ndarray:
    """x'x in exact integers."""
    most = int(np.abs(x).max()) if x.size else 0
    if most * most * max(1, len(x)) < EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    f = x.astype(object)
    return f.T @ f


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows whose vector is not null and holds neither null nor non-finite entries."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.filter(F.col(vector).isNotNull() & finite)
    return kept.select(F.col(key).alias("key"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long") + SHIFT).alias("x"))


def summed(tables: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of (i, j, value) rows; as many as the matrix has entries."""
    totals = tables.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    return {(r["i"], r["j"]): int(r["value"]) for r in totals}


def fit(distinct: DataFrame, k: int) -> Whitening | None:
    """Covariance and leading components of a table of distinct vectors `x`; None without vectors.

    Components with no variance, to double precision, cannot be whitened and are left out.
    """
    n, dimension = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return None
    exact = "i int, j int, value decimal(38,0)"

    def sums(batches):
        total = np.zeros(dimension, object)
        for batch in batches:
            total = total + matrix_of(batch["x"], dimension).astype(object).sum(0) if len(batch) else total
        yield pa.RecordBatch.from_pylist([{"i": i, "j": 0, "value": int(v)} for i, v in enumerate(total)], WHOLE)

    total = summed(distinct.select("x").mapInArrow(sums, exact))
    sums_ = [total[(i, 0)] for i in range(dimension)]
    centre = np.array([round(Fraction(s, n)) for s in sums_], np.int64)

    def products(batches):
        total = np.zeros((dimension, dimension), object)
        for batch in batches:
            total = total + gram(matrix_of(batch["x"], dimension) - centre)
        yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "value": int(total[i, j])} for i in range(dimension) for j in range(i + 1)], WHOLE)

    product = summed(distinct.select("x").mapInArrow(products, exact))
    rest = [s - n * int(c) for s, c in zip(sums_, centre, strict=True)]  # n times what the rounded mean left
    covariance = np.zeros((dimension, dimension))
    for (i, j), value in product.items():
        covariance[i, j] = covariance[j, i] = float(Fraction(n * value - rest[i] * rest[j], n * n))
    trace = float(np.trace(covariance))
    values, vectors = eigen(covariance, min(k, dimension)) if dimension else (np.zeros(0), np.zeros((0, 0)))
    good = values > max(trace, 0) * dimension * np.finfo(float).eps
    return Whitening(int(n), sums_, values[good], vectors[:, good], trace)


WHOLE = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.decimal128(38, 0))])


class Projection:
    """Applies a whitening to batches of integer vectors."""

    def __init__(self, model: Whitening):
        self.n, self.dimension = model.n, len(model.sums)
        self.sums = np.array(model.sums, object)
        self.centre = np.array([round(Fraction(s, model.n)) for s in model.sums], np.int64)
        self.rest = np.array([float(Fraction(s - model.n * int(c), model.n)) for s, c in zip(model.sums, self.centre, strict=True)])
        self.weights = model.vectors / np.sqrt(model.values)

    def whitened(self, lists: pa.Array) -> np.ndarray:
        return ((matrix_of(lists, self.dimension) - self.centre) - self.rest) @ self.weights

    def deviation(self, lists: pa.Array) -> list[int | None]:
        """Sum of (n x - S)^2 per row, exact; None where it does not fit in a long."""
        x = matrix_of(lists, self.dimension)
        most = max((abs(s) for s in self.sums), default=0) + self.n * (int(np.abs(x).max()) if x.size else 0)
        if most < 1 << 62:
            d = self.n * x - self.sums.astype(np.int64)
            most = int(np.abs(d).max()) if d.size else 0
            if most * most * max(1, self.dimension) < 1 << 62:
                return (d * d).sum(1).tolist()
            d = d.astype(object)
        else:
            d = self.n * x.astype(object) - self.sums
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(1)]


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.values)
    shared = distinct.sparkSession.sparkContext.broadcast(tuple(model))

    def products(batches):
        project, total, square = Projection(Whitening(*shared.value)), np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = project.whitened(batch["x"])
            total, square = total + z.sum(0), square + z.T @ z
        rows = [(i, -1, float(total[i])) for i in range(k)] + [(i, j, float(square[i, j])) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "value"])

    found = distinct.select("x").mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    total = {(r["i"], r["j"]): r["value"] / model.n for r in found}
    return max((abs(total[i, j] - total[i, -1] * total[j, -1] - (i == j)) for i in range(k) for j in range(k)), default=0.0)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """(key, n, deviation, component, whitened, explained, identity_error), a row per vector and component from 1.

    Entries c become x = floor(64 c) + 1000000; the covariance is taken over the distinct vectors. n is their number,
    deviation the sum over dimensions of (n x - sum)^2 (null if it does not fit in a long), whitened the centred vector
    projected on the component and divided by the root of its eigenvalue, explained the eigenvalue's share of the trace.

    Rows whose vector is null or holds a null or non-finite entry are left out. Shorter vectors count as filled up with
    zeros. Repeated rows and null keys give rows like any other. There are as many components as the vectors have
    dimensions with variance, at most `components`; one distinct vector has none, so its rows give none. An empty table
    gives an empty table. Other columns are not looked at.
    """
    source = integer_vectors(rows, key, vector)
    key_type = rows.schema[key].dataType
    schema = with_fields(
        source.select("key").schema, "n long, deviation long, component int, whitened double, explained double, identity_error double"
    )
    distinct = stored(source.select("x").distinct(), "vectors")
    model = fit(distinct, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    error = identity_error(distinct, model)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    def project(batches):
        known = Whitening(*shared.value)
        projection, k = Projection(known), len(known.values)
        explained = known.values / known.trace
        for batch in batches:
            z, m = projection.whitened(batch["x"]), len(batch)
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"].take(pa.array(row)),
                    pa.array(np.full(m * k, known.n)),
                    pa.array(projection.deviation(batch["x"]), pa.int64()).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=schema.names,
            )

    return source.mapInArrow(project, schema).select(F.col("key").cast(key_type).alias(key), *schema.names[1:])
