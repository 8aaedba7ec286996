"""Whitening of embeddings: the leading components by contour integration (FEAST).

Counts, sums and the covariance come from passes over the table that give one partial result a
task.  The spectrum of the covariance is sliced by inertia counts at places where
eigenvalues lie apart, and each slice is solved as a task of its own: a quadrature over
complex shifted solves projects a small basis onto the eigenvectors of the slice,
Rayleigh-Ritz extracts them, and both steps repeat until the residuals are at rounding level.
The number found in a slice must equal the inertia count of its borders, so none is missed.

What the driver holds is the covariance, bounded by ``MAX_DIM`` squared, never rows.

Defined cases: rows whose vector is null or empty, or holds null, NaN, infinite or overlong
entries (2**42 and more, whose integer form leaves the range of a long when scaled) are
dropped, and so are rows of another length than most (the greater of equally frequent
lengths is taken).  Repeated rows count as often as they come, a null vec_id stays null, and
columns beside ``vec_id`` and ``embedding`` are not read.  Directions whose variance is below
1e-10 of the greatest hold nothing but rounding and are no components; an empty table, one
row, or equal rows give an empty result.  A deviation beyond the range of a long is null.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table

# executors need not have this package: the task functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
MAX_DIM = 2048
SLICE = 4  # eigenvalues of a slice, if they lie apart
NODES = 8  # of the quadrature on the upper half of the contour
APART = 1e-6  # least gap at the border of a slice, relative to the greatest eigenvalue
NOTHING = 1e-10  # relative variance that is rounding


# ---- eigenvalues of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar tridiagonal matrix, by Householder steps."""
    a = np.array(a, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        v = x / np.linalg.norm(x)
        w = a[k + 1 :, k + 1 :] @ v
        w = 2 * (w - v * (v @ w))
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        below = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = below
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot, above = diagonal[0] - shifts, np.zeros(len(shifts), np.int64)
    above += pivot > 0
    for a, b in zip(diagonal[1:], beside, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = a - shifts - b * b / pivot
        above += pivot > 0
    return above


def leading(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues by bisection of inertia counts, falling."""
    radius = np.abs(diagonal) + np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    low, high = np.full(k, -radius.max() - 1), np.full(k, radius.max() + 1)
    wanted = np.arange(1, k + 1)
    for _ in range(60):
        middle = (low + high) / 2
        more = inertia(diagonal, beside, middle) >= wanted
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return (low + high) / 2


def slices(matrix: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals that hold at least the k greatest eigenvalues.

    Borders lie in gaps; eigenvalues too close to be told apart stay in one interval.
    """
    d = len(matrix)
    diagonal, beside = tridiagonal(matrix)
    asked = min(d, k + 1)
    while True:
        values = leading(diagonal, beside, asked)
        wide = np.flatnonzero(values[:-1] - values[1:] >= APART * max(abs(values[0]), np.finfo(float).tiny)) + 1
        ends = wide[wide >= min(k, d)]
        if len(ends) or asked == d:
            break
        asked = min(d, 2 * asked)
    end = int(ends[0]) if len(ends) else d
    margin = max(abs(values[0]), np.finfo(float).tiny) * APART
    border = lambda i: (values[i - 1] + values[i]) / 2 if 0 < i < len(values) else (values[0] + margin if i == 0 else values[-1] - margin)
    cuts, at = [0], 0
    for i in [*[int(w) for w in wide if w < end], end]:
        # the last gap that keeps a slice small
        following = next((int(w) for w in [*wide, end] if w > i), end)
        if i == end or following - at > SLICE:
            cuts.append(i)
            at = i
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        high, low = border(a), border(b)
        found = inertia(diagonal, beside, np.array([low, high]))
        out.append((float(low), float(high), int(found[0] - found[1])))
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues inside (low, high), falling, and their eigenvectors as columns."""
    d = len(matrix)
    size = np.abs(matrix).sum(axis=1).max()
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (nodes + 1))
    middle, radius = (low + high) / 2, (high - low) / 2
    shifts = [middle * np.eye(d) + radius * t * np.eye(d) - matrix for t in turn]
    width, best = min(d, count + max(2, count // 2)), None
    while True:
        basis = np.random.default_rng(1).standard_normal((d, width))
        for _ in range(30):
            projected = sum(w / 2 * (radius * t * np.linalg.solve(s, basis)).real for w, t, s in zip(weights, turn, shifts, strict=True))
            q = np.linalg.qr(projected)[0]
            small = q.T @ matrix @ q
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            basis = q @ vectors
            inside = (values > low) & (values < high)
            found, held = values[inside][::-1], basis[:, inside][:, ::-1]
            if len(found) == count:
                rest = np.abs(matrix @ held - held * found).max(initial=0)
                if best is None or rest < best[0]:
                    best = (rest, found, held)
                if rest <= 4e-15 * size:
                    break
        if best is not None and best[0] <= 1e-11 * size:
            return best[1], best[2]
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, but the projection does not give them")
        width, best = min(d, 2 * width), None


def _solve(matrix: np.ndarray):
    """Task function: the eigenpairs of each interval."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"value": [], "vector": []}
            for low, high, count in zip(frame["low"], frame["high"], frame["count"], strict=True):
                values, vectors = feast(matrix, low, high, int(count))
                out["value"] += values.tolist()
                out["vector"] += [v.tolist() for v in vectors.T]
            yield pd.DataFrame(out)

    return rows


def eigenpairs(spark, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k greatest eigenvalues, falling, and unit eigenvectors as columns; rounding noise is left out.

    One task solves each slice; the matrix goes along, bounded by ``MAX_DIM``.
    """
    if not len(matrix) or not matrix.any():
        return np.zeros(0), np.zeros((len(matrix), 0))
    intervals = slices(matrix, k)
    frame = spark.createDataFrame(intervals, "low double, high double, count int").repartition(len(intervals))
    found = frame.mapInPandas(_solve(matrix), "value double, vector array<double>").collect()  # k and a cluster
    basis = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: -r["value"])]).T)[0]
    small = basis.T @ matrix @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    values, vectors = values[::-1][:k], (basis @ vectors)[:, ::-1][:, :k]
    keep = values > NOTHING * values[0]
    values, vectors = values[keep], vectors[:, keep]
    # the entry of the greatest size is positive
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


# ---- passes over the table


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integer vectors of a batch."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _sums(dim: int):
    """Task function: per dimension the sum of all entries, in two halves that cannot overflow."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = _matrix(batch, dim)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            columns = [np.arange(dim), np.full(dim, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "n", "high", "low"])

    return rows


class Centre:
    """The exact mean as a whole number and a rest, and what follows from it for a matrix."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.base, self.rest = n, np.array([s // n for s in sums], np.int64), [s % n for s in sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)**2, exact; None beyond the range of a long."""
        near = x - self.base
        if (int(np.abs(near).max(initial=0)) + 1) * self.n < 2 ** (31 - (x.shape[1].bit_length() + 1) // 2):
            return ((near * self.n - np.array(self.rest)) ** 2).sum(axis=1).tolist()
        wide = near.astype(object) * self.n - np.array(self.rest, object)
        return [v if v < 2**63 else None for v in (wide * wide).sum(axis=1).tolist()]


def _products(dim: int, centre: Centre, project: np.ndarray | None):
    """Task function: sums and products of the centred vectors, or of their projections.

    Row -1 has the sums, row i the products with dimension i.
    """
    width = dim if project is None else project.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y = centre.centred(_matrix(batch, dim))
            y = y if project is None else y @ project
            total += y.sum(axis=0)
            products += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, width), pa.int64()), pa.array([total.tolist(), *products.tolist()], pa.list_(pa.float64()))], names=["i", "x"]
        )

    return rows


def _covariance(rows: DataFrame, dim: int, centre: Centre, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance with divisor n; what rounding leaves of the mean is taken off."""
    width = dim if project is None else project.shape[1]
    parts = rows.select("embedding").mapInArrow(_products(dim, centre, project), "i bigint, x array<double>")
    sums = parts.select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()  # width squared
    out = np.zeros((width + 1, width))
    out[sums["i"].to_numpy() + 1, sums["j"].to_numpy()] = sums["x"].to_numpy() / centre.n
    out, mean = out[1:], out[0]
    out = out - np.outer(mean, mean)
    return (out + out.T) / 2


def _whitened(dim: int, centre: Centre, project: np.ndarray, explained: list[float], error: float):
    """Task function: one row a vector and component."""
    k = project.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dim)
            m = len(x)
            every = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)),
                pa.array(centre.deviations(x), pa.int64()).take(every), pa.array((centre.centred(x) @ project).ravel()),
                pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and embedding (as doubles) of the rows that take part, and their length."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**42))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where((F.size("embedding") > 0) & F.forall("embedding", entry))
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors have {dim} entries, more than {MAX_DIM}")
    return rows.where(F.size("embedding") == dim), dim


def whiten(vectors: DataFrame, *, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of all usable vectors.

    Returns vec_id, component (from 1), n, deviation, whitened, explained and identity_error, the
    last measured on the whitened values of the whole table.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    schema = (
        f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, "
        "whitened double, explained double, identity_error double"
    )
    if not dim:
        return spark.createDataFrame([], schema)
    parts = rows.select("embedding").mapInArrow(_sums(dim), "i bigint, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    sums = {r["i"]: r for r in parts.groupBy("i").agg(*wide).collect()}  # one row a dimension
    centre = Centre(int(sums[0]["n"]), [(int(sums[i]["high"]) << 32) + int(sums[i]["low"]) for i in range(dim)])
    covariance = _covariance(rows, dim, centre)
    values, directions = eigenpairs(spark, covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    project = directions / np.sqrt(values)
    error = float(np.abs(_covariance(rows, dim, centre, project) - np.eye(len(values))).max())
    explained = (values / np.trace(covariance)).tolist()
    return rows.mapInArrow(_whitened(dim, centre, project, explained, error), schema)


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
