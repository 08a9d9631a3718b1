"""Whitening of embeddings by FEAST contour integration.

Spark makes the list of distinct quantised vectors, their exact sums, and their covariance as sums of one small
matrix a task. The covariance has a row and a column per dimension, whatever the number of vectors. Its
spectrum is cut at wide gaps into intervals of a few eigenvalues, and each interval is a task: a contour around it,
complex shifted solves at the nodes of a quadrature rule, whose sum projects onto the interval's eigenvectors,
and Rayleigh-Ritz on that subspace, again until the residuals vanish and the number of values inside equals the
one that inertia (signs of the pivots at the interval's ends) says. A last Rayleigh-Ritz makes the intervals'
vectors orthogonal to each other.

Defined results: vectors that are null or hold a null, NaN or infinite entry are left out; shorter vectors count as
padded with zeros (an empty one is all zeros); entries beyond 2^52 / 64 count as that; repeated ids and
rows are each given a result; a null id stays null; components without variance (an eigenvalue that is zero in double precision)
are left out, so equal vectors only, one vector or none give no rows; a deviation that a long can't hold is null; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut_lineage

#: Components returned, quadrature nodes on the upper half of a contour, eigenvalues an interval aims at,
#: and the most rounds of projection.
COMPONENTS, NODES, INTERVAL, ROUNDS = 16, 8, 8, 60

SHIFT = 1_000_000
_MOST = 1 << 52
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vector: Column) -> Column:
    """Whether a vector has only finite entries."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))), F.lit(False))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) doubles of lists without nulls; shorter lists are padded with zeros."""
    lengths = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if (lengths == dims).all():
        return flat.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) of each entry c; SHIFT is added where sums are told."""
    return np.clip(np.floor(64 * vectors), -_MOST, _MOST).astype(np.int64)


def packed(steps: np.ndarray) -> list[bytes]:
    """Each row as bytes of the narrowest integer type that holds it: equal rows, equal bytes."""
    low, high = steps.min(axis=1, initial=0), steps.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(steps)
    widths = np.select([(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1) for w in (1, 2, 4)], [1, 2, 4], 8)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        for i, row in zip(at.tolist(), steps[at].astype(f"<i{width}"), strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(rows: pa.Array, dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), dtype=np.int64)
    for i, row in enumerate(rows.to_pylist()):
        out[i] = np.frombuffer(row, dtype=f"<i{len(row) // dims}")
    return out


def _exact_sum(steps: np.ndarray) -> list[int]:
    if len(steps) * (int(np.abs(steps).max(initial=0)) + 1) < 1 << 62:
        return steps.sum(axis=0).tolist()
    return steps.astype(object).sum(axis=0).tolist()


def fit_list(vectors: DataFrame, dims: int) -> DataFrame:
    """x: each distinct quantised vector once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(quantised(matrix(batch.column(0), dims))), pa.binary())], ["x"])

    return cut_lineage(vectors.select("vector").mapInArrow(pack, "x binary").distinct())


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors of the fit list and the exact sum of each dimension (of steps, without SHIFT)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            n += batch.num_rows
            total = [a + b for a, b in zip(total, _exact_sum(unpacked(batch.column(0), dims)), strict=True)]
        dim = pa.array(range(-1, dims), pa.int32())
        yield pa.RecordBatch.from_arrays([dim, pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], ["dim", "s"])

    found = {r["dim"]: int(r["s"]) for r in fit.mapInArrow(add, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


class Centre:
    """Exact mean of the fit list: an integer part and a remainder over n, each per dimension."""

    def __init__(self, n: int, total: list[int]) -> None:
        self.n, self.whole = n, np.array([s // n for s in total], dtype=np.int64)
        self.rest = [s % n for s in total]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, steps: np.ndarray) -> np.ndarray:
        """x - S/n: the integer part is taken off exactly, so that nothing cancels."""
        return (steps - self.whole).astype(np.float64) - self.part

    def deviations(self, steps: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, in integers of any size."""
        t, n = steps - self.whole, self.n
        widest = int(np.abs(t).max(initial=0))
        if t.shape[1] * (n * (widest + 1)) ** 2 < 1 << 62:
            return ((n * t - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        if t.shape[1] * (widest + 1) * max(widest, n) < 1 << 62:
            square, cross = (t * t).sum(axis=1).tolist(), (t * np.array(self.rest, dtype=np.int64)).sum(axis=1).tolist()
        else:
            wide = t.astype(object)
            square, cross = (wide * wide).sum(axis=1).tolist(), (wide * np.array(self.rest, dtype=object)).sum(axis=1).tolist()
        rest = sum(r * r for r in self.rest)
        exact = [n * n * a - 2 * n * b + rest for a, b in zip(square, cross, strict=True)]
        return [e if e < 1 << 63 else None for e in exact]


def products(fit: DataFrame, dims: int, centre: Centre, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum of z z' over the fit list, z the centred vectors, or their coordinates in ``basis`` with a leading 1."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            z = centre.centred(unpacked(batch.column(0), dims))
            if basis is not None:
                z = np.hstack([np.ones((len(z), 1)), z @ basis])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    cells = fit.mapInArrow(add, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("v"))
    return np.array([r["v"] for r in rows.orderBy("i").collect()])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a symmetric matrix after Householder reflections from both sides."""
    a, n = a.copy(), len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 1):
        v = a[k + 1 :, k].copy()
        off[k] = np.linalg.norm(v)
        v[0] += np.copysign(off[k], v[0])
        length = v @ v
        if length and k < n - 2:
            inner = a[k + 1 :, k + 1 :]
            p = inner @ v * (2 / length)
            w = p - (v @ p) / length * v
            inner -= np.outer(v, w) + np.outer(w, v)
    return np.diag(a).copy(), off**2


def inertia(diagonal: np.ndarray, off2: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each shift: the negative pivots of the shifted tridiagonal matrix."""
    tiny = np.finfo(float).eps * (np.abs(diagonal).max() + np.sqrt(off2.max(initial=0))) + np.finfo(float).tiny
    pivot, below = diagonal[0] - shifts, np.zeros(len(shifts), dtype=np.int64)
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shifts - off2[i - 1] / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) that cover the ``wanted`` largest eigenvalues, cut at the widest gap near
    each ``INTERVAL`` of them. Eigenvalues that are zero in double precision are in none."""
    n = len(v)
    diagonal, off2 = tridiagonal(v)
    reach = float(np.abs(v).sum(axis=1).max())
    low, high = np.full(n, -reach), np.full(n, reach)
    for _ in range(40):
        middle = (low + high) / 2
        above = inertia(diagonal, off2, middle) <= np.arange(n)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    values = ((low + high) / 2)[::-1]
    zero = n * np.finfo(float).eps * max(values[0], 0.0)
    known = int((values > max(zero, 2 * reach * 2.0**-40)).sum())
    wanted = min(wanted, known)
    edges, done = [float(values[0] + 0.05 * reach)], 0
    ends: list[int] = []
    while done < wanted:
        first = min(done + INTERVAL, wanted)
        after = np.append(values[1:known], min(0.0, values[-1]) if known == n else values[known])
        gaps = values[first - 1 : known] - after[first - 1 : known]
        reached = 2 * INTERVAL
        while gaps[:reached].max() < 1e-6 * values[0] and reached < len(gaps):  # equal values stay together
            reached *= 2
        at = first + int(np.argmax(gaps[:reached]))
        edges.append(float((values[at - 1] + after[at - 1]) / 2))
        ends.append(at)
        done = at
    counts = n - inertia(diagonal, off2, np.array(edges))
    return [(edges[i + 1], edges[i], int(counts[i + 1] - counts[i])) for i in range(len(ends))]


def feast(v: np.ndarray, low: float, high: float, inside: int) -> np.ndarray:
    """(dims, inside) unit eigenvectors of the eigenvalues between low and high."""
    n = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (1 + nodes))
    size = min(n, 2 * inside + 4)
    y = np.random.default_rng(7).standard_normal((n, size))
    floor = 8 * n * np.finfo(float).eps * np.abs(v).sum(axis=1).max()
    for _ in range(ROUNDS):
        q = np.zeros_like(y)
        for turn, weight in zip(turns, weights, strict=True):
            q += weight / 2 * np.real(radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(n) - v, y))
        q, _ = np.linalg.qr(q)
        values, inner = np.linalg.eigh(q.T @ v @ q)
        y = q @ inner
        here = (values > low) & (values < high)
        if here.sum() == inside and np.linalg.norm(v @ y[:, here] - y[:, here] * values[here], axis=0).max() <= floor:
            return y[:, here]
    raise ArithmeticError(f"{inside} eigenvalues lie between {low} and {high}, and the contour did not settle on them")


def components(vectors: DataFrame, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; an interval is a Spark task."""
    spark, cuts = vectors.sparkSession, intervals(v, wanted)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = feast(v, low, high, inside)
                yield pa.RecordBatch.from_arrays([pa.array(list(found.T), pa.list_(pa.float64()))], ["u"])

    if not cuts:
        return np.zeros(0), np.zeros((len(v), 0))
    tasks = spark.createDataFrame(cuts, "low double, high double, inside long").repartition(len(cuts), "low")
    rows = tasks.mapInArrow(solve, "u array<double>").collect()
    q, _ = np.linalg.qr(np.array([r["u"] for r in rows]).T)
    values, inner = np.linalg.eigh(q.T @ v @ q)
    if len(values) != sum(c[2] for c in cuts) or values.min() <= cuts[-1][0]:
        raise ArithmeticError("inertia counts other eigenvalues than were found")
    values, u = values[::-1][:wanted], (q @ inner)[:, ::-1][:, :wanted]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return values, u


def whitened(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Coordinates of every usable row of embeddings (vec_id, embedding) in the ``wanted`` largest principal
    components, scaled to unit variance over the distinct quantised vectors."""
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).filter(usable(F.col("vector")))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    empty = spark.createDataFrame([], RESULT)
    if not dims:
        return empty
    fit = fit_list(rows, dims)
    n, total = sums(fit, dims)
    centre = Centre(n, total)
    v = products(fit, dims, centre) / n
    v = (v + v.T) / 2
    values, u = components(rows, v, wanted) if v.any() else (np.zeros(0), np.zeros((dims, 0)))
    if not len(values):
        return empty
    scaled = u / np.sqrt(values)
    moments = products(fit, dims, centre, scaled)
    mean = moments[0, 1:] / n
    error = float(np.abs(moments[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(values))).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = quantised(matrix(batch.column(1), dims))
            w = centre.centred(steps) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(steps), pa.int64()), lists], ["vec_id", "deviation", "w"])

    explained = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    long = rows.mapInArrow(project, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
