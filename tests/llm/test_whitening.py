"""Whitening against a dense eigensolver, and its parts against plain twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows):
    """{vec_id: (deviation, coordinates)}, explained shares, n by numpy's own eigensolver."""
    width = max(len(e) for _, e in rows)
    x = np.array([[*np.floor(64 * np.float32(e).astype(float)), *[0] * (width - len(e))] for _, e in rows]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    v = z.T @ z / n
    values, u = np.linalg.eigh(v)
    values, u = values[::-1][:16], u[:, ::-1][:, :16]
    keep = values > 1e-9 * values[0]
    values, u = values[keep], u[:, keep]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(values), values / np.trace(v)


def compared(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    n, deviation, coordinates, explained = plain(rows)
    assert (got.n == n).all() and (got.identity_error < 1e-9).all()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r[0] for r in rows]].to_numpy()
    assert wide.shape == coordinates.shape
    assert np.allclose(wide * np.sign((wide * coordinates).sum(axis=0)), coordinates, atol=1e-6)
    assert got[got.component == 1].set_index("vec_id").deviation.loc[[r[0] for r in rows]].tolist() == deviation.tolist()
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


def test_equals_a_dense_eigensolver(spark):
    g = np.random.default_rng(1)
    base = g.standard_normal((300, 24)) * np.linspace(3, 0.2, 24)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    compared(spark, rows + [(1_000 + i, rows[7][1]) for i in range(400)])


def test_short_vectors_few_dimensions_and_rank_one(spark):
    g = np.random.default_rng(2)
    compared(spark, [(i, v[: 2 + i % 2].tolist()) for i, v in enumerate(g.standard_normal((50, 3)))])
    compared(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, []), (8, [-3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "w", "n", "vector", "component", "at", "u")})
    got = whitening.whitened(df).toPandas()
    assert sorted(got.groupby("component").size().tolist()) == [5, 5]
    assert got.n.unique().tolist() == [4] and got.identity_error.max() < 1e-9
    assert {v for v in got.vec_id if v == v} == {1, 7, 8} and got.vec_id.isna().sum() == 2
    for few in (df.limit(0), df.filter("vec_id = 1"), df.filter("vec_id in (3, 4)"), df.filter("vec_id = 8")):
        assert whitening.whitened(few).count() == 0


def test_deviation_is_exact_where_products_are_large(spark):
    rows = [(i, [float(i % 7) * 2e9, float(i)]) for i in range(60)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).filter("component = 1").collect()}
    x = [[int(np.floor(64 * float(np.float32(e)))) + 1_000_000 for e in v] for _, v in rows]
    fit = {tuple(v) for v in x}
    total = [sum(v[i] for v in fit) for i in range(2)]
    exact = [sum((len(fit) * a - b) ** 2 for a, b in zip(v, total, strict=True)) for v in x]
    assert got == {i: e if e < 1 << 63 else None for i, e in enumerate(exact)} and None in got.values()


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [2] * 30, [9, 9, 9, 1, 1, 1e-3], [7, *[1] * 40], list(np.linspace(1, 1.001, 50))])
def test_contours_find_every_eigenvector(spark, values):
    g = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(g.standard_normal((len(values), len(values))))
    v = q * np.array(values, dtype=float) @ q.T
    found, u = whitening.components(spark.range(1), (v + v.T) / 2)
    assert np.allclose(found, sorted(values, reverse=True)[:16], rtol=1e-12)
    assert np.allclose(u.T @ u, np.eye(len(found)), atol=1e-13) and np.allclose(v @ u, u * found, atol=1e-12)


def test_inertia_counts_eigenvalues():
    g = np.random.default_rng(5)
    a = g.standard_normal((20, 20))
    a = a + a.T
    diagonal, off2 = whitening.tridiagonal(a)
    shifts = np.linspace(-12, 12, 101)
    assert whitening.inertia(diagonal, off2, shifts).tolist() == [(np.linalg.eigvalsh(a) < s).sum() for s in shifts]


def test_packed_rows_are_equal_for_equal_vectors_only():
    steps = np.array([[1, -128], [127, 0], [128, 0], [-(1 << 40), 5], [1, -128]])
    rows = whitening.packed(steps)
    assert rows[0] == rows[4] and len(set(rows)) == 4
    assert (whitening.unpacked(whitening.pa.array(rows), 2) == steps).all()
