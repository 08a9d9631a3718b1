"""Near-duplicate vectors against all pairs, and the index's bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, least=0.9):
    """{position: (n_links, component)} by all pairs; rows of (vec_id, vector or None)."""
    width = max(len(v) for _, v in rows if v is not None)
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([[*np.float32(rows[i][1]).astype(float), *[0] * (width - len(rows[i][1]))] for i in good])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= least
    label = np.arange(len(good))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    out = [(i, 0, i, True) for i, _ in rows]
    for at, i in enumerate(good):
        ids = [rows[good[j]][0] for j in np.flatnonzero(label == label[at])]
        low = min((j for j in ids if j is not None), default=None)
        out[i] = (rows[i][0], int(near[at].sum()) - 1, low, rows[i][0] == low)
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("rid", "vector", "home", "ball", "list", "a", "n")})
    return [tuple(r) for r in vector_dedup.linked(df.repartition(3), **more).select("vec_id", "n_links", "component_id", "kept").collect()]


def around(g, centre, n, cosine):
    """n unit vectors with that cosine to centre."""
    z = g.standard_normal((n, len(centre)))
    z -= (z @ centre)[:, None] * centre
    return cosine * centre + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def test_groups_of_every_width(spark):
    """Tight groups (balls), loose ones (single links), groups about the threshold (members compared), equal vectors."""
    g = np.random.default_rng(1)
    centres = np.linalg.qr(g.standard_normal((32, 32)))[0]
    parts = [around(g, centres[0], 700, 0.995), around(g, centres[1], 60, 0.95), around(g, centres[2], 300, 0.98), around(g, 0.95 * centres[2] + math.sqrt(1 - 0.95**2) * centres[3], 300, 0.98)]
    parts += [np.tile(centres[4], (400, 1)), around(g, centres[5], 30, 0.92), g.standard_normal((500, 32)), around(g, (centres[2] + centres[6]) / math.sqrt(2), 200, 0.99)]
    x = np.concatenate(parts) * g.uniform(0.01, 90, (sum(map(len, parts)), 1))
    rows = [(int(i), v.tolist()) for i, v in zip(g.permutation(len(x)), x, strict=True)]
    got, want = sorted(found(spark, rows)), sorted(plain(rows))
    assert got == want


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0]
    rows = [(5, v), (3, v), (5, v), (None, v), (None, None), (7, None), (8, []), (9, [0.0, 0.0, 0.0]), (10, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (12, [None, 1.0, 1.0])]
    rows += [(13, w), (14, [6.0, -2.0, 0.0]), (15, [1e-30, 2e-30, 3e-30]), (16, [-1.0, -2.0, -3.0]), (17, [1.0])]
    assert sorted(found(spark, rows), key=repr) == sorted(plain(rows), key=repr)
    assert found(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert found(spark, [(None, v), (None, v)]) == [(None, 1, None, True)] * 2
    assert vector_dedup.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_of_lone_pairs_at_the_threshold(spark):
    """Pairs with cosines of 0.9 to 0.93 among as many unlike vectors: the hardest case for the lists."""
    g = np.random.default_rng(3)
    x = g.standard_normal((4_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.concatenate([around(g, v, 1, g.uniform(0.901, 0.93)) for v in x])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    links = sum(r[1] for r in found(spark, rows))
    assert 0.98 * len(rows) <= links <= len(rows)


def test_blocks_and_chunks_of_a_hot_list(spark, monkeypatch):
    for name, size in (("CHUNK", 20), ("QUERIES", 16), ("CODES", 48)):
        monkeypatch.setattr(vector_dedup, name, size)
    g = np.random.default_rng(6)
    centre = np.eye(16)[0]
    x = np.concatenate([around(g, centre, 300, 0.985), around(g, centre, 100, 0.93), g.standard_normal((200, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert sorted(found(spark, rows)) == sorted(plain(rows))


@pytest.mark.parametrize("least", [0.5, 0.75, 0.99])
def test_other_thresholds(spark, least):
    g = np.random.default_rng(7)
    x = np.concatenate([around(g, c, 40, k) for c, k in zip(np.eye(8), (0.99, 0.97, 0.9, 0.8, 0.7, 0.999, 0.95, 0.6), strict=True)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = sorted(found(spark, rows, least=least)), sorted(plain(rows, least))
    assert [r[2:] for r in got] == [r[2:] for r in want]
    assert [r[1] for r in got] == [r[1] for r in want]


def test_lookup_distances_are_within_the_codes_errors():
    g = np.random.default_rng(8)
    sample = g.standard_normal((2_000, 30))
    index = vector_dedup.Index.fit(sample, 20)
    x = np.pad(vector_dedup.unit(g.standard_normal((300, 30))), ((0, 0), (0, 2)))
    home = vector_dedup.nearest(x, index.centres, 1)[:, 0]
    codes, term, error = index.coded(x, home)
    d = index.distances(x, index.tables(x), codes, home, term)
    exact = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert (np.abs(d.T - exact) <= error + vector_dedup.LOOKUP).all() and error.max() < 1
