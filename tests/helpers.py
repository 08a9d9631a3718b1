"""Comparison of Spark rows with DuckDB rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    if isinstance(v, float):
        return None if v != v else f"{v:.9g}"
    return v


def same(df, c, sql):
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(n) for n in order]
    want = sorted((tuple(shown(r[i]) for i in at) for r in rows), key=repr)
    got = sorted((tuple(shown(r[n]) for n in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
