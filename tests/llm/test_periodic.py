"""Runs of words against a search of every period, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("runs", "collapsed", "best", "n_words", "text_")})
    got = [tuple(r[c] for c in COLUMNS) for r in periodic.digest(df.repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted((plain_digest(*r) for r in rows), key=repr)


def test_random_texts_of_few_words(spark):
    g = random.Random(3)
    rows = []
    for i in range(600):
        w = [g.choice("abcdefgh"[: g.choice([1, 2, 3, 8])]) for _ in range(g.choice([0, 3, 6, 20, 90, 300]))]
        unit = [g.choice(["x", "y", "é", " "]) for _ in range(g.randint(1, 12))]
        at = g.randint(0, len(w))
        rows.append((i, g.choice(["", " "]) + g.choice([" ", "\n", "\t "]).join(w[:at] + (unit * 20)[: g.randint(0, 120)] + w[at:]) + g.choice(["", "\r\n"])))
    compared(spark, rows)


def test_whole_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compared(spark, rows)


def test_odd_rows(spark):
    again = "of the people by " * 7
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "a " * 5), (6, "a " * 6), (7, "ab " * 6), (7, "ab " * 6), (None, again), (None, None), (8, again), (9, again + again), (10, "x " + again), (14, "\u0000 " * 9), (40, "x   " * 12), (-3, again)]
    compared(spark, rows)
    assert periodic.digest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("words", "runs"), [([7] * 300_000, 1), ([1, 2, 3] * 100_000, 1), (list(range(300_000)), 0), (list(range(1000)) * 200, 1), (list(range(1000)) * 3 + [5] * 9, 1)])
def test_long_texts(words, runs):
    ids = np.array(words, dtype=np.int64)
    begin, stop, q = periodic.find_runs(ids, np.array([0, len(ids)]))
    assert len(begin) == runs


def test_texts_of_a_block_do_not_touch():
    ids = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], dtype=np.int64)
    begin, stop, q = periodic.find_runs(ids, np.array([0, 6, 6, 11, 13]))
    assert list(zip(begin, stop, q, strict=True)) == [(0, 6, 1)]


def test_nodes_of_the_grammar_are_derived_where_they_say():
    g = np.random.default_rng(4)
    part = g.integers(0, 30, 400)
    ids = np.concatenate([part, g.integers(0, 30, 100), part, part[50:250]])
    start, boundary, end, node, place = periodic.grammar(ids, np.array([0, len(ids)]))
    assert len(np.unique(node)) == len(start) < len(node) and (start < boundary).all() and (boundary < end).all()
    for k, at in zip(node, place, strict=True):
        assert (ids[at : at + end[k] - start[k]] == ids[start[k] : end[k]]).all()


def test_a_colliding_hash_is_noticed(spark, monkeypatch):
    ids = np.array([1, 2, 3, 1, 2, 4] * 6 + [5] * 8, dtype=np.int64)
    right = periodic.find_runs(ids, np.array([0, len(ids)]))
    same = periodic.Equal.same
    calls = []

    def wrong(self, i, j, n):
        calls.append(1)
        return same(self, i, j, n) | (len(calls) < 4)

    monkeypatch.setattr(periodic.Equal, "same", wrong)
    assert all((a == b).all() for a, b in zip(right, periodic.find_runs(ids, np.array([0, len(ids)])), strict=True))
