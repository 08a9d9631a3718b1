"""Values carried along long keys: as-of joins and pauses, with and without ranges."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import reconcile, versions

CASES = [1_000_000, 7]


@pytest.mark.parametrize("task_rows", CASES)
def test_as_of_equals_a_search_per_query(spark, task_rows):
    g = random.Random(2)
    history = [(g.choice(["a", "b", None]), t, f"v{i}") for i, t in enumerate(g.sample(range(400), 120))]
    queries = [(g.choice(["a", "a", "b", "c", None]), g.randrange(-5, 420), i) for i in range(300)]
    h = spark.createDataFrame(history, "k string, eff int, name string")
    q = spark.createDataFrame(queries, "k string, at int, n int")
    got = {r["n"]: r["name"] for r in versions.as_of(q, h, "k", "at", "eff", ["name"], task_rows).collect()}
    for k, at, n in queries:
        own = sorted((e, v) for x, e, v in history if x == k)
        i = bisect.bisect_left([e for e, _ in own], at)
        assert got[n] == (own[max(i - 1, 0)][1] if own else None)
    assert len(got) == len(queries)


@pytest.mark.parametrize("task_rows", CASES)
def test_pauses_equal_a_scan_per_stream(spark, task_rows):
    g = random.Random(3)
    events = [(s, i, g.choice(["pause", "resume", "fail", "other", "other"]), i * 10) for s in ("x", "y", None) for i in range(100)] + [("z", 1, "pause", 5)]
    df = spark.createDataFrame(events, "stream string, seq int, event_type string, at int")
    got = sorted(reconcile.pauses(df, "pause", ("resume", "fail"), task_rows=task_rows).collect(), key=repr)
    want = []
    for s, i, kind, at in events:
        if kind == "pause":
            end = next(((t, k) for x, j, k, t in events if x == s and j > i and k in ("resume", "fail")), (None, "not_ended"))
            want.append((s, i, at, *end))
    assert [tuple(r) for r in got] == sorted(want, key=repr)


def test_a_million_rows_of_one_key_are_linear(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 3 == 0, "pause").when(F.col("id") % 30_001 == 1, "resume").otherwise("other").alias("event_type"), F.col("id").alias("at"))
    began = time.monotonic()
    assert reconcile.pauses(df, "pause", ("resume",), stream="k", seq="id").filter("ended_how = 'resume'").count() > n // 4
    found = versions.as_of(df.select("k", "at"), df.filter("id % 500000 = 7").select("k", F.col("id").alias("eff"), F.col("id").alias("v")), "k", "at", "eff", ["v"])
    assert found.groupBy("v").count().count() == 2
    assert time.monotonic() - began < 60
