"""Paths, names and chain checks on small cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.functions import text as T
from ledgerlane.operators import custody


def test_paths_are_taken_apart_and_resolved(spark):
    doc = {"a": [{"b c": 1, 'q"\'': ["x", {"é": None}]}, [2.5]], "": {"_n1": "t"}}
    cases = {
        "$": (0, None), "$.a[0]": (2, '{"b c":1,"q\\"\'":["x",{"é":null}]}'), '$.a[0]["b c"]': (3, "1"), '$.a[0]["q\\"\'"][0]': (4, "x"), "$.a[1][0]": (3, "2.5"), '$[""]._n1': (2, "t"), "$.a[2]": (2, None), "$.a[0].z": (3, None), "$.a.b": (2, None),
        "a": None, "$.": None, "$.a[-1]": None, "$.a[01]": None, "$.1a": None, "$.a ": None, '$["a]': None,
    }
    df = spark.createDataFrame([(p, json.dumps(doc, ensure_ascii=False)) for p in cases], "path string, doc string")
    got = {r["path"]: (r["n"], r["v"]) for r in df.select("path", F.size(K.path_steps(F.col("path"))).alias("n"), K.resolve(F.col("doc"), F.col("path")).alias("v")).collect()}
    for path, want in cases.items():
        if want is None:
            assert got[path] == (-1, None) or got[path] == (None, None), path
        elif path != "$":
            assert got[path] == want, path
    assert json.loads(got["$"][1]) == doc
    built = spark.range(1).select(K.json_path("a", F.lit(3), "b c").alias("p")).first()["p"]
    assert built == '$.a[3]["b c"]'


def test_sensitive_names_and_own_words(spark):
    names = {"DB_PASSWORD": True, "x-api-key": True, "apikey": True, "Set-Cookie": True, "colour": False, "keyboard": False, "signing_key_id": True}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", T.sensitive_name(F.col("n"))).collect()} == names
    m = spark.range(1).select(T.redact_map(F.create_map(F.lit("colour"), F.lit("red"), F.lit("token"), F.lit("t"))).alias("a"), T.redact_map(F.create_map(F.lit("colour"), F.lit("red"), F.lit("token"), F.lit("t")), ("colour",)).alias("b")).first()
    assert m["a"] == {"colour": "red", "token": T.REDACTED} and m["b"] == {"colour": T.REDACTED, "token": "t"}


@pytest.mark.parametrize("task_rows", [1_000_000, 3])
def test_chain_errors_both_ways(spark, task_rows):
    rows = [(s, i, json.dumps({"stream_id": s if i != 4 else "other", "tenant_id": "t" if i != 6 else "u", "n": i})) for s in ("a", "b", "c") for i in range(1, 12)]
    b = custody.build_chain(spark.createDataFrame(rows, "stream string, seq long, fields string"))
    b = b.filter("not (stream = 'b' and seq = 7)").withColumn("fields", F.expr("if(stream = 'a' and seq = 9, fields || ' ', fields)"))
    b = b.unionByName(b.filter("stream = 'c' and seq = 5"))
    got = {(r["stream"], r["seq"]): r["error"] for r in custody.verify_chain(b, tenant=F.lit("t"), task_rows=task_rows).collect()}
    want = {(s, i): "foreign" if i in (4, 6) else None for s in ("a", "b", "c") for i in range(1, 12)}
    want[("a", 9)] = "altered"
    del want[("b", 7)]
    want |= {("b", 8): "gap"} | {("b", i): "unchecked" for i in range(9, 12)} | {("c", 5): "gap"} | {("c", i): "unchecked" for i in range(6, 12)}
    assert got == want


@pytest.mark.parametrize("task_rows", [1_000_000, 4, 1])
def test_chain_errors_equal_a_scan_per_stream(spark, task_rows):
    import random

    r = random.Random(5)
    rows = [(s, i, json.dumps({"stream_id": s if r.random() > 0.1 else "x", "n": i})) for s in "abcdefgh" for i in range(1, 31)]
    built = [list(x) for x in custody.build_chain(spark.createDataFrame(rows, "stream string, seq long, fields string")).collect()]
    for x in built:  # stream, seq, fields, prev_hash, event_hash
        if r.random() < 0.1:
            x[r.choice([2, 3, 4])] += " "
    built = [x for x in built if x[0] < "c" or r.random() > 0.03] + [list(x) for x in built if x[0] > "e" and r.random() < 0.03]
    want, ended, before = [], {}, {}
    for s, seq, fields, prev, own in sorted(built, key=lambda x: x[:2]):
        last, held = before.get(s, (0, custody.GENESIS))
        if seq != last + 1:
            ended.setdefault(s, seq)
        before[s] = (seq, own)
        want.append([s, seq, fields, prev, own, held])
    for x in want:
        s, seq, fields, prev, own, held = x
        gap = ended.get(s, 99)
        error = "gap" if seq == gap else "unchecked" if seq > gap else "foreign" if json.loads(fields)["stream_id"] != s else "broken_link" if prev != held else "altered" if hashlib.sha256((prev + fields).encode()).hexdigest() != own else None
        x[5] = error
    assert {x[5] for x in want} == {"gap", "unchecked", "foreign", "broken_link", "altered", None}
    got = custody.verify_chain(spark.createDataFrame(built, "stream string, seq long, fields string, prev_hash string, event_hash string"), task_rows=task_rows)
    assert sorted(map(repr, map(list, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("turned", [False, True])
def test_places_that_come_twice_have_an_order(spark, turned):
    items = [(1, "a", "s", 5, 0), (2, "b", "s", 9, 0), (2, "a", "s", 5, 1), (3, "c", "s", 7, 0), (3, "d", "s", 8, 1)]
    rows = spark.createDataFrame(items[::-1] if turned else items, "place long, item_id string, stream string, seq long, again int").coalesce(1)
    events = spark.createDataFrame([("s", n, "k") for n in (5, 7, 8, 9)], "stream string, seq long, event_type string")
    got = {(r["place"], r["item_id"], r["error"]) for r in custody.verify_item_links(rows, events, "k", then=("again",)).collect()}
    assert got == {(2, "a", "out_of_order"), (2, "a", "linked_twice")}
