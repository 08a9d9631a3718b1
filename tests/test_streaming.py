"""Streams over several triggers against their batch twins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import sightings, versions
from ledgerlane.sources.tail import TailReader, custody_tail
from ledgerlane.streaming import jobs

SIGHTING = "place long, subject long, content_hash string, hints map<string,string>, at timestamp, seq long"


def plain_events(rows):
    """What each sighting is, one after the other, with everything that is known held in memory."""
    held, out = {}, []
    for _, subject, content, hints, _, seq in rows:
        s = held.setdefault(subject, {"known": [], "changes": 0})
        now = None if hints is None else {k: v for k, v in hints.items() if v is not None}
        if content not in s["known"]:
            s["known"].append(content)
            s["base"], s["items"] = dict(now or {}), []
            out.append((subject, seq, "version", content, len(s["known"]), None, None, None, None))
        elif content != s["known"][-1]:
            s["changes"] += 1
            out.append((subject, seq, "reverted", content, s["known"].index(content) + 1, None, s["known"][-1], content, s["changes"]))
        elif now is not None:
            current = dict(s["base"])  # the version's own hints, then every recorded change in order
            for hint, _, new in s["items"]:
                current.pop(hint, None)
                if new is not None:
                    current[hint] = new
            for hint in sorted(current.keys() | now.keys()):
                change = (hint, current.get(hint), now.get(hint))
                if change[1] != change[2] and change not in s["items"]:
                    s["items"].append(change)
                    s["changes"] += 1
                    out.append((subject, seq, "hint", content, len(s["known"]), *change, s["changes"]))
    return out


def sighted(triples):
    return [(i + 1, s, c, h, datetime(2024, 1, 1) + timedelta(seconds=i), i + 1) for i, (s, c, h) in enumerate(triples)]


CASES = {
    "reverts": [(1, c, None) for c in "abaa"] + [(2, c, None) for c in "abab"] + [(3, c, None) for c in "abcacbcc"],
    "hints": [(1, "a", {}), (1, "a", {"x": "1"}), (1, "a", {}), (1, "a", {"x": "1"}), (1, "a", {"x": "2", "y": "0"}), (1, "a", None), (1, "a", {"x": None, "y": "0"}), (1, "b", {"x": "9"}), (1, "a", {"x": "7"}), (1, "b", {"x": "9"}), (1, "b", {"x": "8"})],
}
g = random.Random(5)
CASES["many"] = [(g.randrange(4), g.choice("abc"), None if g.random() < 0.2 else {k: g.choice(["0", "1", None]) for k in g.sample("xyz", g.randrange(3))}) for _ in range(150)]


@pytest.mark.parametrize("name", CASES)
def test_versions_reverts_and_hints(spark, tmp_path, name):
    rows = sighted(CASES[name])
    want = sorted(plain_events(rows), key=repr)
    frame = spark.createDataFrame(rows, SIGHTING)
    order = ["at", "seq"]
    first = versions.assign_versions(frame, "subject", "content_hash", order).select("subject", "seq", F.lit("version"), "content_hash", "version")
    assert sorted([tuple(r) for r in first.collect()], key=repr) == sorted([w[:5] for w in want if w[2] == "version"], key=repr)
    batch = sightings.changes(frame, "subject", "content_hash", "hints", order).select("subject", "seq", "kind", "content_hash", "hint", "old", "new", "occurrence")
    assert sorted([tuple(r) for r in batch.collect()], key=repr) == sorted([(*w[:4], *w[5:]) for w in want if w[2] != "version"], key=repr)

    # a third of the rows a trigger, and a restart with what comes later
    late, log, out = rows[-3:], str(tmp_path / "log"), str(tmp_path / "out")
    for part in (rows[:-3], late):
        spark.createDataFrame(part, SIGHTING).coalesce(1).write.mode("append").parquet(log)
        stream = jobs.stateful_versions(custody_tail(spark, log, seq="place", max_events=-(-len(rows) // 3)).drop("place"))
        jobs.run_available(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"), conf=jobs.ON_DISK, to_head=True)
    assert sorted([tuple(r) for r in spark.read.parquet(out).drop("batch").collect()], key=repr) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != jobs.ON_DISK["spark.sql.streaming.stateStore.providerClass"]


def test_tail_admits_events_in_order(spark, tmp_path):
    log = str(tmp_path / "log")
    frame = spark.range(1, 501).select(F.col("id").alias("seq"), F.lit(datetime(2024, 5, 1)).alias("at"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    frame.repartition(3).write.parquet(log)  # files whose seqs overlap
    reader = TailReader(log, "seq", 40, 100, 4, frame.schema)
    assert reader.admitted(40) == 140 and reader.admitted(450) == 500 and reader.admitted(500) == 500
    assert [(p.after, p.until) for p in reader.partitions({"seq": 40}, {"seq": 44})] == [(40, 41), (41, 42), (42, 43), (43, 44)]
    assert reader.partitions({"seq": 44}, {"seq": 44}) == []
    seen = []
    for _ in range(2):
        stream = custody_tail(spark, log, after=40, max_events=200)
        jobs.run_available(stream, lambda b, n: seen.append(sorted(r["seq"] for r in b.collect())), str(tmp_path / "cp"), to_head=True)
        spark.range(501, 601).select(F.col("id").alias("seq"), F.lit(datetime(2024, 5, 1)).alias("at"), F.create_map(F.lit("k"), F.col("id")).alias("m")).write.mode("append").parquet(log)
    assert seen == [list(range(41, 241)), list(range(241, 441)), list(range(441, 501)), list(range(501, 601))]


def test_an_empty_log_needs_a_schema(spark, tmp_path):
    seen = []
    stream = custody_tail(spark, str(tmp_path / "none"), schema="seq long, x string")
    jobs.run_available(stream, lambda b, n: seen.append(b.count()), str(tmp_path / "cp"), to_head=True)
    assert sum(seen) == 0


PAGES = "unit_key string, pages_before long, cursor_before string, next_cursor string, items array<struct<subject:string,content_hash:string,idempotency_key:string>>"


def page(unit, n, keys, cursor=None):
    return (unit, n, (f"c{n}" if n else "") if cursor is None else cursor, f"c{n + 1}", [(f"s{k}", k * 64, k * 64) for k in keys])


def test_only_pages_that_go_on_are_applied(spark):
    pages = spark.createDataFrame([page("u", 2, "a"), page("u", 3, "b"), page("u", 5, "c"), page("u", 1, "d"), page("v", 0, "e"), page("v", 1, "f", "other"), page("v", 2, "g"), page("w", 0, "h", "c7"), page("x", 1, "i"), page("v", 0, "e")], PAGES)
    state = spark.createDataFrame([("u", 1, "c1"), ("u", 2, "c2"), ("z", 9, "c9")], "unit_key string, pages_done long, cursor string")
    assert sorted((r["unit_key"], r["pages_before"]) for r in jobs.applicable(pages, state).collect()) == [("u", 2), ("u", 3), ("v", 0)]
    assert sorted((r["unit_key"], r["pages_before"]) for r in jobs.applicable(pages, None).collect()) == [("v", 0)]


def test_ingest_publishes_all_or_nothing(spark, tmp_path, monkeypatch):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    spark.createDataFrame([page("u", 0, "ab"), page("u", 1, "bc"), page("v", 0, "a")], PAGES).coalesce(1).write.parquet(log)
    stream = lambda: spark.readStream.schema(PAGES).parquet(log)

    def lost(*_):
        raise OSError("lost before the commit record")

    with monkeypatch.context() as m:
        m.setattr(jobs, "publish", lost)
        with pytest.raises(Exception, match="lost before"):
            jobs.ingest(stream(), out, str(tmp_path / "cp"))
    assert jobs.committed(spark, out, "items") is None  # written, but not there
    for checkpoint in ("cp", "cp", "other"):
        jobs.ingest(stream(), out, str(tmp_path / checkpoint))
        tables = {t: jobs.committed(spark, out, t) for t in jobs.TABLES}
        assert {t: rows.count() for t, rows in tables.items()} == {"items": 3, "links": 4, "events": 3, "checkpoints": 2}
        assert sorted((r["unit_key"], r["pages_done"], r["item_count"]) for r in tables["events"].collect()) == [("u", 1, 2), ("u", 2, 1), ("v", 1, 1)]
        assert len({r["commit"] for rows in tables.values() for r in rows.collect()}) == 1


def test_keys_of_a_part_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "PARTS", 2)  # many keys a call of Python
    calls = random.Random(7)
    rows = [(i + 1, calls.choice(["a", "b", "c", "d", None]), calls.choice(["seen", "absent", "lost"])) for i in range(200)]
    held, want = {}, []
    for seq, key, now in rows:
        last, n = held.get(key, ("seen", 0))
        if now != last:
            held[key] = (now, n + 1)
            want.append((key, "again" if now == "seen" else "away", seq, now, n + 1))
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, "seq long, key string, state string").coalesce(1).write.mode("append").parquet(log)
        stream = jobs.observation_machine(custody_tail(spark, log, max_events=50), "seen", {"seen": "again", "*": "away"})
        jobs.run_available(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"), conf=jobs.ON_DISK, to_head=True)
    assert sorted([tuple(r) for r in spark.read.parquet(out).drop("batch").collect()], key=repr) == sorted(want, key=repr)
