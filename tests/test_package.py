"""Files as they are stored: digests of their bytes, packages written and read back, and single faults."""

import gzip
import hashlib
import json
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.functions.canonical import canonical
from ledgerlane.operators import custody, package
from ledgerlane.sinks import files
from ledgerlane.sources import readers


def test_digest_is_that_of_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_LINES", 7)
    rows = spark.range(50).select("id", F.concat(F.lit("é\n\""), "id").alias("t")).repartition(6)
    got = files.write_jsonl(rows, str(tmp_path / "x.jsonl"), ["id"]).first()
    want = "".join(json.dumps({"id": i, "t": f'é\n"{i}'}, ensure_ascii=False, separators=(",", ":")) + "\n" for i in range(50)).encode()
    assert (got["rows"], got["bytes"], got["sha256"]) == (50, len(want), hashlib.sha256(want).hexdigest())
    parts = files.part_records(spark, str(tmp_path)).orderBy("part").collect()
    assert len(parts) > 6 and b"".join(bytes(p["content"]) for p in parts) == want
    assert all(p["sha256"] == hashlib.sha256(bytes(p["content"])).hexdigest() for p in parts)
    none = files.write_jsonl(rows.limit(0), str(tmp_path / "y.jsonl"), ["id"]).first()
    assert (none["rows"], none["bytes"], none["sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest())


PAGES = {"p1": {"ok": True, "messages": [{"b": 1, "a": "x"}, {"a": [1.0, None]}]}, "p2": [{"z": "ü"}]}


def parts(spark):
    """Six events of a stream, the items of three of them, and their pages."""
    events = custody.build_chain(spark.createDataFrame([("s", i, "k", f'{{"n":{i}}}') for i in range(1, 7)], "stream string, seq long, event_type string, fields string"))
    stored = {k: json.dumps(v, indent=1, ensure_ascii=False).encode() for k, v in PAGES.items()}
    sha = {k: hashlib.sha256(v).hexdigest() for k, v in stored.items()}
    evidence = [(k, f"e/{k}", "page", "complete", sha[k], sha[k], len(v), "v", 0) for k, v in stored.items()]
    items = []
    for n, (page, path, fragment, seq) in enumerate([("p1", "$.messages[0]", PAGES["p1"]["messages"][0], 2), ("p1", "$.messages[1]", PAGES["p1"]["messages"][1], 3), ("p2", "$[0]", PAGES["p2"][0], 6)]):
        content = hashlib.sha256(path.encode()).hexdigest()
        key = hashlib.sha256("\x1f".join(("t", "chat", f"m{n}", content)).encode()).hexdigest()
        items.append((str(n), "s", seq, key, "t", "chat", f"m{n}", content, page, f"e/{page}", path, hashlib.sha256(canonical(fragment).encode()).hexdigest()))
    schema = {k: v.replace(" STRING", " string") for k, v in readers.PACKAGE.items()}
    return {
        "events": events, "items": spark.createDataFrame(items, schema["items"]), "evidence": spark.createDataFrame(evidence, schema["evidence"]), "anchors": events.filter("seq % 2 = 0").select("stream", "seq", "event_hash"),
        "heads": events.filter("seq = 5").select("stream", "seq", "event_hash"), "objects": spark.createDataFrame([(sha[k], bytearray(v)) for k, v in stored.items()], "sha256 string, content binary"),
    }


def test_package_holds_what_its_head_covers(spark, tmp_path):
    given = parts(spark)
    manifest = files.write_package(*(given[k] for k in ("events", "items", "evidence", "anchors", "heads", "objects")), str(tmp_path / "p"))
    assert {r["file"]: r["lines"] for r in manifest.filter("file is not null").collect()} == {"events.jsonl": 5, "items.jsonl": 2, "evidence.jsonl": 1, "anchors.jsonl": 2}
    back = readers.package(spark, str(tmp_path / "p"))
    assert package.verify_package(back).count() == 0
    for name in ("events", "items", "evidence", "anchors"):
        upto = given[name].filter("seq <= 5") if "seq" in given[name].columns else given[name].filter("evidence_id = 'p1'")
        assert back[name].select(*sorted(back[name].columns)).exceptAll(upto.select(*sorted(back[name].columns))).isEmpty() and back[name].count() == upto.count()
    assert [r["sha256"] == r["own_sha256"] for r in back["objects"].collect()] == [True]


#: Table, column and its faulty value.
FAULTS = {
    "altered": ("events", "fields", "if(seq = 3, '{}', fields)"),
    "wrong_key": ("items", "content_hash", "if(item_id = '0', '0', content_hash)"),
    "evidence_missing": ("items", "evidence_id", "if(item_id = '1', 'gone', evidence_id)"),
    "storage_key_differs": ("items", "storage_key", "storage_key || 'x'"),
    "path_unresolved": ("items", "json_path", "if(item_id = '1', '$.messages[2]', json_path)"),
    "fragment_differs": ("items", "json_path", "if(item_id = '1', '$.messages[0]', json_path)"),
    "not_pinned": ("evidence", "version_id", "cast(null as string)"),
    "source_differs": ("evidence", "source_sha256", "'0'"),
    "storage_incident": ("evidence", "shadow_versions", "2L"),
    "bytes_differ": ("objects", "content", "content || cast(' ' as binary)"),
    "bytes_missing": ("objects", "content", None),
    "anchor_differs": ("anchors", "event_hash", "'0'"),
    "head_differs": ("heads", "event_hash", "'0'"),
}


@pytest.mark.parametrize("error", FAULTS)
def test_each_fault_is_found(spark, tmp_path, error):
    given = parts(spark)
    table, column, value = FAULTS[error]
    given[table] = given[table].withColumn(column, F.expr(value)) if value else given[table].limit(0)
    files.write_package(*(given[k] for k in ("events", "items", "evidence", "anchors", "heads", "objects")), str(tmp_path / "p"))
    assert {r["error"] for r in package.verify_package(readers.package(spark, str(tmp_path / "p"))).collect()} == {error}


def test_an_empty_file_is_in_the_manifest(spark, tmp_path):
    given = parts(spark)
    manifest = files.write_package(given["events"], given["items"].limit(0), given["evidence"], given["anchors"].limit(0), given["heads"], given["objects"], str(tmp_path / "p"))
    assert {r["file"]: r["bytes"] for r in manifest.filter("lines = 0").collect()} == {"items.jsonl": 0, "evidence.jsonl": 0, "anchors.jsonl": 0}
    assert package.verify_package(readers.package(spark, str(tmp_path / "p"))).count() == 0


def test_page_fragments(spark):
    df = spark.createDataFrame([("a", '{"ok":true,"odd name":[{"x":1}],"n":[],"s":"[not]"}'), ("b", ' [1, "two"]'), ("c", "{}")], "k string, page string")
    got = {(r["k"], r["json_path"], r["fragment"]) for r in package.page_fragments(df, "k", "page").collect() if r["k"] != "a" or "odd" in r["json_path"]}
    assert got == {("a", '$["odd name"][0]', '{"x":1}'), ("b", "$[0]", "1"), ("b", "$[1]", "two")}


def test_evidence_bytes_of_stored_files(spark, tmp_path):
    for name, content in (("a.bin", b"\x00\xff"), ("b.bin", b"x" * 70)):
        (tmp_path / name).write_bytes(content)
    got = {r["storage_key"].rsplit("/", 1)[-1]: (r["sha256"], r["size"]) for r in readers.evidence_bytes(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (hashlib.sha256(b"\x00\xff").hexdigest(), 2), "b.bin": (hashlib.sha256(b"x" * 70).hexdigest(), 70)}


def test_keys_have_four_parts(spark):
    got = spark.range(1).select(K.idempotency_key(F.lit("t"), F.lit("chat"), F.lit("m"), F.lit("h"))).first()[0]
    assert got == hashlib.sha256(b"t\x1fchat\x1fm\x1fh").hexdigest()


def test_digest_is_carried_over_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_LINES", 7)
    monkeypatch.setattr(files, "SLICE", 100)
    rows = spark.range(200).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).repartition(6)
    for name in ("x.jsonl", "y.jsonl"):
        files.write_lines(rows, str(tmp_path / name), ["id"])
    assert len(files._slices(spark, str(tmp_path), ())) > 20  # tasks that one file's digest passes through
    want = {}
    for name in ("x.jsonl", "y.jsonl"):
        data = b"".join(p.read_bytes() for p in sorted((tmp_path / name).glob("part-*")))
        want[name] = (200, len(data), hashlib.sha256(data).hexdigest())
    assert {r["file"]: (r["lines"], r["bytes"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()} == want
    assert [r["file"] for r in files.file_digests(spark, str(tmp_path), but=("x.jsonl",)).collect()] == ["y.jsonl"]


def test_a_package_is_stored_as_gzip_and_digested_as_its_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_LINES", 7)
    monkeypatch.setattr(files, "SLICE", 300)
    monkeypatch.setattr(files, "_PIECE", 40)
    given = parts(spark)
    more = custody.build_chain(spark.range(1, 201).select(F.lit("s").alias("stream"), F.col("id").alias("seq"), F.lit("k").alias("event_type"), F.concat(F.lit('{"n":'), "id", F.lit("}")).alias("fields")))
    head = more.filter("seq = 190").select("stream", "seq", "event_hash")
    manifest = files.write_package(more, given["items"], given["evidence"], given["anchors"], head, given["objects"], str(tmp_path / "p"))
    stated = {r["file"]: (r["lines"], r["bytes"], r["sha256"]) for r in manifest.filter("file is not null").collect()}
    stored = 0
    for name, sums in stated.items():
        found = sorted((tmp_path / "p" / name).glob("part-*"))
        assert all(p.suffix == ".gz" for p in found)
        data = b"".join(gzip.decompress(p.read_bytes()) for p in found)
        assert sums == (data.count(b"\n"), len(data), hashlib.sha256(data).hexdigest())
        stored += sum(p.stat().st_size for p in found)
    assert stated["events.jsonl"][0] == 190 and stored < sum(sums[1] for sums in stated.values())
    assert sorted(r["seq"] for r in spark.read.json(str(tmp_path / "p" / "events.jsonl")).collect()) == list(range(1, 191))


def test_gzip_parts_of_several_members_and_cut_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").mkdir()
    one, two = b"a\n" * 3_000_000, bytes(range(256)) * 9
    (tmp_path / "x.jsonl" / "part-0.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    (tmp_path / "x.jsonl" / "part-1").write_bytes(two)
    got = files.file_digests(spark, str(tmp_path)).first()
    assert (got["bytes"], got["lines"], got["sha256"]) == (len(one + two + two), (one + two + two).count(b"\n"), hashlib.sha256(one + two + two).hexdigest())
    with pytest.raises(zlib.error):
        list(files._unpacked("part-0.gz", files.pa.py_buffer(gzip.compress(two)[:-9])))


def test_a_file_of_any_name_is_digested_by_itself(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"f {n}").mkdir()
        for part in range(3):
            (tmp_path / f"f {n}" / f"part-{part}").write_bytes(f"{n}/{part}\n".encode() * (n + 1))
    want = {f"f {n}": hashlib.sha256(b"".join(f"{n}/{part}\n".encode() * (n + 1) for part in range(3))).hexdigest() for n in range(40)}
    assert {r["file"]: r["sha256"] for r in files.file_digests(spark, str(tmp_path)).collect()} == want


def test_packed_hashes_are_told_apart_and_unpacked(spark):
    texts = ["0" * 64, "0" * 63 + "f", "0" * 63 + "F", "0" * 64 + "\n", "0", "", "\0" * 32, "ü", "\0" * 33 + "0", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.packed_hash(F.col("t")).alias("p"))
    got = rows.select("t", F.octet_length("p").alias("n"), F.hex("p").alias("p"), K.unpacked_hash(F.col("p")).alias("back")).collect()
    assert [r["back"] for r in got] == texts and len({r["p"] for r in got}) == len(texts)
    assert [r["n"] for r in got][:3] == [32, 32, 97]


def test_a_scratch_table_is_there_inside_only(spark):
    from ledgerlane.plans.shared import scratch, table_exists

    with scratch(spark.range(5)) as t:
        path = t.inputFiles()[0].rsplit("/", 1)[0]
        assert sorted(r["id"] for r in t.collect()) == [0, 1, 2, 3, 4] and table_exists(spark, path)
    assert not table_exists(spark, path)
