"""Sinks: canonical JSON lines with the digest of their file, report files in fixed order, packages.

A logical file ``x.jsonl`` is a folder of part files in the order of its lines; its bytes are those of the parts, one
after the other, of a part that is stored as gzip those it holds. SHA-256 of a whole file is sequential by nature: it is carried
from one slice of a file to the next, a task each, while each part's own record is made by itself."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions.canonical import canonical_row
from ledgerlane.functions.keys import packed_hash, unpacked_hash
from ledgerlane.functions.resumable import Sha256
from ledgerlane.operators.digest import carried, lane_sums
from ledgerlane.plans.shared import TIDY, materialized, settings, small, table_exists

#: Lines of a part file at most, so that a part is read by a task at once; bytes of a file that a task digests.
PART_LINES, SLICE = 50_000, 256 << 20
#: Bytes of a gzip part that are unpacked at once; files that are digested side by side.
_PIECE, ASIDE = 1 << 20, 32
DIGEST = "file string, lines long, bytes long, sha256 string"


def write_lines(rows: DataFrame, path: str, order: list, compression: str = "none", hashes: tuple[str, ...] = ()) -> None:
    """Rows as canonical JSON lines in an order, range-partitioned so that part files follow it. The columns are sorted, not
    the longer lines, which are made as they are written, and hashes travel as bytes; parts may be stored as gzip."""
    extra = {f"_o{i}": c for i, c in enumerate(order) if isinstance(c, Column)}
    sent = {c: unpacked_hash(F.col(c)) for c in hashes if c in rows.columns}
    ordered = rows.withColumns({c: packed_hash(F.col(c)) for c in sent} | extra).orderBy(*[f"_o{i}" if f"_o{i}" in extra else sent.get(c, c) for i, c in enumerate(order)])
    ordered = ordered.withColumns(sent).select(*rows.columns)
    ordered.select(canonical_row(ordered).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", PART_LINES).option("compression", compression).text(path)


def _named(raw: DataFrame) -> DataFrame:
    """Binary files with the logical file and the part that they are."""
    steps = F.split("path", "/")
    return raw.withColumn("file", F.url_decode(F.element_at(steps, -2))).withColumn("part", F.element_at(steps, -1)).withColumn("bytes", F.col("length"))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path))


def part_sizes(spark: SparkSession, path: str) -> DataFrame:
    """file, part, path and bytes of each part file of the logical files below path, whose content isn't read."""
    return _binary(spark, path).select("file", "part", "path", "bytes")


def part_records(spark: SparkSession, path: str) -> DataFrame:
    """file, part, bytes and sha256 of each part file of the logical files below path, and its content."""
    return _binary(spark, path).select("file", "part", "bytes", F.sha2("content", 256).alias("sha256"), "content")


def _unpacked(path: str, content: pa.Buffer) -> Iterator[pa.Buffer]:
    """The bytes that a part holds, piece by piece if it is stored as gzip; a gzip part that is cut off raises."""
    if not path.endswith(".gz"):
        yield content
        return
    unpack = zlib.decompressobj(31)
    for at in range(0, content.size, _PIECE):
        left = content.slice(at, min(_PIECE, content.size - at)).to_pybytes()
        while left:
            if unpack.eof:  # another member
                unpack = zlib.decompressobj(31)
            yield pa.py_buffer(unpack.decompress(left, _PIECE))
            left = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
    yield pa.py_buffer(unpack.flush())
    if not unpack.eof:
        raise zlib.error(f"{path} ends within its gzip data")


def _slices(spark: SparkSession, path: str, but: tuple[str, ...]) -> list[dict[str, list[str]]]:
    """The part files below path, without those of the files in but, in rounds: of each file the next parts of SLICE
    bytes together, or one. The driver holds names and sizes."""
    sizes = part_sizes(spark, path).filter(~F.col("file").isin(*but)) if but else part_sizes(spark, path)
    rounds: dict[int, dict[str, list[str]]] = {}
    at: dict[str, tuple[int, int]] = {}
    for r in sizes.orderBy("file", "part").toLocalIterator():
        turn, held = at.get(r["file"], (0, 0))
        if held and held + r["bytes"] > SLICE:
            turn, held = turn + 1, 0
        at[r["file"]] = (turn, held + r["bytes"])
        rounds.setdefault(turn, {}).setdefault(r["file"], []).append(r["path"])
    return [dict(part) for i in sorted(rounds) for part in batched(rounds[i].items(), ASIDE)]


def file_digests(spark: SparkSession, path: str, names: tuple[str, ...] = (), but: tuple[str, ...] = ()) -> DataFrame:
    """SNK-1: file, lines, bytes and SHA-256 of the bytes of each logical file below path (without those in but), from what
    is stored. Spark's scan doesn't see part files without bytes, so an empty file is told only if it is among names and is
    there.

    A task takes a slice of a file and hands the digest's state on to the task of the next one, by the driver, so a file
    may have any size; files go side by side."""
    held: dict[str, tuple[bytes | None, int, int]] = {}
    for paths in _slices(spark, path, but):  # of each file

        def run(batches: Iterator[pa.RecordBatch], held: dict = held) -> Iterator[pa.RecordBatch]:
            found: dict[str, tuple[Sha256, int, int]] = {}
            for batch in batches:
                for file, part, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if file not in found:
                        state, lines, size = held.get(file, (None, 0, 0))
                        found[file] = (Sha256(state), lines, size)
                    digest, lines, size = found[file]
                    for data in _unpacked(part, content.as_buffer()):
                        if data.size:
                            digest.update(data.address, data.size)
                        lines, size = lines + data.to_pybytes().count(b"\n"), size + data.size
                    found[file] = (digest, lines, size)
            for file, (digest, lines, size) in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([digest.state]), pa.array([lines]), pa.array([size])], ["file", "state", "lines", "bytes"])

        # one task reads a file's slice and orders it; no bytes are sent
        each = [_named(spark.read.format("binaryFile").load(own)).select("file", "part", "content").coalesce(1).sortWithinPartitions("part") for own in paths.values()]
        parts = reduce(DataFrame.unionByName, each)
        # a part is a batch by itself, a file a task; a row a file comes back
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.unionOutputPartitioning": "false"}):
            found = parts.select("file", "part", "content").mapInArrow(run, "file string, state binary, lines long, bytes long").collect()
        held = held | {r["file"]: (bytes(r["state"]), r["lines"], r["bytes"]) for r in found}
    rows = [(file, lines, size, Sha256(state).hexdigest()) for file, (state, lines, size) in held.items()]
    rows += [(n, 0, 0, hashlib.sha256().hexdigest()) for n in names if n not in held and table_exists(spark, f"{path}/{n}")]
    return spark.createDataFrame(rows, DIGEST)


def write_jsonl(rows: DataFrame, path: str, order: list) -> DataFrame:
    """SNK-1: rows, bytes and SHA-256 of the file, and an order-independent digest of its lines, from what was written."""
    spark = rows.sparkSession
    write_lines(rows, path, order)
    sums = spark.read.text(path).agg(F.count(F.lit(1)).alias("rows"), *lane_sums(F.sha2("value", 256)))
    whole = file_digests(spark, path).agg(F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))
    # one row each
    return sums.crossJoin(F.broadcast(whole)).select("rows", "bytes", "sha256", carried([F.col(f"lane{i}") for i in range(8)]).alias("digest"))


def write_report_files(units: DataFrame, conversations: DataFrame, observations: DataFrame, renders: DataFrame, path: str) -> DataFrame:
    """SNK-2: the report's four files in their orders, with lines, bytes and SHA-256 of each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = {"units": (units, [text("conversation_id"), text("day"), text("unit_key"), text("job_id")]), "conversations": (conversations, [text("conversation_id")]), "observations": (observations, [text("stream"), F.col("seq")]), "renders": (renders, [text("render_id")])}
    for name, (rows, order) in parts.items():
        write_lines(rows, f"{path}/{name}.jsonl", order)
    return file_digests(units.sparkSession, path, tuple(f"{name}.jsonl" for name in parts))


#: A package's line files, each with the columns that order it.
PACKAGE_FILES = {"events.jsonl": ["stream", "seq"], "items.jsonl": ["stream", "seq", "idempotency_key", "item_id"], "evidence.jsonl": ["storage_key", "evidence_id"], "anchors.jsonl": ["stream", "seq"]}

#: Columns of theirs that are sent as bytes.
PACKAGE_HASHES = ("idempotency_key", "prev_hash", "event_hash", "content_hash", "raw_hash")


def write_package(events: DataFrame, items: DataFrame, evidence: DataFrame, anchors: DataFrame, heads: DataFrame, objects: DataFrame, path: str) -> DataFrame:
    """SNK-3: a package that is consistent with each stream's planned head: events and anchors up to it, items of those
    events, the evidence of those items and its bytes; and a manifest with the digest of each file and the heads.

    items have the stream and seq of their event; heads (stream, seq, event_hash); objects (sha256, content)."""
    spark = events.sparkSession
    with settings(spark, TIDY):
        upto = small(heads.select("stream", F.col("seq").alias("_head")))
        own = lambda rows: rows.join(upto, "stream").filter(F.col("seq") <= F.col("_head")).select(*rows.columns)
        write = lambda name, rows: write_lines(rows, f"{path}/{name}", PACKAGE_FILES[name], "gzip", PACKAGE_HASHES)
        write("events.jsonl", own(events))
        write("items.jsonl", own(items))
        write("anchors.jsonl", own(anchors))
        # which evidence it is, the written items tell: nothing that they were made of is read again
        named = materialized(spark.read.schema("evidence_id STRING").json(f"{path}/items.jsonl").distinct())
        kept = evidence.join(named, "evidence_id", "left_semi").select(*evidence.columns)
        write("evidence.jsonl", kept)
        objects.join(kept.select("sha256").distinct(), "sha256", "left_semi").write.mode("overwrite").parquet(f"{path}/objects")
        manifest = file_digests(spark, path, tuple(PACKAGE_FILES), ("objects", "manifest.json")).filter(F.col("file").isin(*PACKAGE_FILES))
        manifest = manifest.unionByName(heads.select("stream", "seq", "event_hash"), allowMissingColumns=True)
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")  # four files, and a row a stream
        return manifest


def write_manifests(manifests: DataFrame, path: str) -> None:
    """SNK-4: manifests by conversation and day."""
    manifests.write.mode("overwrite").partitionBy("conversation_id", "day").json(path)


def append_new(items: DataFrame, path: str, key: str = "idempotency_key") -> DataFrame:
    """SNK-5: items that a Parquet table doesn't hold yet, appended to it; returns what was appended."""
    from ledgerlane.operators.versions import new_items

    spark = items.sparkSession
    fresh = items.dropDuplicates([key])
    if table_exists(spark, path):
        fresh = new_items(items, spark.read.parquet(path), key)
    fresh = materialized(fresh)
    fresh.write.mode("append").parquet(path)
    return fresh


def persist(items: DataFrame, path: str) -> DataFrame:
    """SNK-5: items (idempotency_key, subject, content_hash, normalizer_version, derived) into the tables ``items`` and
    ``derivations`` below path: new keys only, existing ones are reused, and one derivation of each item and
    normalizer version. One row: inserted, existing and derivations_inserted."""
    keys = items.select("idempotency_key").distinct()
    fresh = append_new(items.select("idempotency_key", "subject", "content_hash"), f"{path}/items")
    each = items.select("idempotency_key", "normalizer_version", "derived").withColumn("derivation", F.sha2(F.concat_ws("\x1f", "idempotency_key", "normalizer_version"), 256))
    derived = append_new(each, f"{path}/derivations", "derivation")
    counts = [rows.agg(F.count(F.lit(1)).alias(name)) for rows, name in ((fresh, "inserted"), (keys, "keys"), (derived, "derivations_inserted"))]
    one = counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each
    return one.select("inserted", (F.col("keys") - F.col("inserted")).alias("existing"), "derivations_inserted")
