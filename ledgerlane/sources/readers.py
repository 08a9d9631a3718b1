"""Sources: pages, export files, archives, logs, packages and streams, with explicit schemas."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions import text as T
from ledgerlane.functions.keys import json_path
from ledgerlane.operators.archive import conversation_type
from ledgerlane.operators.normalize import CONVERSATION, MEMBER, MESSAGE
from ledgerlane.plans.shared import is_folder

#: Lines of a package's files.
PACKAGE = {
    "events": "stream STRING, seq BIGINT, event_type STRING, fields STRING, prev_hash STRING, event_hash STRING",
    "items": "item_id STRING, stream STRING, seq BIGINT, idempotency_key STRING, tenant_id STRING, source STRING, subject STRING, content_hash STRING, evidence_id STRING, storage_key STRING, json_path STRING, raw_hash STRING",
    "evidence": "evidence_id STRING, storage_key STRING, kind STRING, state STRING, sha256 STRING, source_sha256 STRING, size BIGINT, version_id STRING, shadow_versions BIGINT",
    "anchors": "stream STRING, seq BIGINT, event_hash STRING",
}
MANIFEST = "file STRING, lines BIGINT, bytes BIGINT, sha256 STRING, stream STRING, seq BIGINT, event_hash STRING"


def _strict(value: Column, schema: str) -> Column:
    """Parsed JSON; text of another shape raises."""
    parsed = F.from_json(value, schema, {"mode": "FAILFAST"})
    return F.when(parsed.isNull(), F.raise_error(F.concat(F.lit("malformed page: "), F.substring(F.coalesce(value, F.lit("null")), 1, 80)))).otherwise(parsed)


def page_messages(pages: DataFrame, value: str = "value") -> DataFrame:
    """SRC-1: one row per message of API pages ``{"ok": true, "messages": [...]}``, with its index and path;
    a page that isn't ok raises. Raw text stays with the page, so hashes are over the original."""
    page = _strict(F.col(value), f"struct<ok: BOOLEAN, has_more: BOOLEAN, messages: ARRAY<STRUCT<{_nested(MESSAGE)}>>>")
    rows = pages.withColumn("_page", page)
    rows = rows.withColumn("_page", F.when(~F.coalesce(F.col("_page.ok"), F.lit(False)), F.raise_error(F.lit("page is not ok")).cast(rows.schema["_page"].dataType)).otherwise(F.col("_page")))
    out = rows.select(*[c for c in pages.columns if c != value], F.posexplode("_page.messages").alias("message_index", "message"))
    return out.withColumn("json_path", json_path("messages", F.col("message_index")))


def message_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1 from files, one page each."""
    return page_messages(spark.read.text(path, wholetext=True).withColumn("page", F.col("_metadata.file_path")))


def _nested(ddl: str) -> str:
    """``a STRING, b STRUCT<...>`` as the inside of a struct type."""
    depth, out, start = 0, [], 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


def day_messages(files: DataFrame, value: str = "value") -> DataFrame:
    """SRC-2: one row per element of export day files (bare arrays), with its index and path."""
    rows = files.withColumn("_m", _strict(F.col(value), f"array<struct<{_nested(MESSAGE)}>>"))
    out = rows.select(*[c for c in files.columns if c != value], F.posexplode("_m").alias("message_index", "message"))
    return out.withColumn("json_path", F.concat(F.lit("$["), F.col("message_index").cast("string"), F.lit("]")))


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2 from ``<folder>/<day>.json`` files; a file is one task's work."""
    rows = spark.read.text(path, wholetext=True).withColumn("_p", F.col("_metadata.file_path"))
    place = r"([^/]+)/(\d{4}-\d{2}-\d{2})\.json$"
    rows = rows.withColumn("folder", F.url_decode(F.regexp_extract("_p", place, 1))).withColumn("hint_day", F.to_date(F.regexp_extract("_p", place, 2)))
    return day_messages(rows.drop("_p"))


LISTING = "archive STRING, idx BIGINT, name STRING, folded_name STRING, is_dir BOOLEAN, method INT, crc32 BIGINT, compressed_size BIGINT, uncompressed_size BIGINT, local_header_offset BIGINT, flags INT"


def listed(archives: DataFrame) -> DataFrame:
    """SRC-3 / UDF-3: entries of zip archives (path, content); one archive is listed by one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for where, content in zip(part["path"], part["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pd.DataFrame([(where, i, e.filename, e.filename.casefold(), e.is_dir(), e.compress_type, e.CRC, e.compress_size, e.file_size, e.header_offset, e.flag_bits) for i, e in enumerate(z.infolist())], columns=[x.split()[0] for x in LISTING.split(", ")])

    return archives.select("path", "content").mapInPandas(run, LISTING)


def archive_listing(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3 from files."""
    return listed(spark.read.format("binaryFile").load(path))


#: Why a conversation's messages can't be collected, and the beginning of a stand-in id.
REFUSED_ID, REFUSED_TEAM, STAND_IN = "conversation_id_lone_surrogate", "team_id_lone_surrogate", "lone-surrogate:"


def conversation_metadata(files: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """SRC-4: conversations of metadata files (value, kind): id, kind, folder (its name; of dms the id), team.

    Elements without an id, or whose folder is missing or no plain name, are left out. Half a surrogate pair in
    a name becomes U+FFFD; one in an id or team makes the conversation ``refused`` (why), under a stand-in id."""
    marked = T.make_valid(F.col(value), f"{T.HALF}$2")
    rows = files.withColumn("_c", _strict(marked, f"array<struct<{_nested(CONVERSATION)}>>")).select(kind, F.posexplode("_c").alias("idx", "c"))
    cid, half = F.col("c.id"), F.lit(T.HALF)
    folder = T.without_halves(F.when(F.col(kind) == "dm", cid).otherwise(F.col("c.name")))
    plain = (folder != "") & ~F.contains(folder, F.lit("/")) & ~folder.isin(".", "..")
    usable = [F.when((F.col(f"c.{f}") != "") & ~F.contains(F.col(f"c.{f}"), F.lit("/")), F.col(f"c.{f}")) for f in ("context_team_id", "team_id", "team")]
    team = F.coalesce(*usable)
    refused = F.when(F.contains(cid, half), REFUSED_ID).when(F.contains(team, half), REFUSED_TEAM)
    return rows.filter((cid != "") & plain).select(
        F.when(F.contains(cid, half), F.concat(F.lit(STAND_IN), T.code_units(cid))).otherwise(cid).alias("conversation_id"), kind, folder.alias("folder"), T.without_halves(F.col("c.name")).alias("name"),
        F.when(~F.contains(team, half), team).alias("team_id"), "idx", refused.alias("refused"),
    )


def _label(*names: Column) -> Column:
    """The first name that isn't empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def directory_members(pages: DataFrame, value: str = "value") -> DataFrame:
    """SRC-5: members of directory pages: kind (bot or user), whether they are archived, the name they are listed by, and
    the key they are found by (of the name, or of the id without one). Elements without an id are left out."""
    rows = pages.withColumn("_p", _strict(F.col(value), f"struct<ok: BOOLEAN, members: ARRAY<STRUCT<{_nested(MEMBER)}>>>")).select(F.posexplode("_p.members").alias("idx", "member"))
    m = F.col("member")
    name = _label(m["profile"]["real_name"], m["real_name"], m["profile"]["display_name"], m["name"])
    return rows.filter(m["id"] != "").select("idx", "member", m["id"].alias("id"), F.when(F.coalesce(m["is_bot"], F.lit(False)), "bot").otherwise("user").alias("kind"), F.coalesce(m["deleted"], F.lit(False)).alias("archived"), F.coalesce(name, m["id"]).alias("display"), T.search_key(F.coalesce(name, m["id"])).alias("search_key"))


def directory_conversations(pages: DataFrame, value: str = "value") -> DataFrame:
    """SRC-5: conversations of directory pages ``{"ok": true, "channels": [...]}``: type, whether they are archived, name (of a
    direct message its user) and the key they are found by. Elements without an id are left out."""
    rows = pages.withColumn("_p", _strict(F.col(value), f"struct<ok: BOOLEAN, channels: ARRAY<STRUCT<{_nested(CONVERSATION)}, user: STRING>>>")).select(F.posexplode("_p.channels").alias("idx", "conversation"))
    c = F.col("conversation")
    kind = conversation_type(c["is_im"], c["is_mpim"], c["is_private"], c["is_group"])
    name = _label(c["name"], F.when(kind == "im", c["user"]))
    return rows.filter(c["id"] != "").select("idx", "conversation", c["id"].alias("id"), kind.alias("kind"), F.coalesce(c["is_archived"], F.lit(False)).alias("archived"), F.coalesce(name, c["id"]).alias("display"), T.search_key(F.coalesce(name, c["id"])).alias("search_key"))


def custody_log(events: DataFrame, stream: str, types: tuple[str, ...] = ()) -> DataFrame:
    """SRC-6: a stream's events in seq order, of some types only if given; both filters reach the scan."""
    own = events.filter(F.col("stream") == stream)
    return (own.filter(F.col("event_type").isin(*types)) if types else own).orderBy("seq")


def package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-7: what SNK-3 wrote: the lines of its four files, the manifest's files (``stated``) and heads, each file
    as it is now (``found``: lines, bytes, SHA-256), and the stored objects with their own hash and size."""
    from ledgerlane.sinks.files import PACKAGE_FILES, file_digests

    out = {name: spark.read.schema(schema).json(f"{path}/{name}.jsonl", mode="FAILFAST") for name, schema in PACKAGE.items()}
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest.json", mode="FAILFAST")
    out |= {"stated": manifest.filter("file is not null").select("file", "lines", "bytes", "sha256"), "heads": manifest.filter("stream is not null").select("stream", "seq", "event_hash")}
    out["found"] = file_digests(spark, path, tuple(PACKAGE_FILES), ("manifest.json", "objects"))
    out["objects"] = spark.read.parquet(f"{path}/objects").select("sha256", "content", F.sha2("content", 256).alias("own_sha256"), F.length("content").cast("long").alias("own_size"))
    return out


def evidence_bytes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: hash and size of stored objects. Spark's scan leaves out files without bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("storage_key"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


def table_stream(spark: SparkSession, path: str, like: DataFrame | None = None, files_per_batch: int | None = None) -> DataFrame:
    """SRC-9: a Parquet table as a stream, with the schema of the files there now."""
    schema = (like if like is not None else spark.read.parquet(path)).schema
    reader = spark.readStream.schema(schema)
    if not is_folder(spark, path):  # a stream watches folders: of a single file's, only that file
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
