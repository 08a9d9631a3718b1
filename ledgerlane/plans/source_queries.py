"""Queries of sources, projections, sinks, packages and streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.functions import keys as K
from ledgerlane.functions.canonical import canonical_json
from ledgerlane.operators import custody as C
from ledgerlane.operators import normalize as N
from ledgerlane.operators import package as P
from ledgerlane.operators import recompute as Q
from ledgerlane.operators import versions as X
from ledgerlane.operators.reconcile import unit_order
from ledgerlane.operators.registry import register
from ledgerlane.plans import views as V
from ledgerlane.plans.custody_queries import CARRY, EVENTS_SEEN, HASHED, HEX, LANES, _built
from ledgerlane.plans.shared import materialized, scratch, shared_folder, small
from ledgerlane.sinks import files as W
from ledgerlane.sources import readers as R
from ledgerlane.sources.tail import custody_tail
from ledgerlane.streaming import jobs as J


def _raw(spark, sf):
    """Messages as raw structs, some deleted, some with files and mentions."""
    m = V.msg(spark, sf)
    e = F.col("event_id")
    raw = F.struct(
        K.instant_ts(F.col("sent_at")).alias("ts"), F.when(e % 31 != 0, F.col("author")).alias("user"), F.when(e % 31 == 0, F.concat(F.lit("B"), F.col("author"))).alias("bot_id"), F.concat(F.col("text"), F.lit(" <@U"), (F.col("k") % 7).cast("string"), F.lit(">")).alias("text"),
        F.when(e % 41 == 0, K.instant_ts(F.col("sent_at"))).alias("deleted_ts"), F.when(e % 9 == 0, F.array(F.struct(F.concat(F.lit("F"), (e % 300).cast("string")).alias("id"), F.col("text").alias("name")))).alias("files"),
    )
    return m.select("unit_key", "conversation_id", "event_id", raw.alias("raw"))


def _pages(spark, sf):
    rows = _raw(spark, sf).groupBy("conversation_id", "unit_key").agg(F.array_sort(F.collect_list(F.struct("event_id", "raw"))).alias("m"))
    return rows.select("conversation_id", "unit_key", F.to_json(F.struct(F.lit(True).alias("ok"), F.transform("m", lambda x: x["raw"]).alias("messages"))).alias("value"))


_TS = "CAST(CAST(epoch_us(sent_at) AS BIGINT) // 1000000 AS VARCHAR) || '.' || lpad(CAST(CAST(epoch_us(sent_at) AS BIGINT) % 1000000 AS VARCHAR), 6, '0')"


@register("src1_prj1_messages", f"""WITH {V.MSG} SELECT unit_key, row_number() OVER (PARTITION BY unit_key ORDER BY event_id) - 1 AS message_index, '$.messages[' || (row_number() OVER (PARTITION BY unit_key ORDER BY
  event_id) - 1) || ']' AS json_path, 'T0/' || conversation_id || '/' || {_TS} AS subject, CASE WHEN event_id % 31 = 0 THEN 'B' || author ELSE author END AS author,
CASE WHEN event_id % 41 = 0 THEN '' ELSE text || ' <@U' || (k % 7) || '>' END AS text, event_id % 41 = 0 AS deleted, CASE WHEN event_id % 9 = 0 THEN 'F' || (event_id % 300) ELSE ''
  END AS file_ids, CASE WHEN event_id % 41 = 0 THEN '' ELSE 'U' || (k % 7) END AS mentions FROM msg""")
def src1(spark, sf):
    m = N.messages(R.page_messages(_pages(spark, sf)))
    return m.select("unit_key", F.col("message_index").cast("long").alias("message_index"), "json_path", "subject", "author", "text", "deleted", F.array_join("file_ids", ",").alias("file_ids"), F.array_join("mentions", ",").alias("mentions"))


@register("src2_day_files", f"WITH {V.MSG} SELECT unit_key, row_number() OVER (PARTITION BY unit_key ORDER BY event_id) - 1 AS message_index, '$[' || (row_number() OVER (PARTITION BY unit_key ORDER BY event_id) - 1) || ']' AS json_path, {_TS} AS ts FROM msg")
def src2(spark, sf):
    rows = _raw(spark, sf).groupBy("unit_key").agg(F.array_sort(F.collect_list(F.struct("event_id", "raw"))).alias("m"))
    d = R.day_messages(rows.select("unit_key", F.to_json(F.transform("m", lambda x: x["raw"])).alias("value")))
    return d.select("unit_key", F.col("message_index").cast("long").alias("message_index"), "json_path", F.col("message.ts").alias("ts"))


@register("prj2_files", f"""WITH {V.MSG}, f AS (SELECT 'F' || (event_id % 300) AS id, text AS name, unit_key, row_number() OVER (PARTITION BY unit_key ORDER BY event_id) - 1 AS i, event_id FROM msg), n AS
  (SELECT *, row_number() OVER (PARTITION BY id ORDER BY unit_key, i) AS n FROM f WHERE event_id % 9 = 0) SELECT id, name, unit_key FROM n WHERE n = 1""")
def prj2(spark, sf):
    return N.files(R.page_messages(_pages(spark, sf)), "message", ["unit_key", "message_index"]).select("id", "name", "unit_key")


_MEMBERS = "m AS (SELECT c_custkey, 'U' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS display, c_name AS real_name, c_custkey % 11 = 0 AS gone, c_custkey % 13 = 0 AS bot FROM customer)"


def _members(spark, sf):
    c = V.read(spark, sf, "customer")
    k = F.col("c_custkey")
    profile = F.struct(F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("display_name"), F.col("c_name").alias("real_name"), F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")).alias("email"))
    m = F.struct(F.concat(F.lit("U"), k.cast("string")).alias("id"), F.col("c_name").alias("real_name"), (k % 11 == 0).alias("deleted"), (k % 13 == 0).alias("is_bot"), profile.alias("profile"))
    pages = c.groupBy(F.floor(k / 50).alias("page")).agg(F.array_sort(F.collect_list(m)).alias("m"))
    return R.directory_members(pages.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.col("m").alias("members"))).alias("value")))


@register("src5_directory_members", f"WITH {_MEMBERS} SELECT id, CASE WHEN bot THEN 'bot' ELSE 'user' END AS kind, gone AS archived, real_name AS display, lower(real_name) AS search_key FROM m")
def src5(spark, sf):
    return _members(spark, sf).select("id", "kind", "archived", "display", "search_key")


@register("src5_directory_conversations", """SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'im' WHEN c_custkey % 3 = 0 THEN 'private_channel' ELSE 'public_channel' END AS kind, c_custkey % 10 = 0 AS archived,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name WHEN c_custkey % 7 = 0 THEN 'U' || c_custkey ELSE 'C' || c_custkey END AS display, lower(CASE WHEN c_custkey % 5 <> 0 THEN c_name WHEN c_custkey % 7 = 0 THEN 'U' || c_custkey ELSE 'C' || c_custkey END) AS search_key FROM customer WHERE c_custkey % 11 <> 0""")
def src5c(spark, sf):
    """Conversation pages; some elements have no id, some no name, and direct messages are listed by their user."""
    c = V.read(spark, sf, "customer")
    k = F.col("c_custkey")
    s = F.struct(F.when(k % 11 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("id"), F.when(k % 5 != 0, F.col("c_name")).alias("name"), (k % 7 == 0).alias("is_im"), (k % 3 == 0).alias("is_private"), (k % 10 == 0).alias("is_archived"), F.concat(F.lit("U"), k.cast("string")).alias("user"))
    pages = c.groupBy(F.floor(k / 50).alias("page")).agg(F.array_sort(F.collect_list(s)).alias("c")).select(F.to_json(F.struct(F.lit(True).alias("ok"), F.col("c").alias("channels"))).alias("value"))
    return R.directory_conversations(pages).select("id", "kind", "archived", "display", "search_key")


@register("prj3_identities", f"""WITH {_MEMBERS} SELECT 'T0/user/' || id || '#profile' AS subject, display AS display_name, real_name, gone AS deactivated, sha256('{{"deactivated":' || gone || ',"display_name":"' || display || '","email":"u' || c_custkey || '@example.com","fp":"chat.profile/1","real_name":"' || real_name || '","user":"' || id || '"}}')
  AS content_hash FROM m""")
def prj3(spark, sf):
    return N.identities(_members(spark, sf)).select("subject", "display_name", "real_name", "deactivated", "content_hash")


def _conversations(spark, sf):
    c = V.read(spark, sf, "customer")
    k = F.col("c_custkey")
    members = F.array(F.concat(F.lit("U"), (k % 9).cast("string")), F.concat(F.lit("U"), (k % 4).cast("string")))
    s = F.struct(F.concat(F.lit("C"), k.cast("string")).alias("id"), F.when(k % 5 != 0, F.col("c_name")).alias("name"), (k % 7 == 0).alias("is_im"), (k % 3 == 0).alias("is_private"), (k % 10 == 0).alias("is_archived"), F.struct(F.col("c_mktsegment").alias("value")).alias("topic"), members.alias("members"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("team_id"))
    return c.groupBy(F.floor(k / 50).alias("page"), F.element_at(F.array(F.lit("channel"), F.lit("dm")), (k % 2 + 1).cast("int")).alias("kind")).agg(F.array_sort(F.collect_list(s)).alias("c")).select("page", "kind", F.to_json("c").alias("value"))


@register("src3_archive_listing", """SELECT 'A' || doc_id // 10 AS archive, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS idx, coalesce(source, 'none') || '/Doc ' || doc_id || '.txt' AS name,
  lower(coalesce(source, 'none') || '/Doc ' || doc_id || '.txt') AS folded_name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS uncompressed_size FROM documents""")
def src3(spark, sf):
    def packed(group: pd.DataFrame) -> pd.DataFrame:
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in group.sort_values("doc_id")[["name", "text"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name), text)
        return pd.DataFrame({"path": group["path"].iloc[:1], "content": [made.getvalue()]})

    d = V.read(spark, sf, "documents")
    rows = d.select("doc_id", F.concat(F.lit("A"), F.floor(F.col("doc_id") / 10).cast("string")).alias("path"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    archives = rows.groupBy("path").applyInPandas(packed, "path string, content binary")  # ten documents each
    return R.listed(archives).select("archive", "idx", "name", "folded_name", "uncompressed_size")


@register("src4_conversation_metadata", r"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'channel' ELSE 'dm' END AS kind, 'C' || c_custkey AS id,
  CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, 'T' || c_nationkey AS team FROM customer),
m AS (SELECT *, k % 17 = 0 AS bad_id, k % 19 = 0 AS bad_team, CASE WHEN k % 23 = 0 THEN 'x/' || name WHEN k % 29 = 0 THEN name || chr(65533) ELSE name END AS shown FROM c WHERE k % 31 <> 0)
SELECT CASE WHEN bad_id THEN 'lone-surrogate:' || array_to_string(list_transform(regexp_extract_all(id, '.'), lambda x: printf('%04x', unicode(x))), '.') || '.d83d' ELSE id END AS conversation_id, kind,
  CASE WHEN kind = 'dm' THEN id || CASE WHEN bad_id THEN chr(65533) ELSE '' END ELSE shown END AS folder, CASE WHEN NOT bad_team THEN team END AS team_id,
  CASE WHEN bad_id THEN 'conversation_id_lone_surrogate' WHEN bad_team THEN 'team_id_lone_surrogate' END AS refused
FROM m WHERE kind = 'dm' OR (shown IS NOT NULL AND NOT contains(shown, '/'))""")
def src4(spark, sf):
    # ids, teams and names with half a surrogate pair, folders with a slash, and elements without an id
    c = V.read(spark, sf, "customer")
    k = F.col("c_custkey")
    half = lambda x, n: F.concat(x, F.when(k % n == 0, F.lit("\\ud83d")).otherwise(""))
    name = F.when(k % 23 == 0, F.concat(F.lit("x/"), "c_name")).otherwise(half(F.col("c_name"), 29))
    s = F.struct(F.when(k % 31 != 0, half(F.concat(F.lit("C"), k.cast("string")), 17)).alias("id"), F.when(k % 5 != 0, name).alias("name"), F.lit("").alias("context_team_id"), half(F.concat(F.lit("T"), F.col("c_nationkey").cast("string")), 19).alias("team_id"))
    pages = c.groupBy(F.floor(k / 50).alias("page"), F.element_at(F.array(F.lit("channel"), F.lit("dm")), (k % 2 + 1).cast("int")).alias("kind")).agg(F.array_sort(F.collect_list(s)).alias("c"))
    raw = pages.select("page", "kind", F.replace(F.to_json("c"), F.lit("\\\\ud83d"), F.lit("\\ud83d")).alias("value"))
    return R.conversation_metadata(raw).select("conversation_id", "kind", "folder", "team_id", "refused")


@register("prj4_conversations", """SELECT 'C' || c_custkey AS conversation_id, CASE WHEN c_custkey % 7 = 0 THEN 'im' WHEN c_custkey % 3 = 0 THEN 'private_channel' ELSE 'public_channel' END AS type,
  coalesce(c_mktsegment, '') AS topic, array_to_string(list_sort(['U' || (c_custkey % 9), 'U' || (c_custkey % 4)]), ',') AS members, c_custkey % 10 = 0 AS archived FROM customer""")
def prj4(spark, sf):
    rows = _conversations(spark, sf).select(F.explode(F.from_json("value", f"array<struct<{R._nested(N.CONVERSATION)}>>")).alias("conversation"))
    return N.conversations(rows).select("conversation_id", "type", "topic", F.array_join("members", ",").alias("members"), "archived")


@register("src6_custody_log", f"WITH {V.CHAIN} SELECT seq, event_type, actor FROM chain WHERE stream = 'S3' AND event_type IN ('job_paused', 'job_resumed')")
def src6(spark, sf):
    return R.custody_log(V.chain(spark, sf), "S3", ("job_paused", "job_resumed")).select("seq", "event_type", "actor")


@register("snk1_jsonl_digest", f"""WITH {V.MSG}, v AS (SELECT event_id, '{{"event_id":' || event_id || ',"half":' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id // 2 AS VARCHAR) ELSE event_id // 2 || '.5' END || ',"text":"' || text || '"}}' AS line FROM msg),
h AS (SELECT line, sha256(line) AS h FROM v), lanes AS (SELECT count(*) AS n, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, {LANES} FROM h), {CARRY} SELECT n AS rows, bytes, (SELECT sha256(string_agg(line || chr(10), '' ORDER BY event_id)) FROM v) AS sha256, {HEX} AS digest FROM c0""")
def snk1(spark, sf):
    m = V.msg(spark, sf).select("event_id", "text", (F.col("event_id") / 2).alias("half"))
    return W.write_jsonl(m, f"{shared_folder(spark, 'jsonl')}/messages.jsonl", ["event_id"])


#: Lines, bytes and SHA-256 of the files whose lines are in lines (file, place, line).
_SUMS = "SELECT file, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(string_agg(line || chr(10), '' ORDER BY place)) AS sha256 FROM lines GROUP BY file"

_RENDERS = "renders AS (SELECT conversation_id, count(DISTINCT day) AS files, count(*) FILTER (WHERE event_id % 9 = 0) AS natives, 'R' || conversation_id AS render_id FROM msg GROUP BY conversation_id)"


@register("snk2_report_files", f"""WITH {V.UNITS}, {_RENDERS},
by_state AS (SELECT conversation_id, state, place, count(*) AS n, sum(coalesce(expected_count, 0)) AS e, sum(collected) AS c, sum(file_gaps) AS g FROM ranked WHERE kind <> 'directory' GROUP BY ALL),
roll AS (SELECT conversation_id, string_agg('"' || state || '":' || n, ',' ORDER BY state) AS by_status, sum(n) AS units, arg_min(state, place) AS worst, sum(e) AS e, sum(c) AS c, sum(g) AS g FROM by_state GROUP BY conversation_id),
clicks AS (SELECT 'S' || (CAST(substr(author, 2) AS INTEGER) % 10) AS stream, text, author, row_number() OVER (PARTITION BY CAST(substr(author, 2) AS INTEGER) % 10 ORDER BY event_id) AS seq FROM msg),
each AS (SELECT 'units.jsonl' AS file, (conversation_id, coalesce(CAST(day AS VARCHAR), ''), unit_key, job_id) AS o, '{{"access_lost":' || access_lost || ',"collected":' || collected || ',"conversation_id":"' || conversation_id || '","day":' || coalesce('"' || day || '"', 'null') || ',"expected_count":' || coalesce(CAST(expected_count AS VARCHAR), 'null')
|| ',"file_gaps":' || file_gaps || ',"gap_reasons":[' || array_to_string(list_transform(gap_reasons, lambda x: '"' || x || '"'), ',') || '],"job_id":"' || job_id || '","kind":"' ||
  kind || '","recon_status":"' || recon_status || '","status":"' || status || '","unit_key":"' || unit_key || '"}}' AS line FROM units
  UNION ALL SELECT 'conversations.jsonl', (conversation_id, '', '', ''), '{{"by_status":{{' || by_status || '}},"collected":' || c || ',"conversation_id":"' || conversation_id || '","expected_count":' || e || ',"file_gaps":' || g || ',"units":' || units || ',"worst":"' || worst || '"}}' FROM roll
  UNION ALL SELECT 'observations.jsonl', (stream, lpad(CAST(seq AS VARCHAR), 12, '0'), '', ''), '{{"actor":"' || author || '","seq":' || seq || ',"stream":"' || stream || '"}}' FROM clicks WHERE text = 'click'
  UNION ALL SELECT 'renders.jsonl', (render_id, '', '', ''), '{{"conversation_id":"' || conversation_id || '","files":' || files || ',"natives":' || natives || ',"render_id":"' || render_id || '"}}' FROM renders),
lines AS (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY o) AS place FROM each)
{_SUMS}""")
def snk2(spark, sf):
    from ledgerlane.operators.reconcile import conversation_rollup

    u = V.reconciled(spark, sf)
    o = V.chain(spark, sf).filter("event_type = 'file_unavailable'").select("stream", "seq", "actor")
    r = V.msg(spark, sf).groupBy("conversation_id").agg(F.countDistinct("day").alias("files"), F.count_if(F.col("event_id") % 9 == 0).alias("natives"))
    r = r.withColumn("render_id", F.concat(F.lit("R"), "conversation_id"))
    return W.write_report_files(u, conversation_rollup(u), o, r, shared_folder(spark, "report"))


#: Events a package leaves out because they came after it was planned.
LATER = 2


def _stamp(unit_key):
    """A number of a unit that decides about its damage."""
    return F.substring(F.split_part(unit_key, F.lit("/"), F.lit(1)), 2, 9).cast("int") * 31 + F.substring(unit_key, -2, 2).cast("int")


def _write(spark, sf, b, pages, damaged: bool, path: str) -> None:
    """The package of _package as it is written: its events b, its pages."""
    hurt = lambda cond, bad, good: F.when(cond, bad).otherwise(good) if damaged else good
    s = F.col("seq")
    heads = b.select("stream", "seq", "event_hash").join(small(b.groupBy("stream").agg((F.max("seq") - LATER).alias("seq"))), ["stream", "seq"])
    heads = materialized(heads.withColumn("event_hash", hurt(F.col("stream") == "S3", F.lit("0"), F.col("event_hash"))))
    events = b.withColumn("fields", hurt(s % 97 == 0, F.concat("fields", F.lit(" ")), F.col("fields")))
    anchors = b.filter(s % 10 == 0).select("stream", "seq", hurt(s % 50 == 0, F.lit("0"), F.col("event_hash")).alias("event_hash"))

    n = _stamp(F.col("unit_key"))
    evidence = pages.select(
        F.col("unit_key").alias("evidence_id"), F.concat(F.lit("evidence/"), "unit_key").alias("storage_key"), F.lit("page").alias("kind"), F.lit("complete").alias("state"), "sha256", hurt(n % 13 == 0, F.lit("0"), F.col("sha256")).alias("source_sha256"), F.octet_length("value").cast("long").alias("size"),
        hurt(n % 11 == 0, F.lit(None).cast("string"), F.lit("v1")).alias("version_id"), hurt(n % 17 == 0, F.lit(1), F.lit(0)).cast("long").alias("shadow_versions"),
    )
    objects = pages.select("sha256", hurt(n % 23 == 0, F.concat("value", F.lit(" ")), F.col("value")).cast("binary").alias("content"), n.alias("n"))
    objects = objects.filter(F.col("n") % 19 != 0) if damaged else objects

    e, raw = F.col("event_id"), F.col("raw")
    place = F.row_number().over(Window.partitionBy("unit_key").orderBy("event_id")) - 1
    seq = V.chain(spark, sf).select("event_id", "stream", "seq")
    m = _raw(spark, sf).withColumn("i", place + hurt(e % 137 == 0, F.lit(1_000_000), F.lit(0))).join(seq, "event_id")
    subject = K.message_subject(F.lit("T0"), F.col("conversation_id"), F.col("raw.ts"))
    key = K.idempotency_key(F.lit("T0"), F.lit("chat"), subject, F.sha2("raw.text", 256))
    items = m.select(
        e.cast("string").alias("item_id"), "stream", "seq", hurt(e % 113 == 0, F.lit("0"), key).alias("idempotency_key"), F.lit("T0").alias("tenant_id"), F.lit("chat").alias("source"), subject.alias("subject"), F.sha2("raw.text", 256).alias("content_hash"),
        hurt(e % 139 == 0, F.lit("none"), F.col("unit_key")).alias("evidence_id"), F.concat(F.lit("evidence/"), "unit_key", hurt(e % 127 == 0, F.lit("x"), F.lit(""))).alias("storage_key"), K.json_path("messages", F.col("i")).alias("json_path"), hurt(e % 131 == 0, F.lit("0"), F.sha2(canonical_json(F.to_json(raw)), 256)).alias("raw_hash"),
    )
    W.write_package(events, items, evidence, anchors, heads, objects, path)


def _package(spark, sf, damaged: bool) -> str:
    """A package of the messages: each is an item of the event with its number, in the stored page of its unit. Damaged:
    every kind of fault, each in some places."""
    path = shared_folder(spark, "package")
    # hashed once, and kept until the package is written
    with scratch(_built(spark, sf)) as b, scratch(_pages(spark, sf).withColumn("sha256", F.sha2("value", 256))) as pages:
        _write(spark, sf, b, pages, damaged, path)
    if damaged:  # what happens to a package on its way: a line more, a file more, an object more, a file that was lost
        spark.createDataFrame([('{"event_hash":"0","seq":1,"stream":"S1"}',)], "value string").write.mode("append").text(f"{path}/anchors.jsonl")
        spark.createDataFrame([("note",)], "value string").write.text(f"{path}/notes.jsonl")
        spark.createDataFrame([("f" * 64, bytearray(b"stray"))], "sha256 string, content binary").write.mode("append").parquet(f"{path}/objects")
        spark.createDataFrame([("lost.jsonl", 1, 1, "0")], "file string, lines long, bytes long, sha256 string").write.mode("append").json(f"{path}/manifest.json")
    return path


_HEADS = f"heads AS (SELECT stream, max(seq) - {LATER} AS head FROM chain GROUP BY stream)"


@register("snk3_src7_package", f"""WITH RECURSIVE {HASHED}, {_HEADS}, lines AS (SELECT 'events.jsonl' AS file, '{{"event_hash":"' || event_hash || '","event_type":"' || event_type || '","fields":"' || replace(fields, '"', '\\"') || '","prev_hash":"' || prev_hash || '","seq":' || seq || ',"stream":"' || stream || '"}}' AS line, row_number() OVER (ORDER BY stream, seq) AS place
  FROM built JOIN heads USING (stream) WHERE seq <= head
  UNION ALL SELECT 'anchors.jsonl', '{{"event_hash":"' || event_hash || '","seq":' || seq || ',"stream":"' || stream || '"}}', row_number() OVER (ORDER BY stream, seq) FROM built JOIN heads USING (stream) WHERE seq <= head AND seq % 10 = 0),
own AS (SELECT event_id, unit_key FROM chain JOIN heads USING (stream) JOIN msg USING (event_id) WHERE seq <= head)
SELECT 'written' AS what, * FROM ({_SUMS}) UNION ALL SELECT 'rows', 'items', (SELECT count(*) FROM own), NULL, NULL UNION ALL SELECT 'rows', 'evidence', (SELECT count(DISTINCT unit_key) FROM own), NULL, NULL
UNION ALL SELECT 'rows', 'objects', (SELECT count(DISTINCT unit_key) FROM own), NULL, NULL UNION ALL SELECT 'rows', 'events', (SELECT sum(head) FROM heads), NULL, NULL UNION ALL SELECT 'rows', 'errors', 0, NULL, NULL""")
def snk3(spark, sf):
    """A package written and read back: the digests of what SQL can write too, the rows of each part, and no errors."""
    p = R.package(spark, _package(spark, sf, damaged=False))
    same = p["stated"].join(p["found"], ["file", "lines", "bytes", "sha256"]).filter("file in ('events.jsonl', 'anchors.jsonl')").select(F.lit("written").alias("what"), "file", "lines", "bytes", "sha256")
    for name in ("items", "evidence", "objects", "events"):
        same = same.unionByName(p[name].agg(F.count(F.lit(1)).alias("lines")).select(F.lit("rows").alias("what"), F.lit(name).alias("file"), "lines"), allowMissingColumns=True)
    errors = P.verify_package(p).agg(F.count(F.lit(1)).alias("lines")).select(F.lit("rows").alias("what"), F.lit("errors").alias("file"), "lines")
    return same.unionByName(errors, allowMissingColumns=True)


@register("prj6_unit_rows", f"WITH {V.UNITS} SELECT unit_key, CASE WHEN unit_key LIKE '%5' THEN 'matched' ELSE recon_status END AS recon_status, CASE WHEN unit_key LIKE '%5' THEN 'chain' ELSE 'database' END AS basis FROM units WHERE kind <> 'directory'")
def prj6(spark, sf):
    u = V.reconciled(spark, sf).filter("kind <> 'directory'").select("unit_key", "recon_status")
    f = u.filter(F.col("unit_key").endswith("5")).withColumn("recon_status", F.lit("matched"))
    return P.unit_rows(u, f, "unit_key", ["recon_status"])


@register("mrk10_verify_package", f"""WITH {V.CHAIN}, {_HEADS}, own AS (SELECT c.stream, c.seq, m.event_id, m.unit_key, CAST(split_part(substr(m.unit_key, 2), '/', 1) AS INTEGER) * 31 + CAST(right(m.unit_key, 2) AS INTEGER) AS n FROM chain c JOIN heads h ON h.stream = c.stream AND c.seq <= h.head JOIN msg m USING (event_id)),
ev AS (SELECT DISTINCT unit_key, n FROM own WHERE event_id % 139 <> 0), i AS (SELECT *, event_id % 139 <> 0 AS there, n % 19 <> 0 AS stored, event_id % 137 <> 0 AS found FROM own)
SELECT 'events' AS file, stream || '/' || seq AS what, 'altered' AS error FROM own WHERE seq % 97 = 0 UNION ALL SELECT 'anchors', stream || '/' || seq, 'anchor_differs' FROM own WHERE seq % 50 = 0 UNION ALL SELECT 'anchors', 'S1/1', 'anchor_differs' UNION ALL SELECT 'heads', 'S3', 'head_differs'
UNION ALL SELECT 'manifest', 'anchors.jsonl', 'altered' UNION ALL SELECT 'manifest', 'anchors.jsonl', 'wrong_lines' UNION ALL SELECT 'manifest', 'notes.jsonl', 'unlisted' UNION ALL SELECT 'manifest', 'lost.jsonl', 'missing' UNION ALL SELECT 'objects', repeat('f', 64), 'not_an_object'
UNION ALL SELECT 'evidence', 'evidence/' || unit_key, 'not_pinned' FROM ev WHERE n % 11 = 0 UNION ALL SELECT 'evidence', 'evidence/' || unit_key, 'source_differs' FROM ev WHERE n % 13 = 0 UNION ALL SELECT 'evidence', 'evidence/' || unit_key, 'storage_incident' FROM ev WHERE n % 17 = 0
UNION ALL SELECT 'evidence', 'evidence/' || unit_key, 'bytes_missing' FROM ev WHERE n % 19 = 0 UNION ALL SELECT 'evidence', 'evidence/' || unit_key, 'bytes_differ' FROM ev WHERE n % 23 = 0 AND n % 19 <> 0
UNION ALL SELECT 'items', CAST(event_id AS VARCHAR), 'wrong_key' FROM i WHERE event_id % 113 = 0 UNION ALL SELECT 'items', CAST(event_id AS VARCHAR), 'evidence_missing' FROM i WHERE NOT there UNION ALL SELECT 'items', CAST(event_id AS VARCHAR), 'storage_key_differs' FROM i WHERE there AND event_id % 127 = 0
UNION ALL SELECT 'items', CAST(event_id AS VARCHAR), 'path_unresolved' FROM i WHERE there AND stored AND NOT found UNION ALL SELECT 'items', CAST(event_id AS VARCHAR), 'fragment_differs' FROM i WHERE there AND stored AND found AND event_id % 131 = 0""")
def mrk10(spark, sf):
    """A package with faults of every kind, as it was written and read back."""
    return P.verify_package(R.package(spark, _package(spark, sf, damaged=True)))


def _job_chain(spark, sf):
    """A chain for each job of the units view: its start, pauses, a fact of each unit, some a second time and otherwise, its end."""
    u = V.reconciled(spark, sf)
    k = F.col("collected")
    start, end = F.lit("A0"), F.lit("job_finished")
    fact = lambda collected: F.to_json(F.struct("unit_key", "kind", "conversation_id", F.col("day").cast("string").alias("day"), "recon_status", "expected_count", collected.alias("collected"), "file_gaps"))
    row = lambda where, o1, o2, o3, kind, actor, payload: where.select(F.col("job_id").alias("stream"), F.lit(o1).alias("o1"), o2.alias("o2"), F.lit(o3).alias("o3"), kind.alias("event_type"), actor.alias("actor"), payload.alias("payload"))
    jobs, key, none = u.select("job_id").distinct(), F.col("unit_key"), F.lit("{}")
    settled = F.when(F.col("status") == "failed", "unit_failed").otherwise("unit_reconciled")
    rows = row(jobs, 0, F.lit(""), 0, F.lit("job_started"), start, none).unionByName(row(jobs, 2, F.lit(""), 0, end, start, none))
    for part in (
        row(u.filter(k % 11 == 0), 1, key, -1, F.lit("job_paused"), F.lit("A1"), none), row(u, 1, key, 0, settled, F.concat(F.lit("A"), (k % 3).cast("string")), fact(k)),
        row(u.filter(k % 7 == 0), 1, key, 1, F.lit("unit_reconciled"), F.lit("A2"), fact(k + 100)), row(u.filter(k % 5 == 0), 1, key, 2, F.lit("job_resumed"), F.lit("A1"), none),
    ):
        rows = rows.unionByName(part)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("stream").orderBy("o1", "o2", "o3")).cast("long"))
    return rows.select("stream", "seq", "event_type", "actor", "payload", F.timestamp_seconds(1_700_000_000 + F.col("seq")).alias("at"))


#: The job chains of _job_chain.
_JOB_EVENTS = """job_events AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY o1, o2, o3) AS seq FROM (SELECT DISTINCT job_id AS stream, 0 AS o1, '' AS o2, 0 AS o3, 'job_started' AS event_type, 'A0' AS actor, NULL AS outcome FROM units UNION ALL SELECT DISTINCT job_id, 2, '', 0, 'job_finished', 'A0', NULL FROM units
  UNION ALL SELECT job_id, 1, unit_key, -1, 'job_paused', 'A1', NULL FROM units WHERE collected % 11 = 0 UNION ALL SELECT job_id, 1, unit_key, 0, CASE WHEN status = 'failed' THEN 'unit_failed' ELSE 'unit_reconciled' END, 'A' || collected % 3, recon_status FROM units
  UNION ALL SELECT job_id, 1, unit_key, 1, 'unit_reconciled', 'A2', recon_status FROM units WHERE collected % 7 = 0 UNION ALL SELECT job_id, 1, unit_key, 2, 'job_resumed', 'A1', NULL FROM units WHERE collected % 5 = 0))"""

#: Exceptions that a report lists of each job.
_CAP = 5

_SECTIONS_SQL = f"""WITH {V.UNITS}, {_JOB_EVENTS},
side AS (SELECT 'a' AS side, job_id AS stream, unit_key, kind, conversation_id, CAST(day AS VARCHAR) AS day, status, recon_status, expected_count, collected, file_gaps FROM units
  UNION ALL SELECT 'b', job_id, unit_key, kind, conversation_id, CAST(day AS VARCHAR), status, CASE WHEN collected % 19 = 0 THEN 'matched' ELSE recon_status END, expected_count, collected + CASE WHEN collected % 10 = 3 THEN 1 ELSE 0 END, file_gaps FROM units WHERE collected % 23 <> 0 OR kind = 'directory'
  UNION ALL SELECT 'b', 'J1', 'C99/2024-01-01', 'conversation_day', 'C99', '2024-01-01', 'done', 'gap', 9, 8, 0),
named AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' ELSE recon_status END AS state FROM side),
placed AS (SELECT *, coalesce(list_position(['failed', 'access_lost', 'gap', 'surplus', 'unverifiable', 'matched_against_archive', 'pending', 'matched', 'not_applicable'], state), 10) - 1 AS place FROM named),
states AS (SELECT side, stream, conversation_id, state, place, count(*) AS n, sum(coalesce(expected_count, 0)) AS e, sum(collected) AS c, sum(file_gaps) AS g FROM placed WHERE kind <> 'directory' GROUP BY ALL),
bad AS (SELECT *, row_number() OVER (PARTITION BY side, stream ORDER BY place, conversation_id, coalesce(day, ''), unit_key) AS nth, count(*) OVER (PARTITION BY side, stream) AS total FROM placed WHERE place < 5),
ends AS (SELECT p.stream, p.seq, (SELECT min(e.seq) FROM job_events e WHERE e.stream = p.stream AND e.seq > p.seq AND e.event_type = 'job_resumed') AS stop FROM job_events p WHERE p.event_type = 'job_paused'),
sides AS (SELECT 'a' AS side UNION ALL SELECT 'b'), jobs AS (SELECT DISTINCT side, stream FROM side),
cells AS (
  SELECT side, 'units' AS section, stream, unit_key AS name, unnest([('kind', kind), ('conversation_id', conversation_id), ('day', day), ('status', status), ('recon_status', recon_status), ('expected_count', CAST(expected_count AS VARCHAR)), ('collected', CAST(collected AS VARCHAR)), ('file_gaps', CAST(file_gaps AS VARCHAR))]) AS f FROM side
  UNION ALL SELECT side, 'units_by_status', stream, s, ('n', CAST((SELECT count(*) FROM side x WHERE x.side = jobs.side AND x.stream = jobs.stream AND x.status = s) AS VARCHAR)) FROM jobs, (SELECT unnest(['pending', 'running', 'done', 'failed', 'retry_later', 'paused']) AS s)
  UNION ALL SELECT side, 'units_by_recon_status', stream, s, ('n', CAST((SELECT count(*) FROM side x WHERE x.side = jobs.side AND x.stream = jobs.stream AND x.kind <> 'directory' AND x.recon_status = s) AS VARCHAR)) FROM jobs, (SELECT unnest(['pending', 'matched', 'gap', 'surplus', 'unverifiable', 'failed', 'access_lost', 'not_applicable', 'matched_against_archive']) AS s)
  UNION ALL SELECT side, 'totals', stream, 'expected_count', ('n', CAST(CAST(sum(expected_count) AS BIGINT) AS VARCHAR)) FROM side GROUP BY side, stream UNION ALL SELECT side, 'totals', stream, 'collected', ('n', CAST(CAST(sum(collected) AS BIGINT) AS VARCHAR)) FROM side GROUP BY side, stream UNION ALL SELECT side, 'totals', stream, 'file_gaps', ('n', CAST(CAST(sum(file_gaps) AS BIGINT) AS VARCHAR)) FROM side GROUP BY side, stream
  UNION ALL SELECT side, 'exceptions', stream, CAST(nth AS VARCHAR), unnest([('unit_key', unit_key), ('state', state)]) FROM bad WHERE nth <= {_CAP} UNION ALL SELECT DISTINCT side, 'exceptions_total', stream, 'all', ('n', CAST(total AS VARCHAR)) FROM bad
  UNION ALL SELECT side, 'conversations', stream, conversation_id, unnest([('units', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR)), ('worst', arg_min(state, place)), ('by_status', string_agg(state || '=' || n, ',' ORDER BY state)), ('expected_count', CAST(CAST(sum(e) AS BIGINT) AS VARCHAR)), ('collected', CAST(CAST(sum(c) AS BIGINT) AS VARCHAR)), ('file_gaps', CAST(CAST(sum(g) AS BIGINT) AS VARCHAR))]) FROM states GROUP BY side, stream, conversation_id
  UNION ALL SELECT side, 'pauses', stream, CAST(seq AS VARCHAR), unnest([('resumed_ms', CAST((stop - seq) * 1000 + CASE WHEN side = 'b' AND seq % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR)), ('ended_how', CASE WHEN stop IS NULL THEN 'not_ended' ELSE 'job_resumed' END)]) FROM ends, sides
  UNION ALL SELECT side, 'actors', stream, event_type || '/' || actor, ('n', CAST(count(*) AS VARCHAR)) FROM job_events, sides WHERE side = 'a' OR actor <> 'A2' GROUP BY ALL
  UNION ALL SELECT 'a', 'verdict', stream, 'clean', ('clean', CASE WHEN count(*) FILTER (WHERE kind = 'conversation_day' AND place < 5) = 0 THEN 'true' ELSE 'false' END) FROM placed WHERE side = 'a' GROUP BY stream UNION ALL SELECT DISTINCT 'b', 'verdict', stream, 'clean', ('clean', 'true') FROM side),
rows_of AS (SELECT DISTINCT side, section, stream, name FROM cells), one AS (SELECT section, stream, name FROM rows_of GROUP BY ALL HAVING count(*) = 1)"""


@register("mrk11_recompute", f"""{_SECTIONS_SQL}
SELECT a.section, a.stream, a.name, a.f[1] AS field, a.f[2] AS recomputed, b.f[2] AS stated FROM cells a JOIN cells b ON a.side = 'a' AND b.side = 'b' AND a.section = b.section AND a.stream = b.stream AND a.name = b.name AND a.f[1] = b.f[1] WHERE a.f[2] IS DISTINCT FROM b.f[2] AND NOT (a.section = 'verdict' AND a.f[2] = 'true')
UNION ALL SELECT o.section, o.stream, o.name, 'row', CASE WHEN r.side = 'a' THEN 'there' ELSE 'missing' END, CASE WHEN r.side = 'a' THEN 'missing' ELSE 'there' END FROM one o JOIN rows_of r USING (section, stream, name)""")
def mrk11(spark, sf):
    """The chain of each job against a report whose units, pauses, actors and verdict are partly wrong."""
    events = materialized(_job_chain(spark, sf))
    n = F.col("collected")
    u = V.reconciled(spark, sf).select(F.col("job_id").alias("stream"), "unit_key", "kind", "conversation_id", F.col("day").cast("string").alias("day"), "status", "recon_status", "expected_count", "collected", "file_gaps").filter((n % 23 != 0) | (F.col("kind") == "directory"))
    u = u.withColumn("recon_status", F.when(n % 19 == 0, "matched").otherwise(F.col("recon_status"))).withColumn("collected", n + F.when(n % 10 == 3, 1).otherwise(0))
    ghost = spark.createDataFrame([("J1", "C99/2024-01-01", "conversation_day", "C99", "2024-01-01", "done", "gap", 9, 8, 0)], u.schema)
    stated = Q.unit_sections(u.unionByName(ghost), _CAP) | Q.job_sections(events.filter("actor <> 'A2'"), u)
    pauses = Q.job_sections(events, u)["pauses"]
    stated["pauses"] = pauses.withColumn("resumed_ms", F.col("resumed_ms") + F.when(F.col("name").cast("long") % 2 == 0, 1).otherwise(0))
    stated["verdict"] = u.select("stream", F.lit("clean").alias("name"), F.lit(True).alias("clean")).distinct()
    return Q.recompute(events, stated, _CAP)


@register("mrk11_sections", f"""{_SECTIONS_SQL} SELECT section, stream, name, f[1] AS field, f[2] AS value FROM cells WHERE side = 'a'""")
def mrk11b(spark, sf):
    """Every section that the chains give, as cells."""
    out = None
    for section, rows in Q.report_sections(materialized(_job_chain(spark, sf)), _CAP).items():
        fields = F.explode(F.create_map(*[x for c in Q.SECTIONS[section] for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value")
        cells = rows.select(F.lit(section).alias("section"), "stream", "name", fields)
        out = cells if out is None else out.unionByName(cells)
    return out


@register("agg24_outcomes", f"WITH {V.UNITS}, {_JOB_EVENTS} SELECT stream, outcome, count(*) AS n, (SELECT count(*) FROM job_events e WHERE e.stream = j.stream) AS events FROM job_events j WHERE outcome IS NOT NULL GROUP BY ALL")
def agg24b(spark, sf):
    """AGG-24 with the outcomes that its events state."""
    events = _job_chain(spark, sf)
    stated = F.when(F.col("event_type").isin(*Q.SETTLED), F.get_json_object("payload", "$.recon_status"))
    fold = C.chain_fold(events, Q.STARTED, (Q.FINISHED,), Q.STOPS, "items_collected", outcome=stated)
    return fold.select("stream", F.explode("outcomes").alias("outcome", "n"), "events")


@register("agg25_chain_verdict", f"""WITH {V.UNITS}, {_JOB_EVENTS}, bad AS (SELECT job_id AS stream, CASE WHEN status = 'failed' THEN 'failed' ELSE recon_status END AS what, count(*) AS n FROM units WHERE kind = 'conversation_day' AND (status = 'failed' OR recon_status IN ('gap', 'surplus', 'access_lost', 'unverifiable')) GROUP BY ALL),
f AS (SELECT stream, count(*) FILTER (WHERE event_type = 'job_started') + CASE WHEN stream = 'J1' THEN 1 ELSE 0 END AS st, count(*) FILTER (WHERE event_type = 'job_finished') - CASE WHEN stream = 'J2' THEN 1 ELSE 0 END AS fi, CASE WHEN stream = 'J3' THEN 2 ELSE 0 END AS sp FROM job_events GROUP BY stream)
SELECT stream, array_to_string(list_concat(list_filter([CASE WHEN st <> 1 THEN 'not exactly one start' END, CASE WHEN fi <> 1 THEN 'not exactly one final event' END, CASE WHEN sp > 0 THEN sp || ' stop(s) recorded' END], lambda x: x IS NOT NULL), coalesce((SELECT list(n || ' unit(s) ' || what ORDER BY n || ' unit(s) ' || what) FROM bad WHERE bad.stream = f.stream), [])), '; ') AS reasons FROM f""")
def agg25(spark, sf):
    """Whole job chains; one was started twice, one has no end, one was stopped."""
    events = _job_chain(spark, sf).filter("not (stream = 'J2' and event_type = 'job_finished')")
    more = lambda name, kind, n: events.filter(f"stream = '{name}' and event_type = 'job_started'").withColumn("event_type", F.lit(kind)).withColumn("seq", F.col("seq") + 1_000_000 + n)
    events = materialized(events.unionByName(more("J1", "job_started", 0)).unionByName(more("J3", "cancel_requested", 0)).unionByName(more("J3", "job_failed", 1)))
    units = Q.unit_facts(events).filter("kind = 'conversation_day'").withColumn("what", F.when(F.col("status") == "failed", "failed").otherwise(F.col("recon_status"))).filter(F.col("what").isin(*Q.UNCLEAN))
    fold = C.chain_fold(events, Q.STARTED, (Q.FINISHED,), Q.STOPS, "items_collected")
    verdict = C.chain_verdict(fold, units.groupBy("stream", "what").agg(F.count(F.lit(1)).cast("string").alias("n")), Q.FINISHED)
    return verdict.select("stream", F.array_join("reasons", "; ").alias("reasons"))


@register("jon24_batch_leftovers", f"WITH {V.MSG} SELECT unit_key, CASE WHEN count(*) % 6 = 0 THEN 'items_missing' ELSE 'unknown_batch' END AS error FROM msg GROUP BY 1 HAVING count(*) % 6 = 0 OR count(*) % 6 = 5")
def jon24(spark, sf):
    n = V.msg(spark, sf).groupBy("unit_key").agg(F.count(F.lit(1)).alias("item_count")).withColumn("root", F.lit("r"))
    return C.verify_batches(n.filter("item_count % 6 <> 5"), n.filter("item_count % 6 <> 0"), "unit_key")


_ITEM_KEY = "sha256('T0' || chr(31) || 'chat' || chr(31) || unit_key || chr(31) || sha256(text))"

#: Messages of a page.
PAGE = 6


def _unit_pages(spark, sf):
    """Pages of each unit with their cursors; an item is a text in a conversation, so it comes in many pages. Some
    units bring a page again, from a cursor that isn't theirs, or skip one."""
    m = V.msg(spark, sf)
    key = K.idempotency_key(F.lit("T0"), F.lit("chat"), F.col("conversation_id"), F.sha2("text", 256))
    n = F.row_number().over(Window.partitionBy("unit_key").orderBy("event_id")) - 1
    rows = m.select("unit_key", F.floor(n / PAGE).alias("pages_before"), F.struct(F.col("conversation_id").alias("subject"), F.sha2("text", 256).alias("content_hash"), key.alias("idempotency_key")).alias("i"))
    p = rows.groupBy("unit_key", "pages_before").agg(F.array_sort(F.collect_list("i")).alias("items"))
    cursor = lambda at: F.when(at > 0, F.concat(F.lit("c"), at.cast("string"))).otherwise("")
    at = F.col("pages_before")
    p = p.select("unit_key", "pages_before", cursor(at).alias("cursor_before"), cursor(at + 1).alias("next_cursor"), "items")
    other = F.array(F.struct(F.lit("x").alias("subject"), F.lit("0" * 64).alias("content_hash"), F.sha2("unit_key", 256).alias("idempotency_key")))
    stale = p.filter(at == 0).withColumn("items", other).withColumn("cursor_before", F.lit("c9"))
    early = p.filter(at == 0).withColumn("items", other).withColumn("pages_before", F.lit(1000).cast("long"))
    return p.unionByName(stale).unionByName(early)


@register("stm1_exactly_once_ingest", f"""WITH {V.MSG}, k AS (SELECT unit_key, event_id, sha256('T0' || chr(31) || 'chat' || chr(31) || conversation_id || chr(31) || sha256(text)) AS key, (row_number() OVER (PARTITION BY unit_key ORDER BY event_id) - 1) // {PAGE} AS page FROM msg),
f AS (SELECT unit_key, key, min(page) AS page FROM k GROUP BY ALL), p AS (SELECT DISTINCT unit_key, page FROM k)
SELECT 'items' AS what, key AS name, 1 AS n, 1 AS commits FROM k GROUP BY key UNION ALL SELECT 'links', unit_key || '/' || key, 1, 1 FROM f
UNION ALL SELECT 'events', p.unit_key || '/' || (p.page + 1), (SELECT count(*) FROM f WHERE f.unit_key = p.unit_key AND f.page = p.page), 1 FROM p UNION ALL SELECT 'units', unit_key || '/c' || (max(page) + 1), max(page) + 1, 1 FROM p GROUP BY unit_key""")
def stm1(spark, sf):
    """Pages ingested in several triggers, and all of them once more from a new checkpoint into the same tables."""
    out = shared_folder(spark, "ingest")
    path, n = _log(spark, _unit_pages(spark, sf), ["pages_before", "unit_key", "cursor_before"], "pages")
    for run in (1, 2):
        pages = custody_tail(spark, path, seq="place", max_events=-(-n // TRIGGERS)).drop("place")
        J.ingest(pages, f"{out}/tables", f"{out}/checkpoint{run}", to_head=True)
    t = {name: J.committed(spark, f"{out}/tables", name) for name in J.TABLES}
    counted = lambda what, rows, name, n: rows.groupBy(F.lit(what).alias("what"), name.alias("name")).agg(F.max(n).cast("long").alias("n"), F.count(F.lit(1)).alias("commits"))
    last = t["checkpoints"].groupBy("unit_key").agg(F.max("pages_done").alias("pages_done"), F.max_by("cursor", "pages_done").alias("cursor"))
    return (
        counted("items", t["items"], F.col("idempotency_key"), F.lit(1)).unionByName(counted("links", t["links"], F.concat_ws("/", "unit_key", "idempotency_key"), F.lit(1)))
        .unionByName(counted("events", t["events"], F.concat_ws("/", "unit_key", F.col("pages_done").cast("string")), F.col("item_count"))).unionByName(counted("units", last, F.concat_ws("/", "unit_key", "cursor"), F.col("pages_done")))
    )


def _collected(spark, stream, name, mode="append", conf=None, to_head=False):
    out = shared_folder(spark, name)
    J.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint", mode, conf, to_head)
    return spark.read.parquet(f"{out}/rows").drop("batch")


def _log(spark, rows, order, name):
    """rows as a stored log, with their place in the order as ``place``, and how many there are."""
    path = f"{shared_folder(spark, name)}/log"
    unit_order(rows, [F.col(c) for c in order]).write.parquet(path)
    return path, spark.read.parquet(path).count()


#: Triggers in which the stream queries read their table.
TRIGGERS = 4


@register("stm5_stateful_versions", EVENTS_SEEN)
def stm5(spark, sf):
    """The sightings as a log, followed in several triggers."""
    path, n = _log(spark, V.versions(spark, sf).drop("hint"), ["at", "seq"], "sightings")
    stream = custody_tail(spark, path, seq="place", max_events=-(-n // TRIGGERS)).drop("place")
    return _collected(spark, J.stateful_versions(stream), "versions", conf=J.ON_DISK, to_head=True)


@register("src9_custody_tail", f"WITH {V.CHAIN}, h AS (SELECT max(seq) AS head FROM chain WHERE stream = 'S3') SELECT seq, event_type, actor, head, true AS after_earlier_triggers FROM chain, h WHERE stream = 'S3' AND seq > 10")
def src9(spark, sf):
    """One stream's log from a cursor: half of it is there at first, then the query is started again where it was."""
    own = materialized(V.chain(spark, sf).filter("stream = 'S3'").select("seq", "event_type", "actor"))
    head = own.agg(F.max("seq")).first()[0]
    path, out = shared_folder(spark, "tail"), shared_folder(spark, "tailed")
    for half in (own.filter(F.col("seq") * 2 <= head), own.filter(F.col("seq") * 2 > head)):
        half.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.mode("append").parquet(path)
        stream = custody_tail(spark, path, after=10, max_events=-(-head // TRIGGERS))
        J.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint", to_head=True)
    rows = spark.read.parquet(f"{out}/rows")
    ends = rows.groupBy("batch").agg(F.max("seq").alias("end"), F.min("seq").alias("begin"))  # a row a trigger
    ends = ends.withColumn("before", F.coalesce(F.max("end").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(10)))
    return rows.join(F.broadcast(ends), "batch").select("seq", "event_type", "actor", F.lit(head).alias("head"), ((F.col("begin") == F.col("before") + 1) & (F.col("seq") > F.col("before"))).alias("after_earlier_triggers"))


@register("stm4_access_stream", f"""WITH {V.MSG}, l AS (SELECT *, k < 10 AS lost, coalesce(lag(k < 10) OVER (PARTITION BY conversation_id ORDER BY event_id), false) AS before FROM msg) SELECT conversation_id AS key,
  event_id AS seq, CASE WHEN lost THEN 'access_lost' ELSE 'access_restored' END AS event FROM l WHERE lost <> before""")
def stm4s(spark, sf):
    m = V.msg(spark, sf)
    path, n = _log(spark, m.select(F.col("conversation_id").alias("key"), F.when(F.col("k") < 10, "lost").otherwise("held").alias("state"), F.col("event_id").alias("seq")), ["seq"], "pages_seen")
    rows = custody_tail(spark, path, seq="place", max_events=-(-n // TRIGGERS)).drop("place")
    return _collected(spark, J.observation_machine(rows, "held", {"lost": "access_lost", "held": "access_restored"}), "access", to_head=True).select("key", "event", "seq")


_PLACED = f"{V.VERSIONS}, placed AS (SELECT *, row_number() OVER (ORDER BY moment, seq) AS place FROM versions)"


def _machine(spark, sf, state, initial, events, name):
    """A state machine per subject over the log of sightings, in several triggers."""
    path, n = _log(spark, V.versions(spark, sf).select("subject", "content_hash", "hint", "at", "seq"), ["at", "seq"], name)
    rows = custody_tail(spark, path, seq="place", max_events=-(-n // TRIGGERS)).select(F.col("subject").cast("string").alias("key"), state.alias("state"), F.col("place").alias("seq"))
    return _collected(spark, J.observation_machine(rows, initial, events), name, conf=J.ON_DISK, to_head=True)


@register("stm2_absence_stream", f"""WITH {_PLACED}, l AS (SELECT *, hint <> 'F' AS present, coalesce(lag(hint <> 'F') OVER (PARTITION BY subject ORDER BY place), true) AS before FROM placed)
SELECT CAST(subject AS VARCHAR) AS key, place AS seq, CASE WHEN present THEN 'observed_again' ELSE 'no_longer_observed' END AS event, row_number() OVER (PARTITION BY subject ORDER BY place) AS occurrence FROM l WHERE present <> before""")
def stm2s(spark, sf):
    out = _machine(spark, sf, F.when(F.col("hint") != "F", "seen").otherwise("absent"), "seen", {"seen": "observed_again", "absent": "no_longer_observed"}, "absence")
    return out.select("key", "seq", "event", "occurrence")


@register("stm3_availability_stream", f"""WITH {_PLACED}, l AS (SELECT *, CASE WHEN content_hash IN ('1-URGENT', '2-HIGH') THEN content_hash ELSE '' END AS r FROM placed), b AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY subject ORDER BY place), '') AS before FROM l)
SELECT CAST(subject AS VARCHAR) AS key, place AS seq, r AS reason, CASE WHEN r = '' THEN 'file_became_available' ELSE 'file_unavailable' END AS event, row_number() OVER (PARTITION BY subject ORDER BY place) AS occurrence FROM b WHERE r <> before""")
def stm3s(spark, sf):
    refused = F.when(F.col("content_hash").isin("1-URGENT", "2-HIGH"), F.col("content_hash")).otherwise("")
    return _machine(spark, sf, refused, "", {"": "file_became_available", "*": "file_unavailable"}, "availability").select("key", "seq", F.col("state").alias("reason"), "event", "occurrence")


@register("stm6_reaction_stream", f"""WITH {V.MSG}, l AS (SELECT *, k % 4 = 0 AS has, bool_or(k % 4 = 0) OVER (PARTITION BY author ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM msg
  WHERE text <> 'error') SELECT author AS key, event_id AS seq, has FROM l WHERE has OR coalesce(before, false)""")
def stm6s(spark, sf):
    m = V.msg(spark, sf)
    path, n = _log(spark, m.select(F.col("author").alias("key"), (F.col("k") % 4 == 0).alias("has"), (F.col("text") == "error").alias("deleted"), F.col("event_id").alias("seq")), ["seq"], "reactions")
    rows = custody_tail(spark, path, seq="place", max_events=-(-n // TRIGGERS)).drop("place")
    return _collected(spark, J.reaction_stream(rows), "reactions", conf=J.ON_DISK, to_head=True).select("key", "seq", "has")


@register("stm9_streaming_dedupe", f"WITH {V.MSG} SELECT DISTINCT unit_key, text FROM msg")
def stm9(spark, sf):
    e = R.table_stream(spark, f"{sf}/events.parquet", files_per_batch=1)
    conv = F.concat(F.lit("C"), (F.col("user_id") % 20).cast("string"))
    rows = e.select(K.unit_key(conv, F.to_date("ts")).alias("unit_key"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("at"))
    rows = rows.withColumn("key", F.concat_ws("/", "unit_key", "text"))
    return _collected(spark, J.deduplicated(rows, "key", "at", "60 days"), "dedupe").select("unit_key", "text")


@register("stm7_job_feed", f"""WITH {V.UNITS}, {_JOB_EVENTS}, h AS (SELECT stream, max(seq) AS head FROM job_events GROUP BY stream)
SELECT e.stream, u.status, count(*) AS n, max(e.seq) AS last_seq, any_value(h.head) AS head FROM job_events e JOIN units u ON u.job_id = e.stream AND u.unit_key = e.o2 JOIN h ON h.stream = e.stream WHERE e.event_type IN ('unit_reconciled', 'unit_failed') GROUP BY e.stream, u.status""")
def stm7(spark, sf):
    """Counts of settled units, the last seq of each and the heads, from what several triggers moved."""
    units = V.units(spark, sf).select(F.col("job_id").alias("stream"), "unit_key", "status")
    return J.feed_snapshot(_fed(spark, sf, lambda e: J.job_feed(e, units, Q.SETTLED), "update"))


def _fed(spark, sf, of, mode):
    """What a stream over the job chains' log gives, with the trigger that gave it."""
    events = _job_chain(spark, sf).withColumn("unit_key", F.get_json_object("payload", "$.unit_key")).select("stream", "seq", "event_type", "unit_key")
    path, n = _log(spark, events, ["seq", "stream"], "job_log")
    out = shared_folder(spark, "feed")
    stream = of(custody_tail(spark, path, seq="place", max_events=-(-n // TRIGGERS)).drop("place"))
    J.run_available(stream, lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={k}"), f"{out}/checkpoint", mode, to_head=True)
    return spark.read.parquet(f"{out}/rows")


@register("stm7_settled_since", f"WITH {V.UNITS}, {_JOB_EVENTS} SELECT e.stream, e.seq, e.o2 AS unit_key, u.status, u.recon_status, u.collected FROM job_events e JOIN units u ON u.job_id = e.stream AND u.unit_key = e.o2 WHERE e.event_type IN ('unit_reconciled', 'unit_failed') AND e.seq > 20")
def stm7b(spark, sf):
    """The feed's rows since a seq, as they come."""
    units = V.reconciled(spark, sf).select(F.col("job_id").alias("stream"), "unit_key", "status", "recon_status", "collected")
    return _fed(spark, sf, lambda e: J.settled_since(e, units, Q.SETTLED, 20), "append").drop("batch")


@register("sink_append_new", f"WITH {V.MSG} SELECT unit_key AS idempotency_key FROM msg GROUP BY 1 HAVING min(event_id % 20) > 0")
def append_new(spark, sf):
    """SNK-5 on a table: the second append adds what the first didn't hold."""
    m = V.msg(spark, sf).select(F.col("unit_key").alias("idempotency_key"), "event_id")
    path = f"{shared_folder(spark, 'items')}/table"
    W.append_new(m.filter("event_id % 20 = 0"), path)
    return W.append_new(m, path).select("idempotency_key")


@register("snk5_derivations", f"""WITH {V.MSG}, k AS (SELECT event_id, {_ITEM_KEY} AS key FROM msg), one AS (SELECT DISTINCT key FROM k WHERE event_id % 2 = 0), two AS (SELECT DISTINCT key FROM k)
SELECT 1 AS run, (SELECT count(*) FROM one) AS inserted, 0 AS existing, (SELECT count(*) FROM one) AS derivations_inserted UNION ALL SELECT 2, (SELECT count(*) FROM two) - (SELECT count(*) FROM one), (SELECT count(*) FROM one), (SELECT count(*) FROM two) - (SELECT count(*) FROM one)
UNION ALL SELECT 3, 0, (SELECT count(*) FROM two), (SELECT count(*) FROM two)""")
def snk5d(spark, sf):
    """Half of the items, then all of them, then all with a newer normalizer."""
    m = V.msg(spark, sf)
    key = K.idempotency_key(F.lit("T0"), F.lit("chat"), F.col("unit_key"), F.sha2("text", 256))
    items = m.select("event_id", key.alias("idempotency_key"), F.col("unit_key").alias("subject"), F.sha2("text", 256).alias("content_hash"), F.lit("{}").alias("derived"))
    path, out = shared_folder(spark, "persisted"), None
    for run, rows, version in ((1, items.filter("event_id % 2 = 0"), "1.0"), (2, items, "1.0"), (3, items, "1.1")):
        done = W.persist(rows.withColumn("normalizer_version", F.lit(version)), path).select(F.lit(run).alias("run"), "*")
        out = done if out is None else out.unionByName(done)
    return out


@register("scl6_json_paths", """SELECT event_id, '$.m["a b"][' || (event_id % 3) || ']' AS path, 3 AS steps, event_type || (event_id % 3) AS found, NULL::VARCHAR AS missing, false AS valid FROM events""")
def scl6(spark, sf):
    """A path built, taken apart and resolved in a document; one that leads nowhere; and text that is no path."""
    e = V.read(spark, sf, "events")
    i = (F.col("event_id") % 3).cast("int")
    doc = F.to_json(F.struct(F.create_map(F.lit("a b"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.concat("event_type", n.cast("string")))).alias("m")))
    path = K.json_path("m", "a b", i)
    return e.select("event_id", path.alias("path"), F.size(K.path_steps(path)).alias("steps"), K.resolve(doc, path).alias("found"), K.resolve(doc, F.concat(path, F.lit(".x"))).alias("missing"), K.path_steps(F.concat(path, F.lit("]"))).isNotNull().alias("valid"))


@register("jon18_latest_items", f"WITH {V.VERSIONS}, f AS (SELECT subject, content_hash, min((moment, seq)) AS first FROM versions GROUP BY ALL) SELECT subject, arg_max(content_hash, first) AS content_hash, count(*) AS versions FROM f GROUP BY subject")
def latest_items(spark, sf):
    v = X.assign_versions(V.versions(spark, sf), "subject", "content_hash", ["at", "seq"])
    return v.groupBy("subject").agg(F.max_by("content_hash", "version").alias("content_hash"), F.count(F.lit(1)).alias("versions"))


@register("udf1_canonical_json", "SELECT event_id, '{\"a\":\"' || event_type || '\",\"k\":' || regexp_extract(props, '\"k\": (\\d+)', 1) || '}' AS canonical FROM events")
def udf1(spark, sf):
    from ledgerlane.functions.canonical import canonical_json

    raw = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(' ,  "a" : "'), "event_type", F.lit('" }'))
    return V.read(spark, sf, "events").select("event_id", canonical_json(raw).alias("canonical"))
