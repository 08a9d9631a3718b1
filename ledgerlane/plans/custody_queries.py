"""Queries of versions, digests, Merkle trees and hash chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.operators import custody as C
from ledgerlane.operators import digest as D
from ledgerlane.operators import merkle as M
from ledgerlane.operators import sightings as Y
from ledgerlane.operators import versions as X
from ledgerlane.operators.registry import register
from ledgerlane.plans import views as V
from ledgerlane.plans.shared import materialized

_FIRST = V.VERSIONS + ", firsts AS (SELECT *, row_number() OVER (PARTITION BY subject, content_hash ORDER BY moment, seq) AS nth FROM versions)"


@register("win1_versions", f"WITH {_FIRST} SELECT subject, content_hash, row_number() OVER (PARTITION BY subject ORDER BY moment, seq) AS version FROM firsts WHERE nth = 1")
def win1(spark, sf):
    return X.assign_versions(V.versions(spark, sf), "subject", "content_hash", ["at", "seq"]).select("subject", "content_hash", F.col("version").cast("long").alias("version"))


@register("win2_latest_per_key", f"WITH {V.VERSIONS} SELECT subject, arg_max(content_hash, (moment, seq)) AS content_hash, arg_max(seq, (moment, seq)) AS seq FROM versions GROUP BY subject")
def win2(spark, sf):
    return X.latest_per_key(V.versions(spark, sf), ["subject"], [F.desc("at"), F.desc("seq")]).select("subject", "content_hash", "seq")


@register("win8_reverts", f"""WITH {_FIRST}, l AS (SELECT *, last_value(CASE WHEN nth = 1 THEN content_hash END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM firsts)
SELECT subject, seq, content_hash, latest, row_number() OVER (PARTITION BY subject ORDER BY moment, seq) AS occurrence FROM l WHERE nth > 1 AND latest <> content_hash""")
def win8(spark, sf):
    r = X.reverts(V.versions(spark, sf), "subject", "content_hash", ["at", "seq"])
    return r.select("subject", "seq", "content_hash", "latest", F.col("occurrence").cast("long").alias("occurrence"))


def _moved(hint: str) -> str:
    """Whether a sighting moves a hint of the latest version in a way that isn't recorded yet."""
    return f"(s.content_hash = f.latest AND s.known AND s.{hint} IS DISTINCT FROM f.{hint} AND NOT list_contains(f.seen, '{hint}' || coalesce(f.{hint}, '-') || coalesce(s.{hint}, '-')))"


def _hint_after(hint: str) -> str:
    return f"CASE WHEN list_contains(f.contents, s.content_hash) AND NOT {_moved(hint)} THEN f.{hint} ELSE s.{hint} END"


#: Each sighting after the one before it: the latest version, the contents and changes known, the hints as they are.
_SEEN = f"""{V.VERSIONS}, s AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY moment, seq) AS n FROM versions),
f AS (SELECT subject, n, seq, content_hash, content_hash AS latest, [content_hash] AS contents, edited, pinned, []::VARCHAR[] AS seen, 0 AS changes, 'version' AS kind, NULL::VARCHAR AS was, false AS e, false AS p, NULL::VARCHAR AS old_edited, NULL::VARCHAR AS old_pinned FROM s WHERE n = 1
UNION ALL SELECT s.subject, s.n, s.seq, s.content_hash, CASE WHEN list_contains(f.contents, s.content_hash) THEN f.latest ELSE s.content_hash END, CASE WHEN list_contains(f.contents, s.content_hash) THEN f.contents ELSE list_append(f.contents, s.content_hash) END, {_hint_after("edited")}, {_hint_after("pinned")},
  CASE WHEN list_contains(f.contents, s.content_hash) THEN f.seen || CASE WHEN {_moved("edited")} THEN ['edited' || coalesce(f.edited, '-') || coalesce(s.edited, '-')] ELSE [] END || CASE WHEN {_moved("pinned")} THEN ['pinned' || coalesce(f.pinned, '-') || coalesce(s.pinned, '-')] ELSE [] END ELSE [] END,
  f.changes + f.e::INT + f.p::INT + CASE WHEN f.kind = 'reverted' THEN 1 ELSE 0 END, CASE WHEN NOT list_contains(f.contents, s.content_hash) THEN 'version' WHEN s.content_hash <> f.latest THEN 'reverted' END, f.latest, {_moved("edited")}, {_moved("pinned")}, f.edited, f.pinned
  FROM f JOIN s ON s.subject = f.subject AND s.n = f.n + 1),
moves AS (SELECT subject, seq, content_hash, latest, len(contents) AS top, 'edited' AS hint, old_edited AS old, edited AS new, changes + 1 AS occurrence FROM f WHERE e
  UNION ALL SELECT subject, seq, content_hash, latest, len(contents), 'pinned', old_pinned, pinned, changes + e::INT + 1 FROM f WHERE p)"""


@register("win9_hint_changes", f"WITH RECURSIVE {_SEEN} SELECT subject, content_hash, seq, hint, old, new FROM moves")
def win9(spark, sf):
    return Y.hint_changes(V.versions(spark, sf), "subject", "content_hash", "hints", ["at", "seq"]).select("subject", "content_hash", "seq", "hint", "old", "new")


#: Every version, revert and moved hint of the view, as the stream and the batch operators have them.
EVENTS_SEEN = f"""WITH RECURSIVE {_SEEN} SELECT subject, seq, kind, content_hash, CAST(len(contents) AS INTEGER) AS version, NULL::VARCHAR AS hint, NULL::VARCHAR AS old, NULL::VARCHAR AS new, NULL::BIGINT AS occurrence FROM f WHERE kind = 'version'
UNION ALL SELECT subject, seq, kind, content_hash, CAST(list_position(contents, content_hash) AS INTEGER), NULL, was, content_hash, changes + 1 FROM f WHERE kind = 'reverted'
UNION ALL SELECT subject, seq, 'hint', content_hash, CAST(top AS INTEGER), hint, old, new, occurrence FROM moves"""


@register("win8_win9_changes", f"SELECT subject, seq, kind, content_hash, hint, old, new, occurrence FROM ({EVENTS_SEEN}) WHERE kind <> 'version'")
def win89(spark, sf):
    """WIN-8 and WIN-9 together: occurrences count both."""
    return Y.changes(V.versions(spark, sf), "subject", "content_hash", "hints", ["at", "seq"]).select("subject", "seq", "kind", "content_hash", "hint", "old", "new", "occurrence")


@register("win14_dedupe_first", f"WITH {V.MSG} SELECT unit_key, text, min(event_id) AS event_id FROM msg GROUP BY ALL")
def win14(spark, sf):
    return X.dedupe_first(V.msg(spark, sf), ["unit_key", "text"], ["event_id"]).select("unit_key", "text", "event_id")


@register("win7_edit_pairs", """WITH t AS (SELECT conv_id, turn, role, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn)
  AS n FROM conversations) SELECT conv_id, turn, role, p AS previous, h AS text FROM t WHERE n > 1""")
def win7(spark, sf):
    t = V.read(spark, sf, "conversations").withColumn("text", F.sha2("text", 256))
    return X.edit_pairs(t, "conv_id", "turn").select("conv_id", "turn", "role", "previous", "text")


@register("win10_effective_intervals", """SELECT o_custkey, o_orderkey, CAST(CASE WHEN row_number() OVER w > 1 THEN o_orderdate END AS VARCHAR) AS effective_from, CAST(lead(o_orderdate) OVER w AS VARCHAR) AS effective_to
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win10(spark, sf):
    o = V.read(spark, sf, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    e = X.effective_intervals(o, "o_custkey", "at")
    return e.select("o_custkey", "o_orderkey", F.col("effective_from.o_orderdate").cast("string").alias("effective_from"), F.col("effective_to.o_orderdate").cast("string").alias("effective_to"))


@register("jon12_identity_as_of", """WITH h AS (SELECT o_custkey % 150 AS user_id, o_orderdate AS eff, max(o_orderpriority) AS name FROM orders GROUP BY 1, 2), q AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS
  TIMESTAMP) - INTERVAL (CAST(8000 * (event_id % 400) / 400 AS INTEGER)) DAY AS at FROM events)
SELECT q.user_id, CAST(q.at AS VARCHAR) AS at, coalesce((SELECT arg_max(h.name, h.eff) FROM h WHERE h.user_id = q.user_id AND h.eff < q.at), (SELECT arg_min(h.name, h.eff) FROM h WHERE h.user_id = q.user_id)) AS name FROM q""")
def jon12(spark, sf):
    h = V.read(spark, sf, "orders").groupBy((F.col("o_custkey") % 150).alias("user_id"), F.col("o_orderdate").alias("eff")).agg(F.max("o_orderpriority").alias("name"))
    e = V.read(spark, sf, "events")
    days = F.round(8000 * (F.col("event_id") % 400) / 400).cast("int")
    q = e.select("user_id", (F.to_date("ts").cast("timestamp_ntz") - F.make_dt_interval(days)).alias("at")).distinct()
    return X.as_of(q, h, "user_id", "at", "eff", ["name"]).select("user_id", F.col("at").cast("string").alias("at"), "name")


@register("jon14_best_derivation", """WITH d AS (SELECT l_orderkey AS item_id, CAST(l_linenumber % 3 AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INTEGER) % 12 AS VARCHAR) AS v FROM lineitem),
b AS (SELECT item_id, arg_max(v, string_split(v, '.')[1]::INT * 100 + string_split(v, '.')[2]::INT) AS normalizer_version FROM d GROUP BY item_id) SELECT o_orderkey AS item_id, normalizer_version FROM orders JOIN b ON b.item_id = o_orderkey""")
def jon14(spark, sf):
    d = V.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.concat_ws(".", (F.col("l_linenumber") % 3).cast("string"), (F.col("l_quantity").cast("int") % 12).cast("string")).alias("normalizer_version"))
    return X.best_derivation(V.read(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")), d).select("item_id", "normalizer_version")


@register("agg21_versions_numeric_order", """WITH v AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INTEGER) % 12 AS VARCHAR) AS v FROM lineitem) SELECT v AS version, row_number() OVER
  (ORDER BY string_split(v, '.')[1]::INT, string_split(v, '.')[2]::INT) AS place FROM v""")
def agg21(spark, sf):
    from pyspark.sql.window import Window

    v = V.read(spark, sf, "lineitem").select(F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_quantity").cast("int") % 12).cast("string")).alias("version"))
    return X.fingerprint_versions(v, "version").select("version", F.row_number().over(Window.orderBy(K.version_key(F.col("version")))).cast("long").alias("place"))


@register("stm2_absence_events", f"""WITH {V.VERSIONS}, l AS (SELECT *, hint <> 'F' AS present, coalesce(lag(hint <> 'F') OVER (PARTITION BY subject ORDER BY moment, seq), true) AS before FROM versions)
SELECT subject, seq, CASE WHEN present THEN 'observed_again' ELSE 'no_longer_observed' END AS event, row_number() OVER (PARTITION BY subject ORDER BY moment, seq) AS occurrence FROM l WHERE present <> before""")
def stm2(spark, sf):
    v = V.versions(spark, sf).withColumn("present", F.col("hint") != "F")
    return X.absence_events(v, "subject", "present", ["at", "seq"]).select("subject", "seq", "event", F.col("occurrence").cast("long").alias("occurrence"))


@register("stm3_availability_events", f"""WITH {V.VERSIONS}, l AS (SELECT *, CASE WHEN content_hash IN ('1-URGENT', '2-HIGH') THEN content_hash ELSE '' END AS r FROM versions), b AS (SELECT *, coalesce(lag(r) OVER (PARTITION BY subject ORDER BY moment, seq), '') AS before FROM l)
SELECT subject, seq, r AS reason, CASE WHEN r = '' THEN 'file_became_available' ELSE 'file_unavailable' END AS event FROM b WHERE r <> before""")
def stm3(spark, sf):
    v = V.versions(spark, sf).withColumn("refused", F.when(F.col("content_hash").isin("1-URGENT", "2-HIGH"), F.col("content_hash")))
    return X.availability_events(v, "subject", "refused", ["at", "seq"]).select("subject", "seq", F.col("state").alias("reason"), "event")


@register("stm4_access_events", f"""WITH {V.MSG}, l AS (SELECT *, k < 10 AS lost, coalesce(lag(k < 10) OVER (PARTITION BY conversation_id ORDER BY event_id), false) AS before FROM msg) SELECT conversation_id,
  event_id, CASE WHEN lost THEN 'access_lost' ELSE 'access_restored' END AS event FROM l WHERE lost <> before""")
def stm4(spark, sf):
    return X.access_events(V.msg(spark, sf).withColumn("lost", F.col("k") < 10), "conversation_id", "lost", ["event_id"]).select("conversation_id", "event_id", "event")


@register("stm6_reaction_snapshots", f"""WITH {V.MSG}, l AS (SELECT *, k % 4 = 0 AS has, bool_or(k % 4 = 0) OVER (PARTITION BY author ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM msg
  WHERE text <> 'error') SELECT author, event_id, has FROM l WHERE has OR coalesce(before, false)""")
def stm6(spark, sf):
    m = V.msg(spark, sf).withColumn("reactions", F.when(F.col("k") % 4 == 0, F.array("text")).otherwise(F.array().cast("array<string>"))).withColumn("deleted", F.col("text") == "error")
    return X.reaction_snapshots(m, "author", "reactions", "deleted", ["event_id"]).select("author", "event_id", (F.size("reactions") > 0).alias("has"))


_KEY = "sha256('T0' || chr(31) || 'chat' || chr(31) || subject || chr(31) || sha256(text))"


@register("scl1_idempotency_key", f"WITH {V.MSG} SELECT event_id, {_KEY} AS idempotency_key FROM msg")
def scl1(spark, sf):
    m = V.msg(spark, sf)
    return m.select("event_id", K.idempotency_key(F.lit("T0"), F.lit("chat"), F.col("subject"), F.sha2("text", 256)).alias("idempotency_key"))


@register("scl2_subjects", """SELECT event_id, 'T0/C' || (user_id % 20) || '/' || event_id AS message, 'T0/file/F' || (event_id % 100) AS file, 'T0/user/U' || user_id || '#profile-embed' AS profile, 'T0/C' ||
  (user_id % 20) || '/' || event_id || '#reactions' AS reactions FROM events""")
def scl2(spark, sf):
    m, w = V.msg(spark, sf), F.lit("T0")
    s = K.message_subject(w, F.col("conversation_id"), F.col("event_id").cast("string"))
    return m.select("event_id", s.alias("message"), K.file_subject(w, F.concat(F.lit("F"), (F.col("event_id") % 100).cast("string"))).alias("file"), K.profile_subject(w, F.col("author"), True).alias("profile"), K.derived_subject(s, "reactions").alias("reactions"))


@register("scl4_fingerprints", f"""WITH {V.MSG} SELECT event_id, sha256('{{"author":"' || author || '","deleted":' || CASE WHEN k = 0 THEN 'true' ELSE 'false' END || ',"fp":"chat.message/2","text":"' || CASE WHEN k = 0 THEN '' ELSE text END || '","thread_root":' || coalesce('"' || root_id || '"', 'null') || '}}')
  AS content_hash FROM msg""")
def scl4(spark, sf):
    m, gone = V.msg(spark, sf), F.col("k") == 0
    return m.select("event_id", K.canonical_hash(fp=F.lit("chat.message/2"), author=F.col("author"), text=F.when(gone, "").otherwise(F.col("text")), thread_root=F.col("root_id").cast("string"), deleted=gone).alias("content_hash"))


@register("scl5_instants", """SELECT event_id, CAST(CAST(epoch_us(ts) AS BIGINT) AS VARCHAR) AS us, CAST(CAST(epoch_us(ts) AS BIGINT) // 1000000 AS VARCHAR) || '.' || lpad(CAST(CAST(epoch_us(ts) AS BIGINT) %
  1000000 AS VARCHAR), 6, '0') AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS rfc3339 FROM events""")
def scl5(spark, sf):
    m = V.msg(spark, sf).withColumn("ts", K.instant_ts(F.col("sent_at")))
    return m.select("event_id", F.unix_micros(K.ts_instant(F.col("ts"))).cast("string").alias("us"), "ts", K.rfc3339(F.col("sent_at")).alias("rfc3339"))


@register("snk5_new_items", f"WITH {V.MSG}, i AS (SELECT event_id, {_KEY} AS key FROM msg) SELECT DISTINCT key AS idempotency_key FROM i WHERE key NOT IN (SELECT key FROM i WHERE event_id % 3 = 0)")
def snk5(spark, sf):
    i = scl1(spark, sf)
    return X.new_items(i, i.filter("event_id % 3 = 0")).select("idempotency_key")


@register("snk6_new_links", f"WITH {V.MSG}, l AS (SELECT DISTINCT unit_key, author FROM msg) SELECT unit_key, author FROM l WHERE NOT EXISTS (SELECT 1 FROM msg m WHERE m.event_id % 2 = 0 AND m.unit_key = l.unit_key AND m.author = l.author)")
def snk6(spark, sf):
    m = V.msg(spark, sf)
    return X.new_links(m, m.filter("event_id % 2 = 0"), ["unit_key", "author"]).select("unit_key", "author")


LANES = ", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS s{i}" for i in range(8))
CARRY = "c7 AS (SELECT *, s7 AS t7 FROM lanes)" + "".join(f", c{i} AS (SELECT *, s{i} + t{i + 1} // 4294967296 AS t{i} FROM c{i + 1})" for i in range(6, -1, -1))
HEX = " || ".join(f"lpad(lower(to_hex(CAST(t{i} % 4294967296 AS BIGINT))), 8, '0')" for i in range(8))


@register("agg6_multiset_digest", f"""WITH {V.MSG}, v AS (SELECT conversation_id, sha256(subject) AS h FROM msg), lanes AS (SELECT conversation_id, count(*) AS n, {LANES} FROM v GROUP BY conversation_id), {CARRY}
  SELECT conversation_id, n AS rows, {HEX} AS digest FROM c0""")
def agg6(spark, sf):
    return D.multiset_digest(V.msg(spark, sf), ["conversation_id"], F.col("subject"))


@register("agg5_differing_buckets", f"WITH {V.MSG}, u AS (SELECT unit_key, count(*) AS n FROM msg GROUP BY 1) SELECT DISTINCT CAST(CAST('0x' || substr(sha256(unit_key), 1, 3) AS BIGINT) AS INTEGER) AS bucket FROM u WHERE n % 10 = 0")
def agg5(spark, sf):
    u = V.msg(spark, sf).groupBy("unit_key").agg(F.count(F.lit(1)).alias("n"))
    other = u.withColumn("n", F.when(F.col("n") % 10 == 0, F.col("n") + 1).otherwise(F.col("n")))
    record = F.concat_ws("|", "unit_key", F.col("n").cast("string"))
    return D.differing_buckets(D.bucketed_digest(u, F.col("unit_key"), record), D.bucketed_digest(other, F.col("unit_key"), record))


@register("jon9_compare_facts", f"""WITH {V.MSG}, u AS (SELECT unit_key, count(*) AS n FROM msg GROUP BY 1)
SELECT unit_key, 'duplicate_unit_event' AS difference FROM u WHERE n % 7 = 0 AND n % 5 <> 0 UNION ALL SELECT unit_key, 'unit_unsettled_in_database' FROM u WHERE n % 11 = 0 AND n %
  5 <> 0 UNION ALL SELECT unit_key, 'unit_missing_from_chain' FROM u WHERE n % 5 = 0 AND n % 11 <> 0 UNION ALL SELECT unit_key, 'unit_differs' FROM u WHERE n % 13 = 0 AND n % 5 <>
  0 AND n % 11 <> 0""")
def jon9(spark, sf):
    u = V.msg(spark, sf).groupBy("unit_key").agg(F.count(F.lit(1)).alias("n"))
    c = u.filter("n % 5 <> 0").withColumn("seq", F.lit(1))
    c = c.unionByName(c.filter("n % 7 = 0").withColumn("seq", F.lit(2)))
    d = u.select("unit_key", F.when(F.col("n") % 13 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"), (F.col("n") % 11 != 0).alias("settled"))
    return D.compare_facts(c, d, "unit_key", ["n"], "seq")


@register("set4_multiset_difference", f"""WITH {V.MSG}, a AS (SELECT unit_key, count(*) FILTER (WHERE event_id % 4 <> 0) AS x, count(*) FILTER (WHERE event_id % 5 <> 0) AS y FROM msg GROUP BY 1) SELECT unit_key, greatest(x
  - y, 0) AS missing, greatest(y - x, 0) AS extra FROM a WHERE x <> y""")
def set4(spark, sf):
    m = V.msg(spark, sf)
    return D.multiset_difference(m.filter("event_id % 4 <> 0"), m.filter("event_id % 5 <> 0"), ["unit_key"])


_TREE = """tree AS (SELECT g, CAST(row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY g) AS n, h, 0 AS lvl FROM leaf
  UNION ALL SELECT g, i // 2, (max(n) + 1) // 2, CASE WHEN count(*) = 2 THEN sha256(from_hex('01' || min(CASE WHEN i % 2 = 0 THEN h END) || min(CASE WHEN i % 2 = 1 THEN h END))) ELSE min(h) END, max(lvl) + 1 FROM tree WHERE n > 1 GROUP BY g, i // 2)"""


@register("mrk1_merkle_roots", f"WITH RECURSIVE {V.MSG}, leaf AS (SELECT unit_key AS g, event_id AS o, sha256('\\x00'::BLOB || encode(subject)) AS h FROM msg), {_TREE} SELECT g AS unit_key, h AS root FROM tree WHERE n = 1")
def mrk1(spark, sf):
    m = V.msg(spark, sf).withColumn("leaf", M.leaf_hash(F.col("subject")))
    return M.roots(m, ["unit_key"], ["event_id"], "leaf").select("unit_key", "root")


@register("mrk2_batch_roots", f"""WITH RECURSIVE {V.MSG}, leaf AS (SELECT unit_key AS g, {_KEY} AS o, sha256(from_hex('00' || {_KEY} || sha256(text))) AS h FROM msg), {_TREE} SELECT g AS unit_key, h AS root,
  (SELECT count(*) FROM msg WHERE unit_key = g) AS item_count FROM tree WHERE n = 1""")
def mrk2(spark, sf):
    m = V.msg(spark, sf).withColumn("content_hash", F.sha2("text", 256))
    m = m.withColumn("key", K.idempotency_key(F.lit("T0"), F.lit("chat"), F.col("subject"), F.col("content_hash")))
    return M.batch_roots(m, ["unit_key"], "key", "content_hash")


@register("mrk3_record_roots", f"""WITH RECURSIVE leaf AS (SELECT l_orderkey % 2000 AS g, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS o, sha256('\\x00'::BLOB || encode('{{"ord":' || row_number() OVER (PARTITION BY l_orderkey % 2000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) || ',"part":' || l_partkey || ',"supp":' || l_suppkey || '}}'))
  AS h FROM lineitem), {_TREE} SELECT g AS batch, h AS root FROM tree WHERE n = 1""")
def mrk3(spark, sf):
    from pyspark.sql.window import Window

    o = F.row_number().over(Window.partitionBy("batch").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    r = V.read(spark, sf, "lineitem").withColumn("batch", F.col("l_orderkey") % 2000).select("batch", o.alias("ord"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return M.record_roots(r, ["batch"], "ord", ["ord", "part", "supp"]).select("batch", "root")


_FIELDS = """'{"actor":"' || actor || '","created_at":"' || strftime(moment, '%Y-%m-%dT%H:%M:%S.%fZ') || '","event_type":"' || event_type || '","payload":"' || payload || '","seq":' || seq || ',"stream_id":"' || stream || '"}'"""
HASHED = f"{V.CHAIN}, f AS (SELECT *, {_FIELDS} AS fields FROM chain), built AS (SELECT stream, seq, event_type, fields, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || fields) AS event_hash FROM f WHERE seq = 1 UNION ALL SELECT f.stream, f.seq, f.event_type, f.fields, b.event_hash, sha256(b.event_hash || f.fields) FROM built b JOIN f ON f.stream = b.stream AND f.seq = b.seq + 1)"


def _built(spark, sf):
    c = V.chain(spark, sf)
    fields = C.event_json(F.col("stream"), F.col("seq"), F.col("event_type"), F.col("actor"), F.col("payload"), K.rfc3339(F.col("at")))
    return C.build_chain(c.select("stream", "seq", "event_type", fields.alias("fields")))


@register("mrk4_event_hash", f"WITH {V.CHAIN} SELECT stream, seq, sha256(repeat('0', 64) || {_FIELDS}) AS event_hash FROM chain")
def mrk4(spark, sf):
    c = V.chain(spark, sf)
    fields = C.event_json(F.col("stream"), F.col("seq"), F.col("event_type"), F.col("actor"), F.col("payload"), K.rfc3339(F.col("at")))
    return c.select("stream", "seq", C.event_hash(F.lit(C.GENESIS), fields).alias("event_hash"))


@register("mrk5_build_chain", f"WITH RECURSIVE {HASHED} SELECT stream, seq, prev_hash, event_hash FROM built")
def mrk5(spark, sf):
    return _built(spark, sf).select("stream", "seq", "prev_hash", "event_hash")


@register("mrk6_verify_chain", f"""WITH {V.CHAIN}, g AS (SELECT stream, min(seq) AS lost FROM chain WHERE seq % 701 = 0 GROUP BY stream) SELECT c.stream, c.seq, CASE WHEN c.seq = g.lost + 1 THEN 'gap' WHEN c.seq >
  g.lost THEN 'unchecked' WHEN c.seq % 89 = 0 THEN 'foreign' WHEN (c.seq - 1) % 83 = 0 AND c.seq > 1 THEN 'broken_link' WHEN c.seq % 97 = 0 THEN 'altered' END AS error FROM chain c LEFT JOIN g USING (stream) WHERE c.seq % 701 <> 0""")
def mrk6(spark, sf):
    """A chain with altered and dropped events, events that name another stream, and events rewritten with their own hash."""
    c, s = V.chain(spark, sf), F.col("seq")
    fields = C.event_json(F.when(s % 89 == 0, "elsewhere").otherwise(F.col("stream")), s, F.col("event_type"), F.col("actor"), F.col("payload"), K.rfc3339(F.col("at")))
    b = C.build_chain(c.select("stream", "seq", "event_type", fields.alias("fields"))).filter("seq % 701 <> 0")
    b = b.withColumn("fields", F.when((s % 97 == 0) & (s % 89 != 0), F.concat("fields", F.lit(" "))).otherwise(F.col("fields")))
    other = F.concat("fields", F.lit("\n"))  # its own hash fits, that of the next event doesn't
    b = b.withColumn("_f", F.when((s % 83 == 0) & (s % 97 != 0), other).otherwise(F.col("fields"))).withColumn("event_hash", F.when((s % 83 == 0) & (s % 97 != 0), C.event_hash(F.col("prev_hash"), other)).otherwise(F.col("event_hash"))).drop("fields").withColumnRenamed("_f", "fields")
    return C.verify_chain(materialized(b)).select("stream", "seq", "error")  # stored, as a log is


@register("mrk7_verify_batches", f"""WITH {V.MSG}, u AS (SELECT unit_key, count(*) AS n FROM msg GROUP BY 1) SELECT unit_key, CASE WHEN n % 9 = 0 THEN 'items_missing' WHEN n % 10 = 0 THEN 'unknown_batch' WHEN n % 8 =
  0 THEN 'wrong_count' ELSE 'wrong_root' END AS error FROM u WHERE n % 9 = 0 OR n % 10 = 0 OR n % 8 = 0 OR n % 7 = 0""")
def mrk7(spark, sf):
    m = V.msg(spark, sf).withColumn("content_hash", F.sha2("text", 256))
    m = m.withColumn("key", K.idempotency_key(F.lit("T0"), F.lit("chat"), F.col("subject"), F.col("content_hash")))
    real = M.batch_roots(m, ["unit_key"], "key", "content_hash")
    n = F.col("item_count")
    stated = real.filter((n % 10 != 0) | (n % 9 == 0)).select("unit_key", F.when(n % 8 == 0, n + 1).otherwise(n).alias("item_count"), F.when(n % 7 == 0, F.lit("0")).otherwise(F.col("root")).alias("root"))
    return C.verify_batches(stated, real.filter(n % 9 != 0), "unit_key")


@register("mrk8_verify_anchors", f"""WITH {V.CHAIN} SELECT stream, seq + CASE WHEN seq % 16 = 0 THEN 1000000 ELSE 0 END AS seq, CASE WHEN seq % 16 = 0 OR seq > (SELECT max(h.seq) FROM chain h WHERE h.stream =
  chain.stream AND (h.seq % 12 <> 0 OR h.seq % 16 = 0)) THEN 'events_deleted' WHEN seq % 12 = 0 THEN 'event_missing' ELSE 'anchor_differs' END AS error FROM chain WHERE seq % 4 = 0
  AND (seq % 16 = 0 OR seq % 12 = 0 OR seq % 20 = 0)""")
def mrk8(spark, sf):
    b = mrk4(spark, sf)
    s = F.col("seq")
    anchors = b.filter(s % 4 == 0).select("stream", (s + F.when(s % 16 == 0, 1_000_000).otherwise(0)).alias("seq"), F.when((s % 20 == 0) & (s % 16 != 0), F.lit("0")).otherwise(F.col("event_hash")).alias("event_hash"))
    return C.verify_anchors(anchors, b.filter((s % 12 != 0) | (s % 16 == 0)))


@register("mrk8_anchor_states", f"""WITH {V.CHAIN}, h AS (SELECT stream, max(seq) AS head FROM chain GROUP BY stream)
SELECT stream, seq, CASE WHEN seq % 28 = 0 THEN 'hidden' ELSE 'anchor_differs' END AS error FROM chain WHERE seq % 4 = 0 AND (seq % 28 = 0 OR seq % 20 = 0)
UNION ALL SELECT stream, head + CASE WHEN stream = 'S1' THEN 1 ELSE 0 END, 'head_differs' FROM h WHERE stream IN ('S1', 'S2') UNION ALL SELECT stream, head, 'not_sealed' FROM h WHERE CAST(substr(stream, 2) AS INTEGER) % 2 = 0 AND NOT (head % 4 = 0 AND head % 28 <> 0 AND head % 20 <> 0)""")
def mrk8b(spark, sf):
    """Hidden anchors, head records that don't fit, and finalised streams without a seal at their head."""
    b, s = materialized(mrk4(spark, sf)), F.col("seq")
    anchors = b.filter(s % 4 == 0).select("stream", "seq", F.when(s % 20 == 0, F.lit("0")).otherwise(F.col("event_hash")).alias("event_hash"), (s % 28 == 0).alias("hidden"))
    last = b.groupBy("stream").agg(F.max("seq").alias("seq"), F.max_by("event_hash", "seq").alias("event_hash"))
    heads = last.select("stream", (s + F.when(F.col("stream") == "S1", 1).otherwise(0)).alias("seq"), F.when(F.col("stream") == "S2", F.lit("0")).otherwise(F.col("event_hash")).alias("event_hash"))
    return C.verify_anchors(anchors, b, heads=heads, finalised=last.filter(F.substring("stream", 2, 9).cast("int") % 2 == 0))


#: Files of a render's batch.
BATCH_FILES = 5


@register("mrk7_render_batches", f"""WITH f AS (SELECT l_suppkey AS r, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS ord, l_orderkey FROM lineitem), g AS (SELECT r, ord // {BATCH_FILES} AS b, count(*) AS n, min(ord) AS o FROM f GROUP BY ALL), t AS (SELECT r, count(*) AS b, sum(n) AS n FROM g GROUP BY r),
s AS (SELECT *, (r + b) % 11 = 0 AS x1, (r + b) % 13 = 0 AS x2, (r + b) % 17 = 0 AS x3, (r + b) % 19 = 0 AS x4 FROM g)
SELECT r AS render_id, b + 1 AS seq, 'wrong_batch' AS error FROM s WHERE x1 UNION ALL SELECT r, b + 1, 'wrong_count' FROM s WHERE x2 UNION ALL SELECT r, b + 1, 'wrong_first_ord' FROM s WHERE x3 UNION ALL SELECT r, b + 1, 'wrong_root' FROM s WHERE x4
UNION ALL SELECT r, 1000000, 'wrong_files' FROM t WHERE r % 3 = 0 UNION ALL SELECT r, 1000000, 'wrong_batches' FROM t WHERE r % 5 = 0 UNION ALL SELECT r, 1000000, 'wrong_batches_root' FROM t WHERE r % 7 = 0 OR EXISTS (SELECT 1 FROM s WHERE s.r = t.r AND x4)""")
def mrk7b(spark, sf):
    """Renders of the line items of a supplier: batch events with wrong numbers, counts, starts and roots, and wrong ends."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    f = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("render_id"), place.alias("ord"), F.col("l_orderkey").alias("order"))
    f = materialized(f.withColumn("seq", (F.floor(F.col("ord") / BATCH_FILES) + 1).cast("long")))
    real = materialized(M.record_roots(f, ["render_id", "seq"], "ord", ["ord", "order"]).join(f.groupBy("render_id", "seq").agg(F.min("ord").alias("first_ord")), ["render_id", "seq"]))
    n = F.col("render_id") + F.col("seq") - 1
    stated = real.select(
        "render_id", "seq", (F.col("seq") - 1 + F.when(n % 11 == 0, 1).otherwise(0)).alias("batch"), (F.col("leaves") + F.when(n % 13 == 0, 1).otherwise(0)).alias("file_count"), (F.col("first_ord") + F.when(n % 17 == 0, 1).otherwise(0)).alias("first_ord"),
        F.when(n % 19 == 0, F.lit("00" * 32)).otherwise(F.col("root")).alias("root"),
    )
    whole = M.roots(real.withColumn("leaf", M.leaf_hash(F.unhex("root"))), ["render_id"], ["seq"], "leaf").select("render_id", "root")
    ends = real.groupBy("render_id").agg(F.sum("leaves").alias("file_count"), F.count(F.lit(1)).alias("batch_count")).join(whole, "render_id")
    r = F.col("render_id")
    ends = ends.select("render_id", F.lit(1_000_000).cast("long").alias("seq"), (F.col("file_count") + F.when(r % 3 == 0, 1).otherwise(0)).alias("file_count"), (F.col("batch_count") + F.when(r % 5 == 0, 1).otherwise(0)).alias("batch_count"), F.when(r % 7 == 0, F.lit("0")).otherwise(F.col("root")).alias("batches_root"))
    return C.verify_render_batches(stated, f, ends, ["ord", "order"])


@register("jon24_item_links", f"""WITH {V.CHAIN}, i AS (SELECT event_id AS place, event_id AS item_id, stream, CASE WHEN event_id % 37 = 0 THEN 1 ELSE seq END AS seq FROM chain UNION ALL SELECT event_id + 1000000, event_id, stream, seq FROM chain WHERE event_id % 41 = 0),
o AS (SELECT *, last_value(seq) OVER (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM i)
SELECT place, CAST(item_id AS VARCHAR) AS item_id, 'not_linked' AS error FROM o WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.stream = o.stream AND c.seq = o.seq AND c.event_type = 'items_collected') UNION ALL SELECT place, CAST(item_id AS VARCHAR), 'out_of_order' FROM o WHERE was > seq
UNION ALL SELECT place, CAST(item_id AS VARCHAR), 'linked_twice' FROM o WHERE place >= 1000000""")
def jon24b(spark, sf):
    """Items in the order of their file against the batch events they name. From a million ids on, the place of a copy may be
    that of another item, which then comes first; the SQL leaves that open."""
    c = V.chain(spark, sf)
    e = F.col("event_id")
    items = c.select(e.alias("place"), e.cast("string").alias("item_id"), "stream", F.when(e % 37 == 0, 1).otherwise(F.col("seq")).cast("long").alias("seq"), F.lit(0).alias("again"))
    again = c.filter(e % 41 == 0).select((e + 1_000_000).alias("place"), e.cast("string").alias("item_id"), "stream", "seq", F.lit(1).alias("again"))
    return C.verify_item_links(items.unionByName(again), c, "items_collected", then=("again",))


@register("mrk9_anchors_due", f"""WITH {V.CHAIN}, p AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'job_paused' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1
  PRECEDING), 0) AS part FROM chain), n AS (SELECT *, row_number() OVER (PARTITION BY stream, part ORDER BY seq) AS k FROM p)
SELECT stream, seq, event_type FROM n WHERE event_type = 'job_paused' OR k % 8 = 0""")
def mrk9(spark, sf):
    return C.anchors_due(V.chain(spark, sf), ("job_paused",)).select("stream", "seq", "event_type")


@register("agg24_chain_fold", f"""WITH {V.CHAIN} SELECT stream, min(seq) FILTER (WHERE event_type = 'items_collected') AS started_seq, greatest(count(*) FILTER (WHERE event_type = 'items_collected') - 1, 0) AS
  duplicate_starts, min(seq) FILTER (WHERE event_type IN ('job_resumed', 'job_paused')) AS final_seq,
arg_min(event_type, seq) FILTER (WHERE event_type IN ('job_resumed', 'job_paused')) AS final_type, greatest(count(*) FILTER (WHERE event_type IN ('job_resumed', 'job_paused')) - 1,
  0) AS duplicate_finals, count(*) FILTER (WHERE event_type = 'job_paused') AS stops, count(*) FILTER (WHERE event_type = 'unit_reconciled') AS batches, count(*) AS events FROM
  chain GROUP BY stream""")
def agg24(spark, sf):
    return C.chain_fold(V.chain(spark, sf), "items_collected", ("job_resumed", "job_paused"), ("job_paused",), "unit_reconciled")


@register("win13_first_fact", f"WITH {V.MSG} SELECT unit_key, min(event_id) AS event_id, count(*) - 1 AS later FROM msg GROUP BY 1")
def win13(spark, sf):
    return C.first_fact(V.msg(spark, sf), "unit_key", "event_id").select("unit_key", "event_id", "later")


@register("jon27_integrity", f"WITH {V.MSG} SELECT event_id FROM msg WHERE event_id % 17 = 0")
def jon27(spark, sf):
    """Items whose stored page no longer hashes to what was recorded."""
    m = V.msg(spark, sf)
    pages = m.select(F.col("event_id").alias("page_id"), F.concat(F.lit('{"messages":[{"text":"'), F.when(F.col("event_id") % 17 == 0, F.lit("altered")).otherwise(F.col("text")), F.lit('"}]}')).alias("json"))
    items = m.select("event_id", F.col("event_id").alias("page_id"), K.json_path("messages", F.lit(0)).alias("path"), F.sha2(F.concat(F.lit('{"text":"'), "text", F.lit('"}')), 256).alias("raw_hash"))
    return C.integrity_mismatches(items, pages, "page_id", "json", "path", "raw_hash").select("event_id")


@register("jon27_derivations", f"WITH {V.MSG} SELECT event_id FROM msg WHERE event_id % 19 = 0")
def jon27b(spark, sf):
    """Derivations that no longer hash to what was recorded; the order of their keys doesn't matter."""
    m, e = V.msg(spark, sf), F.col("event_id")
    there = F.concat(F.lit('{"b": "'), "text", F.lit('", "a": '), e.cast("string"), F.lit("}"))
    derived = F.when(e % 19 == 0, F.concat(F.lit('{"a":-1,"b":"'), "text", F.lit('"}'))).otherwise(there)
    recorded = F.sha2(F.concat(F.lit('{"a":'), e.cast("string"), F.lit(',"b":"'), "text", F.lit('"}')), 256)
    return C.derivation_mismatches(m.select("event_id", derived.alias("derived"), recorded.alias("derived_hash"))).select("event_id")
