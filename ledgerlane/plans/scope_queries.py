"""Queries of scopes, archives, slices, audits, visibility and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.functions import text as T
from ledgerlane.functions.status import OBSERVATIONS
from ledgerlane.operators import archive as A
from ledgerlane.operators import audit as U
from ledgerlane.operators import normalize as N
from ledgerlane.operators import scope as S
from ledgerlane.operators import slicing as L
from ledgerlane.operators.registry import register
from ledgerlane.plans import views as V
from ledgerlane.plans.custody_queries import CARRY, HEX

_SCOPES = """scopes AS (SELECT c_custkey AS scope_id, CASE WHEN c_custkey % 100 = 0 THEN '*' ELSE 'C' || (c_custkey % 20) END AS external_id, TIMESTAMP '2024-01-01' + INTERVAL (CAST(c_custkey * 7 % 30 AS INTEGER)) DAY AS date_from,
  TIMESTAMP '2024-01-01' + INTERVAL (CAST(c_custkey * 7 % 30 + 1 + c_custkey % 3 AS INTEGER)) DAY AS date_to, ['none', 'parent', 'thread'][CAST(c_custkey % 3 AS INTEGER) + 1] AS thread_parent_policy, c_custkey % 3 AS prank FROM customer WHERE c_custkey % 5 = 0),
u AS (SELECT DISTINCT unit_key, conversation_id, day FROM msg), cov AS (SELECT DISTINCT u.unit_key, s.scope_id FROM u JOIN scopes s ON (s.external_id = u.conversation_id OR s.external_id = '*') AND s.date_from < u.day + INTERVAL 1 DAY AND s.date_to > u.day)"""


def _scopes(spark, sf):
    c = V.read(spark, sf, "customer").filter("c_custkey % 5 = 0")
    start = F.timestamp_seconds(F.lit(1704067200) + (F.col("c_custkey") * 7 % 30) * 86400)
    return c.select(F.col("c_custkey").alias("scope_id"), F.when(F.col("c_custkey") % 100 == 0, "*").otherwise(F.concat(F.lit("C"), (F.col("c_custkey") % 20).cast("string"))).alias("external_id"), start.alias("date_from"), F.timestamp_seconds(F.unix_seconds(start) + (1 + F.col("c_custkey") % 3) * 86400).alias("date_to"), F.element_at(F.array(*[F.lit(p) for p in S.POLICIES]), (F.col("c_custkey") % 3 + 1).cast("int")).alias("thread_parent_policy"))


def _unit_days(spark, sf):
    return V.msg(spark, sf).select("unit_key", "conversation_id", "day").distinct()


@register("jon2_scope_coverage", f"WITH {V.MSG}, {_SCOPES} SELECT unit_key, scope_id FROM cov")
def jon2(spark, sf):
    return S.coverage(_unit_days(spark, sf), _scopes(spark, sf))


@register("jon3_effective_scope", f"""WITH {V.MSG}, {_SCOPES},
own AS (SELECT DISTINCT u.conversation_id, c.scope_id FROM cov c JOIN u USING (unit_key)),
applying AS (SELECT conversation_id, scope_id FROM own
  UNION ALL SELECT DISTINCT u.conversation_id, s.scope_id FROM u, scopes s WHERE u.conversation_id NOT IN (SELECT conversation_id FROM own)),
r AS (SELECT a.conversation_id, s.date_from, s.date_to, max(s.date_to) OVER (PARTITION BY a.conversation_id ORDER BY s.date_from, s.date_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM applying a JOIN scopes s USING (scope_id)),
i AS (SELECT *, sum(CASE WHEN date_from <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY conversation_id ORDER BY date_from, date_to) AS island FROM r),
m AS (SELECT conversation_id, min(date_from) AS date_from, max(date_to) AS date_to FROM i GROUP BY conversation_id, island),
whole AS (SELECT conversation_id, min(date_from) AS a, max(date_to) AS b, count(*) AS ranges FROM m GROUP BY 1),
h AS (SELECT u.unit_key, min(m.date_from) AS date_from, arg_min(m.date_to, m.date_from) AS date_to FROM m JOIN u USING (conversation_id)
  WHERE m.date_from < u.day + INTERVAL 1 DAY AND m.date_to > u.day GROUP BY 1),
p AS (SELECT c.unit_key, max(s.prank) AS rank, count(*) AS scopes FROM cov c JOIN scopes s USING (scope_id) GROUP BY 1)
SELECT u.unit_key, CAST(coalesce(h.date_from, w.a) AS VARCHAR) AS date_from, CAST(coalesce(h.date_to, w.b) AS VARCHAR) AS date_to,
  ['none', 'parent', 'thread'][CAST(coalesce(p.rank, (SELECT max(prank) FROM scopes)) AS INTEGER) + 1] AS policy, coalesce(p.scopes, 0) AS scopes, w.ranges
FROM u JOIN whole w USING (conversation_id) LEFT JOIN h ON h.unit_key = u.unit_key LEFT JOIN p ON p.unit_key = u.unit_key""")
def jon3(spark, sf):
    e = S.effective_scope(_unit_days(spark, sf), _scopes(spark, sf))
    return e.withColumns({"date_from": F.col("date_from").cast("string"), "date_to": F.col("date_to").cast("string"), "ranges": F.size("ranges").cast("long")})


@register("win6_merge_intervals", f"""WITH {V.MSG}, {_SCOPES}, r AS (SELECT *, max(date_to) OVER (PARTITION BY external_id ORDER BY date_from, date_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM
  scopes), i AS (SELECT *, sum(CASE WHEN date_from <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY external_id ORDER BY date_from, date_to) AS island FROM r)
SELECT external_id, CAST(min(date_from) AS VARCHAR) AS date_from, CAST(max(date_to) AS VARCHAR) AS date_to FROM i GROUP BY external_id, island""")
def win6(spark, sf):
    m = S.merge_intervals(_scopes(spark, sf), ["external_id"], "date_from", "date_to")
    return m.select("external_id", F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"))


@register("win12_scope_index", f"WITH {V.MSG}, {_SCOPES} SELECT external_id, scope_id, row_number() OVER (PARTITION BY external_id ORDER BY scope_id) - 1 AS scope_index FROM scopes")
def win12(spark, sf):
    return S.scope_index(_scopes(spark, sf), "external_id", ["scope_id"]).select("external_id", "scope_id", F.col("scope_index").cast("long").alias("scope_index"))


@register("flt1_in_scope", f"""WITH {V.MSG}, {_SCOPES} SELECT m.event_id, NOT EXISTS (SELECT 1 FROM scopes s WHERE s.external_id = m.conversation_id) OR EXISTS (SELECT 1 FROM scopes s WHERE s.external_id =
  m.conversation_id AND m.sent_at >= s.date_from AND m.sent_at < s.date_to) AS in_scope FROM msg m""")
def flt1(spark, sf):
    r = _scopes(spark, sf).select(F.col("external_id").alias("conversation_id"), "date_from", "date_to")
    return S.messages_in_scope(V.msg(spark, sf), r).select("event_id", "in_scope")


@register("flt2_select_messages", f"WITH {V.MSG} SELECT event_id, unit_key, row_number() OVER (PARTITION BY unit_key ORDER BY event_id) - 1 AS page_index FROM msg QUALIFY event_id IN (SELECT root_id FROM msg)")
def flt2(spark, sf):
    from pyspark.sql.window import Window

    m = V.msg(spark, sf).withColumn("page_index", (F.row_number().over(Window.partitionBy("unit_key").orderBy("event_id")) - 1).cast("long"))
    return S.select_messages(m, m.select(F.col("root_id").alias("event_id")).distinct(), ["event_id"]).select("event_id", "unit_key", "page_index")


@register("flt3_unit_day", "SELECT event_id, ts >= TIMESTAMP '2024-01-05' + INTERVAL (CAST(user_id % 20 AS INTEGER)) DAY AND ts < TIMESTAMP '2024-01-06' + INTERVAL (CAST(user_id % 20 AS INTEGER)) DAY AS own FROM events")
def flt3(spark, sf):
    day = F.date_add(F.lit("2024-01-05").cast("date"), F.substring("conversation_id", 2, 9).cast("int"))
    return V.msg(spark, sf).select("event_id", S.unit_day_filter(F.col("sent_at"), day).alias("own"))


@register("jon11_thread_context", f"""WITH {V.MSG}, t AS (SELECT *, sent_at >= TIMESTAMP '2024-01-10' AND sent_at < TIMESTAMP '2024-01-12 12:00:00' AS own FROM msg), w AS (SELECT r.root_id AS th FROM t r JOIN t p ON
  p.event_id = r.root_id AND NOT p.own AND p.sent_at < TIMESTAMP '2024-01-10' AND p.root_id IS NULL WHERE r.own UNION SELECT p.event_id FROM t p JOIN t r ON r.root_id = p.event_id
  AND r.sent_at >= TIMESTAMP '2024-01-12 12:00:00' WHERE p.own AND p.root_id IS NULL)
SELECT event_id FROM t WHERE NOT own AND coalesce(root_id, event_id) IN (SELECT th FROM w)""")
def jon11(spark, sf):
    m = V.msg(spark, sf)
    at = lambda x: F.lit(x).cast("timestamp")
    return S.thread_context(m.withColumn("w", F.lit("T0")), at("2024-01-10"), at("2024-01-12 12:00:00"), "thread", ["w"], "event_id", "root_id").select("event_id")


_UNIT_ROWS = "unit_rows AS (SELECT o_orderkey AS unit_key, ['pending', 'running', 'done', 'failed', 'retry_later', 'paused'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS status, CASE WHEN o_orderkey % 6 = 4 THEN o_orderdate END AS retry_after FROM orders)"


def _unit_rows(spark, sf):
    o = V.read(spark, sf, "orders")
    states = F.array(*[F.lit(x) for x in ("pending", "running", "done", "failed", "retry_later", "paused")])
    return o.select(F.col("o_orderkey").alias("unit_key"), F.element_at(states, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("status"), F.when(F.col("o_orderkey") % 6 == 4, F.col("o_orderdate").cast("timestamp")).alias("retry_after"))


def _at(x):
    return F.lit(x).cast("timestamp")


@register("flt5_startable", f"WITH {_UNIT_ROWS} SELECT unit_key, status FROM unit_rows WHERE status IN ('pending', 'running', 'paused') OR (status = 'retry_later' AND retry_after <= TIMESTAMP '1998-01-01')")
def flt5(spark, sf):
    return S.startable(_unit_rows(spark, sf), _at("1998-01-01")).select("unit_key", "status")


@register("flt5_remaining", f"""WITH {_UNIT_ROWS} SELECT count(*) FILTER (WHERE status NOT IN ('done', 'failed')) AS remaining, CAST(min(epoch(retry_after) - epoch(TIMESTAMP '1998-01-01')) FILTER (WHERE status =
  'retry_later' AND retry_after > TIMESTAMP '1998-01-01') AS BIGINT) AS next_retry_s FROM unit_rows""")
def flt5b(spark, sf):
    return S.remaining(_unit_rows(spark, sf), _at("1998-01-01"))


@register("jon23_rerun_set", f"WITH {V.UNITS}, {_SCOPES.replace('u AS (SELECT', 'ud AS (SELECT').replace('FROM u JOIN', 'FROM ud u JOIN')} SELECT c.unit_key, 'N' || c.scope_id AS scope_id FROM cov c JOIN units USING (unit_key) WHERE units.status = 'failed'")
def jon23(spark, sf):
    sc = _scopes(spark, sf)
    links = S.coverage(_unit_days(spark, sf), sc)
    names = sc.select(F.col("scope_id").alias("old_id"), F.concat(F.lit("N"), F.col("scope_id").cast("string")).alias("new_id"))
    return S.rerun_set(V.units(spark, sf).filter("kind <> 'directory'"), links, names)


_FILES = """files AS (SELECT 'E' || (o_custkey % 7) AS export_id, o_orderkey AS idx, CASE WHEN o_orderkey % 50 = 0 THEN ['channels.json', 'groups.json', 'users.json', 'notes.txt', 'dms.json'][CAST(o_orderkey // 50 % 5 AS INTEGER) + 1] WHEN o_orderkey % 53 = 0 THEN '__MACOSX/._x' WHEN o_orderkey % 59 = 0 THEN 'f' || (o_custkey % 40) || '/' WHEN o_orderkey % 61 = 0 THEN 'f' || (o_custkey % 40) || '/2026-02-30.json'
  ELSE 'f' || (o_custkey % 40) || '/' || strftime(o_orderdate, '%Y-%m-%d') || '.json' END AS name, o_orderkey * 97 % 1000003 AS off, CAST(floor(o_totalprice) AS BIGINT) % 300 AS csize FROM orders),
cls AS (SELECT *, CASE WHEN name LIKE '%/' THEN 'directory' WHEN name NOT LIKE '%/%' AND name LIKE '%.json' THEN 'metadata' WHEN try_cast(nullif(regexp_extract(name, '^[^/]+/(\\d{4}-\\d{2}-\\d{2})\\.json$', 1), '') AS DATE) IS NOT NULL THEN 'day' ELSE 'unknown' END AS kind, name LIKE '\\_\\_MACOSX/%' ESCAPE '\\' AS junk FROM files),
days AS (SELECT *, string_split(name, '/')[1] AS folder FROM cls WHERE kind = 'day'), convs AS (SELECT 'f' || (c_custkey % 60) AS folder, 'C' || (c_custkey % 60) AS conversation_id, c_custkey AS idx, CASE WHEN c_nationkey > 5 THEN 'T' || (c_nationkey % 4) END AS team FROM customer WHERE c_custkey % 3 <> 0)"""


def _files(spark, sf):
    o = V.read(spark, sf, "orders")
    k, folder = F.col("o_orderkey"), F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string"))
    meta = F.element_at(F.array(*[F.lit(x) for x in ("channels.json", "groups.json", "users.json", "notes.txt", "dms.json")]), (F.floor(k / 50) % 5 + 1).cast("int"))
    name = F.when(k % 50 == 0, meta).when(k % 53 == 0, "__MACOSX/._x").when(k % 59 == 0, F.concat(folder, F.lit("/"))).when(k % 61 == 0, F.concat(folder, F.lit("/2026-02-30.json"))).otherwise(F.concat(folder, F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".json")))
    f = o.select(F.concat(F.lit("E"), (F.col("o_custkey") % 7).cast("string")).alias("export_id"), k.alias("idx"), name.alias("name"), (k * 97 % 1000003).alias("off"), (F.floor("o_totalprice").cast("long") % 300).alias("csize"))
    return A.classify(f)


def _convs(spark, sf):
    c = V.read(spark, sf, "customer").filter("c_custkey % 3 <> 0")
    n = (F.col("c_custkey") % 60).cast("string")
    return c.select(F.concat(F.lit("f"), n).alias("folder"), F.concat(F.lit("C"), n).alias("conversation_id"), F.col("c_custkey").alias("idx"), F.when(F.col("c_nationkey") > 5, F.concat(F.lit("T"), (F.col("c_nationkey") % 4).cast("string"))).alias("team"))


@register("flt4_classify_entries", f"WITH {_FILES} SELECT idx, kind, junk, CASE WHEN kind = 'day' THEN string_split(name, '/')[1] END AS folder FROM cls")
def flt4(spark, sf):
    return _files(spark, sf).select("idx", "kind", "junk", "folder")


@register("jon1_enumerate_units", f"""WITH {_FILES}, named AS (SELECT DISTINCT d.export_id, c.conversation_id, CAST(regexp_extract(d.name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE) AS day FROM days d JOIN (SELECT *, 'E' || (idx % 7) AS export_id FROM convs) c USING (export_id, folder)),
s AS (SELECT s_suppkey AS scope_id, 'E' || (s_suppkey % 7) AS export_id, CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE 'C' || (s_suppkey % 60) END AS external_id, TIMESTAMP '1992-01-01' + INTERVAL (CAST(s_suppkey * 37 % 2400 AS INTEGER)) DAY + INTERVAL (CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 0 END) HOUR AS date_from, s_suppkey % 400 + 1 AS n FROM supplier),
r AS (SELECT *, CAST(date_from AS DATE) - 1 AS first, CAST(date_from + INTERVAL (CAST(n AS INTEGER)) DAY - INTERVAL 1 MICROSECOND AS DATE) + 1 AS last FROM s)
SELECT scope_id, export_id, conversation_id, CAST(day AS VARCHAR) AS day FROM named JOIN r USING (export_id) WHERE (external_id = '*' OR external_id = conversation_id) AND day BETWEEN first AND last""")
def jon1(spark, sf):
    """A scope for each supplier, of one conversation or all, over days or a year."""
    p = V.read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    start = F.unix_seconds(F.lit("1992-01-01").cast("timestamp")) + k * 37 % 2400 * 86400 + F.when(k % 2 == 0, 21600).otherwise(0)
    scopes = p.select(k.alias("scope_id"), F.concat(F.lit("E"), (k % 7).cast("string")).alias("export_id"), F.when(k % 5 == 0, "*").otherwise(F.concat(F.lit("C"), (k % 60).cast("string"))).alias("external_id"), F.timestamp_seconds(start).alias("date_from"), F.timestamp_seconds(start + (k % 400 + 1) * 86400).alias("date_to"))
    convs = _convs(spark, sf).withColumn("export_id", F.concat(F.lit("E"), (F.col("idx") % 7).cast("string")))
    return S.enumerate_units(_files(spark, sf).filter("kind = 'day'"), convs, scopes).withColumn("day", F.col("day").cast("string"))


@register("jon7_orphan_folders", f"WITH {_FILES} SELECT DISTINCT folder FROM days WHERE folder NOT IN (SELECT folder FROM convs)")
def jon7(spark, sf):
    return A.orphan_folders(_files(spark, sf).filter("kind = 'day'"), _convs(spark, sf))


@register("jon8_empty_conversations", f"WITH {_FILES} SELECT idx, conversation_id FROM convs WHERE folder NOT IN (SELECT folder FROM days)")
def jon8(spark, sf):
    return A.empty_conversations(_convs(spark, sf), _files(spark, sf).filter("kind = 'day'")).select("idx", "conversation_id")


@register("win4_overlaps", f"WITH {_FILES}, l AS (SELECT *, lag(off + 30 + csize) OVER (PARTITION BY export_id ORDER BY off, idx) AS p FROM files) SELECT idx, p AS previous_end FROM l WHERE off < p")
def win4(spark, sf):
    return A.overlaps(_files(spark, sf), "export_id", "off", "csize", "idx").select("idx", "previous_end")


@register("agg14_teams", f"WITH {_FILES} SELECT count(DISTINCT team) AS teams, count(*) FILTER (WHERE team IS NULL) AS without_team FROM convs")
def agg14(spark, sf):
    return A.teams(_convs(spark, sf), "team")


@register("agg15_workspace_vote", f"WITH {_FILES}, n AS (SELECT folder, team, count(*) AS n, min(idx) AS f FROM convs WHERE team IS NOT NULL GROUP BY ALL) SELECT folder, arg_max(team, (n, -f)) AS workspace FROM n GROUP BY folder")
def agg15(spark, sf):
    return A.workspace_vote(_convs(spark, sf), "folder", "team", "idx")


@register("agg17_duplicates", f"WITH {_FILES} SELECT folder, count(*) AS n FROM convs GROUP BY folder HAVING count(*) > 1")
def agg17(spark, sf):
    return A.duplicates(_convs(spark, sf), ["folder"])


@register("agg17_first_wins", f"WITH {_FILES} SELECT folder, min(idx) AS idx FROM convs GROUP BY folder")
def agg17b(spark, sf):
    return A.first_wins(_convs(spark, sf), ["folder"], "idx").select("folder", "idx")


def _listed(name, column, rows):
    """A count and a sample as JSON members."""
    return f"""'"{name}":' || (SELECT count(*) FROM ({rows})) || ',"{name}_sample":[' || coalesce((SELECT string_agg('"' || {column} || '"', ',' ORDER BY {column}) FROM (SELECT {column} FROM ({rows}) ORDER BY {column} LIMIT 100)), '') || ']'"""


_ENCODED = "(SELECT *, CASE WHEN idx % 3 = 0 THEN 'utf-8' ELSE 'cp437' END AS encoding FROM cls)"


@register("agg16_findings", f"""WITH {_FILES}, k AS (SELECT string_agg('"' || kind || '":' || n, ',' ORDER BY kind) AS e FROM (SELECT kind, count(*) AS n FROM cls GROUP BY kind)), o AS (SELECT DISTINCT folder FROM days WHERE folder NOT IN (SELECT folder FROM convs)), x AS (SELECT DISTINCT folder FROM convs WHERE folder NOT IN (SELECT folder FROM days)),
m AS (SELECT count(*) AS messages, count(*) FILTER (WHERE event_id % 5 <> 0) AS threaded, count(*) FILTER (WHERE event_id % 71 = 0) AS no_ts FROM events), t AS (SELECT count(*) AS n, count(DISTINCT team) AS teams, count(*) FILTER (WHERE team IS NULL) AS bare FROM convs),
c AS (SELECT string_agg('"' || encoding || '":{{"count":' || n || ',"sample":[' || s || ']}}', ',' ORDER BY encoding) AS j FROM (SELECT encoding, count(*) AS n, (SELECT string_agg('"' || name || '"', ',' ORDER BY name) FROM (SELECT name FROM {_ENCODED} i WHERE i.encoding = o.encoding ORDER BY name LIMIT 100)) AS s FROM {_ENCODED} o GROUP BY encoding))
SELECT '{{' || {_listed("anomalies", "name", "SELECT CAST(event_id AS VARCHAR) AS name FROM events WHERE event_id % 11 = 0")} || ',"conversations":' || t.n || ',' || {_listed("empty", "folder", "SELECT folder FROM x")} || ',"encodings":{{' || c.j || '}},"entries":{{' || k.e || '}},' || {_listed("junk", "name", "SELECT name FROM cls WHERE junk")}
  || ',' || {_listed("listed_twice", "folder", "SELECT folder FROM convs GROUP BY folder HAVING count(*) > 1")} || ',"messages":' || m.messages || ',' || {_listed("orphans", "folder", "SELECT folder FROM o")} || ',"teams":' || t.teams || ',"threaded":' || m.threaded || ',' || {_listed("unknown", "name", "SELECT name FROM cls WHERE kind = 'unknown'")}
  || ',' || {_listed("unparseable", "name", "SELECT name FROM cls WHERE kind = 'day' AND idx % 67 = 0")} || ',"without_team":' || t.bare || ',"without_ts":' || m.no_ts || '}}' AS findings FROM k, m, t, c""")
def agg16(spark, sf):
    e = F.col("event_id")
    m = V.msg(spark, sf).select((e % 5 != 0).alias("threaded"), F.when(e % 11 == 0, e.cast("string")).alias("anomaly"), (e % 71 == 0).alias("no_ts"))
    f = _files(spark, sf).withColumn("encoding", F.when(F.col("idx") % 3 == 0, "utf-8").otherwise("cp437")).withColumn("unparseable", (F.col("kind") == "day") & (F.col("idx") % 67 == 0))
    return A.findings(f, _convs(spark, sf), m)


@register("scl16_root_folder", f"""WITH {_FILES}, w AS (SELECT export_id, CASE WHEN export_id = 'E3' AND name NOT LIKE '%/%' THEN name WHEN name LIKE '\\_\\_MACOSX/%' ESCAPE '\\' THEN name ELSE 'Wrap ' || export_id
  || '/' || name END AS name FROM files), t AS (SELECT export_id, string_split(name, '/')[1] AS head, regexp_extract(name, '^[^/]*/(.*)$', 1) AS rest, name FROM w WHERE name NOT
  LIKE '\\_\\_MACOSX/%' ESCAPE '\\') SELECT export_id, CASE WHEN min(head) = max(head) AND bool_and(name LIKE '%/%') AND bool_or(rest IN ('channels.json', 'groups.json',
  'dms.json', 'mpims.json')) THEN min(head) || '/' END AS root FROM t GROUP BY export_id""")
def scl16(spark, sf):
    f = _files(spark, sf)
    n = F.when((F.col("export_id") == "E3") & ~F.col("name").contains("/"), F.col("name")).when(F.col("junk"), F.col("name")).otherwise(F.concat(F.lit("Wrap "), "export_id", F.lit("/"), "name"))
    return A.root_folder(f.withColumn("name", n), "export_id")


@register("scl15_tier", f"""WITH {_FILES}, g AS (SELECT export_id, bool_or(name IN ('channels.json', 'groups.json', 'dms.json', 'mpims.json')) AS c, bool_or(name IN ('groups.json', 'dms.json', 'mpims.json')) AS f,
  bool_or(name = 'users.json') AS u, CASE export_id WHEN 'E1' THEN 'pro' WHEN 'E2' THEN 'business_plus' WHEN 'E3' THEN 'free' END AS plan FROM cls WHERE kind = 'metadata' AND idx % 200 <> 50 GROUP BY export_id),
t AS (SELECT *, CASE WHEN NOT c THEN NULL WHEN f THEN 'full' ELSE 'public_only' END AS tier FROM g)
SELECT export_id, tier, NOT u AS users_missing, CASE WHEN tier IS NULL THEN NULL ELSE array_to_string(list_filter([
CASE WHEN NOT u THEN 'users_missing' END, CASE WHEN plan IN ('pro', 'free') AND tier <> 'public_only' THEN 'plan_does_not_give_tier' WHEN plan = 'business_plus' AND tier =
  'public_only' THEN 'public_only_despite_plan' END], lambda x: x IS NOT NULL), ',') END AS warnings,
  CASE WHEN tier IS NULL THEN NULL WHEN tier = 'public_only' THEN 7 ELSE 6 END AS blind_spots FROM t""")
def scl15(spark, sf):
    plan = F.expr("CASE export_id WHEN 'E1' THEN 'pro' WHEN 'E2' THEN 'business_plus' WHEN 'E3' THEN 'free' END")
    t = A.tier(_files(spark, sf).filter("kind = 'metadata' and idx % 200 <> 50").withColumn("plan", plan), "export_id", declared="plan")
    return t.select("export_id", "tier", "users_missing", F.array_join("warnings", ",").alias("warnings"), F.size("blind_spots").alias("blind_spots"))


@register("jon10_thread_roots", f"""WITH {V.MSG} SELECT r.event_id, r.root_id AS root_ts, p.event_id IS NULL AS root_missing, CAST(p.day AS VARCHAR) AS root_day FROM msg r LEFT JOIN msg p ON p.conversation_id =
  r.conversation_id AND p.event_id = r.root_id WHERE r.root_id IS NOT NULL""")
def jon10(spark, sf):
    m = V.msg(spark, sf)
    r = m.filter("root_id is not null").select("event_id", "conversation_id", F.col("root_id").alias("root_ts"))
    return L.thread_roots(r, m.withColumnRenamed("event_id", "ts"), ["conversation_id"]).select("event_id", "root_ts", "root_missing", F.col("root_day").cast("string").alias("root_day"))


def _slices(spark, sf):
    m = V.msg(spark, sf)
    return m.select("conversation_id", "day", F.col("event_id").alias("ts"), "sent_at", F.col("root_id").alias("context_root"), "author", "text")


@register("grp1_plain_parts", f"""WITH {V.MSG} SELECT event_id AS ts, CAST((row_number() OVER w - 1) // 7 + 1 AS INTEGER) AS part, CAST((count(*) OVER (PARTITION BY conversation_id, day) + 6) // 7 AS INTEGER) AS
  parts FROM msg WINDOW w AS (PARTITION BY conversation_id, day ORDER BY sent_at, event_id)""")
def grp1_plain(spark, sf):
    return L.plain_parts(_slices(spark, sf), ["conversation_id", "day"], ["sent_at", "ts"], 7).select("ts", "part", "parts")


def _greedy(cap: int, own: str = "1", root: str = "1", counted: bool = True) -> str:
    """Greedy parts as a recursion over a slice's events, with the part, its size and what is in it."""
    need = f"{own} + CASE WHEN o.r IS NOT NULL AND NOT list_contains(s.present, o.r) THEN {root} ELSE 0 END"
    again = f"CASE WHEN list_contains(s.present, o.ts) THEN {own} ELSE 0 END" if counted else "0"
    fresh = f"{own} + CASE WHEN o.r IS NOT NULL THEN {root} ELSE 0 END"
    held = "CASE WHEN o.r IS NULL THEN [o.ts] ELSE [o.ts, o.r] END"
    return f"""WITH RECURSIVE {V.MSG},
o AS (SELECT conversation_id, day, event_id AS ts, root_id AS r, row_number() OVER (PARTITION BY conversation_id, day ORDER BY sent_at, event_id) AS n FROM msg),
s AS (SELECT conversation_id, day, n, ts, 1 AS part, {fresh} AS total, {held} AS present FROM o WHERE n = 1
  UNION ALL SELECT o.conversation_id, o.day, o.n, o.ts, CASE WHEN s.total + {need} > {cap} THEN s.part + 1 ELSE s.part END,
    CASE WHEN s.total + {need} > {cap} THEN {fresh} ELSE s.total + {need} - {again} END,
    CASE WHEN s.total + {need} > {cap} THEN {held} ELSE list_concat(s.present, {held}) END
  FROM s JOIN o ON o.conversation_id = s.conversation_id AND o.day = s.day AND o.n = s.n + 1)"""


@register("grp1_split_parts", f"{_greedy(7)} SELECT ts, part FROM s")
def grp1(spark, sf):
    return L.split_parts(_slices(spark, sf), ["conversation_id", "day"], 7).select("ts", "part")


@register("grp2_split_by_entries", f"{_greedy(9, 'o.ts % 3', 'o.r % 3', counted=False)} SELECT ts, part FROM s")
def grp2(spark, sf):
    s = _slices(spark, sf).withColumn("entries", (F.col("ts") % 3).cast("int")).withColumn("root_entries", (F.col("context_root") % 3).cast("int"))
    return L.split_by_entries(s, ["conversation_id", "day"], 9).select("ts", "part")


@register("grp5_pages", f"{_greedy(10)} SELECT ts, part AS page FROM s")
def grp5(spark, sf):
    return L.pages(_slices(spark, sf), ["conversation_id", "day"], 10).select("ts", "page")


@register("grp3_context", f"""WITH {V.MSG}, p AS (SELECT conversation_id, day, event_id AS ts, root_id, (row_number() OVER (PARTITION BY conversation_id, day ORDER BY sent_at, event_id) - 1) // 7 + 1 AS part
  FROM msg), n AS (SELECT DISTINCT conversation_id, day, part, root_id FROM p WHERE root_id IS NOT NULL)
SELECT n.conversation_id, CAST(n.day AS VARCHAR) AS day, CAST(n.part AS INTEGER) AS part, n.root_id AS root_ts, CASE WHEN m.event_id IS NULL THEN 'parent_not_held' WHEN m.k % 3 <>
  0 THEN 'outside_file' ELSE 'out_of_scope' END AS marker FROM n LEFT JOIN msg m ON m.conversation_id = n.conversation_id AND m.event_id = n.root_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conversation_id = n.conversation_id AND p.day = n.day AND p.part = n.part AND p.ts = n.root_id)""")
def grp3(spark, sf):
    p = L.plain_parts(_slices(spark, sf), ["conversation_id", "day"], ["sent_at", "ts"], 7).withColumnRenamed("context_root", "root_ts")
    m = V.msg(spark, sf).select("conversation_id", F.col("event_id").alias("ts"), (F.col("k") % 3 != 0).alias("in_scope"))
    return L.context(p, m, "conversation_id").withColumn("day", F.col("day").cast("string"))


@register("grp4_externals", """WITH r AS (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS size, l_linenumber * 1000000 + l_partkey AS file_id FROM lineitem), e AS (SELECT *, size > 80000 AS pol, sum(size)
  OVER (PARTITION BY l_orderkey, size > 80000 ORDER BY size, file_id DESC, l_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM r) SELECT l_orderkey,
  count(*) FILTER (WHERE pol OR kept > 120000) AS externals, count(*) AS files FROM e GROUP BY l_orderkey""")
def grp4(spark, sf):
    f = V.read(spark, sf, "lineitem").select("l_orderkey", F.floor("l_extendedprice").cast("long").alias("size"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("file_id"))
    x = L.externals(f, ["l_orderkey"], "size", "file_id", 120000, 80000)
    return x.groupBy("l_orderkey").agg(F.count_if("external").alias("externals"), F.count(F.lit(1)).alias("files"))


@register("grp6_structure_violations", f"""WITH {V.MSG}, e AS (SELECT unit_key AS f, CAST(event_id - event_id % 2 * (CASE WHEN k = 7 THEN 1 ELSE 0 END) AS VARCHAR) AS id, CAST(root_id AS VARCHAR) AS parent, author FROM msg)
SELECT f, id AS what, 'duplicate_id' AS rule FROM e GROUP BY f, id HAVING count(*) > 1 UNION ALL SELECT DISTINCT f, parent, 'missing_parent' FROM e WHERE parent IS NOT NULL AND NOT
  EXISTS (SELECT 1 FROM e x WHERE x.f = e.f AND x.id = e.parent) UNION ALL SELECT DISTINCT f, author, 'unknown_participant' FROM e WHERE NOT EXISTS (SELECT 1 FROM msg p WHERE
  p.unit_key = e.f AND p.author = e.author AND p.k % 2 = 0)
UNION ALL SELECT DISTINCT unit_key, text, 'attachment_without_entry' FROM msg a WHERE NOT EXISTS (SELECT 1 FROM msg p WHERE p.unit_key = a.unit_key AND p.text = a.text AND p.k % 3 = 0)""")
def grp6(spark, sf):
    m = V.msg(spark, sf).withColumnRenamed("unit_key", "f")
    odd = F.when(F.col("k") == 7, F.col("event_id") % 2).otherwise(0)
    e = m.select("f", (F.col("event_id") - odd).cast("string").alias("id"), F.col("root_id").cast("string").alias("parent"), F.col("author").alias("participant"))
    people = m.filter("k % 2 = 0").select("f", F.col("author").alias("id"))
    return L.structure_violations(e, people, m.select("f", F.col("text").alias("name")), m.filter("k % 3 = 0").select("f", F.col("text").alias("name")), "f")


@register("win11_parts_check", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber) OR count(DISTINCT l_linenumber) <> count(*)")
def win11(spark, sf):
    return L.parts_check(V.read(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@register("scl7_local_days", "SELECT event_id, CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS local_day FROM events")
def scl7(spark, sf):
    return V.msg(spark, sf).select("event_id", L.local_day(F.col("sent_at"), "Asia/Kolkata").cast("string").alias("local_day"))


@register("scl7_day_bounds", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT CAST(day AS VARCHAR) AS day, CAST(CAST(day AS TIMESTAMP) - INTERVAL 330 MINUTE AS VARCHAR) AS
  day_start, CAST(CAST(day AS TIMESTAMP) + INTERVAL 1110 MINUTE AS VARCHAR) AS day_end FROM d""")
def scl7b(spark, sf):
    d = V.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return L.day_bounds(d, "Asia/Kolkata").select(*[F.col(c).cast("string").alias(c) for c in ("day", "day_start", "day_end")])


@register("jon26_units_of_local_day", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS local_day FROM orders) SELECT CAST(local_day AS VARCHAR) AS local_day, CAST(local_day - i AS VARCHAR) AS day FROM d, (SELECT unnest([0, 1]) AS i)")
def jon26(spark, sf):
    d = V.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("local_day")).distinct()
    return S.units_of_local_day(L.day_bounds(d, "Asia/Kolkata", "local_day")).select(F.col("local_day").cast("string").alias("local_day"), F.col("day").cast("string").alias("day"))


@register("srt2_stm8_slices", f"WITH {V.MSG} SELECT conversation_id, CAST(day AS VARCHAR) AS day, count(*) AS n, arg_min(event_id, (sent_at, event_id)) AS first_event FROM msg GROUP BY ALL")
def srt2(spark, sf):
    s = _slices(spark, sf).groupBy("conversation_id", "day").agg(F.count(F.lit(1)).alias("n"), F.min_by("ts", F.struct("sent_at", "ts")).alias("first_event"))
    return s.withColumn("day", F.col("day").cast("string"))


@register("snk4_manifests", f"""WITH {V.MSG}, p AS (SELECT *, CAST((row_number() OVER (PARTITION BY conversation_id, day ORDER BY event_id) - 1) // 7 + 1 AS INTEGER) AS part FROM msg) SELECT conversation_id,
CAST(day AS VARCHAR) AS day, part, '{{\"events\":[' || string_agg('{{\"ts\":' || event_id || ',\"author\":\"' || author || '\",\"text\":\"' || text || '\"}}', ',' ORDER BY event_id) || '],\"participants\":[' || string_agg(DISTINCT '\"' || author || '\"', ',' ORDER BY '\"' || author || '\"') || ']}}'
  AS manifest FROM p GROUP BY ALL""")
def snk4(spark, sf):
    p = L.plain_parts(_slices(spark, sf), ["conversation_id", "day"], ["ts"], 7)
    return L.manifests(p, ["conversation_id", "day", "part"], ["ts"], ["ts", "author", "text"]).withColumn("day", F.col("day").cast("string"))


@register("jon16_file_outcomes", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS file_id FROM lineitem), x AS (SELECT o_orderkey % 2000 AS file_id, arg_max(o_orderpriority, o_orderkey) AS reason FROM
  orders GROUP BY 1) SELECT r.l_orderkey, r.l_linenumber, r.file_id, CASE WHEN p.p_partkey IS NOT NULL THEN 'collected' ELSE 'refused: ' || x.reason END AS outcome FROM r LEFT JOIN
  part p ON p.p_partkey = r.file_id AND p.p_size > 10 LEFT JOIN x USING (file_id) WHERE x.reason IS NOT NULL""")
def jon16(spark, sf):
    r = V.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("file_id"))
    c = V.read(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("file_id"), F.sha2("p_name", 256).alias("sha256"))
    x = V.read(spark, sf, "orders").select((F.col("o_orderkey") % 2000).alias("file_id"), F.col("o_orderpriority").alias("reason"), F.col("o_orderkey").alias("seq"))
    return L.file_outcomes(r.join(x.select("file_id").distinct(), "file_id", "left_semi"), c, x).select("l_orderkey", "l_linenumber", "file_id", "outcome")


@register("jon17_conversation_info", """WITH s AS (SELECT o_custkey, o_orderpriority AS name, o_orderdate, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'), l AS (SELECT o_custkey, arg_max(name,
  (o_orderdate, o_orderkey)) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS k FROM s GROUP BY 1), w AS (SELECT o_custkey, string_agg(DISTINCT 'U' || (o_orderkey % 7), ',' ORDER BY 'U' || (o_orderkey % 7)) AS c FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
  SELECT c_custkey, coalesce(l.n, c_name) AS name, coalesce(l.k, c_name) AS known_names, coalesce(w.c, '') AS custodians FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN w ON w.o_custkey = c_custkey""")
def jon17(spark, sf):
    c, every = V.read(spark, sf, "customer"), V.read(spark, sf, "orders")
    o = every.filter("o_orderdate <= timestamp_ntz'1998-01-01'")
    s = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("name"), F.struct("o_orderdate", "o_orderkey").alias("collected_at"))
    e = c.select("c_custkey", F.col("c_name").alias("name"), F.lit(0).alias("idx"))
    k = F.col("o_orderkey")
    covered = every.select(F.col("o_custkey").alias("c_custkey"), F.when(k % 2 == 0, "custodian").otherwise("channel").alias("scope_type"), F.concat(F.lit("U"), (k % 7).cast("string")).alias("external_id"))
    out = L.conversation_info(c.select("c_custkey"), s, e, "c_custkey", F.struct(F.lit("2100-01-01").cast("timestamp_ntz"), F.lit(0).cast("long")), covered)
    return out.withColumn("known_names", F.array_join("known_names", ",")).withColumn("custodians", F.array_join("custodians", ","))


@register("jon15_latest_snapshot", """WITH s AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS reactions FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1) SELECT c_custkey,
  reactions FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def jon15(spark, sf):
    from ledgerlane.operators import versions as X

    c = V.read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("T0/"), F.col("c_custkey").cast("string")).alias("subject"))
    o = V.read(spark, sf, "orders").select(F.concat(F.lit("T0/"), F.col("o_custkey").cast("string"), F.lit("#reactions")).alias("subject"), F.struct("o_orderdate", "o_orderkey").alias("version"), F.col("o_orderdate").alias("collected_at"), F.col("o_orderpriority").alias("reactions"))
    return X.with_latest_snapshot(c, o, "subject", F.lit("1998-01-01").cast("timestamp_ntz")).select("c_custkey", "reactions")


@register("agg22_reconcile_render", f"""WITH {V.MSG} SELECT conversation_id, CAST(day AS VARCHAR) AS day, count(*) FILTER (WHERE event_id % 19 = 0) AS missing, count(*) FILTER (WHERE event_id % 23 = 0 AND event_id % 19
  <> 0) AS extra FROM msg GROUP BY ALL HAVING count(*) FILTER (WHERE event_id % 19 = 0 OR event_id % 23 = 0) > 0""")
def agg22(spark, sf):
    m = V.msg(spark, sf).select("conversation_id", "day", "subject", "event_id").withColumn("kind", F.lit("primary"))
    r = m.filter("event_id % 19 <> 0")
    r = r.unionByName(r.filter("event_id % 23 = 0"))
    out = L.reconcile_render(m, r, ["conversation_id", "day"])
    return out.withColumn("day", F.col("day").cast("string"))


_PRIMARY_LANES = ", ".join(f"sum(CASE WHEN prim THEN CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) ELSE 0 END) AS s{i}" for i in range(8))


@register("agg22_render_summary", f"""WITH {V.MSG}, v AS (SELECT *, event_id % 6 <> 0 AS prim, sha256(subject) AS h FROM msg), lanes AS (SELECT {_PRIMARY_LANES} FROM v), {CARRY}
SELECT (SELECT count(*) FROM v WHERE prim) AS items, (SELECT count(*) FROM v WHERE prim) AS primaries, (SELECT count(*) FROM v WHERE NOT prim) AS context_events, (SELECT count(*) FROM v WHERE NOT prim AND k % 3 = 0) AS out_of_scope_context,
  (SELECT count(*) FROM (SELECT DISTINCT conversation_id, day FROM v)) AS slices, (SELECT CAST(sum(k % 3) AS BIGINT) FROM v) AS edits, (SELECT count(*) FROM v WHERE event_id % 9 = 0) AS attachments, (SELECT count(*) FROM v WHERE event_id % 27 = 0) AS unavailable, (SELECT count(*) FROM v WHERE event_id % 45 = 0) AS externals,
  (SELECT count(*) FROM (SELECT DISTINCT conversation_id, day, event_id % 4 FROM v)) AS files, {HEX} AS digest FROM c0""")
def agg22b(spark, sf):
    e = F.col("event_id")
    m = V.msg(spark, sf).withColumn("kind", F.when(e % 6 != 0, "primary").otherwise("context")).withColumn("in_scope", F.col("k") % 3 != 0)
    m = m.withColumns({"edits": (F.col("k") % 3).cast("long"), "attachments": (e % 9 == 0).cast("long"), "unavailable": (e % 27 == 0).cast("long"), "externals": (e % 45 == 0).cast("long"), "part": e % 4})
    return L.render_summary(m, V.msg(spark, sf).filter(e % 6 != 0).select("subject"))


@register("agg23_natives", """WITH r AS (SELECT l_partkey AS sha256, count(DISTINCT l_linenumber > 6) AS n, min(CASE WHEN l_linenumber > 6 THEN 2 ELSE 1 END) AS size FROM lineitem GROUP BY 1), s AS (SELECT
  p_partkey AS sha256, CASE WHEN p_size = 7 THEN 9 ELSE 1 END AS size FROM part WHERE p_size <> 3), j AS (SELECT coalesce(r.sha256, s.sha256) AS sha256, CASE WHEN r.n > 1 THEN
  'two_sizes' WHEN r.n IS NULL THEN 'unreferenced' WHEN s.size IS NULL THEN 'missing' WHEN s.size <> r.size THEN 'wrong_size' END AS error FROM r FULL JOIN s USING (sha256)) SELECT
  * FROM j WHERE error IS NOT NULL""")
def agg23(spark, sf):
    r = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("sha256"), F.when(F.col("l_linenumber") > 6, 2).otherwise(1).alias("size"))
    s = V.read(spark, sf, "part").filter("p_size <> 3").select(F.col("p_partkey").alias("sha256"), F.when(F.col("p_size") == 7, 9).otherwise(1).alias("size"))
    return L.natives_check(r, s)


@register("jon22_registry_audit", """WITH r AS (SELECT doc_id AS storage_key, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'complete' END AS state, sha256(text) AS h, doc_id % 8 < 2 AS young FROM documents WHERE
  doc_id % 29 <> 0), s AS (SELECT doc_id AS storage_key, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0) SELECT
  coalesce(r.storage_key, s.storage_key) AS storage_key, CASE WHEN r.state IS NULL THEN 'shadow' WHEN s.h IS NULL AND r.state = 'complete' THEN 'missing' WHEN s.h IS NULL THEN CASE
  WHEN young THEN 'left_pending' ELSE 'needs_refetch' END WHEN s.h <> r.h THEN 'integrity_incident' WHEN r.state = 'pending' THEN 'completed' ELSE 'intact' END AS outcome FROM r
  FULL JOIN s USING (storage_key)""")
def jon22(spark, sf):
    d = V.read(spark, sf, "documents")
    i = F.col("doc_id")
    r = d.filter(i % 29 != 0).select(i.alias("storage_key"), F.when(i % 4 == 0, "pending").otherwise("complete").alias("state"), F.sha2("text", 256).alias("sha256"), F.when(i % 8 < 2, _at("2024-01-10")).otherwise(_at("2024-01-01")).alias("created_at"))
    s = d.filter(i % 11 != 0).select(i.alias("storage_key"), F.when(i % 13 == 0, "x").otherwise(F.sha2("text", 256)).alias("stored_sha256"))
    return U.registry_vs_stored(r, s, _at("2024-01-10 12:00:00"), "INTERVAL 1 DAY")


@register("src8_evidence_hashes", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def src8(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@register("agg11_evidence_summary", "SELECT CAST(min(o_orderdate) AS VARCHAR) AS first_until, CAST(max(o_orderdate) AS VARCHAR) AS last_until, count(*) AS objects, count(*) FILTER (WHERE o_orderstatus <> 'F') AS incomplete FROM orders")
def agg11(spark, sf):
    o = V.read(spark, sf, "orders").select(F.col("o_orderdate").alias("retain_until"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("pending").alias("state"))
    return U.evidence_summary(o).withColumns({c: F.col(c).cast("string") for c in ("first_until", "last_until")})


@register("agg12_retention_targets", """WITH o AS (SELECT DISTINCT l_partkey AS object_id, l_suppkey AS owner FROM lineitem), w AS (SELECT s_suppkey AS owner, CASE WHEN s_suppkey % 17 <> 0 THEN TIMESTAMP '2024-01-01' +
  INTERVAL (CAST(s_suppkey * 13 % 400 AS INTEGER)) DAY END AS u FROM supplier) SELECT object_id, CAST(CASE WHEN bool_or(u IS NULL) THEN NULL ELSE max(u) END AS VARCHAR) AS until,
  arg_max(owner, (CASE WHEN u IS NULL THEN 1 ELSE 0 END, coalesce(u, TIMESTAMP '1900-01-01'), owner)) AS owner FROM o JOIN w USING (owner) GROUP BY object_id""")
def agg12(spark, sf):
    o = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("owner")).distinct()
    k = F.col("s_suppkey")
    w = V.read(spark, sf, "supplier").select(k.alias("owner"), F.when(k % 17 != 0, F.timestamp_seconds(1704067200 + (k * 13 % 400) * 86400)).alias("until"))
    return U.retention_targets(o, w).withColumn("until", F.col("until").cast("string"))


@register("scl17_retain_target", """SELECT o_orderkey, CAST(least(TIMESTAMP '1998-01-01' + INTERVAL 90 DAY, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END, TIMESTAMP '1998-01-01' + INTERVAL 90 DAY)) AS
  VARCHAR) AS target, o_orderdate < least(TIMESTAMP '1998-01-01' + INTERVAL 30 DAY, least(TIMESTAMP '1998-01-01' + INTERVAL 90 DAY, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN
  o_orderdate END, TIMESTAMP '1998-01-01' + INTERVAL 90 DAY))) AS extend FROM orders""")
def scl17(spark, sf):
    o = V.read(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    t = U.retain_target(_at("1998-01-01"), "INTERVAL 90 DAYS", F.when(F.col("o_orderkey") % 3 != 0, F.col("d")))
    return o.select("o_orderkey", t.cast("string").alias("target"), U.extension_needed(F.col("d"), _at("1998-01-01"), "INTERVAL 30 DAYS", t).alias("extend"))


@register("set1_jon21_owner_union", """SELECT DISTINCT object_id, owner FROM (SELECT l_partkey AS object_id, 'job' || (l_orderkey % 50) AS owner FROM lineitem UNION ALL SELECT l_suppkey, 'item' || (l_orderkey % 50) FROM
  lineitem UNION ALL SELECT o_custkey, 'report' || (o_orderkey % 50) FROM orders)""")
def set1(spark, sf):
    l, o = V.read(spark, sf, "lineitem"), V.read(spark, sf, "orders")
    own = lambda x, c, k, p: x.select(F.col(c).alias("object_id"), F.concat(F.lit(p), (F.col(k) % 50).cast("string")).alias("owner"))
    return U.union_owners(own(l, "l_partkey", "l_orderkey", "job"), own(l, "l_suppkey", "l_orderkey", "item"), own(o, "o_custkey", "o_orderkey", "report"))


@register("set5_jon18_hold_scope", """WITH ob AS (SELECT p_partkey AS object_id, CASE WHEN p_size % 3 = 0 THEN p_partkey - p_partkey % 10 END AS archive_id, p_size % 5 <> 0 AS complete FROM part), m AS (SELECT
  l_partkey AS object_id FROM lineitem WHERE l_orderkey % 97 = 0 UNION SELECT l_suppkey FROM lineitem WHERE l_orderkey % 89 = 0) SELECT DISTINCT o2.object_id FROM m LEFT JOIN ob ON
  ob.object_id = m.object_id JOIN ob o2 ON o2.object_id = coalesce(ob.archive_id, m.object_id) WHERE o2.complete""")
def set5(spark, sf):
    p, l = V.read(spark, sf, "part"), V.read(spark, sf, "lineitem")
    ob = p.select(F.col("p_partkey").alias("object_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey") - F.col("p_partkey") % 10).alias("archive_id"), F.when(F.col("p_size") % 5 != 0, "complete").otherwise("pending").alias("state"))
    own = lambda c, n: l.filter(F.col("l_orderkey") % n == 0).select(F.col(c).alias("object_id"), F.lit("matter").alias("owner"))
    return U.hold_scope(ob, own("l_partkey", 97), own("l_suppkey", 89))


@register("jon20_held", "SELECT c_custkey AS id, c_custkey % 41 = 0 OR n_nationkey % 7 = 0 OR n_regionkey = 3 AS held FROM customer JOIN nation ON n_nationkey = c_nationkey")
def jon20(spark, sf):
    c = V.read(spark, sf, "customer").join(V.read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    name = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    rows = c.select(F.col("c_custkey").alias("id"), name("m", "c_custkey").alias("matter"), name("c", "n_nationkey").alias("client"), name("t", "n_regionkey").alias("tenant"))
    holds = rows.filter("id % 41 = 0").select(F.col("matter").alias("scope_id")).union(c.filter("n_nationkey % 7 = 0").select(name("c", "n_nationkey"))).union(c.filter("n_regionkey = 3").select(name("t", "n_regionkey")))
    return U.held(rows, holds, ["matter", "client", "tenant"]).select("id", "held")


@register("jon19_visible_jobs", "SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_custkey % 53 = 0 OR c_nationkey = 4 OR n_regionkey = 2")
def jon19(spark, sf):
    c = V.read(spark, sf, "customer").join(V.read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = V.read(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matter"), F.col("c_nationkey").alias("client"), F.col("n_regionkey").alias("tenant"))
    give = lambda t, x, cond: c.filter(cond).select(F.lit(t).alias("scope_type"), F.col(x).cast("string").alias("scope_id"))
    a = give("matter", "c_custkey", "c_custkey % 53 = 0").union(give("client", "c_nationkey", "c_nationkey = 4")).union(give("tenant", "n_regionkey", "n_regionkey = 2")).withColumn("revoked_at", F.lit(None).cast("timestamp"))
    gone = give("tenant", "n_regionkey", "n_regionkey = 1").withColumn("revoked_at", _at("2024-01-01"))
    return U.visible(rows, a.union(gone), {"matter": "matter", "client": "client", "tenant": "tenant"}).select("id")


@register("agg18_roles_by_scope", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS roles FROM orders GROUP BY 1")
def agg18(spark, sf):
    return U.roles_by_scope(V.read(spark, sf, "orders"), ["o_custkey"], "o_orderpriority").withColumn("roles", F.array_join("roles", ","))


@register("set2_memberships", "SELECT DISTINCT user_id, event_type AS grp FROM events WHERE event_id % 3 = 0 UNION SELECT user_id, event_type FROM events WHERE value > 50")
def set2(spark, sf):
    e = V.read(spark, sf, "events").select("user_id", F.col("event_type").alias("grp"), "event_id", "value")
    return U.memberships(e.filter("event_id % 3 = 0").select("user_id", "grp"), e.filter("value > 50").select("user_id", "grp"))


@register("agg26_eligible", "SELECT count(DISTINCT o_custkey) AS eligible FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND c_acctbal > 0")
def agg26(spark, sf):
    a = V.read(spark, sf, "orders").withColumnRenamed("o_custkey", "principal_id")
    p = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("principal_id"), (F.col("c_acctbal") > 0).alias("active"))
    return U.eligible_count(a, p, F.col("o_orderpriority") == "1-URGENT")


@register("flt8_list_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice < 200000")
def flt8(spark, sf):
    o = V.read(spark, sf, "orders")
    return U.list_jobs(o, {"o_orderstatus": "F", "o_orderpriority": None}, {"o_orderdate": (F.lit("1996-01-01").cast("timestamp_ntz"), None), "o_totalprice": (None, 200000)}).select("o_orderkey")


@register("flt9_keyset_page", f"WITH {V.UNITS} SELECT conversation_id, unit_key, job_id FROM conv_units WHERE (conversation_id, unit_key) > ('C15', 'C15/2024-01-10') ORDER BY conversation_id, unit_key LIMIT 51")
def flt9(spark, sf):
    u = V.units(spark, sf).filter("kind <> 'directory'")
    return U.keyset_page(u, ["conversation_id", "unit_key"], ("C15", "C15/2024-01-10"), 50).select("conversation_id", "unit_key", "job_id")


@register("flt10_prefix_search", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red w')")
def flt10(spark, sf):
    return V.read(spark, sf, "part").filter(T.with_prefix(F.col("p_name"), "red w")).select("p_partkey", "p_name")


@register("flt7_stale", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY")
def flt7(spark, sf):
    o = V.read(spark, sf, "orders").withColumn("state", F.col("o_orderstatus")).withColumn("d", F.col("o_orderdate").cast("timestamp"))
    return U.stale(o, ("P", "O"), "d", _at("1998-01-01"), "INTERVAL 365 DAYS").select("o_orderkey")


@register("flt6_deadlines", """SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'past' ELSE 'warn' END AS due FROM orders WHERE o_orderstatus <> 'F' AND (o_orderdate <= TIMESTAMP
  '1998-01-01' OR (o_orderdate <= TIMESTAMP '1998-02-01' AND o_orderkey % 2 = 0))""")
def flt6(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    p = V.read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", d).alias("resumed_at"), d.alias("deadline_at"), F.when(F.col("o_orderkey") % 2 != 0, d).alias("warned_at"))
    return U.deadlines(p, _at("1998-01-01"), "INTERVAL 31 DAYS").select("o_orderkey", "due")


@register("jon25_missing_partner", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def jon25(spark, sf):
    o = V.read(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").withColumnRenamed("o_custkey", "c_custkey")
    return U.missing_partner(V.read(spark, sf, "customer"), o, "c_custkey").select("c_custkey")


@register("set3_unlisted", "SELECT DISTINCT p_name AS name FROM part EXCEPT SELECT p_name FROM part WHERE p_size < 45")
def set3(spark, sf):
    p = V.read(spark, sf, "part").withColumnRenamed("p_name", "name")
    return U.unlisted(p, p.filter("p_size < 45"))


@register("set6_rerun_equal", "SELECT o_orderkey, 'first' AS side FROM orders WHERE o_orderkey % 101 = 0 UNION ALL SELECT o_orderkey, 'second' FROM orders WHERE o_orderkey % 103 = 0 AND o_orderkey % 101 <> 0")
def set6(spark, sf):
    o = V.read(spark, sf, "orders").select("o_orderkey")
    two = o.filter("o_orderkey % 101 <> 0")
    return U.rerun_equal(o, two.union(two.filter("o_orderkey % 103 = 0")))


@register("agg13_quota", """WITH u AS (SELECT o_custkey % 100 AS client, count(*) FILTER (WHERE o_orderstatus = 'O') AS in_flight,
  CAST(sum(CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS bytes, count(*) FILTER (WHERE o_orderstatus = 'F') AS ready FROM orders GROUP BY 1)
SELECT *, array_to_string(list_filter([CASE WHEN bytes > 24000000 THEN 'bytes' END, CASE WHEN in_flight > 50 THEN 'in_flight' END], lambda x: x IS NOT NULL), ',') AS "over" FROM u""")
def agg13(spark, sf):
    e = V.read(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("client"), F.when(F.col("o_orderstatus") == "O", "uploading").when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("state"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return U.quota(e, {"bytes": 24_000_000, "in_flight": 50}).withColumn("over", F.array_join("over", ","))


@register("win5_byte_budget", f"WITH {V.CHAIN}, t AS (SELECT stream, seq, sum(strlen(payload)) OVER (PARTITION BY stream ORDER BY seq) AS t FROM chain) SELECT stream, seq FROM t WHERE t <= 500 OR seq = 1")
def win5(spark, sf):
    return U.byte_budget_page(V.chain(spark, sf), "stream", "seq", "payload", 500).select("stream", "seq")


_OBSERVED = f"""{V.MSG}, seen AS (SELECT unit_key, CAST(event_id AS VARCHAR) AS item_id, subject, ['file_unavailable', 'file_became_available', 'access_lost', 'access_restored', 'no_longer_observed', 'observed_again', 'message'][CAST(event_id % 7 AS INTEGER) + 1] AS kind, event_id, k FROM msg)"""


@register("prj5_observations", f"""WITH {_OBSERVED} SELECT unit_key, item_id, kind, subject, CASE WHEN event_id % 7 < 2 THEN 'F' || (event_id % 50) END AS file_id, CASE WHEN event_id % 7 IN (0, 2) THEN 'r' || (k % 4) END AS reason, '2024-01-01T00:00:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || 'Z' AS observed_at FROM seen WHERE kind <> 'message'""")
def prj5(spark, sf):
    """Item-level events of all kinds, of which six are observations."""
    m, e, k = V.msg(spark, sf), F.col("event_id"), F.col("k")
    kind = F.element_at(F.array(*[F.lit(x) for x in (*OBSERVATIONS, "message")]), (e % 7 + 1).cast("int"))
    derived = F.to_json(F.struct(F.when(e % 7 < 2, F.concat(F.lit("F"), (e % 50).cast("string"))).alias("file_id"), F.when((e % 7).isin(0, 2), F.concat(F.lit("r"), (k % 4).cast("string"))).alias("reason"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z")).alias("observed_at")))
    return N.observations(m.select("unit_key", e.cast("string").alias("item_id"), kind.alias("kind"), "subject", derived.alias("derived")))


@register("agg10_observation_counts", f"WITH {_OBSERVED} SELECT kind, CASE WHEN event_id % 7 IN (0, 2) THEN 'r' || (k % 4) END AS reason, count(*) AS n FROM seen WHERE kind <> 'message' GROUP BY ALL")
def agg10(spark, sf):
    return prj5(spark, sf).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("scl8_mentions", """WITH t AS (SELECT event_id, '<@U' || user_id || '> and <@U' || (user_id % 7) || '|x> <@U' || user_id || '>' AS t FROM events) SELECT event_id,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '<@([A-Z0-9]+)(\\|[^>]*)?>', 1))), ',') AS mentions FROM t""")
def scl8(spark, sf):
    u = F.col("user_id").cast("string")
    t = F.concat(F.lit("<@U"), u, F.lit("> and <@U"), (F.col("user_id") % 7).cast("string"), F.lit("|x> <@U"), u, F.lit(">"))
    return V.read(spark, sf, "events").select("event_id", F.array_join(T.mentions(t), ",").alias("mentions"))


@register("scl11_redact", """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'xox[abeoprs]-[A-Za-z0-9-]{8,}', '[REDACTED]', 'g'),
  'xapp-\\d-[A-Za-z0-9-]{8,}', '[REDACTED]', 'g'), '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]{8,}', '[REDACTED]', 'g'), '\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}',
  '[REDACTED]', 'g'), '\\b(AKIA|ASIA)[A-Z0-9]{16}\\b', '[REDACTED]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g')) AS
  redacted FROM documents""")
def scl11(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted"))


#: JSON strings with a pair, a first half, an escaped backslash and a second half.
_HALVES = (r'"a\ud83d\ude00"', r'"a\ud83d b"', r'"\\ud83d"', r'"\\\ude00z"')


@register("scl9_lone_surrogates", r"""SELECT doc_id, doc_id % 4 IN (1, 3) AS lone, CASE doc_id % 4 WHEN 1 THEN '55357' WHEN 3 THEN '56832' ELSE '' END AS units,
  CASE doc_id % 4 WHEN 0 THEN 'a' || chr(128512) WHEN 1 THEN 'a' || chr(65533) || ' b' WHEN 2 THEN '\ud83d' ELSE '\' || chr(65533) || 'z' END AS text FROM documents""")
def scl9(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in _HALVES]), (F.col("doc_id") % 4 + 1).cast("int"))
    parsed = F.from_json(F.concat(F.lit("["), T.make_valid(raw), F.lit("]")), "array<string>")
    return V.read(spark, sf, "documents").select("doc_id", T.has_lone_surrogate(raw).alias("lone"), F.array_join(T.lone_surrogates(raw), ",").alias("units"), F.get(parsed, F.lit(0)).alias("text"))


#: One character of each kind that is revealed, added to texts by their ids.
_REVEALED = (0x61C, 0x85, 0xFDD0, 0xAD, 0x2028, 0x1FFFE, 0x200B, 0x2069, 0x41)


@register("scl12_reveal_invisible", rf"""WITH t AS (SELECT doc_id, text || chr([{", ".join(map(str, _REVEALED))}][CAST(doc_id % {len(_REVEALED)} AS INTEGER) + 1]) || 'z' AS t FROM documents),
c AS (SELECT doc_id, t, regexp_extract_all(t, '(?s).') AS cs FROM t)
SELECT doc_id, md5(CASE WHEN t IS NULL THEN NULL ELSE array_to_string(list_transform(cs, lambda x: CASE
  WHEN regexp_matches(x, '[\x{{61C}}\x{{200E}}\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{FDD0}}-\x{{FDEF}}]') OR unicode(x) % 65536 >= 65534 THEN printf('[U+%04X]', unicode(x))
  WHEN regexp_matches(x, '[\p{{Cf}}\p{{Zl}}\p{{Zp}}\t\n\r]') THEN x || printf('[U+%04X]', unicode(x)) ELSE x END), '') END) AS revealed FROM c""")
def scl12(spark, sf):
    added = F.element_at(F.array(*[F.lit(chr(c)) for c in _REVEALED]), (F.col("doc_id") % len(_REVEALED) + 1).cast("int"))
    return V.read(spark, sf, "documents").select("doc_id", F.md5(T.reveal_invisible(F.concat("text", added, F.lit("z")))).alias("revealed"))


# of the letters in documents, folding changes the case and the sharp s only
@register("scl10_search_key", "SELECT doc_id, substr(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 1, 1024) AS search_key FROM documents")
def scl10(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", T.search_key(F.col("text")).alias("search_key"))


@register("scl14_error_parts", """WITH e AS (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ': ' || o_orderstatus || ': x' ELSE '' END AS e FROM orders) SELECT o_orderkey, CASE WHEN
  instr(e, ': ') > 0 THEN substr(e, 1, instr(e, ': ') - 1) ELSE e END AS error_type, CASE WHEN instr(e, ': ') > 0 THEN substr(e, instr(e, ': ') + 2) ELSE '' END AS error_message
  FROM e""")
def scl14(spark, sf):
    e = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(": "), "o_orderstatus", F.lit(": x"))).otherwise(""))
    a, b = K.error_parts(e)
    return V.read(spark, sf, "orders").select("o_orderkey", a.alias("error_type"), b.alias("error_message"))


_NAMES = """n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '/' || source || ': report.txt' WHEN 1 THEN 'e' || chr(769) || 'tude ' || source || '.' || repeat('x', 16)
  WHEN 2 THEN 'draft.' || repeat('y', 17) WHEN 3 THEN ' ..' || repeat(source, 60) || '.pdf ' ELSE 'a' || chr(8238) || 'b?.' END AS o FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(o), '[/\\\\<>:"|?*\\p{C}]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM n),
e AS (SELECT doc_id, s, regexp_extract(s, '^.+\\.([^.]*)$', 1) AS ext FROM s),
x AS (SELECT doc_id, CASE WHEN ext <> '' AND strlen(ext) <= 16 THEN substr(s, 1, length(s) - length(ext) - 1) ELSE s END AS stem, CASE WHEN ext <> '' AND strlen(ext) <= 16 THEN '.' || ext ELSE '' END AS suffix FROM e)"""


@register("scl18_attachment_names", f"""WITH {_NAMES} SELECT doc_id, 'F' || doc_id || '_' || CASE WHEN strlen(stem) > 200 - strlen('F' || doc_id || '_' || suffix) THEN substr(stem, 1, CAST(200 - strlen('F' || doc_id ||
  '_' || suffix) AS BIGINT)) ELSE stem END || suffix AS name FROM x""")
def scl18(spark, sf):
    i = F.col("doc_id") % 5
    name = (
        F.when(i == 0, F.concat("lang", F.lit("/"), "source", F.lit(": report.txt"))).when(i == 1, F.concat(F.lit("étude "), "source", F.lit("." + "x" * 16))).when(i == 2, "draft." + "y" * 17)
        .when(i == 3, F.concat(F.lit(" .."), F.repeat("source", 60), F.lit(".pdf "))).otherwise("a‮b?.")
    )
    return V.read(spark, sf, "documents").select("doc_id", T.attachment_name(F.concat(F.lit("F"), F.col("doc_id").cast("string")), name).alias("name"))


@register("scl19_event_mapping", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' ELSE 'message' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'type=' || event_type || ';user=' ||
  user_id ELSE 'type=' || event_type END AS custom FROM events""")
def scl19(spark, sf):
    sub = F.expr("CASE event_type WHEN 'signup' THEN 'channel_join' WHEN 'error' THEN 'channel_leave' END")
    fields = L.custom_fields(user=F.when(F.col("user_id") % 2 == 0, F.col("user_id")), type=F.col("event_type"))
    return V.read(spark, sf, "events").select("event_id", L.event_type(sub, F.col("event_type")).alias("kind"), F.array_join(F.transform(fields, lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";").alias("custom"))


@register("scl20_participants", f"""WITH {V.MSG}, p AS (SELECT DISTINCT unit_key, author AS user_id FROM msg UNION SELECT unit_key, 'U' || (k % 7) FROM msg) SELECT p.unit_key, p.user_id, coalesce(nullif(trim(CASE
  WHEN c.c_custkey % 3 = 0 THEN ' ' ELSE c.c_mktsegment END), ''), nullif(trim(c.c_name), ''), p.user_id) AS name FROM p LEFT JOIN customer c ON 'U' || c.c_custkey = p.user_id""")
def scl20(spark, sf):
    m = V.msg(spark, sf).withColumn("m", F.array(F.concat(F.lit("U"), (F.col("k") % 7).cast("string"))))
    n = V.read(spark, sf, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("display_name"), F.col("c_name").alias("real_name"))
    return L.participants(m, ["unit_key"], "author", "m", n).select("unit_key", "user_id", "name")
