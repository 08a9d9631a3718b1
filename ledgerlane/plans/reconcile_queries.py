"""Queries of reconciliation, rollup and ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.functions import status as S
from ledgerlane.operators import reconcile as R
from ledgerlane.operators.registry import register
from ledgerlane.plans import views as V


@register("flagship_worst_units", f"""WITH {V.UNITS} SELECT unit_key, job_id, conversation_id, state, place, expected_count, collected, file_gaps, (SELECT count(*) FROM ranked WHERE place < 5) AS total FROM ranked
  WHERE place < 5 ORDER BY place, conversation_id, unit_key, job_id LIMIT 100""")
def flagship(spark, sf):
    """AGG-1, WIN-3, SRT-3: the 100 worst units and how many there are."""
    u = V.reconciled(spark, sf)
    state = S.severity(F.col("status"), F.col("recon_status"))
    u = u.select("unit_key", "job_id", "conversation_id", state.alias("state"), S.rank(state).alias("place"), "expected_count", "collected", "file_gaps").filter("place < 5")
    return R.capped(u, ["place", "conversation_id", "unit_key", "job_id"], 100).drop("more")


@register("agg1_unit_status", f"WITH {V.UNITS} SELECT job_id, unit_key, kind, recon_status FROM units")
def agg1(spark, sf):
    return V.reconciled(spark, sf).select("job_id", "unit_key", "kind", "recon_status")


@register("agg1_archive_status", f"""WITH {V.UNITS} SELECT unit_key, CASE WHEN access_lost THEN 'access_lost' WHEN expected_count IS NOT NULL AND collected = expected_count AND file_gaps = 0 AND len(gap_reasons) = 0
  THEN 'matched_against_archive' ELSE 'gap' END AS recon_status FROM conv_units""")
def agg1_archive(spark, sf):
    return R.unit_status(V.units(spark, sf).filter("kind <> 'directory'"), archive=True).select("unit_key", "recon_status")


@register("agg2_archive_accounting", f"""WITH {V.MSG}, f AS (SELECT conversation_id || '/' || CAST(day - CAST(event_id % 11 = 0 AS INTEGER) AS VARCHAR) AS entry, day - CAST(event_id % 11 = 0 AS INTEGER) AS hint, day,
  subject FROM msg) SELECT entry, count(DISTINCT subject) AS messages, count(DISTINCT CASE WHEN day <> hint THEN subject END) AS anomalies FROM f GROUP BY entry""")
def agg2(spark, sf):
    m = V.msg(spark, sf).withColumn("hint_day", F.date_sub("day", F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)))
    return R.archive_accounting(m.withColumn("entry", K.unit_key(F.col("conversation_id"), F.col("hint_day"))))


@register("agg3_job_status", f"""WITH {V.UNITS}, j AS (SELECT job_id, bool_or(status = 'failed') AS f, bool_or(recon_status IN ('gap', 'surplus', 'access_lost')) AS g, bool_or(recon_status = 'unverifiable') AS u FROM units WHERE kind = 'conversation_day' GROUP BY job_id)
SELECT job_id, CASE WHEN f THEN 'completed_with_failed_units' WHEN g THEN 'completed_with_gaps' WHEN u THEN 'completed_unverified' ELSE 'completed' END AS job_status FROM j""")
def agg3(spark, sf):
    return R.job_status(V.reconciled(spark, sf))


@register("agg3_job_summary", f"WITH {V.UNITS}, c AS (SELECT job_id, state, count(*) AS n FROM ranked WHERE kind = 'conversation_day' GROUP BY job_id, state) SELECT job_id, string_agg(state || '=' || n, ',' ORDER BY state) AS summary FROM c GROUP BY job_id")
def agg3_summary(spark, sf):
    s = R.job_summary(V.reconciled(spark, sf))
    return s.select("job_id", F.array_join(F.transform(F.map_entries("units"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("summary"))


@register("agg4_counts_zero_rows", f"""WITH {V.UNITS}, v AS (SELECT unnest(['pending', 'matched', 'gap', 'surplus', 'unverifiable', 'failed', 'access_lost', 'not_applicable', 'matched_against_archive']) AS value,
  unnest(range(9)) AS place) SELECT value, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM units WHERE recon_status = value) AS n FROM v""")
def agg4(spark, sf):
    return R.counts_with_zero_rows(V.reconciled(spark, sf), "recon_status", S.RECON_STATUS)


@register("agg7_totals", f"WITH {V.UNITS} SELECT CAST(sum(coalesce(expected_count, 0)) AS BIGINT) AS expected_count, CAST(sum(coalesce(collected, 0)) AS BIGINT) AS collected, CAST(sum(coalesce(file_gaps, 0)) AS BIGINT) AS file_gaps FROM units")
def agg7(spark, sf):
    return R.totals(V.reconciled(spark, sf))


@register("agg8_conversation_rollup", f"""WITH {V.UNITS}, c AS (SELECT conversation_id, state, place, count(*) AS n, sum(coalesce(expected_count, 0)) AS e, sum(collected) AS c, sum(file_gaps) AS g FROM ranked WHERE kind <> 'directory' GROUP BY ALL)
SELECT conversation_id, CAST(sum(n) AS BIGINT) AS units, arg_min(state, place) AS worst, string_agg(state || '=' || n, ',' ORDER BY state) AS by_status, CAST(sum(e) AS BIGINT) AS
  expected_count, CAST(sum(c) AS BIGINT) AS collected, CAST(sum(g) AS BIGINT) AS file_gaps FROM c GROUP BY conversation_id""")
def agg8(spark, sf):
    r = R.conversation_rollup(V.reconciled(spark, sf))
    return r.withColumn("by_status", F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@register("jon4_collected_by_own_day", f"""WITH {V.MSG}, u AS (SELECT DISTINCT unit_key, conversation_id, day FROM msg), l AS (SELECT event_id AS item_id, conversation_id || '/' || strftime(day - CAST(event_id % 7 = 0 AS INTEGER), '%Y-%m-%d') AS unit_key FROM msg),
h AS (SELECT DISTINCT u.conversation_id, l.item_id FROM l JOIN u USING (unit_key)), c AS (SELECT h.conversation_id, m.day, count(DISTINCT m.subject) AS n FROM h JOIN msg m ON m.event_id = h.item_id GROUP BY ALL)
SELECT u.unit_key, coalesce(c.n, 0) AS collected FROM u LEFT JOIN c ON c.conversation_id = u.conversation_id AND c.day = u.day""")
def jon4(spark, sf):
    m = V.msg(spark, sf)
    u = m.select("unit_key", "conversation_id", "day").distinct()
    shifted = F.date_sub("day", F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    links = m.select(F.col("event_id").alias("item_id"), K.unit_key(F.col("conversation_id"), shifted).alias("unit_key"))
    return R.collected(links, u, m.select(F.col("event_id").alias("item_id"), "subject", "day")).select("unit_key", "collected")


_TWO_JOBS = """two AS (SELECT 'A' AS job_id, unit_key, event_id AS item_id FROM msg UNION ALL SELECT 'B', unit_key, event_id FROM msg WHERE event_id % 13 <> 0),
tu AS (SELECT DISTINCT job_id, unit_key, CASE WHEN hash_n % 5 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN hash_n % 7 = 0 THEN 'gap' ELSE 'matched' END AS recon_status, hash_n % 3 AS file_gaps FROM (SELECT job_id, unit_key, CAST(substr(unit_key, -2) AS INTEGER) AS hash_n FROM two)),
base AS (SELECT DISTINCT j.job_id, j.unit_key, t.item_id FROM tu j JOIN two t ON t.unit_key = j.unit_key AND t.job_id <> j.job_id JOIN tu o ON o.job_id = t.job_id AND o.unit_key = t.unit_key WHERE o.status = 'done' AND o.recon_status = 'matched' AND o.file_gaps = 0)"""


def _two_jobs(spark, sf):
    m = V.msg(spark, sf).select("unit_key", F.col("event_id").alias("item_id"))
    two = m.withColumn("job_id", F.lit("A")).unionByName(m.filter("item_id % 13 <> 0").withColumn("job_id", F.lit("B")))
    n = F.substring("unit_key", -2, 2).cast("int")
    tu = two.select("job_id", "unit_key").distinct().select("job_id", "unit_key", F.when(n % 5 == 0, "failed").otherwise("done").alias("status"), F.when(n % 7 == 0, "gap").otherwise("matched").alias("recon_status"), (n % 3).alias("file_gaps"))
    return two, tu


@register("jon5_clean_baseline", f"WITH {V.MSG}, {_TWO_JOBS} SELECT job_id, unit_key, count(*) AS n FROM base GROUP BY ALL")
def jon5(spark, sf):
    return R.baseline(*_two_jobs(spark, sf)).groupBy("job_id", "unit_key").agg(F.count(F.lit(1)).alias("n"))


@register("jon6_no_longer_observed", f"""WITH {V.MSG}, {_TWO_JOBS} SELECT b.job_id, b.unit_key, b.item_id FROM base b JOIN tu c ON c.job_id = b.job_id AND c.unit_key = b.unit_key AND c.status = 'done' AND c.recon_status =
  'matched' AND c.file_gaps = 0 WHERE NOT EXISTS (SELECT 1 FROM two o WHERE o.job_id = b.job_id AND o.unit_key = b.unit_key AND o.item_id = b.item_id) AND b.item_id % 10 <> 3""")
def jon6(spark, sf):
    two, tu = _two_jobs(spark, sf)
    clean = tu.filter("status = 'done' and recon_status = 'matched' and file_gaps = 0")
    reported = two.select("item_id").filter("item_id % 10 = 3").distinct()
    return R.absence(R.baseline(two, tu), two, clean, reported).select("job_id", "unit_key", "item_id")


@register("jon13_pauses", f"""WITH {V.CHAIN}, p AS (SELECT c.stream, c.seq, c.moment AS paused_at, (SELECT min(e.seq) FROM chain e WHERE e.stream = c.stream AND e.seq > c.seq AND e.event_type IN ('job_resumed')) AS es FROM chain c WHERE c.event_type = 'job_paused')
SELECT p.stream, p.seq, CAST(epoch_us(p.paused_at) AS BIGINT) AS paused_us, CAST(CAST(epoch_us(e.moment) AS BIGINT) AS VARCHAR) AS resumed_us, coalesce(e.event_type, 'not_ended') AS ended_how FROM p LEFT JOIN chain e ON e.stream = p.stream AND e.seq = p.es""")
def jon13(spark, sf):
    p = R.pauses(V.chain(spark, sf), "job_paused", ("job_resumed",))
    return p.select("stream", "seq", F.unix_micros("paused_at").alias("paused_us"), F.unix_micros("resumed_at").cast("string").alias("resumed_us"), "ended_how")


@register("agg19_pause_time", f"""WITH {V.CHAIN}, p AS (SELECT c.stream, c.moment AS paused_at, (SELECT min(e.seq) FROM chain e WHERE e.stream = c.stream AND e.seq > c.seq AND e.event_type = 'job_resumed') AS es FROM chain c WHERE c.event_type = 'job_paused')
SELECT coalesce(e.event_type, 'not_ended') AS ended_how, count(*) AS n, CAST(sum(CAST(epoch_us(coalesce(e.moment, TIMESTAMP '2024-02-01')) AS BIGINT) // 1000 -
  CAST(epoch_us(p.paused_at) AS BIGINT) // 1000) AS BIGINT) AS paused_ms FROM p LEFT JOIN chain e ON e.stream = p.stream AND e.seq = p.es GROUP BY 1""")
def agg19(spark, sf):
    return R.pause_time(R.pauses(V.chain(spark, sf), "job_paused", ("job_resumed",)), F.lit("2024-02-01").cast("timestamp"))


@register("agg20_gap_reasons", f"WITH {V.MSG} SELECT unit_key, string_agg(DISTINCT text || '_' || (k % 3), ',' ORDER BY text || '_' || (k % 3)) AS gap_reasons FROM msg GROUP BY unit_key")
def agg20(spark, sf):
    m = V.msg(spark, sf).select("unit_key", F.array(F.concat_ws("_", "text", (F.col("k") % 3).cast("string"))).alias("gap_reasons"))
    return R.gap_reasons(m, "unit_key", "gap_reasons").withColumn("gap_reasons", F.array_join("gap_reasons", ","))


@register("srt1_unit_order", f"WITH {V.UNITS} SELECT row_number() OVER (ORDER BY coalesce(conversation_id, ''), coalesce(CAST(day AS VARCHAR), ''), unit_key, job_id) AS place, unit_key, job_id FROM units")
def srt1_all(spark, sf):
    """SRT-1, all units in the order of the units file."""
    order = [F.coalesce("conversation_id", F.lit("")), F.coalesce(F.col("day").cast("string"), F.lit("")), F.col("unit_key"), F.col("job_id")]
    return R.unit_order(V.units(spark, sf), order).select("place", "unit_key", "job_id")


@register("agg9_actor_counts", f"WITH {V.CHAIN} SELECT event_type, actor, count(*) AS n FROM chain GROUP BY ALL")
def agg9(spark, sf):
    return V.chain(spark, sf).groupBy("event_type", "actor").agg(F.count(F.lit(1)).alias("n"))


@register("scl13_unit_key_parts", f"""WITH {V.UNITS} SELECT job_id, unit_key, regexp_extract(unit_key, '^(.*)/[^/]*$', 1) AS conversation, CAST(try_cast(nullif(regexp_extract(unit_key, '/(\\d{{4}}-\\d{{2}}-\\d{{2}})$',
  1), '') AS DATE) AS VARCHAR) AS day, kind FROM units""")
def scl13(spark, sf):
    u = V.units(spark, sf).select("job_id", "unit_key")
    key = F.col("unit_key")
    return u.select("job_id", "unit_key", F.coalesce(K.unit_conversation(key), F.lit("")).alias("conversation"), K.unit_day(key).cast("string").alias("day"), K.unit_kind(key).alias("kind"))
