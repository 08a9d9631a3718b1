"""Adapter views over the driver tables, in Spark and as SQL; both give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions import keys as K


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def msg(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a workspace: conversation, ids, time, author, text, change hint, thread root, unit."""
    e = read(spark, sf, "events")
    conversation = F.concat(F.lit("C"), (F.col("user_id") % 20).cast("string"))
    e = e.select(
        conversation.alias("conversation_id"), "event_id", F.concat_ws("/", F.lit("T0"), conversation, F.col("event_id").cast("string")).alias("subject"), F.col("ts").cast("timestamp").alias("sent_at"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("author"),
        F.col("event_type").alias("text"), F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") - F.col("event_id") % 5).alias("root_id"), F.to_date("ts").alias("day"), "value",
    )
    return e.withColumn("unit_key", K.unit_key(F.col("conversation_id"), F.col("day")))


MSG = """msg AS (SELECT 'C' || (user_id % 20) AS conversation_id, event_id, 'T0/C' || (user_id % 20) || '/' || event_id AS subject, ts AS sent_at, 'U' || user_id AS author, event_type AS text,
  CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k, CASE WHEN event_id % 5 <> 0 THEN event_id - event_id % 5 END AS root_id, CAST(ts AS DATE) AS day, value, 'C' || (user_id % 20) || '/' || strftime(ts, '%Y-%m-%d') AS unit_key FROM events)"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation-days of msg with expected and collected counts, and one directory unit per job."""
    m = msg(spark, sf)
    n = F.substring("conversation_id", 2, 9).cast("int") * 31 + F.dayofmonth("day")
    u = m.groupBy("unit_key", "conversation_id", "day").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("event_id") % 97 != 0).alias("collected"), F.count_if((F.col("text") == "error") & (F.col("event_id") % 53 == 0)).alias("file_gaps"))
    u = u.withColumn("n", n).select(
        F.concat(F.lit("J"), (F.substring("conversation_id", 2, 9).cast("int") % 4).cast("string")).alias("job_id"), "unit_key", "conversation_id", "day", F.lit("conversation_day").alias("kind"),
        F.when(F.col("n") % 37 == 0, None).otherwise(F.col("n_all") - F.when(F.col("n") % 29 == 0, 1).otherwise(0)).alias("expected_count"), "collected", "file_gaps",
        F.when(F.col("n") % 41 == 0, "failed").otherwise("done").alias("status"), F.when(F.col("n") % 43 == 0, F.array(F.lit("history_limited"))).otherwise(F.array().cast("array<string>")).alias("gap_reasons"), (F.col("n") % 47 == 0).alias("access_lost"),
    )
    d = u.select("job_id").distinct().select("job_id", F.lit("directory").alias("unit_key"), F.lit("").alias("conversation_id"), F.lit(None).cast("date").alias("day"), F.lit("directory").alias("kind"), F.lit(None).cast("long").alias("expected_count"), F.lit(0).cast("long").alias("collected"), F.lit(0).cast("long").alias("file_gaps"), F.lit("done").alias("status"), F.array().cast("array<string>").alias("gap_reasons"), F.lit(False).alias("access_lost"))
    return u.unionByName(d)


UNITS = MSG + """, raw_units AS (SELECT unit_key, conversation_id, day, count(*) AS n_all, count(*) FILTER (WHERE event_id % 97 <> 0) AS collected, count(*) FILTER (WHERE text = 'error' AND event_id % 53 = 0) AS file_gaps,
  CAST(substr(conversation_id, 2) AS INTEGER) * 31 + day(day) AS n FROM msg GROUP BY unit_key, conversation_id, day),
conv_units AS (SELECT 'J' || (CAST(substr(conversation_id, 2) AS INTEGER) % 4) AS job_id, unit_key, conversation_id, day, 'conversation_day' AS kind, CASE WHEN n % 37 = 0 THEN NULL ELSE n_all - CASE WHEN n % 29 = 0 THEN 1 ELSE 0 END END AS expected_count,
  collected, file_gaps, CASE WHEN n % 41 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n % 43 = 0 THEN ['history_limited'] ELSE []::VARCHAR[] END AS gap_reasons, n % 47 = 0 AS access_lost FROM raw_units),
all_units AS (SELECT * FROM conv_units UNION ALL SELECT DISTINCT job_id, 'directory', '', NULL::DATE, 'directory', NULL::BIGINT, 0::BIGINT, 0::BIGINT, 'done', []::VARCHAR[], false FROM conv_units),
units AS (SELECT *, CASE WHEN kind = 'directory' THEN 'not_applicable' WHEN access_lost THEN 'access_lost' WHEN expected_count IS NULL THEN 'unverifiable' WHEN collected < expected_count OR file_gaps > 0 OR len(gap_reasons) > 0 THEN 'gap' WHEN collected > expected_count THEN 'surplus' ELSE 'matched' END AS recon_status FROM all_units),
ranked AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' ELSE recon_status END AS state, coalesce(list_position(['failed', 'access_lost', 'gap', 'surplus', 'unverifiable', 'matched_against_archive', 'pending', 'matched', 'not_applicable'], CASE WHEN status = 'failed' THEN 'failed' ELSE recon_status END), 10) - 1 AS place FROM units)"""


def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerlane.operators import reconcile

    return reconcile.unit_status(units(spark, sf))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of customers: content is the order priority, in order of date and key; two change markers, one of
    which is not always there, and neither of which is always known."""
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    hints = F.when(k % 7 != 0, F.create_map(F.lit("edited"), "o_orderstatus", F.lit("pinned"), F.when(k % 3 != 0, (k % 2).cast("string"))))
    return o.select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("content_hash"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("hint"), hints.alias("hints"))


VERSIONS = "versions AS (SELECT o_custkey AS subject, o_orderpriority AS content_hash, o_orderdate AS moment, o_orderkey AS seq, o_orderstatus AS hint, o_orderkey % 7 <> 0 AS known, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS edited, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 AS VARCHAR) END AS pinned FROM orders)"


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Ten event streams: stream, seq from 1, event_type, actor, payload, created_at."""
    from pyspark.sql.window import Window

    m = msg(spark, sf)
    stream = F.concat(F.lit("S"), (F.substring("author", 2, 9).cast("int") % 10).cast("string"))
    kind = F.expr("CASE text WHEN 'signup' THEN 'items_collected' WHEN 'view' THEN 'unit_reconciled' WHEN 'click' THEN 'file_unavailable' WHEN 'error' THEN 'job_paused' ELSE 'job_resumed' END")
    rows = m.select(stream.alias("stream"), kind.alias("event_type"), F.col("author").alias("actor"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("payload"), F.col("sent_at").alias("at"), "event_id")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("stream").orderBy("event_id")).cast("long"))


CHAIN = MSG + """, chain AS (SELECT 'S' || (CAST(substr(author, 2) AS INTEGER) % 10) AS stream, CASE text WHEN 'signup' THEN 'items_collected' WHEN 'view' THEN 'unit_reconciled' WHEN 'click' THEN 'file_unavailable' WHEN 'error' THEN 'job_paused' ELSE 'job_resumed' END AS event_type,
  author AS actor, 'k' || k AS payload, sent_at AS moment, event_id, row_number() OVER (PARTITION BY CAST(substr(author, 2) AS INTEGER) % 10 ORDER BY event_id) AS seq FROM msg)"""
