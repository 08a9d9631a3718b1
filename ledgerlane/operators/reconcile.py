"""Reconciling expected with collected counts, and rolling them up to a job's status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.functions import status as S
from ledgerlane.operators.ordered import TASK_ROWS, last_known


def collected(links: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    """JON-4: distinct messages of a unit's own day that are linked to any unit of its conversation.

    links (item_id, unit_key), units (unit_key, conversation_id, day), items (item_id, subject, day)."""
    held = links.join(units.select("unit_key", "conversation_id"), "unit_key").select("conversation_id", "item_id").distinct()
    own = held.join(items.select("item_id", "subject", "day"), "item_id")
    counts = own.groupBy("conversation_id", "day").agg(F.countDistinct("subject").alias("collected"))
    return units.join(counts, ["conversation_id", "day"], "left").withColumn("collected", F.coalesce("collected", F.lit(0)))


def unit_status(units: DataFrame, archive: bool = False) -> DataFrame:
    """AGG-1 as a column recon_status."""
    c = F.col
    return units.withColumn("recon_status", S.unit_recon(c("kind"), c("access_lost"), c("expected_count"), c("collected"), c("file_gaps"), c("gap_reasons"), archive))


def archive_accounting(messages: DataFrame, entry: str = "entry", hint_day: str = "hint_day", subject: str = "subject", day: str = "day") -> DataFrame:
    """AGG-2: distinct messages of each day file, and those whose own day is not the file's."""
    off = F.col(day) != F.col(hint_day)
    return messages.groupBy(entry).agg(F.countDistinct(subject).alias("messages"), F.countDistinct(F.when(off, F.col(subject))).alias("anomalies"))


def job_status(units: DataFrame, jobs: DataFrame | None = None, archive: bool = False) -> DataFrame:
    """AGG-3: status of each job from its units (job_id, kind, status, recon_status); jobs (job_id,
    stop_reason) lists those without any unit too."""
    own = units.filter("kind = 'conversation_day'")
    sums = own.groupBy("job_id").agg(
        F.bool_or(~F.col("status").isin("done", "failed")).alias("unsettled"), F.bool_or(F.col("status") == "failed").alias("failed"),
        F.bool_or(F.col("recon_status").isin("gap", "surplus", "access_lost")).alias("gaps"), F.bool_or(F.col("recon_status") == "unverifiable").alias("unverified"),
    )
    every = units.groupBy("job_id").agg(F.lit(True).alias("enumerated"))
    base = jobs if jobs is not None else units.select("job_id").distinct().withColumn("stop_reason", F.lit(None).cast("string"))
    out = base.join(every, "job_id", "left").join(sums, "job_id", "left")
    done = "completed_against_archive" if archive else "completed"
    status = (
        F.when(F.col("stop_reason") == "cancel", "cancelled").when(F.col("stop_reason") == "job_failure", "failed").when(F.col("enumerated").isNull() | F.coalesce("unsettled", F.lit(False)), "failed")
        .when(F.col("failed"), "completed_with_failed_units").when(F.col("gaps"), "completed_with_gaps").when(F.col("unverified"), "completed_unverified").otherwise(done)
    )
    return out.select("job_id", status.alias("job_status"))


def job_summary(units: DataFrame) -> DataFrame:
    """AGG-3's summary: units of each job by severity."""
    own = units.filter("kind = 'conversation_day'").withColumn("state", S.severity(F.col("status"), F.col("recon_status")))
    counts = own.groupBy("job_id", "state").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("units"))


def counts_with_zero_rows(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """AGG-4: rows by a status, every value listed in its order, unknown ones after."""
    order = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, place int")
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.join(F.broadcast(order), "value", "full")
    return full.select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(values))).alias("place"))


def totals(units: DataFrame) -> DataFrame:
    """AGG-7: expected, collected and file gaps of all units; null counts 0."""
    return units.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("expected_count", "collected", "file_gaps")])


def conversation_rollup(units: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG-8: units, worst status, counts by status and totals of each conversation, without the directory."""
    keys = keys or ["conversation_id"]
    own = units.filter("kind <> 'directory'").withColumn("state", S.severity(F.col("status"), F.col("recon_status")))
    by = own.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("expected_count", "collected", "file_gaps")])
    return by.groupBy(*keys).agg(
        F.sum("n").alias("units"), F.min_by("state", F.struct(S.rank(F.col("state")), "state")).alias("worst"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("by_status"),
        *[F.sum(c).alias(c) for c in ("expected_count", "collected", "file_gaps")],
    )


def capped(rows: DataFrame, order: list, cap: int) -> DataFrame:
    """WIN-3: the cap worst rows by order, with the exact total and whether there are more.

    A sorted limit keeps cap rows per task; the total is a separate aggregate of one row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(cap).crossJoin(F.broadcast(total)).withColumn("more", F.col("total") > cap)  # one row


def unit_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """SRT-1: rows with ``place`` from 1 in the total order of ``order``, all of them.

    Rows are range partitioned and sorted, and each partition's rows are numbered after those of the
    partitions before it, so no task sees all rows."""
    from ledgerlane.plans.shared import materialized

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = materialized(spread.withColumn("_n", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row per partition of the range exchange
    before = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = before.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_n") + F.col("_before") + 1).cast("long").alias("place"))


def gap_reasons(rows: DataFrame, key: str, reasons: str) -> DataFrame:
    """AGG-20: sorted distinct union of arrays per key."""
    each = rows.select(key, F.explode(reasons).alias("reason")).distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("reason")).alias(reasons))


def baseline(links: DataFrame, units: DataFrame) -> DataFrame:
    """JON-5: (job_id, unit_key, item_id) of items that OTHER jobs hold in the same unit, where that unit
    was done, matched and without file gaps."""
    clean = units.filter("status = 'done' and recon_status = 'matched' and file_gaps = 0").select(F.col("job_id").alias("other"), "unit_key")
    held = links.select(F.col("job_id").alias("other"), "unit_key", "item_id").join(clean, ["other", "unit_key"])
    jobs = units.select("job_id", "unit_key").distinct()
    return jobs.join(held, "unit_key").filter("job_id <> other").select("job_id", "unit_key", "item_id").distinct()


def absence(baseline: DataFrame, observed: DataFrame, clean_units: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """JON-6: items seen before in a unit that is clean now, and not seen now, unless already reported."""
    now = baseline.join(clean_units.select("job_id", "unit_key"), ["job_id", "unit_key"], "left_semi")
    gone = now.join(observed.select("job_id", "unit_key", "item_id"), ["job_id", "unit_key", "item_id"], "left_anti")
    return gone if reported is None else gone.join(reported.select("item_id"), "item_id", "left_anti")


def pauses(events: DataFrame, starts: str, ends: tuple[str, ...], stream: str = "stream", seq: str = "seq", kind: str = "event_type", at: str = "at", task_rows: int = TASK_ROWS) -> DataFrame:
    """JON-13: each pause with the first later end of its stream; one end closes every open pause. Other events are
    left out first; the rest is read once, from the last to the first."""
    end = F.when(F.col(kind).isin(*ends), F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind"), F.col(at).alias("at")))
    own = events.filter((F.col(kind) == starts) | F.col(kind).isin(*ends)).withColumn("_end", end)
    out = last_known(own, stream, [seq], "_end", "end", descending=True, task_rows=task_rows).filter(F.col(kind) == starts)
    return out.select(stream, seq, F.col(at).alias("paused_at"), F.col("end.at").alias("resumed_at"), F.coalesce("end.kind", F.lit("not_ended")).alias("ended_how"))


def pause_time(paused: DataFrame, as_of) -> DataFrame:
    """AGG-19: paused milliseconds and number of pauses by how they ended."""
    ms = F.unix_millis(F.coalesce("resumed_at", as_of)) - F.unix_millis("paused_at")
    return paused.groupBy("ended_how").agg(F.count(F.lit(1)).alias("n"), F.sum(ms).alias("paused_ms"))
