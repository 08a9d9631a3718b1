"""Scopes and units: coverage, merged ranges, thread context, what can start, what is run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thread policies, the most inclusive last.
POLICIES = ("none", "parent", "thread")


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """WIN-6: half-open ranges of each key with overlapping and touching ones joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)).over(w)
    out = rows.withColumn("_reach", reach).withColumn("_island", island)
    return out.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def in_scope(at: Column, ranges: Column) -> Column:
    """FLT-1: whether a range of an array of (date_from, date_to) holds at; no ranges or no time: true."""
    hit = F.exists(ranges, lambda r: (at >= r["date_from"]) & (at < r["date_to"]))
    return at.isNull() | F.coalesce(F.size(ranges) == 0, F.lit(True)) | hit


def messages_in_scope(messages: DataFrame, scopes: DataFrame, key: str = "conversation_id", at: str = "sent_at") -> DataFrame:
    """FLT-1 for tables: messages with ``in_scope``: whether a range of their key's scopes (key, date_from, date_to) holds
    them; a key without scopes or no time: true.

    Ranges of a key are merged first and cut into bins of days, so a message meets the ranges of its own bin only, which
    neither overlap nor touch."""
    ends = scopes.groupBy(key, "date_from").agg(F.max("date_to").alias("date_to"))
    day = lambda c: F.unix_date(F.to_date(c))
    ranges = merge_intervals(ends.filter("date_from < date_to"), [key], "date_from", "date_to")
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(day("date_from") / BIN), F.floor(day("date_to") / BIN))))
    held = binned.groupBy(key, "_bin").agg(F.collect_list(F.struct("date_from", "date_to")).alias("_ranges"))
    keys = scopes.select(key, F.lit(True).alias("_scoped")).distinct()
    j = messages.withColumn("_bin", F.floor(day(at) / BIN)).join(held, [key, "_bin"], "left").join(keys, key, "left")
    hit = F.coalesce(F.exists("_ranges", lambda r: (F.col(at) >= r["date_from"]) & (F.col(at) < r["date_to"])), F.lit(False))
    return j.select(*messages.columns, (F.col(at).isNull() | F.col("_scoped").isNull() | hit).alias("in_scope"))


def unit_day_filter(at: Column, day: Column) -> Column:
    """FLT-3: whether at is on the UTC day."""
    return (at >= day.cast("timestamp")) & (at < F.date_add(day, 1).cast("timestamp"))


def coverage(units: DataFrame, scopes: DataFrame, every: str = "*") -> DataFrame:
    """JON-2: (unit_key, scope_id) of units (unit_key, conversation_id, day) and scopes (scope_id,
    external_id, date_from, date_to); ``*`` covers every conversation. Each unit meets the scopes of its
    conversation and those of ``*`` by key; the range is tested inside the join."""
    keyed = units.withColumn("_key", F.explode(F.array("conversation_id", F.lit(every))))
    day, nxt = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    on = (F.col("_key") == F.col("external_id")) & (F.col("date_from") < nxt) & (F.col("date_to") > day)
    return keyed.join(scopes, on).select("unit_key", "scope_id").distinct()


#: Days of a bin in which days meet the ranges of scopes.
BIN = 32


def enumerate_units(day_files: DataFrame, conversations: DataFrame, scopes: DataFrame, every: str = "*") -> DataFrame:
    """JON-1: scope_id, export_id, conversation_id and day of the units that each scope takes from its export: the days
    of the export's day files (export_id, folder, hint_day) of listed conversations (export_id, folder, conversation_id)
    from one day before its range to one day after it, since a file's day may be another zone's.

    scopes (scope_id, export_id, external_id, date_from, date_to) may be many; ``*`` takes every conversation. Days and
    ranges are cut into bins and meet by export, conversation and bin, so neither a long range nor ``*`` is tested
    against all days, and the days of one key are spread over its bins."""
    units = day_files.select("export_id", "folder", F.col("hint_day").alias("day")).join(conversations.select("export_id", "folder", "conversation_id").distinct(), ["export_id", "folder"])
    units = units.select("export_id", "conversation_id", "day").distinct()
    keyed = units.withColumn("_key", F.explode(F.array("conversation_id", F.lit(every)))).withColumn("_bin", F.floor(F.unix_date("day") / BIN))
    first = F.date_sub(F.to_date("date_from"), 1)
    last = F.date_add(F.to_date(F.timestamp_micros(F.unix_micros("date_to") - 1)), 1)
    ranged = scopes.select("scope_id", "export_id", F.col("external_id").alias("_key"), first.alias("_first"), last.alias("_last")).filter("_first <= _last")
    binned = ranged.withColumn("_bin", F.explode(F.sequence(F.floor(F.unix_date("_first") / BIN), F.floor(F.unix_date("_last") / BIN))))
    return keyed.join(binned, ["export_id", "_key", "_bin"]).filter(F.col("day").between(F.col("_first"), F.col("_last"))).select("scope_id", "export_id", "conversation_id", "day")


def effective_scope(units: DataFrame, scopes: DataFrame) -> DataFrame:
    """JON-3: the collection range and thread policy of every unit (unit_key, conversation_id, day).

    The policy is the most inclusive one of the scopes that cover the unit, or of all scopes if none does. The
    ranges are those of the scopes that cover any unit of its conversation, merged; without such a scope those
    of the scopes that give its policy. The unit's own range is the first of them that touches its day, or from
    the first's beginning to the last's end. scopes: how many cover the unit. Scopes are those of one job, so
    their merged ranges fit in a row."""
    rank = F.array_position(F.array(*[F.lit(p) for p in POLICIES]), F.col("thread_parent_policy"))
    ranked = scopes.withColumn("_rank", rank)
    covered = coverage(units, scopes).join(ranked.select("scope_id", "_rank", "thread_parent_policy", "date_from", "date_to"), "scope_id")
    policy = covered.groupBy("unit_key").agg(F.max_by("thread_parent_policy", "_rank").alias("policy"), F.count(F.lit(1)).alias("scopes"))

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        ranges = merge_intervals(rows, keys, "date_from", "date_to")
        return ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date_from", "date_to"))).alias("ranges"))

    own = covered.join(units.select("unit_key", "conversation_id"), "unit_key").select("conversation_id", "scope_id", "date_from", "date_to").distinct()
    every = merged(scopes.select(F.lit(0).alias("_job"), "date_from", "date_to"), ["_job"])
    fallback = ranked.select(F.lit(0).alias("_job"), "thread_parent_policy", "_rank").groupBy("_job").agg(F.max_by("thread_parent_policy", "_rank").alias("_policy"))
    fallback = every.withColumnRenamed("ranges", "_ranges").join(fallback, "_job")
    rows = units.select("unit_key", "conversation_id", "day").join(policy, "unit_key", "left").join(merged(own, ["conversation_id"]), "conversation_id", "left").withColumn("_job", F.lit(0))
    rows = rows.join(F.broadcast(fallback), "_job").withColumn("_r", F.coalesce("ranges", "_ranges"))  # one row
    start, end = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    touching = F.get(F.filter("_r", lambda r: (r["date_from"] < end) & (r["date_to"] > start)), F.lit(0))
    whole = F.struct(F.get("_r", F.lit(0))["date_from"].alias("date_from"), F.element_at("_r", -1)["date_to"].alias("date_to"))
    out = rows.withColumn("_own", F.coalesce(touching, whole))
    return out.select("unit_key", F.col("_own.date_from").alias("date_from"), F.col("_own.date_to").alias("date_to"), F.coalesce("policy", "_policy").alias("policy"), F.coalesce("scopes", F.lit(0)).cast("long").alias("scopes"), F.col("_r").alias("ranges"))


def scope_index(scopes: DataFrame, job: str, order: list[str]) -> DataFrame:
    """WIN-12: place of each scope in its job, from 0."""
    return scopes.withColumn("scope_index", F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1)


def thread_context(messages: DataFrame, date_from: Column, date_to: Column, policy: str, keys: list[str], ts: str = "ts", root: str = "root_ts", at: str = "sent_at") -> DataFrame:
    """JON-11: messages outside [date_from, date_to) that those inside need: the parents of replies whose
    parent is earlier (``parent``), the whole threads of those and of parents with replies at or after the
    end (``thread``)."""
    if policy == "none":
        return messages.limit(0)
    inside = (F.col(at) >= date_from) & (F.col(at) < date_to)
    own, rest = messages.filter(inside), messages.filter(~inside)
    early = rest.filter((F.col(at) < date_from) & F.col(root).isNull()).select(*keys, F.col(ts).alias(root))
    wanted = own.filter(F.col(root).isNotNull()).select(*keys, root).join(early, [*keys, root], "left_semi").distinct()
    if policy == "parent":
        return rest.join(wanted.withColumnRenamed(root, ts), [*keys, ts], "left_semi")
    late = rest.filter((F.col(at) >= date_to) & F.col(root).isNotNull()).select(*keys, root)
    started = own.filter(F.col(root).isNull()).select(*keys, F.col(ts).alias(root)).join(late, [*keys, root], "left_semi")
    threads = wanted.unionByName(started).distinct().withColumnRenamed(root, "_thread")
    return rest.withColumn("_thread", F.coalesce(F.col(root), F.col(ts))).join(threads, [*keys, "_thread"], "left_semi").drop("_thread")


def select_messages(messages: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """FLT-2: messages whose keys are wanted, with their own index in the page."""
    return messages.join(wanted.select(*keys), keys, "left_semi")


def startable(units: DataFrame, as_of: Column) -> DataFrame:
    """FLT-5: units that may start now: pending, running, paused, or retry_later that is due."""
    return units.filter(F.col("status").isin("pending", "running", "paused") | ((F.col("status") == "retry_later") & (F.coalesce("retry_after", as_of) <= as_of)))


def remaining(units: DataFrame, as_of: Column) -> DataFrame:
    """FLT-5: units that aren't settled, and the seconds to the next retry if none may start."""
    wait = F.when((F.col("status") == "retry_later") & (F.col("retry_after") > as_of), F.unix_seconds("retry_after") - F.unix_seconds(as_of))
    return units.agg(F.count_if(~F.col("status").isin("done", "failed")).alias("remaining"), F.min(wait).alias("next_retry_s"))


def rerun_set(units: DataFrame, links: DataFrame, renamed: DataFrame) -> DataFrame:
    """JON-23: failed units with their scopes under the new job's scope ids (old_id, new_id)."""
    failed = units.filter("status = 'failed'").select("unit_key")
    return failed.join(links, "unit_key").join(renamed.withColumnRenamed("old_id", "scope_id"), "scope_id").select("unit_key", F.col("new_id").alias("scope_id"))


def units_of_local_day(bounds: DataFrame, start: str = "day_start", end: str = "day_end") -> DataFrame:
    """JON-26: UTC days that a zone's local day touches; an empty day touches none."""
    days = F.sequence(F.to_date(start), F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")))
    return bounds.filter(F.col(start) < F.col(end)).withColumn("day", F.explode(days))
