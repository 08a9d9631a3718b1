"""Slices (conversation and local day), their parts, contexts and manifests."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_day(at: Column, zone: str) -> Column:
    """SCL-7: day of an instant in a zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def _instant(day: dt.date, zone: ZoneInfo) -> dt.datetime:
    """First instant at or after local midnight of a day that the zone has; the earlier of two."""
    naive = dt.datetime.combine(day, dt.time())
    early, late = (naive.replace(tzinfo=zone, fold=f).astimezone(dt.UTC) for f in (0, 1))
    if early.astimezone(zone).replace(tzinfo=None) == naive:
        return early
    lo, hi = min(early, late), max(early, late)  # midnight is in a gap: find the gap's end
    before = lo.astimezone(zone).utcoffset()
    while hi - lo > dt.timedelta(microseconds=1):
        mid = lo + (hi - lo) / 2
        lo, hi = (mid, hi) if mid.astimezone(zone).utcoffset() == before else (lo, mid)
    return hi


def day_bounds(days: DataFrame, zone: str, day: str = "day") -> DataFrame:
    """SCL-7 / UDF-4: UTC start and end of local days, exact across changes of the clock; days is a small
    dimension of distinct days."""

    @F.pandas_udf("day_start timestamp, day_end timestamp")
    def bounds(d: pd.Series) -> pd.DataFrame:
        z = ZoneInfo(zone)
        return pd.DataFrame({"day_start": [_instant(x, z) for x in d], "day_end": [_instant(x + dt.timedelta(days=1), z) for x in d]})

    return days.withColumn("_b", bounds(day)).select(*days.columns, "_b.day_start", "_b.day_end")


def event_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SRT-2: a slice's events by time, then ts, inside partitions by slice."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "sent_at", "ts")


def _split(rows: DataFrame, keys: list[str], cap: int, entries: bool) -> DataFrame:
    """Greedy parts of sorted slices; each task carries the part it is in, not the slice."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, part, total, present = None, 0, 0, set()
        for batch in batches:
            parts = []
            sizes = batch["entries"] if entries else [1] * len(batch)
            roots = batch["root_entries"] if entries else [1] * len(batch)
            for key, ts, root, n, m in zip(zip(*[batch[k] for k in keys], strict=True), batch["ts"], batch["context_root"], sizes, roots, strict=True):
                if key != own:
                    own, part, total, present = key, 1, 0, set()
                root = None if pd.isna(root) else root
                need = n + (m if root is not None and root not in present else 0)
                if present and total + need > cap:
                    part, total, present = part + 1, 0, set()
                    need = n + (m if root is not None else 0)
                if entries and need > cap:
                    raise ValueError(f"event {ts} needs {need} entries, more than a part holds ({cap})")
                if entries or ts not in present:
                    total += need
                else:  # it was counted as the root of an earlier event
                    total += need - n
                present.add(ts)
                if root is not None:
                    present.add(root)
                parts.append(part)
            yield batch.assign(part=parts)

    return event_order(rows, keys).mapInPandas(run, schema)


def split_parts(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """GRP-1: part of each event (ts, sent_at, context_root or null); a part holds at most cap events,
    counting the context roots that aren't in it."""
    return _split(rows, keys, cap, entries=False)


def split_by_entries(rows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """GRP-2: part of each event by its entries and its context root's (entries, root_entries)."""
    return _split(rows, keys, budget, entries=True)


def pages(rows: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """GRP-5: pages of a day, with context; every message is on one page."""
    return split_parts(rows, keys, most).withColumnRenamed("part", "page")


def plain_parts(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """GRP-1 without context, and WIN-11: part and parts of each slice."""
    w = Window.partitionBy(*keys)
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("part", F.floor((n - 1) / cap).cast("int") + 1).withColumn("parts", F.ceil(F.count(F.lit(1)).over(w) / cap).cast("int"))


def parts_check(files: DataFrame, keys: list[str], part: str = "part") -> DataFrame:
    """WIN-11: slices whose parts aren't exactly 1 to n."""
    s = files.groupBy(*keys).agg(F.min(part).alias("a"), F.max(part).alias("b"), F.countDistinct(part).alias("n"), F.count(F.lit(1)).alias("m"))
    return s.filter("a <> 1 or b <> n or n <> m").select(*keys)


def thread_roots(replies: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """JON-10: replies with their root message (any day, any scope), and whether it is missing."""
    roots = messages.select(*keys, F.col("ts").alias("root_ts"), F.lit(True).alias("_held"), F.col("day").alias("root_day"))
    return replies.join(roots, [*keys, "root_ts"], "left").withColumn("root_missing", F.col("_held").isNull()).drop("_held")


def context(parts: DataFrame, messages: DataFrame, conversation: str, include: bool = True) -> DataFrame:
    """GRP-3: roots that a part needs and doesn't hold: a context event (outside_file or out_of_scope), or
    the reason why there is none. parts (slice keys, part, ts, root_ts), messages (ts, in_scope)."""
    keys = [conversation, "day", "part"]
    own = parts.select(*keys, F.col("ts").alias("root_ts"))
    wanted = parts.filter("root_ts is not null").select(*keys, "root_ts").distinct().join(own, [*keys, "root_ts"], "left_anti")
    held = messages.select(conversation, F.col("ts").alias("root_ts"), "in_scope")
    j = wanted.join(held, [conversation, "root_ts"], "left")
    marker = F.when(F.col("in_scope").isNull(), "parent_not_held").when(F.lit(not include), "parent_not_rendered").when(F.col("in_scope"), "outside_file").otherwise("out_of_scope")
    return j.select(*keys, "root_ts", marker.alias("marker"))


def externals(files: DataFrame, part: list[str], size: str, file_id: str, budget: int, over: int | None = None) -> DataFrame:
    """GRP-4: files kept outside a part's archive: those over a size by policy, then the largest first (ties
    by id) until the rest fits the budget."""
    policy = F.lit(False) if over is None else F.col(size) > over
    rows = files.withColumn("by_policy", policy)
    w = Window.partitionBy(*part, "by_policy")
    after = F.sum(size).over(w.orderBy(F.asc(size), F.desc(file_id)).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_kept", after)
    return rows.withColumn("external", F.col("by_policy") | (F.col("_kept") > budget)).drop("_kept")


def structure_violations(events: DataFrame, participants: DataFrame, attachments: DataFrame, entries: DataFrame, file: str) -> DataFrame:
    """GRP-6: violations of a manifest's structure: duplicate ids, missing parents, unknown participants,
    attachments without an entry and entries without an attachment."""
    ids = events.select(file, F.col("id").alias("what"))
    twice = ids.groupBy(file, "what").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(file, "what", F.lit("duplicate_id").alias("rule"))
    parents = events.filter("parent is not null").select(file, F.col("parent").alias("what")).distinct().join(ids, [file, "what"], "left_anti").withColumn("rule", F.lit("missing_parent"))
    unknown = events.select(file, F.col("participant").alias("what")).distinct().join(participants.select(file, F.col("id").alias("what")), [file, "what"], "left_anti").withColumn("rule", F.lit("unknown_participant"))
    a, e = attachments.select(file, F.col("name").alias("what")), entries.select(file, F.col("name").alias("what"))
    return twice.unionByName(parents).unionByName(unknown).unionByName(a.distinct().join(e, [file, "what"], "left_anti").withColumn("rule", F.lit("attachment_without_entry"))).unionByName(e.distinct().join(a, [file, "what"], "left_anti").withColumn("rule", F.lit("entry_without_attachment")))


def event_type(subtype: Column, text: Column) -> Column:
    """SCL-19: join, leave, message or unknown."""
    return F.when(subtype.isin("channel_join", "group_join"), "join").when(subtype.isin("channel_leave", "group_leave"), "leave").when(subtype.isNull() | (text != ""), "message").otherwise("unknown")


def custom_fields(**values: Column) -> Column:
    """SCL-19: sorted (name, value) pairs; empty ones are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.array_sort(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def display_name(display: Column, real: Column, user: Column) -> Column:
    """SCL-20."""
    return F.coalesce(F.nullif(F.trim(display), F.lit("")), F.nullif(F.trim(real), F.lit("")), user)


def participants(events: DataFrame, part: list[str], author: str, mentions: str, names: DataFrame) -> DataFrame:
    """SCL-20: users that a part refers to, with their names (user_id, display_name, real_name)."""
    users = events.select(*part, F.explode(F.array_union(F.array(author), F.col(mentions))).alias("user_id")).distinct()
    return users.join(names, "user_id", "left").withColumn("name", display_name(F.col("display_name"), F.col("real_name"), F.col("user_id")))


def manifests(events: DataFrame, part: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """SNK-4: one JSON document of each part: its events in order and its participants. A part's size is
    bounded by its cap."""
    doc = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return events.groupBy(*part).agg(doc.alias("events"), F.array_sort(F.collect_set("author")).alias("participants")).select(*part, F.to_json(F.struct("events", "participants")).alias("manifest"))


def file_outcomes(references: DataFrame, collected: DataFrame, refused: DataFrame, key: str = "file_id") -> DataFrame:
    """JON-16: what became of each referenced file: collected wins over the last refusal; neither raises."""
    last = refused.groupBy(key).agg(F.max_by("reason", "seq").alias("reason"))
    j = references.join(collected, key, "left").join(last, key, "left")
    neither = F.raise_error(F.concat(F.lit("file with no outcome: "), F.col(key).cast("string"))).cast("string")
    return j.withColumn("outcome", F.when(F.col("sha256").isNotNull(), "collected").when(F.col("reason").isNotNull(), F.concat(F.lit("refused: "), "reason")).otherwise(neither))


def conversation_info(conversations: DataFrame, snapshots: DataFrame, exported: DataFrame, key: str, until: Column, covered: DataFrame | None = None) -> DataFrame:
    """JON-17: latest snapshot up to an instant, else the export's record; every known name; and the custodians whose
    scopes cover a unit of the conversation (covered: key, scope_type, external_id)."""
    own = snapshots.filter(F.col("collected_at") <= until)
    none = F.array().cast("array<string>")
    last = own.groupBy(key).agg(F.max_by("name", "collected_at").alias("snapshot_name"), F.array_sort(F.collect_set("name")).alias("names"))
    ex = exported.groupBy(key).agg(F.min_by("name", "idx").alias("export_name"))
    out = conversations.join(last, key, "left").join(ex, key, "left")
    # an export's name is the only one known without a snapshot
    known = F.when(F.col("names").isNotNull(), F.col("names")).when(F.col("export_name").isNotNull(), F.array("export_name")).otherwise(none)
    columns = [key, F.coalesce("snapshot_name", "export_name").alias("name"), known.alias("known_names")]
    if covered is not None:
        who = covered.filter("scope_type = 'custodian'").groupBy(key).agg(F.array_sort(F.collect_set("external_id")).alias("custodians"))
        out = out.join(who, key, "left")
        columns.append(F.coalesce("custodians", none).alias("custodians"))
    return out.select(*columns)


def reconcile_render(expected: DataFrame, rendered: DataFrame, slice_keys: list[str]) -> DataFrame:
    """AGG-22: slices whose primary events aren't exactly the expected subjects, with counts."""
    a, b = expected.groupBy(*slice_keys, "subject").agg(F.count(F.lit(1)).alias("a")), rendered.filter("kind = 'primary'").groupBy(*slice_keys, "subject").agg(F.count(F.lit(1)).alias("b"))
    d = a.join(b, [*slice_keys, "subject"], "full").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).filter("d <> 0")
    return d.groupBy(*slice_keys).agg(F.sum(F.greatest("d", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("extra"))


#: Per event of a production: how many edits, attachments, unavailable attachments and external ones it shows.
SHOWN = ("edits", "attachments", "unavailable", "externals")


def render_summary(rendered: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """AGG-22: counts of a production and the digest of its primary subjects; of the columns of SHOWN and ``part``
    those that are there: what its events show, and its files (parts of slices). items (subject): how many went
    in, and a production that doesn't hold exactly these as primaries raises."""
    from ledgerlane.operators.digest import carried, lane_sums

    own = rendered.withColumn("_h", F.when(F.col("kind") == "primary", F.sha2("subject", 256)))
    more = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SHOWN if c in rendered.columns]
    if "part" in rendered.columns:
        more.append(F.countDistinct("conversation_id", "day", "part").alias("files"))
    s = own.agg(F.count_if(F.expr("kind = 'primary'")).alias("primaries"), F.count_if(F.expr("kind = 'context'")).alias("context_events"), F.count_if(F.expr("kind = 'context' and not in_scope")).alias("out_of_scope_context"), F.countDistinct("conversation_id", "day").alias("slices"), *more, *lane_sums(F.col("_h")))
    digest = carried([F.col(f"lane{i}") for i in range(8)])
    names = [c for c in s.columns if not c.startswith("lane")]
    if items is None:
        return s.select(*names, digest.alias("digest"))
    given = items.agg(F.count(F.lit(1)).alias("items"), *[c.alias(f"in_{i}") for i, c in enumerate(lane_sums(F.sha2("subject", 256)))])
    both = s.crossJoin(F.broadcast(given))  # one row each
    same = carried([F.col(f"in_{i}") for i in range(8)])
    sure = F.when((F.col("items") == F.col("primaries")) & (same == digest), digest).otherwise(F.raise_error(F.lit("the production's primaries aren't its items")).cast("string"))
    return both.select("items", *names, sure.alias("digest"))


def natives_check(references: DataFrame, stored: DataFrame) -> DataFrame:
    """AGG-23: natives with two sizes, missing ones, unreferenced ones and wrong sizes."""
    sizes = references.groupBy("sha256").agg(F.countDistinct("size").alias("n"), F.min("size").alias("size"))
    j = sizes.join(stored.select("sha256", F.col("size").alias("stored_size")), "sha256", "full")
    error = F.when(F.col("n") > 1, "two_sizes").when(F.col("n").isNull(), "unreferenced").when(F.col("stored_size").isNull(), "missing").when(F.col("stored_size") != F.col("size"), "wrong_size")
    return j.select("sha256", error.alias("error")).filter("error is not null")
