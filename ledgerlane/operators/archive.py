"""Export archives: entry classes, wrapper folder, tier, overlaps, duplicates, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Metadata files of the documented export layout.
CONVERSATION_FILES = {"channels.json": "channel", "groups.json": "group", "dms.json": "dm", "mpims.json": "mpim"}
FULL_FILES, GRID_FILES = ("groups.json", "dms.json", "mpims.json"), ("org_users.json",)
#: Files that operating systems add to folders.
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
#: Tiers that a declared plan normally gives.
PLAN_TIERS = {"free": ("public_only",), "pro": ("public_only",), "business_plus": ("public_only", "full"), "enterprise_grid": ("public_only", "full", "grid")}
#: What no export holds, and what one of public channels lacks besides.
BLIND_SPOTS = ("earlier_versions_of_edits", "deleted_messages", "history_beyond_plan_or_retention", "file_contents", "canvases_lists_huddles_clips_without_files", "parts_of_shared_channels")
PUBLIC_BLIND_SPOT = "private_channels_and_direct_messages"
HEADER_BYTES = 30


def is_junk(name: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1)
    return name.startswith("__MACOSX/") | last.isin(*JUNK_NAMES)


def classify(entries: DataFrame, name: str = "name", is_dir: Column | None = None) -> DataFrame:
    """FLT-4: kind (metadata, day, directory or unknown), folder, hint_day and junk of each entry."""
    n = F.col(name)
    folder_entry = n.endswith("/") if is_dir is None else is_dir
    parts = F.split(F.regexp_replace(n, "/+$", ""), "/")
    day = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(n, r"^[^/]+/(\d{4}-\d{2}-\d{2})\.json$", 1), F.lit("")), F.lit("yyyy-MM-dd")))
    kind = F.when(folder_entry, "directory").when((F.size(parts) == 1) & n.endswith(".json"), "metadata").when(day.isNotNull(), "day").otherwise("unknown")
    return entries.withColumns({"kind": kind, "folder": F.when(kind == "day", F.get(parts, F.lit(0))), "hint_day": F.when(kind == "day", day), "junk": is_junk(n)})


def root_folder(entries: DataFrame, export: str, name: str = "name") -> DataFrame:
    """SCL-16: an export's single wrapper folder, or null: every entry but junk is under one head, and a
    conversation metadata file sits directly in it."""
    n = F.col(name)
    own = entries.filter(~is_junk(n))
    head, rest = F.substring_index(n, "/", 1), F.regexp_extract(n, "^[^/]*/(.*)$", 1)
    sums = own.groupBy(export).agg(F.min(head).alias("a"), F.max(head).alias("b"), F.bool_and(n.contains("/")).alias("nested"), F.bool_or(rest.isin(*CONVERSATION_FILES)).alias("metadata"))
    return sums.select(export, F.when((F.col("a") == F.col("b")) & F.col("nested") & F.col("metadata"), F.concat("a", F.lit("/"))).alias("root"))


def tier(metadata: DataFrame, export: str, name: str = "name", declared: str | None = None, nested: str | None = None) -> DataFrame:
    """SCL-15: from the names of an export's metadata files its tier, whether it is confirmed, what warns of it
    and what can't be in it; null where none lists conversations."""
    n = F.col(name)
    any_of = lambda names: F.bool_or(n.isin(*names))
    s = metadata.groupBy(export).agg(any_of(CONVERSATION_FILES).alias("c"), any_of(GRID_FILES).alias("g"), any_of(FULL_FILES).alias("f"), any_of(["users.json"]).alias("u"), F.first(declared).alias("plan") if declared else F.lit(None).cast("string").alias("plan"), F.bool_or(nested).alias("nested") if nested else F.lit(False).alias("nested"))
    t = F.when(~F.col("c"), None).when(F.col("g") | F.col("nested"), "grid").when(F.col("f"), "full").otherwise("public_only")
    fits = F.lit(False)
    for plan, tiers in PLAN_TIERS.items():
        fits = fits | ((F.col("plan") == plan) & t.isin(*tiers))
    misfit = F.col("plan").isNotNull() & ~fits
    short = F.col("plan").isin("business_plus", "enterprise_grid") & (t == "public_only")
    warnings = F.array_compact(F.array(F.when(t == "grid", "grid_unconfirmed"), F.when(~F.col("u"), "users_missing"), F.when(misfit, "plan_does_not_give_tier").when(short, "public_only_despite_plan")))
    spots = F.when(t == "public_only", F.array(*[F.lit(x) for x in (*BLIND_SPOTS, PUBLIC_BLIND_SPOT)])).otherwise(F.array(*[F.lit(x) for x in BLIND_SPOTS]))
    return s.select(export, t.alias("tier"), (t != "grid").alias("confirmed"), (~F.col("u")).alias("users_missing"), (misfit | short).alias("plan_warning"), F.when(t.isNotNull(), warnings).alias("warnings"), F.when(t.isNotNull(), spots).alias("blind_spots"))


def conversation_type(is_im: Column, is_mpim: Column, is_private: Column, is_group: Column) -> Column:
    """SCL-15: type of a conversation by its flags."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(is_im), "im").when(yes(is_mpim), "mpim").when(yes(is_private) | yes(is_group), "private_channel").otherwise("public_channel")


def overlaps(entries: DataFrame, archive: str, offset: str, size: str, order: str) -> DataFrame:
    """WIN-4: entries that start before the header and data of the one before them end."""
    w = Window.partitionBy(archive).orderBy(offset, order)
    ends = F.lag(F.col(offset) + HEADER_BYTES + F.col(size)).over(w)
    return entries.withColumn("previous_end", ends).filter(F.col(offset) < F.col("previous_end"))


def teams(rows: DataFrame, team: str) -> DataFrame:
    """AGG-14: distinct teams and rows without one."""
    return rows.agg(F.countDistinct(team).alias("teams"), F.count_if(F.col(team).isNull()).alias("without_team"))


def workspace_vote(rows: DataFrame, export: str, team: str, order: str) -> DataFrame:
    """AGG-15: most common team of each export; of equals the one seen first."""
    n = rows.filter(F.col(team).isNotNull()).groupBy(export, team).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return n.groupBy(export).agg(F.max_by(team, F.struct("n", -F.col("first"))).alias("workspace"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-17: keys that come more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def orphan_folders(day_files: DataFrame, conversations: DataFrame) -> DataFrame:
    """JON-7: folders with day files that no metadata lists."""
    return day_files.select("folder").distinct().join(conversations.select("folder"), "folder", "left_anti")


def empty_conversations(conversations: DataFrame, day_files: DataFrame) -> DataFrame:
    """JON-8: listed conversations without a day file."""
    return conversations.join(day_files.select("folder").distinct(), "folder", "left_anti")


def _sample(rows: DataFrame, column: str, name: str, sample: int) -> DataFrame:
    """One row: how many rows there are, and the first ``sample`` values in order."""
    total = rows.agg(F.count(F.lit(1)).alias(name))
    first = rows.orderBy(column).limit(sample).agg(F.array_sort(F.collect_list(column)).alias(f"{name}_sample"))
    return total.crossJoin(F.broadcast(first))  # one row each


def findings(entries: DataFrame, conversations: DataFrame, messages: DataFrame, sample: int = 100) -> DataFrame:
    """AGG-16: one JSON document about an export: entries by kind; entries and messages that need a look, each as a count
    and a sample; name encodings with a sample each; conversations, their teams, and folders listed twice.

    entries: name, kind, junk, folder, and if known encoding and unparseable; messages: threaded, anomaly (its name, else
    null), and if known no_ts. Each part is a one-row aggregate, so the join of all is one row; samples are
    bounded sorted limits."""
    kinds = entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("entries"))
    days = entries.filter("kind = 'day'")
    counts = messages.agg(F.count(F.lit(1)).alias("messages"), F.count_if("threaded").alias("threaded"), *([F.count_if("no_ts").alias("without_ts")] if "no_ts" in messages.columns else []))
    listed = conversations.agg(F.count(F.lit(1)).alias("conversations"), F.countDistinct("team").alias("teams"), F.count_if(F.col("team").isNull()).alias("without_team"))
    parts = [
        _sample(entries.filter("junk"), "name", "junk", sample), _sample(entries.filter("kind = 'unknown'"), "name", "unknown", sample), _sample(messages.filter("anomaly is not null"), "anomaly", "anomalies", sample), counts, listed,
        _sample(orphan_folders(days, conversations), "folder", "orphans", sample), _sample(empty_conversations(conversations, days).select("folder").distinct(), "folder", "empty", sample), _sample(duplicates(conversations, ["folder"]), "folder", "listed_twice", sample),
    ]
    if "unparseable" in entries.columns:
        parts.append(_sample(entries.filter("unparseable"), "name", "unparseable", sample))
    if "encoding" in entries.columns:
        # a few encodings; of each the first names by a rank that stops at the sample's size
        nth = F.row_number().over(Window.partitionBy("encoding").orderBy("name"))
        first = entries.select("encoding", "name").withColumn("_n", nth).filter(F.col("_n") <= sample).groupBy("encoding").agg(F.array_sort(F.collect_list("name")).alias("sample"))
        found = entries.groupBy("encoding").agg(F.count(F.lit(1)).alias("count")).join(first, "encoding")
        parts.append(found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("encoding", F.struct("count", "sample"))))).alias("encodings")))
    one = kinds
    for part in parts:
        one = one.join(F.broadcast(part))  # one row each
    return one.select(F.to_json(F.struct(*sorted(one.columns))).alias("findings"))
