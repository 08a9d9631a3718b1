"""Identity and versions: first-seen contents, reverts, moved hints, observation state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.functions.keys import version_key
from ledgerlane.operators.ordered import TASK_ROWS, first_known, last_known


def assign_versions(rows: DataFrame, subject: str, content: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """WIN-1: one row per first-seen content of a subject, with its version; existing (subject, version)
    holds the highest version stored before."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(subject, content).orderBy(*order))).filter("_n = 1").drop("_n")
    version = F.row_number().over(Window.partitionBy(subject).orderBy(*order))
    if existing is None:
        return first.withColumn("version", version)
    top = existing.groupBy(subject).agg(F.max("version").alias("_top"))
    return first.withColumn("version", version).join(top, subject, "left").withColumn("version", F.col("version") + F.coalesce("_top", F.lit(0))).drop("_top")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN-2: the last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-14: the first row of each key."""
    return latest_per_key(rows, keys, [F.col(c).asc() for c in order])


def reverts(rows: DataFrame, subject: str, content: str, order: list[str]) -> DataFrame:
    """WIN-8: sightings of a content that was seen before and isn't the latest version's; the latest is the
    content first seen last, so each further sighting is a change again. occurrence counts them."""
    seen = Window.partitionBy(subject, content).orderBy(*order)
    before = Window.partitionBy(subject).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_first", F.row_number().over(seen) == 1)
    marked = marked.withColumn("latest", F.last(F.when(F.col("_first"), F.col(content)), ignorenulls=True).over(before))
    found = marked.filter(~F.col("_first") & (F.col("latest") != F.col(content)))
    return found.drop("_first").withColumn("occurrence", F.row_number().over(Window.partitionBy(subject).orderBy(*order)))


def edit_pairs(states: DataFrame, subject: str, version: str = "version", text: str = "text") -> DataFrame:
    """WIN-7: previous and new text of consecutive versions."""
    w = Window.partitionBy(subject).orderBy(version)
    return states.withColumn("previous", F.lag(text).over(w)).withColumn("_n", F.row_number().over(w)).filter("_n > 1").drop("_n")


def effective_intervals(snapshots: DataFrame, key: str, at: str) -> DataFrame:
    """WIN-10: [effective_from, effective_to) of each snapshot; the first holds from ever, the last for ever."""
    w = Window.partitionBy(key).orderBy(at)
    return snapshots.withColumn("effective_from", F.when(F.row_number().over(w) > 1, F.col(at))).withColumn("effective_to", F.lead(at).over(w))


def as_of(queries: DataFrame, history: DataFrame, key: str, at: str, effective: str, value: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """JON-12: value of the last history row before each query's instant, or the first one if none is.

    Both sides are merged in one order per key, so a key's rows are shuffled once and never paired, and each is
    read once: the fallback is one minimum a key."""
    h = history.select(F.col(key).alias("_key"), F.col(effective).alias("_at"), F.struct(*value).alias("_v"), F.lit(0).alias("_side"))
    q = queries.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(None).cast(h.schema["_v"].dataType).alias("_v"), F.lit(-1).alias("_side"), F.struct(*queries.columns).alias("_row"))
    both = h.withColumn("_row", F.lit(None).cast(q.schema["_row"].dataType)).unionByName(q)
    # queries sort before history of the same instant: a snapshot counts for later instants only
    found = last_known(both, "_key", ["_at", "_side"], "_v", "_last", task_rows=task_rows).filter("_side = -1").drop("_v")
    first = first_known(h, "_key", F.col("_at"), "_v").withColumnRenamed("_key", "_own")
    found = found.join(first, found["_key"].eqNullSafe(first["_own"]), "left").withColumn("_v", F.coalesce("_last", "_v"))
    return found.select("_row.*", *[F.col(f"_v.{c}").alias(c) for c in value])


def best_derivation(items: DataFrame, derivations: DataFrame, key: str = "item_id", version: str = "normalizer_version") -> DataFrame:
    """JON-14: items with their derivation of the numerically highest version."""
    best = latest_per_key(derivations.withColumn("_v", version_key(F.col(version))), [key], [F.col("_v").desc()]).drop("_v")
    return items.join(best, key)


def with_latest_snapshot(messages: DataFrame, snapshots: DataFrame, subject: str, until: Column | None = None, order: str = "version", at: str = "collected_at") -> DataFrame:
    """JON-15: messages with the last snapshot of ``subject#reactions`` up to an instant."""
    own = snapshots if until is None else snapshots.filter(F.col(at) <= until)
    last = latest_per_key(own, [subject], [F.col(order).desc()]).withColumn(subject, F.regexp_replace(subject, "#reactions$", ""))
    return messages.join(last, subject, "left")


def transitions(rows: DataFrame, key: str, state: Column, order: list[str], initial: str) -> DataFrame:
    """STM-2, 3 and 4 in batch: rows where a key's state differs from the one before (``initial`` at first),
    with the state before and how often the key has changed."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("state", state)
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(initial))).filter("state <> before")
    return rows.withColumn("occurrence", F.row_number().over(w))


def absence_events(sightings: DataFrame, key: str, present: str, order: list[str]) -> DataFrame:
    """STM-2: no_longer_observed once per disappearance, observed_again on the return."""
    state = F.when(F.col(present), "seen").otherwise("absent")
    out = transitions(sightings, key, state, order, "seen")
    return out.withColumn("event", F.when(F.col("state") == "absent", "no_longer_observed").otherwise("observed_again"))


def availability_events(attempts: DataFrame, key: str, refused: str, order: list[str]) -> DataFrame:
    """STM-3: file_unavailable once per change of the refusal's reason, file_became_available only after one."""
    state = F.coalesce(F.col(refused), F.lit(""))
    out = transitions(attempts, key, state, order, "")
    return out.withColumn("event", F.when(F.col("state") == "", "file_became_available").otherwise("file_unavailable"))


def access_events(pages: DataFrame, key: str, lost: str, order: list[str]) -> DataFrame:
    """STM-4: access_lost once, access_restored on the first page afterwards."""
    out = transitions(pages, key, F.when(F.col(lost), "lost").otherwise("held"), order, "held")
    return out.withColumn("event", F.when(F.col("state") == "lost", "access_lost").otherwise("access_restored"))


def reaction_snapshots(sightings: DataFrame, key: str, reactions: str, deleted: str, order: list[str]) -> DataFrame:
    """STM-6: a snapshot where reactions are present or were before; never of a deleted message."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = sightings.filter(~F.col(deleted))
    has = F.size(reactions) > 0
    return own.withColumn("_before", F.coalesce(F.bool_or(has).over(w), F.lit(False))).filter(has | F.col("_before")).drop("_before")


def new_items(items: DataFrame, stored: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """SNK-5: items to append: first of each key that isn't stored yet."""
    return items.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def new_links(links: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-6: links that don't exist yet; they feed the batch's root."""
    return links.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def fingerprint_versions(rows: DataFrame, versions: str) -> DataFrame:
    """AGG-21: distinct dotted versions in numeric order."""
    return rows.select(versions).distinct().withColumn("_k", version_key(F.col(versions))).orderBy("_k").drop("_k")
