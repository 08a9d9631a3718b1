"""Stored evidence, retention, holds, visibility and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def registry_vs_stored(registry: DataFrame, stored: DataFrame, as_of: Column, grace: str) -> DataFrame:
    """JON-22: what becomes of pending rows, and objects that nothing accounts for.

    registry (storage_key, state, sha256, created_at), stored (storage_key, stored_sha256)."""
    j = registry.join(stored, "storage_key", "full")
    young = F.col("created_at") > as_of - F.expr(grace)
    outcome = (
        F.when(F.col("state").isNull(), "shadow").when(F.col("stored_sha256").isNull() & (F.col("state") == "complete"), "missing").when(F.col("stored_sha256").isNull(), F.when(young, "left_pending").otherwise("needs_refetch"))
        .when(F.col("stored_sha256") != F.col("sha256"), "integrity_incident").when(F.col("state") == "pending", "completed").otherwise("intact")
    )
    return j.select("storage_key", outcome.alias("outcome"))


def evidence_summary(objects: DataFrame) -> DataFrame:
    """AGG-11."""
    return objects.agg(F.min("retain_until").alias("first_until"), F.max("retain_until").alias("last_until"), F.count(F.lit(1)).alias("objects"), F.count_if(F.expr("state <> 'complete'")).alias("incomplete"))


def union_owners(*memberships: DataFrame) -> DataFrame:
    """SET-1 / JON-18 / JON-21: distinct (object_id, owner) of any number of memberships."""
    return reduce(DataFrame.unionByName, [m.select("object_id", "owner") for m in memberships]).distinct()


def resolve_archives(owned: DataFrame, objects: DataFrame) -> DataFrame:
    """SET-1: entries of an archive stand for the archive."""
    links = objects.filter("archive_id is not null").select("object_id", "archive_id")
    return owned.join(links, "object_id", "left").select(F.coalesce("archive_id", "object_id").alias("object_id"), "owner").distinct()


def evidence_of(objects: DataFrame, owned: DataFrame, owner: str | None = None) -> DataFrame:
    """JON-18: objects of an owner (or of any)."""
    own = owned if owner is None else owned.filter(F.col("owner") == owner)
    return objects.join(own.select("object_id").distinct(), "object_id", "left_semi")


def hold_scope(objects: DataFrame, *memberships: DataFrame) -> DataFrame:
    """SET-5: distinct complete objects that a hold covers, entries resolved to their archives."""
    return evidence_of(objects.filter("state = 'complete'"), resolve_archives(union_owners(*memberships), objects)).select("object_id")


def retention_targets(owned: DataFrame, owners: DataFrame) -> DataFrame:
    """AGG-12: until (null: no cap, if any owner has none) and the owner of the latest, no cap first."""
    j = owned.join(owners, "owner")
    open_end = F.bool_or(F.col("until").isNull())
    return j.groupBy("object_id").agg(F.when(open_end, None).otherwise(F.max("until")).alias("until"), F.max_by("owner", F.struct(F.col("until").isNull(), "until", "owner")).alias("owner"))


def retain_target(as_of: Column, window: str, cap: Column) -> Column:
    """SCL-17: as_of plus the window, at most the cap (null: none)."""
    return F.least(as_of + F.expr(window), F.coalesce(cap, as_of + F.expr(window)))


def extension_needed(current: Column, as_of: Column, floor: str, target: Column) -> Column:
    return current < F.least(as_of + F.expr(floor), target)


def held(rows: DataFrame, holds: DataFrame, ancestors: list[str]) -> DataFrame:
    """JON-20: rows with a column held: an active hold names the row or one of its ancestors. holds (scope_id)
    of active ones; ancestors are columns with scope ids."""
    active = holds.select("scope_id").distinct().withColumn("_hit", F.lit(True))
    keyed = rows.select("id", F.explode(F.array(*ancestors)).alias("scope_id")).join(active, "scope_id").select("id").distinct().withColumn("held", F.lit(True))
    return rows.join(keyed, "id", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def visible(rows: DataFrame, assignments: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """JON-19: rows whose scope at any level (scope type to column) is assigned. Each level is an equi
    semi-join on a key, so no level is compared row by row."""
    live = assignments.filter("revoked_at is null").select("scope_type", "scope_id").distinct()
    keyed = rows.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("scope_type"), F.col(c).cast("string").alias("scope_id")) for t, c in scopes.items()])).alias("s")).select("id", "s.*")
    return rows.join(keyed.join(live, ["scope_type", "scope_id"], "left_semi").select("id").distinct(), "id", "left_semi")


def roles_by_scope(assignments: DataFrame, keys: list[str], role: str = "role") -> DataFrame:
    """AGG-18."""
    return assignments.groupBy(*keys).agg(F.array_sort(F.collect_set(role)).alias("roles"))


def memberships(token_groups: DataFrame, stored: DataFrame) -> DataFrame:
    """SET-2."""
    return token_groups.union(stored).distinct()


def eligible_count(assignments: DataFrame, principals: DataFrame, condition: Column) -> DataFrame:
    """AGG-26: distinct active principals among assignments that meet a condition."""
    return assignments.filter(condition).join(principals.filter("active"), "principal_id", "left_semi").agg(F.countDistinct("principal_id").alias("eligible"))


def list_jobs(jobs: DataFrame, equals: dict[str, object] | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """FLT-8: jobs that meet those filters that are given; absent ones add no predicate."""
    for c, v in (equals or {}).items():
        if v is not None:
            jobs = jobs.filter(F.col(c) == v)
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            jobs = jobs.filter(F.col(c) >= lo)
        if hi is not None:
            jobs = jobs.filter(F.col(c) < hi)
    return jobs


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """FLT-9: rows after a composite key, in order, one more than size (there is more if it comes)."""
    if after is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(size + 1)


def byte_budget_page(events: DataFrame, stream: str, order: str, payload: str, budget: int = 1 << 20) -> DataFrame:
    """WIN-5: the first events of each stream whose payloads fit a budget, one at least."""
    w = Window.partitionBy(stream).orderBy(order)
    total = F.sum(F.octet_length(payload)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_t", total).withColumn("_n", F.row_number().over(w)).filter((F.col("_t") <= budget) | (F.col("_n") == 1)).drop("_t", "_n")


def stale(rows: DataFrame, states: tuple[str, ...], at: str, as_of: Column, age: str) -> DataFrame:
    """FLT-7: rows of some states older than an age."""
    return rows.filter(F.col("state").isin(*states) & (F.col(at) < as_of - F.expr(age)))


def deadlines(pauses: DataFrame, as_of: Column, warn: str) -> DataFrame:
    """FLT-6: open pauses past their deadline, or due for their one warning."""
    open_ = pauses.filter("resumed_at is null")
    state = F.when(F.col("deadline_at") <= as_of, "past").when((F.col("deadline_at") <= as_of + F.expr(warn)) & F.col("warned_at").isNull(), "warn")
    return open_.withColumn("due", state).filter("due is not null")


def missing_partner(rows: DataFrame, partners: DataFrame, key: str, at: str | None = None, as_of: Column | None = None, age: str | None = None) -> DataFrame:
    """JON-25: rows without a partner, at all or after an age."""
    out = rows.join(partners.select(key), key, "left_anti")
    return out if age is None else out.filter(F.col(at) < as_of - F.expr(age))


def unlisted(files: DataFrame, accounted: DataFrame, key: str = "name") -> DataFrame:
    """SET-3: files that nobody accounts for."""
    return files.select(key).distinct().join(accounted.select(key).distinct(), key, "left_anti")


def rerun_equal(one: DataFrame, other: DataFrame) -> DataFrame:
    """SET-6: rows that only one of two runs has (empty: equal), with the side."""
    return one.exceptAll(other).withColumn("side", F.lit("first")).unionByName(other.exceptAll(one).withColumn("side", F.lit("second")))


def quota(exports: DataFrame, limits: dict[str, int], client: str = "client") -> DataFrame:
    """AGG-13: usage of each client by exports in flight and ready, and names of exceeded limits."""
    live = F.col("state").isin("uploading", "validating", "ready")
    u = exports.groupBy(client).agg(F.count_if(F.col("state").isin("uploading", "validating")).alias("in_flight"), F.sum(F.when(live, F.col("bytes")).otherwise(0)).alias("bytes"), F.count_if(F.col("state") == "ready").alias("ready"))
    over = F.filter(F.array(*[F.when(F.col(k) > v, F.lit(k)) for k, v in sorted(limits.items())]), lambda x: x.isNotNull())
    return u.withColumn("over", over)
