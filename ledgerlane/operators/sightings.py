"""Sightings of a subject against what is known of it: versions, reverts, and moved change markers.

A subject's latest version is the content that was first seen last; a sighting of an older content is a revert each
time and doesn't make it the latest. A sighting of the latest content compares its hints (a map of change markers) with the
latest version's, moved on by the changes recorded since: an equal change (hint, old, new) of a version is
recorded once. Hints that are null are unknown and compared with nothing; a hint without a value is not there."""

from __future__ import annotations

from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Hints = dict[str, str]


def moved_hints(current: Hints, seen: Container[tuple[str, str | None, str | None]], now: Hints) -> list[tuple[str, str | None, str | None]]:
    """The changes (hint, old, new) from current to now that weren't seen, in order of hint; both are moved on (seen by its ``add``)."""
    out = []
    for hint in sorted(current.keys() | now.keys()):
        change = (hint, current.get(hint), now.get(hint))
        if change[1] != change[2] and change not in seen:
            out.append(change)
            seen.add(change)
            if change[2] is None:
                del current[hint]
            else:
                current[hint] = change[2]
    return out


def _entries(hints: Column) -> Column:
    """A map as comparable entries, without null values."""
    return F.array_sort(F.filter(F.map_entries(hints), lambda e: e["value"].isNotNull()))


def hint_changes(rows: DataFrame, subject: str, content: str, hints: str, order: list[str]) -> DataFrame:
    """WIN-9: sightings of the latest content whose hints moved, one row per hint with old and new value.

    Windows find the latest version at each sighting and keep those whose hints differ from the sighting before;
    only these are folded, in order, by a pass that holds one version's hints at a time."""
    at = Window.partitionBy(subject).orderBy(*order)
    first = F.row_number().over(Window.partitionBy(subject, content).orderBy(*order)) == 1
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("_latest", F.last(F.when(F.col("_first"), F.struct(content)), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("_latest").eqNullSafe(F.struct(content)) & (F.col("_first") | F.col(hints).isNotNull()))
    rows = rows.withColumn("_e", F.coalesce(_entries(F.col(hints)), F.array().cast("array<struct<key:string,value:string>>")))
    before = F.lag("_e").over(Window.partitionBy(subject, content).orderBy(*order))
    rows = rows.withColumn("_before", before).filter(F.col("_first") | (F.col("_e") != F.col("_before")))
    kept = rows.select(subject, content, *order, "_first", "_e")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if not f.name.startswith("_")) + ", hint string, old string, new string"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = {}, set()
        for batch in batches:
            at, found = [], []
            # a version's rows follow each other and begin with its first sighting
            for i, (is_first, entries) in enumerate(zip(batch.column("_first").to_pylist(), batch.column("_e").to_pylist(), strict=True)):
                now = {e["key"]: e["value"] for e in entries}
                if is_first:
                    current, seen = now, set()
                for change in moved_hints(current, seen, now):
                    at.append(i)
                    found.append(change)
            own = batch.take(pa.array(at, pa.int64()))
            columns = own.columns[:-2] + [pa.array([c[j] for c in found], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(columns, own.schema.names[:-2] + ["hint", "old", "new"])

    return kept.repartition(subject).sortWithinPartitions(subject, *order).mapInArrow(fold, schema)


def changes(rows: DataFrame, subject: str, content: str, hints: str, order: list[str]) -> DataFrame:
    """WIN-8 and WIN-9 together: subject, content, order, kind (reverted or hint), hint, old, new (of a revert: the
    latest content and the one it came back to) and occurrence, the number of the subject's changes so far."""
    from ledgerlane.operators.versions import reverts

    back = reverts(rows, subject, content, order).select(subject, content, *order, F.lit("reverted").alias("kind"), F.lit(None).cast("string").alias("hint"), F.col("latest").alias("old"), F.col(content).alias("new"))
    moved = hint_changes(rows, subject, content, hints, order).select(subject, content, *order, F.lit("hint").alias("kind"), "hint", "old", "new")
    return back.unionByName(moved).withColumn("occurrence", F.row_number().over(Window.partitionBy(subject).orderBy(*order, F.asc_nulls_first("hint"))).cast("long"))
