"""Structured Streaming jobs: exactly-once ingest, stateful versions, observation machines, live feed."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ledgerlane.operators.merkle import EMPTY, batch_roots
from ledgerlane.operators.sightings import moved_hints
from ledgerlane.plans.shared import materialized, publish, settings, table_exists


#: State stores on disk, for state that grows with the data.
ON_DISK = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None, to_head: bool = False) -> None:
    """Processes what is there now, batch by batch, and stops; a restart goes on after the last batch. conf holds for
    this query. to_head: for sources that admit a part of the rest at a time, as the custody tail does."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    with settings(stream.sparkSession, conf or {}):
        query = (writer if to_head else writer.trigger(availableNow=True)).start()
        try:
            if to_head:
                query.processAllAvailable()
            else:
                query.awaitTermination()
        finally:
            query.stop()


#: Tables of an ingest, and the buckets of a key's first hex digit by which known items and links are looked up.
TABLES = ("items", "links", "events", "checkpoints")
ITEM = "array<struct<subject:string,content_hash:string,idempotency_key:string>>"


def committed(spark: SparkSession, out: str, table: str) -> DataFrame | None:
    """The rows of an ingest's table that commit records have published; null before the first."""
    if not table_exists(spark, f"{out}/commits") or not table_exists(spark, f"{out}/{table}"):
        return None
    names = spark.read.text(f"{out}/commits", wholetext=True).select(F.col("value").alias("commit"))
    rows = spark.read.schema(f"{_SCHEMAS[table]}, commit string" + (", bucket string" if table in ("items", "links") else "")).parquet(f"{out}/{table}")
    return rows.join(names, "commit", "left_semi")


_SCHEMAS = {
    "items": "idempotency_key string, subject string, content_hash string", "links": "unit_key string, idempotency_key string, content_hash string",
    "events": "unit_key string, pages_done long, item_count long, root string", "checkpoints": "unit_key string, pages_done long, cursor string",
}


def _unknown(rows: DataFrame, known: DataFrame | None, keys: list[str]) -> DataFrame:
    """rows whose keys aren't known yet; of the known ones only the rows' buckets are read."""
    if known is None:
        return rows
    buckets = [r[0] for r in rows.select("bucket").distinct().collect()]  # 16 at most
    return rows.join(known.filter(F.col("bucket").isin(buckets)).select("bucket", *keys), ["bucket", *keys], "left_anti")


def applicable(pages: DataFrame, state: DataFrame | None) -> DataFrame:
    """The pages (unit_key, pages_before, cursor_before, next_cursor, items) that go on from where their unit is: the
    first from its cursor and page count, each further one from the page before it. The rest was applied before, or
    comes too early."""
    pages = pages.dropDuplicates(["unit_key", "pages_before", "cursor_before"])
    if state is None:
        held = pages.withColumn("_done", F.lit(0).cast("long")).withColumn("_cursor", F.lit(""))
    else:
        last = state.join(pages.select("unit_key").distinct(), "unit_key", "left_semi").groupBy("unit_key").agg(F.max("pages_done").alias("_done"), F.max_by("cursor", "pages_done").alias("_cursor"))
        held = pages.join(last, "unit_key", "left").withColumn("_done", F.coalesce("_done", F.lit(0))).withColumn("_cursor", F.coalesce("_cursor", F.lit("")))
    held = held.filter(F.col("pages_before") >= F.col("_done"))
    # pages of a unit in a trigger, which bounds them
    order = Window.partitionBy("unit_key").orderBy("pages_before", "cursor_before")
    from_here = (F.col("pages_before") == F.col("_done")) & (F.col("cursor_before") == F.col("_cursor"))
    fits = F.when(F.col("pages_before") == F.col("_done"), from_here).otherwise((F.lag("pages_before").over(order) == F.col("pages_before") - 1) & (F.lag("next_cursor").over(order) == F.col("cursor_before")))
    held = held.filter((F.col("pages_before") > F.col("_done")) | from_here).withColumn("_fits", F.coalesce(fits, F.lit(False)))
    return held.withColumn("_all", F.bool_and("_fits").over(order)).filter("_all").select(*pages.columns)


def ingest(stream: DataFrame, out: str, checkpoint: str, to_head: bool = False) -> None:
    """STM-1: pages of units, each applied exactly once. A trigger's new items, new links, batch events (count and Merkle
    root of a page's new links) and unit checkpoints are written under a name of their own, and a commit record then
    publishes all four at once; what has no record is not there for any reader, this one included. A page is
    applied only if its cursor and page count are its unit's, so a replay, from whatever checkpoint, adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = materialized(applicable(batch, committed(spark, out, "checkpoints")))
        if pages.isEmpty():
            return
        each = pages.select("unit_key", "pages_before", F.explode("items").alias("i")).select("unit_key", "pages_before", "i.*").withColumn("bucket", F.substring("idempotency_key", 1, 1))
        first = each.groupBy("bucket", "idempotency_key").agg(F.min_by(F.struct("subject", "content_hash"), F.struct("unit_key", "pages_before")).alias("i")).select("bucket", "idempotency_key", "i.*")
        linked = each.groupBy("bucket", "unit_key", "idempotency_key").agg(F.min("pages_before").alias("pages_before"), F.first("content_hash").alias("content_hash"))
        links = materialized(_unknown(linked, committed(spark, out, "links"), ["unit_key", "idempotency_key"]))
        roots = batch_roots(links, ["unit_key", "pages_before"], "idempotency_key", "content_hash")
        events = pages.select("unit_key", "pages_before").join(roots, ["unit_key", "pages_before"], "left")
        commit = uuid.uuid4().hex
        tables = {
            "items": _unknown(first, committed(spark, out, "items"), ["idempotency_key"]), "links": links.drop("pages_before"),
            "events": events.select("unit_key", (F.col("pages_before") + 1).alias("pages_done"), F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("root", F.lit(EMPTY)).alias("root")),
            "checkpoints": pages.groupBy("unit_key").agg((F.max("pages_before") + 1).alias("pages_done"), F.max_by("next_cursor", "pages_before").alias("cursor")),
        }
        for name, rows in tables.items():
            parts = ["bucket"] if "bucket" in rows.columns else []
            rows = rows.withColumn("commit", F.lit(commit))
            (rows.repartition("bucket") if parts else rows).write.mode("append").partitionBy(*parts, "commit").parquet(f"{out}/{name}")
        publish(spark, f"{out}/commits/{commit}", commit)

    run_available(stream, write, checkpoint, to_head=to_head)


def deduplicated(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """STM-9: first row of each key; state is kept for the watermark's span."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


VERSIONED = "subject long, seq long, kind string, content_hash string, version int, hint string, old string, new string, occurrence long"

_VERSIONED = [x.split()[0] for x in VERSIONED.split(", ")]


#: Parts of the keys that have a state together, so that a trigger calls Python, and reads and writes state, once a part.
PARTS = 1024


def _by_part(stream: DataFrame, key: str) -> GroupedData:
    """Rows by a part of their keys; null has a part of its own."""
    return stream.withColumn("_part", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(PARTS))).cast("int")).groupBy("_part")


def _held(state: GroupState) -> dict:
    """What a part's state holds of its keys."""
    return pickle.loads(state.get[0]) if state.exists else {}


def _placed(parts: Iterator[pd.DataFrame], key: str) -> tuple[pd.DataFrame, list, np.ndarray, np.ndarray]:
    """What one trigger brings of some keys, in order of key and seq; the keys, the number of each row's, and where each begins.
    The events that a trigger admits bound it."""
    rows = pd.concat(list(parts), ignore_index=True)
    codes, keys = pd.factorize(rows[key], use_na_sentinel=False)
    order = np.lexsort((rows["seq"].to_numpy(), codes))
    codes = codes[order]
    return rows.iloc[order], [None if pd.isna(k) else k for k in keys], codes, np.flatnonzero(np.diff(codes, prepend=-1))


def _versioned(subject: object, rows: Iterable[tuple], held: tuple, out: list[tuple]) -> tuple:
    """What a subject's state becomes, (numbers of known contents, latest, changes, its hints as they are now, the changes
    recorded of it), by rows (seq, content, hints) in their order, whose events are added to out."""
    known, latest, changes, current, seen = held
    for seq, content, hints in rows:
        now = None if hints is None else {k: v for k, v in (hints.items() if isinstance(hints, dict) else hints) if v is not None}
        if content != latest:
            if content not in known:
                latest, known[content], current, seen = content, len(known) + 1, dict(now or {}), set()
                out.append((subject, seq, "version", content, known[content], None, None, None, None))
            else:
                changes += 1
                out.append((subject, seq, "reverted", content, known[content], None, latest, content, changes))
        elif now is not None:
            for change in moved_hints(current, seen, now):
                changes += 1
                out.append((subject, seq, "hint", content, len(known), *change, changes))
    return known, latest, changes, current, seen


def stateful_versions(stream: DataFrame) -> DataFrame:
    """STM-5: versions, reverts and moved hints of each subject (subject, content_hash, hints, at, seq), as WIN-1, WIN-8 and
    WIN-9 have them. Known contents are kept without an end, since forgetting one would make a revert a
    version; start it with the settings ``ON_DISK``. A subject's state is its own in that of its part: only those that a
    trigger brings are opened."""

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        codes, subjects = pd.factorize(rows["subject"], use_na_sentinel=False)
        order = np.lexsort((rows["seq"].to_numpy(), rows["at"].to_numpy().astype("int64"), codes))
        begins = np.flatnonzero(np.diff(codes[order], prepend=-1))
        seq, content, hints = (rows[c].iloc[order].tolist() for c in ("seq", "content_hash", "hints"))
        held, out = _held(state), []
        for code, low, high in zip(codes[order][begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
            subject = None if pd.isna(subjects[code]) else int(subjects[code])
            own = pickle.loads(held[subject]) if subject in held else ({}, None, 0, {}, set())
            held[subject] = pickle.dumps(_versioned(subject, zip(seq[low:high], content[low:high], hints[low:high], strict=True), own, out))
        state.update((pickle.dumps(held),))
        columns = dict(zip(_VERSIONED, map(list, zip(*out, strict=True)), strict=True)) if out else {c: [] for c in _VERSIONED}
        yield pd.DataFrame(columns | {c: pd.array(columns[c], "Int64") for c in ("subject", "occurrence")} | {"version": pd.array(columns["version"], "Int32")})

    return _by_part(stream, "subject").applyInPandasWithState(step, VERSIONED, "held binary", "append", GroupStateTimeout.NoTimeout)


MACHINE = "key string, event string, seq long, state string, occurrence long"


def observation_machine(stream: DataFrame, initial: str, events: dict[str, str]) -> DataFrame:
    """STM-2, 3 and 4 as a stream: an event when a key's state (key, state, seq) changes, and how often it has; events
    maps the new state to the event's name, with ``*`` for any other. A key's state is its last state and its count."""

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, keys, codes, begins = _placed(parts, "key")
        held = _held(state)
        own = [held.get(keys[c], (initial, 0)) for c in codes[begins]]
        now = rows["state"].to_numpy(dtype=object)
        before = np.concatenate([[None], now[:-1]])
        before[begins] = [last for last, _ in own]
        moved = np.fromiter((a != b for a, b in zip(now, before, strict=True)), bool, len(now))
        # changes so far in the trigger, less those of the keys before, and those of the triggers before
        n = np.cumsum(moved)
        lengths = np.diff(begins, append=len(now))
        n += np.repeat(np.array([k for _, k in own], dtype=np.int64) - (n[begins] - moved[begins]), lengths)
        ends = begins + lengths - 1
        held.update((keys[c], (last, int(k))) for c, last, k in zip(codes[ends], now[ends], n[ends], strict=True))
        state.update((pickle.dumps(held),))
        at = np.flatnonzero(moved)
        names = [events.get(x, events.get("*", x)) for x in now[at]]
        yield pd.DataFrame({"key": [keys[c] for c in codes[at]], "event": names, "seq": rows["seq"].to_numpy()[at], "state": now[at], "occurrence": n[at]})

    return _by_part(stream, "key").applyInPandasWithState(step, MACHINE, "held binary", "append", GroupStateTimeout.NoTimeout)


def reaction_stream(stream: DataFrame) -> DataFrame:
    """STM-6 as a stream: sightings (key, has, deleted, seq) to be kept as snapshots: those with reactions, and those without
    once the key had some; never of a deleted message. A key's state is whether it had any."""
    schema = "key string, seq long, has boolean"

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, keys, codes, _ = _placed(parts, "key")
        there = ~rows["deleted"].to_numpy(dtype=bool)
        rows, codes = rows[there], codes[there]
        held = _held(state)
        has = rows["has"].astype(bool)
        before = has.groupby(codes).transform(lambda x: x.cummax().shift(fill_value=False)).to_numpy(dtype=bool) if len(rows) else np.zeros(0, bool)
        kept = has.to_numpy() | before | np.array([keys[c] in held for c in codes], dtype=bool)
        held.update((keys[c], True) for c in np.unique(codes[has.to_numpy()]))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame({"key": [keys[c] for c in codes[kept]], "seq": rows["seq"][kept].to_numpy(), "has": has[kept].to_numpy()})

    return _by_part(stream, "key").applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.NoTimeout)


def job_feed(events: DataFrame, units: DataFrame, settled: tuple[str, ...]) -> DataFrame:
    """STM-7: for each stream (job) and status of its settled units, how many there are, the last seq that settled one, and
    under a null status the last event of any kind; a running aggregate for update mode, so that a trigger gives the rows
    that it moved. events: stream, seq, event_type, unit_key; units (stream, unit_key, status) are a table."""
    own = events.withColumn("unit_key", F.when(F.col("event_type").isin(*settled), F.col("unit_key")))
    known = own.join(units.select("stream", "unit_key", "status"), ["stream", "unit_key"], "left")
    return known.groupBy("stream", "status").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


def feed_snapshot(updates: DataFrame) -> DataFrame:
    """The feed as it is after the updates of all triggers (``batch``): stream, status, n, last_seq, and the stream's head."""
    last = updates.groupBy("stream", "status").agg(F.max_by(F.struct("n", "last_seq"), "batch").alias("u")).select("stream", "status", "u.*")
    heads = last.groupBy("stream").agg(F.max("last_seq").alias("head"))
    return last.filter("status is not null").join(heads, "stream")


def settled_since(events: DataFrame, units: DataFrame, settled: tuple[str, ...], after: int) -> DataFrame:
    """STM-7's rows: units that were settled since a seq, with what is known of them; events may be a stream."""
    own = events.filter(F.col("event_type").isin(*settled) & (F.col("seq") > after))
    return own.select("stream", "seq", "unit_key").join(units, ["stream", "unit_key"])
