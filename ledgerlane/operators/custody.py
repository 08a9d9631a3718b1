"""Hash chains: building, verifying, folding and judging event streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.functions.canonical import canonical_json
from ledgerlane.functions.keys import canonical_struct, packed_hash
from ledgerlane.operators.merkle import EMPTY, TASK_ROWS, leaf_hash, record_roots, roots
from ledgerlane.operators.ordered import last_known, longest
from ledgerlane.plans.shared import in_ranges, materialized, small

GENESIS = "0" * 64

#: Numbers of a stream that are compared in one order where streams are long.
BLOCK = 65_536


def event_json(stream: Column, seq: Column, kind: Column, actor: Column, payload: Column, at: Column) -> Column:
    """The canonical fields that an event's hash covers."""
    return canonical_struct(stream_id=stream, seq=seq, event_type=kind, actor=actor, payload=payload, created_at=at)


def event_hash(prev: Column, fields: Column) -> Column:
    """MRK-4."""
    return F.sha2(F.concat(prev, fields), 256)


def build_chain(events: DataFrame, stream: str = "stream", seq: str = "seq", fields: str = "fields") -> DataFrame:
    """MRK-5: events with prev_hash and event_hash. A stream is sequential by nature, so each is hashed in
    order by one task, which holds the last hash only; streams run side by side."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", prev_hash string, event_hash string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, GENESIS
        for part in parts:
            before, after = [], []
            for s, f in zip(part[stream], part[fields], strict=True):
                own, last = s, GENESIS if s != own else last
                before.append(last)
                last = hashlib.sha256((last + f).encode()).hexdigest()
                after.append(last)
            yield part.assign(prev_hash=before, event_hash=after)

    return events.repartition(stream).sortWithinPartitions(stream, seq).mapInPandas(run, schema)


def verify_chain(events: DataFrame, stream: str = "stream", seq: str = "seq", fields: str = "fields", tenant: Column | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """MRK-6: each event with its error (null if none): what comes after a stream's first gap is ``unchecked``; an event
    whose canonical fields name another stream_id (or tenant_id, if a tenant is given) is ``foreign``.

    Whether an event is foreign or altered is told by itself, before it is moved: a caller that takes the error alone
    moves numbers and hashes only. Streams of up to task_rows are compared neighbour by neighbour in one order. Where one
    is longer, streams are cut into blocks of numbers, and a block's first event is compared with the last one of the block before
    it, of which there is one row a block. A number that comes twice is a gap."""
    named = F.get_json_object(fields, "$.stream_id")
    foreign = named.isNotNull() & (named != F.col(stream).cast("string"))
    if tenant is not None:
        foreign = foreign | ~F.get_json_object(fields, "$.tenant_id").eqNullSafe(tenant)
    own = events.select(
        "*", foreign.alias("_foreign"), (F.col("event_hash") != event_hash(F.col("prev_hash"), F.col(fields))).alias("_altered"), (F.col("prev_hash") != GENESIS).alias("_late"),
        packed_hash(F.col("prev_hash")).alias("_prev"), packed_hash(F.col("event_hash")).alias("_own"),
    )
    if longest(events, stream) <= task_rows:
        w = Window.partitionBy(stream).orderBy(seq)
        e = own.withColumn("_hash", F.lag("_own").over(w)).withColumn("_odd", F.col(seq) != F.coalesce(F.lag(seq).over(w), F.lit(0)) + 1)
        e = e.withColumn("_gap", F.min(F.when(F.col("_odd"), F.col(seq))).over(Window.partitionBy(stream)))
    else:
        own = own.withColumn("_block", F.floor(F.col(seq) / min(task_rows, BLOCK)))
        w = Window.partitionBy(stream, "_block").orderBy(seq)
        ends = own.groupBy(stream, (F.col("_block") + 1).alias("_block")).agg(F.max(seq).alias("_end"), F.max_by("_own", seq).alias("_end_hash"))
        e = own.withColumn("_hash", F.lag("_own").over(w)).withColumn("_last", F.lag(seq).over(w)).join(ends, [stream, "_block"], "left")
        e = e.withColumn("_odd", F.col(seq) != F.coalesce("_last", "_end", F.lit(0)) + 1).withColumn("_hash", F.when(F.col("_last").isNull(), F.col("_end_hash")).otherwise(F.col("_hash")))
        e = e.join(small(materialized(e.filter("_odd").groupBy(stream).agg(F.min(seq).alias("_gap")))), stream, "left")
    broken = F.when(F.col(seq) == 1, F.col("_late")).otherwise(F.col("_prev") != F.col("_hash"))
    error = F.when(F.col(seq) == F.col("_gap"), "gap").when(F.col(seq) > F.col("_gap"), "unchecked").when(F.col("_foreign"), "foreign").when(broken, "broken_link").when(F.col("_altered"), "altered")
    return e.withColumn("error", error).select(*events.columns, "error")


def verify_batches(events: DataFrame, batches: DataFrame, key: str) -> DataFrame:
    """MRK-7 / JON-24: stated (item_count, root) of batch events against recomputed ones; leftovers of either
    side are errors."""
    a = events.select(key, F.col("item_count").alias("stated_count"), F.col("root").alias("stated_root"))
    b = batches.select(key, "item_count", "root")
    j = a.join(b, key, "full")
    error = F.when(F.col("root").isNull(), "items_missing").when(F.col("stated_root").isNull(), "unknown_batch").when(F.col("item_count") != F.col("stated_count"), "wrong_count").when(F.col("root") != F.col("stated_root"), "wrong_root")
    return j.select(key, error.alias("error")).filter("error is not null")


def verify_item_links(items: DataFrame, events: DataFrame, batch: str, stream: str = "stream", seq: str = "seq", kind: str = "event_type", then: tuple[str, ...] = ()) -> DataFrame:
    """JON-24: items (place in their file, item_id, stream, seq of their event) that belong to no batch event, that come twice, or
    that come before an item of an earlier event of their stream: place, item_id, error. Places may come twice if the columns in
    then order them."""
    own = events.filter(F.col(kind) == batch).select(stream, seq, F.lit(True).alias("_there")).dropDuplicates([stream, seq])
    j = last_known(items.withColumn("_v", F.col(seq)), stream, ["place", *then], "_v", "_before").join(own, [stream, seq], "left")
    again = items.groupBy("item_id").agg(F.min("place").alias("_first"))
    j = j.join(again, "item_id")
    checks = F.array(F.when(F.col("_there").isNull(), "not_linked"), F.when(F.col("_before") > F.col(seq), "out_of_order"), F.when(F.col("place") > F.col("_first"), "linked_twice"))
    return j.select("place", "item_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("error"))


def _stated(rows: DataFrame, keys: list[str], **checks: Column) -> DataFrame:
    return rows.select(*keys, F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda c: c.isNotNull())).alias("error"))


def verify_render_batches(batches: DataFrame, files: DataFrame, completed: DataFrame, fields: list[str], render: str = "render_id", seq: str = "seq") -> DataFrame:
    """MRK-7 for renders: render_id, seq and error of what batch events state (batch, file_count, first_ord, root) otherwise
    than their files (render_id, seq, ord and fields) give it: a batch's number, its count, where it starts, its first
    file, its root; and of what render_completed states (file_count, batch_count, batches_root) about all."""
    at = Window.partitionBy(render).orderBy(seq)
    held = files.groupBy(render, seq).agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("_first"))
    roots_ = record_roots(files, [render, seq], "ord", fields).select(render, seq, F.col("root").alias("_root"))
    j = batches.join(held, [render, seq], "left").join(roots_, [render, seq], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    j = j.withColumn("_i", F.row_number().over(at) - 1).withColumn("_start", F.sum("_n").over(at) - F.col("_n"))
    out = _stated(
        j, [render, seq], wrong_batch=~F.col("batch").eqNullSafe(F.col("_i")), wrong_count=~F.col("file_count").eqNullSafe(F.col("_n")), wrong_first_ord=~F.col("first_ord").eqNullSafe(F.col("_start")),
        wrong_first_file=(F.col("_n") > 0) & (F.col("_first") != F.col("_start")), wrong_root=~F.col("root").eqNullSafe(F.coalesce("_root", F.lit(EMPTY))),
    )
    totals = j.groupBy(render).agg(F.sum("_n").alias("_files"), F.count(F.lit(1)).alias("_batches"))
    whole = roots(batches.withColumn("_leaf", leaf_hash(F.unhex("root"))), [render], [seq], "_leaf").select(render, F.col("root").alias("_all"))
    c = completed.join(totals, render, "left").join(whole, render, "left")
    return out.unionByName(_stated(
        c, [render, seq], wrong_files=~F.col("file_count").eqNullSafe(F.coalesce("_files", F.lit(0))), wrong_batches=~F.col("batch_count").eqNullSafe(F.coalesce("_batches", F.lit(0))), wrong_batches_root=~F.col("batches_root").eqNullSafe(F.coalesce("_all", F.lit(EMPTY))),
    ))


def verify_anchors(anchors: DataFrame, events: DataFrame, stream: str = "stream", seq: str = "seq", heads: DataFrame | None = None, finalised: DataFrame | None = None) -> DataFrame:
    """MRK-8: anchors whose event was deleted (past the head or missing) or has another hash; with a column ``hidden``,
    those that someone tried to hide; heads (stream, seq, event_hash) that state another head than the events have; and
    finalised streams (stream) whose head no anchor seals."""
    e = events.select(stream, seq, "event_hash")
    last = e.groupBy(stream).agg(F.max(seq).alias("head"), F.max_by("event_hash", seq).alias("head_hash"))
    own = anchors.select(stream, seq, F.col("event_hash").alias("anchored"), (F.col("hidden") if "hidden" in anchors.columns else F.lit(False)).alias("hidden"))
    j = own.join(e, [stream, seq], "left").join(last, stream, "left")
    error = F.when(F.col("hidden"), "hidden").when(F.col("head").isNull() | (F.col(seq) > F.col("head")), "events_deleted").when(F.col("event_hash").isNull(), "event_missing").when(F.col("event_hash") != F.col("anchored"), "anchor_differs")
    out = j.select(stream, seq, error.alias("error")).filter("error is not null")
    if heads is not None:
        h = heads.select(stream, F.struct(F.col(seq).alias("s"), F.col("event_hash").alias("h")).alias("_stated")).join(last.select(stream, F.struct(F.col("head").alias("s"), F.col("head_hash").alias("h")).alias("_found")), stream, "left")
        out = out.unionByName(h.filter(~F.col("_stated").eqNullSafe(F.col("_found"))).select(stream, F.col("_stated.s").alias(seq), F.lit("head_differs").alias("error")))
    if finalised is not None:
        sealed = own.filter(~F.col("hidden")).select(stream, F.col(seq).alias("head"), F.col("anchored").alias("head_hash")).distinct()
        bare = last.join(finalised.select(stream), stream, "left_semi").join(sealed, [stream, "head", "head_hash"], "left_anti")
        out = out.unionByName(bare.select(stream, F.col("head").alias(seq), F.lit("not_sealed").alias("error")))
    return out


def anchors_due(events: DataFrame, lifecycle: tuple[str, ...], every: int = 8, stream: str = "stream", seq: str = "seq", kind: str = "event_type", task_rows: int = TASK_ROWS) -> DataFrame:
    """MRK-9: events at which an anchor is due: a lifecycle event, or the every-th since the last anchor.

    Between two lifecycle events the count restarts at the first, so places are a multiple of every within
    each stretch. Streams of up to task_rows are counted by windows. Longer ones are cut into ranges: each
    range counts on its own, and takes over how many events since the last lifecycle event the ranges before
    it end with."""
    life = F.col(kind).isin(*lifecycle)
    longest = events.groupBy(stream).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    e, keys = events.withColumn("_range", F.lit(0)), [stream, "_range"]
    if longest > task_rows:
        e = in_ranges(events, [stream, seq])
    order = Window.partitionBy(*keys).orderBy(seq)
    e = e.withColumn("_part", F.coalesce(F.sum(F.when(life, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(seq)))
    if longest > task_rows:
        # one row per stream and range: its events, and those behind its last lifecycle event (null: it has none)
        last = F.max(F.when(life, F.col(seq)))
        ends = e.groupBy(*keys).agg(last.alias("_last"), F.count(F.lit(1)).alias("_rows"))
        tails = e.join(ends.select(*keys, "_last"), keys).filter(F.col(seq) > F.col("_last")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_tail"))
        ends = ends.join(tails, keys, "left").withColumn("_tail", F.when(F.col("_last").isNotNull(), F.coalesce("_tail", F.lit(0))))
        ahead = Window.partitionBy(stream).orderBy("_range")
        ends = ends.withColumn("_stretch", F.count("_tail").over(ahead))
        held = Window.partitionBy(stream, "_stretch").orderBy("_range")
        ends = ends.withColumn("_open", F.sum(F.coalesce("_tail", "_rows")).over(held))
        ends = ends.withColumn("_carry", F.coalesce(F.lag("_open").over(ahead), F.lit(0))).select(*keys, "_carry")
        e = e.join(ends, keys).withColumn("_n", F.when(F.col("_part") == 0, F.col("_n") + F.col("_carry")).otherwise(F.col("_n"))).drop("_carry")
    return e.filter(life | (F.col("_n") % every == 0)).select(*events.columns)


def chain_fold(events: DataFrame, start: str, finals: tuple[str, ...], stops: tuple[str, ...], batch: str, stream: str = "stream", seq: str = "seq", kind: str = "event_type", outcome: Column | None = None) -> DataFrame:
    """AGG-24 / WIN-13: first start and final of each stream, how many more there are, stops and batches; with
    ``outcome`` (the reconciliation status that an event states, else null) also how many events state each."""
    if outcome is not None:
        named = events.withColumn("_o", outcome).filter("_o is not null").groupBy(stream, "_o").agg(F.count(F.lit(1)).alias("_n"))
        named = named.groupBy(stream).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_o", "_n")))).alias("outcomes"))
        fold = chain_fold(events, start, finals, stops, batch, stream, seq, kind)
        return fold.join(named, stream, "left").withColumn("outcomes", F.coalesce("outcomes", F.create_map().cast("map<string,bigint>")))
    k, s = F.col(kind), F.col(seq)
    first = lambda cond: F.min(F.when(cond, s))
    return events.groupBy(stream).agg(
        first(k == start).alias("started_seq"), F.greatest(F.count_if(k == start) - 1, F.lit(0)).alias("duplicate_starts"), first(k.isin(*finals)).alias("final_seq"), F.min_by(F.when(k.isin(*finals), k), F.when(k.isin(*finals), s)).alias("final_type"),
        F.greatest(F.count_if(k.isin(*finals)) - 1, F.lit(0)).alias("duplicate_finals"), F.count_if(k.isin(*stops)).alias("stops"), F.count_if(k == batch).alias("batches"), F.count(F.lit(1)).alias("events"),
    )


def chain_verdict(fold: DataFrame, unclean: DataFrame, finished: str = "job_finished", stream: str = "stream") -> DataFrame:
    """AGG-25: reasons why a stream isn't clean (empty: it is). unclean: stream, what, n of its units."""
    units = unclean.groupBy(stream).agg(F.array_sort(F.collect_list(F.concat("n", F.lit(" unit(s) "), "what"))).alias("units"))
    j = fold.join(units, stream, "left")
    own = F.filter(F.array(
        F.when(F.col("started_seq").isNull() | (F.col("duplicate_starts") > 0), F.lit("not exactly one start")), F.when(F.col("final_seq").isNull() | (F.col("duplicate_finals") > 0), F.lit("not exactly one final event")).when(F.col("final_type") != finished, F.concat(F.lit("final event "), "final_type")),
        F.when(F.col("stops") > 0, F.concat(F.col("stops"), F.lit(" stop(s) recorded"))),
    ), lambda x: x.isNotNull())
    return j.select(stream, F.concat(own, F.coalesce("units", F.array().cast("array<string>"))).alias("reasons"))


def first_fact(events: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """WIN-13: the first event of each key, with how many later ones there are."""
    w = Window.partitionBy(key)
    return events.withColumn("later", F.count(F.lit(1)).over(w) - 1).withColumn("_n", F.row_number().over(w.orderBy(seq))).filter("_n = 1").drop("_n")


def integrity_mismatches(items: DataFrame, pages: DataFrame, page_id: str, json: str, path: str, raw_hash: str) -> DataFrame:
    """JON-27: items whose part of the stored page hashes to something else; paths are grouped per page."""
    j = items.join(pages.select(page_id, json), page_id, "left")
    now = F.sha2(F.expr(f"get_json_object(`{json}`, `{path}`)"), 256)
    return j.withColumn("_now", now).filter(~F.col("_now").eqNullSafe(F.col(raw_hash))).drop("_now", json)


def derivation_mismatches(derivations: DataFrame, derived: str = "derived", derived_hash: str = "derived_hash") -> DataFrame:
    """JON-27: derivations whose canonical JSON hashes to something else than was recorded with them."""
    return derivations.filter(~F.sha2(canonical_json(F.col(derived)), 256).eqNullSafe(F.col(derived_hash)))
