"""MRK-11: a report's content rebuilt from the chain alone, and how what it states differs from that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.functions import status as S
from ledgerlane.operators import reconcile as R
from ledgerlane.operators.custody import chain_fold, chain_verdict

#: Events of a job's chain, and what a clean job has no unit of.
STARTED, FINISHED = "job_started", "job_finished"
SETTLED = ("unit_reconciled", "unit_failed")
STOPS = ("cancel_requested", "job_failed")
PAUSED, RESUMED = "job_paused", ("job_resumed", "job_pause_ended")
UNCLEAN = ("gap", "surplus", "access_lost", "unverifiable", "failed")

#: What an event that settles a unit says about it.
FACT = "unit_key STRING, kind STRING, conversation_id STRING, day STRING, recon_status STRING, expected_count BIGINT, collected BIGINT, file_gaps BIGINT"
UNIT = ["kind", "conversation_id", "day", "status", "recon_status", "expected_count", "collected", "file_gaps"]
#: The sections of a report: the columns of each, beside stream and name.
SECTIONS = {
    "units": UNIT, "units_by_status": ["n"], "units_by_recon_status": ["n"], "totals": ["n"], "exceptions": ["unit_key", "state"], "exceptions_total": ["n"],
    "conversations": ["units", "worst", "by_status", "expected_count", "collected", "file_gaps"], "pauses": ["resumed_ms", "ended_how"], "actors": ["n"], "verdict": ["clean"],
}


def settled_facts(events: DataFrame) -> DataFrame:
    """stream, seq and the fact of each event (stream, seq, event_type, payload) that settles a unit."""
    own = events.filter(F.col("event_type").isin(*SETTLED))
    fact = own.withColumn("_f", F.from_json("payload", FACT, {"mode": "FAILFAST"}))
    status = F.when(F.col("event_type") == "unit_failed", "failed").otherwise("done")
    return fact.select("stream", "seq", status.alias("status"), "_f.*")


def unit_facts(events: DataFrame) -> DataFrame:
    """The unit rows that a chain gives: of several facts of a unit the first stands."""
    fields = [c for c in UNIT if c != "unit_key"]
    first = settled_facts(events).groupBy("stream", "unit_key").agg(F.min_by(F.struct(*fields), "seq").alias("_f"))
    return first.select("stream", "unit_key", "_f.*")


def _named(rows: DataFrame, name: str, section: str) -> DataFrame:
    return rows.select("stream", F.col(name).cast("string").alias("name"), *SECTIONS[section])


def unit_sections(units: DataFrame, cap: int) -> dict[str, DataFrame]:
    """What a report derives from its unit rows (stream, unit_key and UNIT), for each stream."""
    state = S.severity(F.col("status"), F.col("recon_status"))
    u = units.withColumn("state", state)
    streams = units.select("stream").distinct()

    def counted(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
        every = streams.withColumn("name", F.explode(F.array(*[F.lit(v) for v in values])))
        return every.join(rows.groupBy("stream", F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n")), ["stream", "name"], "full").withColumn("n", F.coalesce("n", F.lit(0)))

    sums = units.groupBy("stream").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected_count", "collected", "file_gaps")])
    totals = sums.select("stream", F.explode(F.create_map(*[x for c in sums.columns[1:] for x in (F.lit(c), F.col(c))])).alias("name", "n"))
    bad = u.filter(F.col("state").isin(*S.EXCEPTIONS))
    order = [S.rank(F.col("state")), F.coalesce("conversation_id", F.lit("")), F.coalesce("day", F.lit("")), F.col("unit_key")]
    worst = bad.withColumn("place", F.row_number().over(Window.partitionBy("stream").orderBy(*order))).filter(F.col("place") <= cap)
    rolled = R.conversation_rollup(units, ["stream", "conversation_id"])
    by = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return {
        "units": _named(units, "unit_key", "units"), "units_by_status": counted(units, "status", S.UNIT_STATUS), "units_by_recon_status": counted(units.filter("kind <> 'directory'"), "recon_status", S.RECON_STATUS), "totals": totals,
        "exceptions": _named(worst, "place", "exceptions"), "exceptions_total": bad.groupBy("stream", F.lit("all").alias("name")).agg(F.count(F.lit(1)).alias("n")), "conversations": _named(rolled.withColumn("by_status", by), "conversation_id", "conversations"),
    }


def job_sections(events: DataFrame, units: DataFrame) -> dict[str, DataFrame]:
    """What a report says about each job (stream) itself: its pauses, its actors, whether it is clean."""
    paused = R.pauses(events, PAUSED, RESUMED).withColumn("resumed_ms", F.unix_millis("resumed_at") - F.unix_millis("paused_at"))
    actors = events.groupBy("stream", F.concat_ws("/", "event_type", "actor").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    fold = chain_fold(events, STARTED, (FINISHED,), STOPS, "items_collected")
    # only units of a conversation's day can be unclean
    unclean = units.filter("kind = 'conversation_day'").withColumn("what", F.when(F.col("status") == "failed", "failed").otherwise(F.col("recon_status"))).filter(F.col("what").isin(*UNCLEAN))
    verdict = chain_verdict(fold, unclean.groupBy("stream", "what").agg(F.count(F.lit(1)).cast("string").alias("n")), FINISHED)
    return {"pauses": _named(paused, "seq", "pauses"), "actors": actors, "verdict": verdict.select("stream", F.lit("clean").alias("name"), (F.size("reasons") == 0).alias("clean"))}


def report_sections(events: DataFrame, cap: int = 500) -> dict[str, DataFrame]:
    """Every section of a report, from a chain (stream, seq, event_type, actor, payload, at) and nothing else."""
    units = unit_facts(events)
    return unit_sections(units, cap) | job_sections(events, units)


def differences(mine: DataFrame, stated: DataFrame, fields: list[str]) -> DataFrame:
    """stream, name, field, recomputed and stated of rows that differ or are on one side only (both ways)."""
    a, b = (rows.select("stream", "name", F.struct(*fields).alias(side)) for rows, side in ((mine, "a"), (stated, "b")))
    j = a.join(b, ["stream", "name"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    one = F.when(F.col("b").isNull(), F.struct(F.lit("row").alias("field"), F.lit("there").alias("recomputed"), F.lit("missing").alias("stated"))).when(F.col("a").isNull(), F.struct(F.lit("row").alias("field"), F.lit("missing").alias("recomputed"), F.lit("there").alias("stated")))
    each = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("recomputed"), F.col(f"b.{c}").cast("string").alias("stated"))) for c in fields]), lambda d: d.isNotNull())
    return j.select("stream", "name", F.explode(F.when(one.isNotNull(), F.array(one)).otherwise(each)).alias("d")).select("stream", "name", "d.*")


def recompute(events: DataFrame, stated: dict[str, DataFrame], cap: int = 500) -> DataFrame:
    """MRK-11: section, stream, name, field, recomputed and stated of everything a report states otherwise than its chain
    gives it. A report that isn't clean where the chain is has other reasons, which the chain doesn't know."""
    out = None
    for section, mine in report_sections(events, cap).items():
        found = differences(mine, stated[section], SECTIONS[section])
        if section == "verdict":
            found = found.filter("not (recomputed <=> 'true')")
        found = found.select(F.lit(section).alias("section"), "*")
        out = found if out is None else out.unionByName(found)
    return out
