"""Order-independent digests: sums of SHA-256 modulo 2^256, whole and by bucket, and what they prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, LANE = 8, 1 << 32
BUCKETS = 4096


def lane_sums(hashed: Column) -> list[Column]:
    """Sums of the eight 32-bit lanes of hex SHA-256 values; exact up to 2^31 rows per group."""
    return [F.sum(F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"lane{i}") for i in range(LANES)]


def carried(lanes: list[Column]) -> Column:
    """Lane sums as a 64-digit hex number modulo 2^256; null sums count 0."""
    digits, carry = [], F.lit(0).cast("long")
    for lane in reversed(lanes):
        total = F.coalesce(lane, F.lit(0)) + carry
        digits.append(F.lpad(F.lower(F.hex(F.pmod(total, F.lit(LANE)))), 8, "0"))
        carry = F.shiftright(total, 32)
    return F.concat(*reversed(digits))


def multiset_digest(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """AGG-6: keys, rows and digest; equal digests mean equal multisets of values."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *lane_sums(F.sha2(value, 256)))
    return sums.select(*keys, "rows", carried([F.col(f"lane{i}") for i in range(LANES)]).alias("digest"))


def bucket_of(key: Column) -> Column:
    """First 12 bits of a key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 3), 16, 10).cast("int")


def bucketed_digest(rows: DataFrame, key: Column, record: Column) -> DataFrame:
    """AGG-5, one side: bucket, rows and digest."""
    return multiset_digest(rows.select(bucket_of(key).alias("bucket"), record.alias("_r")), ["bucket"], F.col("_r"))


def differing_buckets(one: DataFrame, other: DataFrame) -> DataFrame:
    """AGG-5: buckets whose digests differ, of which there are BUCKETS at most."""
    a, b = one.select("bucket", F.col("digest").alias("a")), other.select("bucket", F.col("digest").alias("b"))
    return a.join(b, "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def compare_facts(chain: DataFrame, database: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """JON-9: differences between a chain's unit facts and a database's, compared in differing buckets only.

    kinds: duplicate_unit_event, unit_unsettled_in_database (settled column false), unit_missing_from_chain,
    unit_differs. The first chain fact of a unit states it."""
    record = F.to_json(F.struct(key, *fields), {"ignoreNullFields": "false"})
    wide = differing_buckets(bucketed_digest(chain, F.col(key), record), bucketed_digest(database.filter("settled"), F.col(key), record))
    few = F.broadcast(wide)  # BUCKETS rows at most
    c = chain.withColumn("bucket", bucket_of(F.col(key))).join(few, "bucket", "left_semi")
    d = database.withColumn("bucket", bucket_of(F.col(key))).join(few, "bucket", "left_semi")
    stated = c.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("stated"), F.count(F.lit(1)).alias("n"))
    both = stated.join(d.select(key, "settled", F.struct(*fields).alias("held")), key, "full")
    kinds = F.array(
        F.when(F.col("n") > 1, F.lit("duplicate_unit_event")), F.when(F.col("stated").isNotNull() & ~F.coalesce("settled", F.lit(False)), F.lit("unit_unsettled_in_database")),
        F.when(F.col("stated").isNull() & F.col("settled"), F.lit("unit_missing_from_chain")), F.when(F.col("stated").isNotNull() & F.col("settled") & ~F.col("stated").eqNullSafe(F.col("held")), F.lit("unit_differs")),
    )
    return both.select(key, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("difference"))


def multiset_difference(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """SET-4 / SET-6: keys whose counts differ, with what is missing from other and extra in it."""
    a, b = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("a")), other.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    d = a.join(b, keys, "full").select(*keys, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d")).filter("d <> 0")
    return d.select(*keys, F.greatest("d", F.lit(0)).alias("missing"), F.greatest(-F.col("d"), F.lit(0)).alias("extra"))
