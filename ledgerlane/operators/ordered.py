"""Values carried along an order within a key, linear in the rows of a key and spread over tasks where keys are long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.plans.shared import in_ranges

#: Rows of one key that a window may put in one task's order.
TASK_ROWS = 1_000_000


def last_known(rows: DataFrame, key: str, order: list[str], value: str, name: str, descending: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows with ``name``: the last value that isn't null of the rows before each one in the order of its key (of
    the rows after it, nearest first, if descending). No two rows of a key may tie where that matters.

    Frames have no end, so each row is read once. Where a key has more than task_rows rows, all are cut into
    ranges of (key, order): a range carries its own values and takes over the last value of the ranges before it, of
    which there is one row per key and range."""
    turn = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    before = lambda *keys: Window.partitionBy(*keys).orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    if longest(rows, key) <= task_rows:
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(before(key)))
    ranges = in_ranges(rows, [F.col(key).asc(), *turn])
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranges.groupBy(F.col(key).alias("_of"), F.col("_range").alias("_in")).agg((F.min_by if descending else F.max_by)(value, place).alias("_end"))
    ahead = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(ahead)).drop("_end")
    own = ranges.withColumn(name, F.last(value, ignorenulls=True).over(before(key, "_range")))
    both = own.join(ends, F.col("_range").eqNullSafe(F.col("_in")) & F.col(key).eqNullSafe(F.col("_of")))
    return both.withColumn(name, F.coalesce(name, "_carried")).drop("_carried", "_of", "_in", "_range")


def longest(rows: DataFrame, key: str) -> int:
    """Rows of the key that has most."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def first_known(rows: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """(key, value): the first value that isn't null of each key, by a partial minimum before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), order)).alias(value))
