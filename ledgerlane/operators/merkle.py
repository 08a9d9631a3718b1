"""RFC 6962 Merkle roots per group, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.functions.canonical import canonical_row
from ledgerlane.plans.shared import in_ranges

#: Rows of one group that a window may put in one task's order.
TASK_ROWS = 1_000_000
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def leaf_hash(data: Column) -> Column:
    """Hex hash of a leaf's bytes."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256)


def node_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def indexed(leaves: DataFrame, group: list[str], order: list[str], most: int, twice: str | None = None) -> DataFrame:
    """leaves with their place i (from 0) in their group; an order that comes twice in it raises ``twice``.

    Groups of up to TASK_ROWS are numbered by a window;
    if one is larger (``most``), leaves are cut into ranges of the order, numbered there, and moved on by
    the leaves of their group in earlier ranges, of which there is one row per group and range."""
    same = lambda w: F.coalesce(F.lag(F.struct(*order)).over(w) == F.struct(*order), F.lit(False))
    sure = lambda i, again: i if twice is None else F.when(again, F.raise_error(F.lit(twice)).cast("long")).otherwise(i)
    if most <= TASK_ROWS:
        w = Window.partitionBy(*group).orderBy(*order)
        return leaves.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("i", sure(F.col("i"), same(w)))
    ranges = in_ranges(leaves, [*group, *order])
    own = Window.partitionBy(*group, "_range")
    counts = ranges.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).drop("_n")
    # equal orders are in one range
    numbered = ranges.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_i", sure(F.col("_i"), same(own.orderBy(*order))))
    return numbered.join(before, [*group, "_range"]).withColumn("i", (F.col("_i") + F.col("_before")).cast("long")).drop("_i", "_before", "_range")


#: Levels of a tree that one aggregation folds; leaves of a group that one aggregation folds whole.
FOLD, WHOLE = 6, 1024


def _paired(level: Column) -> Column:
    """The level above an array of hashes; an odd last one is lifted."""
    half = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    pairs = F.transform(half, lambda i: F.when(2 * i + 1 < F.size(level), node_hash(F.get(level, 2 * i), F.get(level, 2 * i + 1))).otherwise(F.get(level, 2 * i)))
    return F.when(F.size(level) <= 1, level).otherwise(pairs)


def _folded(hashes: Column, levels: int) -> Column:
    """The node that many levels above an array of hashes."""
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), hashes, lambda level, _: _paired(level)), F.lit(0))


def roots(leaves: DataFrame, group: list[str], order: list[str], leaf: str, twice: str | None = None) -> DataFrame:
    """MRK-1: group, root and leaves of each group's leaf hashes in order; an order that comes twice in a group raises ``twice``.

    Each level pairs neighbours and lifts an odd last node, which gives the same root as splitting at the
    largest power of two below n. An aggregation by (group, i / 2^FOLD) folds FOLD levels of an array of 2^FOLD hashes at
    most; the number of aggregations comes from the largest group. No task holds a large group (see ``indexed``); where none has
    over WHOLE leaves, one aggregation folds all levels."""
    sizes = leaves.groupBy(*group).agg(F.count(F.lit(1)).alias("leaves"))
    most = sizes.agg(F.max("leaves")).first()[0] or 0
    levels = max(0, most - 1).bit_length()
    rows = leaves.select(*group, *order, F.col(leaf).alias("h"))
    if most <= WHOLE:
        n = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), "h"))).alias("n"), F.count(F.lit(1)).alias("leaves"))
        root = _folded(F.transform("n", lambda x: x["h"]), max(1, levels))
        if twice is not None:
            again = F.exists(F.sequence(F.lit(1), F.greatest(F.size("n") - 1, F.lit(1))), lambda i: F.get("n", i)["o"] == F.get("n", i - 1)["o"])
            root = F.when(again, F.raise_error(F.lit(twice)).cast("string")).otherwise(root)
        return n.select(*group, root.alias("root"), "leaves")
    level = indexed(rows, group, order, most, twice).select(*group, "i", "h", F.lit(1).cast("long").alias("leaves"))
    while levels > 0:
        up = min(FOLD, levels)
        level = level.groupBy(*group, F.shiftright("i", up).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("n"), F.sum("leaves").alias("leaves"))
        level = level.select(*group, "i", _folded(F.transform("n", lambda x: x["h"]), up).alias("h"), "leaves")
        levels -= up
    return level.select(*group, F.col("h").alias("root"), "leaves")


def array_root(hashes: Column) -> Column:
    """MRK-1 for small groups: root of an array of up to 65,536 leaf hashes, as one expression; more raise."""
    hashes = F.when(F.size(hashes) <= 1 << 16, hashes).otherwise(F.raise_error(F.lit("too many leaves for one array")).cast("array<string>"))
    return F.coalesce(F.get(F.aggregate(F.sequence(F.lit(1), F.lit(16)), hashes, lambda level, _: _paired(level)), F.lit(0)), F.lit(EMPTY))


def batch_roots(items: DataFrame, batch: list[str], key: str, content_hash: str) -> DataFrame:
    """MRK-2: batch, root and item_count over leaves key + content hash (32 bytes each) ordered by key; a key
    that comes twice in a batch raises."""
    twice = items.groupBy(*batch, key).agg(F.count(F.lit(1)).alias("_n"), F.first(content_hash).alias(content_hash))
    sure = F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key in a batch")).cast("string")).otherwise(F.col(key))
    leaves = twice.withColumn("_leaf", leaf_hash(F.concat(F.unhex(sure), F.unhex(content_hash))))
    return roots(leaves, batch, [key], "_leaf").withColumnRenamed("leaves", "item_count")


def record_roots(records: DataFrame, batch: list[str], ord_column: str, fields: list[str]) -> DataFrame:
    """MRK-3: root over canonical JSON (RFC 8785) of fixed fields in order; an ord that comes twice raises."""
    leaves = records.select(*batch, ord_column, leaf_hash(canonical_row(records, fields)).alias("_leaf"))
    return roots(leaves, batch, [ord_column], "_leaf", twice="ord comes twice")
