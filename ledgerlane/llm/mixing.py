"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. Its whole part
is taken as it is; the fraction is rounded by pairing documents: words are moved at random from one to
the other until one of the two fractions is 0 or 1, and the other document goes on as the residual.
Each pairing keeps the pair's words and the expectation of both fractions. Documents are folded in blocks
of about ``BLOCK``, drawn by hash within a source and a size class (a power of two), and the residuals
of the blocks are folded again, level by level. The few residuals of a source, one per size class, are
rounded last, largest first, each to the side that keeps the source nearest to its target.

Defined results: a null text or size counts 0 words and takes 0; sources order by code point, null is a
source of its own and last; equal rows are units of their own (their copies are told apart by a number);
an empty table gives no rows; only the named columns are read, so others can't clash. Random draws are
hashes of id, copy number and seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.llm.common import cut_lineage, salted_left, unwrapped, wrapped

#: Documents folded together; also the fan-in of the reduction tree.
BLOCK = 256
#: Weights by the source's place, repeating.
WEIGHTS = (5, 2, 1)
#: A target is this many times its source's size at most.
REPEATS = 3
#: Copies of one row that are made in one array.
RUN = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null has 0."""
    runs = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(runs, " \t\n\x0b\x0c\r", "")).cast("long")


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """keys with ``place`` from 0, by code point, null last, without one task that sees all of them."""
    parts = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = keys.repartitionByRange(int(parts), F.col(key).asc_nulls_last()).sortWithinPartitions(F.col(key).asc_nulls_last())
    numbered = cut_lineage(spread.withColumn("_n", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftright("_n", 33)).withColumn("_n", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))
    # one row per partition of the range exchange
    before = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = before.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").select(*keys.columns, (F.col("_n") + F.col("_before")).alias("place"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of every source in sized (source, size).

    The words of all sources are shared by weight; a target stops at ``repeats`` times its source's size
    and the excess is shared again by weight. Only sums come to the driver."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(
        ranked(sources, "source").select(
            "source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * repeats).alias("cap")
        )
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while total:
        above = F.col("cap") <= F.lit(level) * F.col("weight") if stopped >= 0 else F.lit(False)
        row = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("caps"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        if row["n"] == stopped or not row["weights"]:
            break
        stopped, level = row["n"], (total - row["caps"]) / row["weights"]
    share = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return sources.select("source", "source_size", share.alias("target"))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pair(state: Column, x: Column, seed: int) -> Column:
    """One pairing: state.unit (the residual) with x; the one that becomes 0 or 1 goes to state.done."""
    cur, none = state["unit"], F.array().cast(_DONE_TYPE)

    def settled(unit: Column, take: float) -> Column:
        return F.array(F.struct(unit["doc_id"].alias("doc_id"), unit["copy"].alias("copy"), unit["size"].alias("size"), F.lit(take).cast("int").alias("take")))

    def left(unit: Column, part: Column) -> Column:
        return F.struct(unit["h"].alias("h"), unit["doc_id"].alias("doc_id"), unit["copy"].alias("copy"), unit["size"].alias("size"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)).alias("part"))

    def step(z: Column) -> Column:
        gain, lose = z["up"], z["down"]
        up_first = (1 - cur["part"]) * cur["size"] <= x["part"] * x["size"]
        down_first = cur["part"] * cur["size"] <= (1 - x["part"]) * x["size"]
        draw = F.pmod(F.xxhash64(cur["h"], x["h"], F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        rises = draw * (gain + lose) < lose
        unit = F.when(rises & up_first, left(x, x["part"] - gain / x["size"])).when(rises, left(cur, cur["part"] + gain / cur["size"])).when(down_first, left(x, x["part"] + lose / x["size"])).otherwise(left(cur, cur["part"] - lose / cur["size"]))
        done = F.when(rises & up_first, settled(cur, 1)).when(rises, settled(x, 0)).when(down_first, settled(cur, 0)).otherwise(settled(x, 1))
        return F.struct(unit.alias("unit"), F.concat(state["done"], done).alias("done"))

    moves = F.struct(
        F.least((1 - cur["part"]) * cur["size"], x["part"] * x["size"]).alias("up"),
        F.least(cur["part"] * cur["size"], (1 - x["part"]) * x["size"]).alias("down"),
    )
    return F.when(cur.isNull(), F.struct(x.alias("unit"), none.alias("done"))).otherwise(_bind(moves, step))


_UNIT_TYPE = "struct<h:bigint,doc_id:bigint,copy:bigint,size:bigint,part:double>"
_DONE_TYPE = "array<struct<doc_id:bigint,copy:bigint,size:bigint,take:int>>"


def _fold(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """keys, unit (the residual) and done of every group of units; a group has about BLOCK of them."""
    listed = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "copy", "size", "part"))).alias("units"))
    start = F.struct(F.lit(None).cast(_UNIT_TYPE).alias("unit"), F.array().cast(_DONE_TYPE).alias("done"))
    folded = listed.select(*keys, F.aggregate("units", start, lambda s, x: _pair(s, x, seed)).alias("s"))
    return cut_lineage(folded.select(*keys, "s.unit", "s.done"))


def _nearest(residuals: DataFrame) -> DataFrame:
    """Rounds a source's residuals, one per size class, largest first, each to the side that keeps the
    sum of all changes in words nearest to 0."""
    listed = residuals.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("unit.size").alias("size"), F.col("unit.h").alias("h"), "unit")), asc=False).alias("units"))
    start = F.struct(F.lit(0.0).alias("off"), F.array().cast(_DONE_TYPE).alias("done"))

    def step(s: Column, x: Column) -> Column:
        u = x["unit"]
        one, zero = s["off"] + (1 - u["part"]) * u["size"], s["off"] - u["part"] * u["size"]
        return _bind(
            F.abs(one) <= F.abs(zero),
            lambda up: F.struct(
                F.when(up, one).otherwise(zero).alias("off"),
                F.concat(s["done"], F.array(F.struct(u["doc_id"].alias("doc_id"), u["copy"].alias("copy"), u["size"].alias("size"), up.cast("int").alias("take")))).alias("done"),
            ),
        )

    return listed.select("source", F.aggregate("units", start, step, lambda s: s["done"]).alias("done"))


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """Copies of every row of sized (doc_id long, source string, size long): one row per row of sized
    with doc_id, source, copy (number among equal rows), size, source_size, target, copies and taken words."""
    sized = cut_lineage(sized.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")))
    wanted = cut_lineage(targets(sized, weights, repeats).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())))
    same = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_m"))
    runs = same.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_m") - 1) / RUN))))
    units = runs.withColumn("_at", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("_m") - F.col("_run") * RUN))))
    units = units.select("doc_id", "source", "size", (F.col("_at") + F.col("_run") * RUN).cast("long").alias("copy"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_key"))
    units = salted_left(units, wanted.select("_key", "source_size", "target", "rate"), "_key").drop("_key")
    whole = F.floor("rate")
    units = units.withColumn("whole", whole.cast("int")).withColumn("part", F.col("rate") - whole).withColumn("h", F.xxhash64("doc_id", "copy", F.lit(seed)))
    units = cut_lineage(units.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")))
    open_units = units.filter("size > 0 and part > 0")
    # one row per source and class, of which there are 63 at most
    blocks = cut_lineage(open_units.groupBy("source", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")).withColumn("_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "class")))
    keyed = open_units.withColumn("_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "class"))
    level = salted_left(keyed, blocks.select("_key", "n"), "_key").withColumn("block", F.pmod("h", F.col("n")))
    settled, most = [], blocks.agg(F.max("n")).first()[0] or 0
    while most > 0:
        folded = _fold(level, ["source", "class", "block"], seed)
        settled.append(folded.select("source", F.explode("done").alias("d")))
        level = folded.select("source", "class", F.floor(F.col("block") / BLOCK).alias("block"), "unit.*")
        most = 0 if most == 1 else -(-most // BLOCK)
        if not most:
            settled.append(_nearest(folded).select("source", F.explode("done").alias("d")))
    sources = wanted.select(F.col("_key"), "source_size", "target", F.floor("rate").cast("int").alias("whole"))
    out = units.filter("not (size > 0 and part > 0)").select("doc_id", "source", "copy", "size", "source_size", "target", F.col("whole").alias("copies"))
    for part in settled:
        rows = part.select(F.col("d.doc_id").alias("doc_id"), "source", F.col("d.copy").alias("copy"), F.col("d.size").alias("size"), F.col("d.take").alias("take"), F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("_key"))
        rows = salted_left(rows, sources, "_key")
        out = out.unionByName(rows.select("doc_id", "source", "copy", "size", "source_size", "target", (F.col("whole") + F.col("take")).alias("copies")))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Rows of docs (with source and text), each as often as the mix takes it. Rows are told apart by a hash
    of all their columns; equal rows are taken as often as all of them together."""
    rows = wrapped(docs).select("row", F.xxhash64("row").alias("unit"), F.col("row.source").cast("string").alias("unit_source"), word_count(F.col("row.text")).alias("unit_size"))
    sized = rows.select(F.col("unit").alias("doc_id"), F.col("unit_source").alias("source"), F.col("unit_size").alias("size"))
    plan = mix(sized, seed=seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    one = rows.dropDuplicates(["unit", "unit_source", "unit_size"])
    on = (one["unit"] == plan["doc_id"]) & one["unit_source"].eqNullSafe(plan["source"]) & (one["unit_size"] == plan["size"])
    taken = one.join(plan, on).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
    return unwrapped(taken.withColumn("again", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN)))), docs)
