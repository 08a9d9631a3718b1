"""MinHash near-duplicate detection with odd sketches.

Each distinct set of five-word shingles is a class. A class has 128 MinHash samples, cut into 32 bands of
four, and an odd sketch: 512 bits, of which each sample flips one. The population count of two sketches'
XOR estimates high similarities precisely; candidates are pairs of classes that share a band and whose
estimate is not clearly below the threshold, and the full shingle sets decide.

A band's bucket of up to ``SMALL`` classes pairs all of them. In a larger one every class is paired with
the bucket's hub (the class with the most company over all bands). When the links found so far have been
joined into components, classes of a large bucket outside its hub's component are compared with all
classes of the bucket in other components: no candidate is given up, and a group of close copies costs a
row per copy. Those comparisons use a second odd sketch of 2,048 bits over the smallest hashes, about 1,000
to 2,000 of them (all of a smaller set's), which tells similarities apart to about 0.01. Pairs with
similarity 0.75 share a band with probability 1 - 5e-6.

Defined results: null texts and texts without words have an empty set, 0 shingles and no link; 1 to 4 words
make one shingle; equal sets are always one group; rows without an id belong to their group but never name
it; rows with equal ids are each given the result of their text, and where one text stays of a component, equal
ids don't make two; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.llm.common import cut_lineage, hashed_words, map_texts, mix64, salted_left, set_id, shingles, unwrapped, wrapped

SAMPLES, BAND = 128, 4
SKETCH_WORDS = 8
SMALL = 24
#: Classes outside a hub's component that one task compares with their bucket.
SPREAD = 256
#: Estimates below this are no candidates; the estimate's error is about 0.05 near the threshold.
ESTIMATE = 0.58

#: The second sketch: its words, the samples it holds at most, and the estimates below which a pair can't
#: link, for whole sets (the estimate's error is about 0.006) and for samples of larger ones (0.012).
FINE_WORDS, FINE_SAMPLES, FINE_ESTIMATES = 32, 2_000, (0.72, 0.70)

_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)

SIGNATURE = "doc_id long, th long, set_id string, n_shingles long, bands array<long>, " + ", ".join(f"o{i} long" for i in range(SKETCH_WORDS))


def min_hashes(hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) smallest hashes of the shingles of each text; starts of the texts' shingles."""
    low = (hashed >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(starts)), dtype=np.uint32)
    for i in range(SAMPLES):
        out[i] = np.minimum.reduceat((low ^ _XOR[i]) * _MUL[i], starts)
    return out.T


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(texts, bands) 64-bit keys; the band's number is part of the key."""
    n = mins.shape[0]
    rows = mins.reshape(n, SAMPLES // BAND, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(SAMPLES // BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for j in range(BAND):
        key = mix64(key * np.uint64(31) + rows[:, :, j] + np.uint64(j + 1))
    return key.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_WORDS) parity bitmaps of the samples, each with its number."""
    n, bits = mins.shape[0], SKETCH_WORDS * 64
    at = (mix64((np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) + mins.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
    flips = np.zeros((n, bits), dtype=np.uint8)
    np.add.at(flips, (np.arange(n)[:, None], at), 1)
    return np.packbits(flips & 1, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SIGNATURE.split(", ")]
    for batch in batches:
        ids, th = batch.column(0), batch.column(2)
        for first, last, counts, hashes, _, _ in hashed_words(batch.column(1)):
            edges = np.concatenate([[0], np.cumsum(counts)])
            sets = [shingles(hashes[edges[i] : edges[i + 1]]) for i in range(last - first)]
            sizes = np.array([len(s) for s in sets])
            have = np.flatnonzero(sizes)
            keys, sketch = [None] * len(sets), np.zeros((len(sets), SKETCH_WORDS), dtype=np.int64)
            if len(have):
                mins = min_hashes(np.concatenate([sets[i] for i in have]), np.concatenate([[0], np.cumsum(sizes[have])[:-1]]))
                for i, row in zip(have.tolist(), band_keys(mins), strict=True):
                    keys[i] = row
                sketch[have] = odd_sketches(mins)
            columns = [ids.slice(first, last - first), th.slice(first, last - first), pa.array([set_id(s) if len(s) else "" for s in sets], pa.string()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(sketch[:, i]) for i in range(SKETCH_WORDS)]], names)


def signatures(docs: DataFrame) -> DataFrame:
    """Set, bands and odd sketch of every text, with the text's hash."""
    text = F.col("text").cast("string")
    return map_texts(docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)), _signed, SIGNATURE)


def estimate(one: list[Column], other: list[Column]) -> Column:
    """Similarity of two classes by their odd sketches."""
    bits = SKETCH_WORDS * 64
    odd = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(one, other, strict=True)), F.lit(0))
    return 1 + bits / (4 * SAMPLES) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * odd / bits))


FINE = "cid long, share int, sampled long, " + ", ".join(f"f{i} long" for i in range(FINE_WORDS))


def fine_sketch(distinct: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(share, samples, parity bitmap): the hashes below 2^64 / 2^share are the samples."""
    share = 0
    while len(distinct) >> share > FINE_SAMPLES:
        share += 1
    own = distinct[distinct >> np.uint64(64 - share) == 0] if share else distinct
    flips = np.bincount((mix64(own) % np.uint64(FINE_WORDS * 64)).astype(np.int64), minlength=FINE_WORDS * 64) & 1
    return share, len(own), np.packbits(flips.astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FINE.split(", ")]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, last, counts, hashes, _, _ in hashed_words(batch.column(2)):
            edges, rows = np.concatenate([[0], np.cumsum(counts)]), []
            for i in range(last - first):
                own = shingles(hashes[edges[i] : edges[i + 1]])
                if len(own) and set_id(own) == batch.column(1)[first + i].as_py():
                    rows.append((ids[first + i], *fine_sketch(own)))
            bits = np.stack([r[3] for r in rows]) if rows else np.zeros((0, FINE_WORDS), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), *[pa.array(bits[:, i]) for i in range(FINE_WORDS)]], names)


def may_link(tag_a: str, tag_b: str) -> Column:
    """Whether two classes' second sketches leave a link possible; sketches of different shares always do."""
    bits = FINE_WORDS * 64
    odd = sum((F.bit_count(F.col(f"{tag_a}_f{i}").bitwiseXOR(F.col(f"{tag_b}_f{i}"))) for i in range(FINE_WORDS)), F.lit(0))
    apart = -bits / 2 * F.log(F.greatest(F.lit(1e-9), 1 - 2 * odd / bits))
    both = F.col(f"{tag_a}_sampled") + F.col(f"{tag_b}_sampled")
    return (F.col(f"{tag_a}_share") != F.col(f"{tag_b}_share")) | (both - apart >= F.when(F.col(f"{tag_a}_share") == 0, FINE_ESTIMATES[0]).otherwise(FINE_ESTIMATES[1]) * (both + apart))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs whose full sets are alike; columns a, b, a_set, b_set, a_text, b_text."""

    def full(text: str | None) -> np.ndarray:
        words = [h for _, _, _, h, _, _ in hashed_words(pa.array([text], pa.string()))]
        return shingles(words[0]) if words else shingles(np.zeros(0, dtype=np.uint64))

    last, known = None, None
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out = []
        for i in range(batch.num_rows):
            if a[i] != last or known is None:
                last, known = a[i], full(batch.column(4)[i].as_py())
                right = set_id(known) == batch.column(2)[i].as_py()
            other = full(batch.column(5)[i].as_py())
            both = len(np.intersect1d(known, other, assume_unique=True))
            if right and set_id(other) == batch.column(3)[i].as_py() and 100 * both >= 75 * (len(known) + len(other) - both):
                out.append(i)
            elif not right:
                known = None
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64())), batch.column(1).take(pa.array(out, pa.int64()))], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b): label is the smallest node that is reached. Labels
    take the neighbours' smallest and then their own label's, until nothing changes."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    changed = True
    while changed:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = cut_lineage(hooked.join(jump, hooked["label"] == jump["_n"], "left").select("node", "old", F.least("label", F.coalesce("_l", "label")).alias("label")))
        changed = not new.filter("old <> label").isEmpty()
        labels = new.select("node", "label")
    return labels


def _paired(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among candidate pairs (a, b), a < b, by their full sets."""
    a = texts.select(F.col("cid").alias("a"), F.col("set_id").alias("a_set"), F.col("text").alias("a_text"))
    b = texts.select(F.col("cid").alias("b"), F.col("set_id").alias("b_set"), F.col("text").alias("b_text"))
    whole = rows.join(b, "b").join(a, "a").select("a", "b", "a_set", "b_set", "a_text", "b_text")
    return cut_lineage(map_texts(whole, _verified, "a long, b long").distinct())


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), set_id, n_shingles, component_id, kept and chosen of every row of docs
    (doc_id, text). chosen: the rows of one text of each component, that of the smallest id (null last)."""
    signed = cut_lineage(signatures(docs))
    sketch = [f"o{i}" for i in range(SKETCH_WORDS)]
    grouped = signed.filter("set_id <> ''").groupBy("set_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    classes = grouped.agg(first, F.count(F.lit(1)).alias("n_rows"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in sketch])
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))

    rows = classes.select("cid", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slim = cut_lineage(rows.join(shared, "band"))
    company = cut_lineage(slim.groupBy("cid").agg(F.sum("n").alias("company")))
    members = cut_lineage(slim.join(classes.select("cid", *sketch), "cid"))
    wanted = classes.join(company, "cid", "left_semi").select("cid", "set_id", F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    texts = plain.join(wanted, (plain["th"] == wanted["_th"]) & plain["doc_id"].eqNullSafe(wanted["_id"])).select("cid", "set_id", "text")
    texts = cut_lineage(texts.dropDuplicates(["cid"]))

    def side(df: DataFrame, tag: str, *more: str) -> DataFrame:
        return df.select(F.col("band"), *[F.col(c).alias(f"{tag}_{c}") for c in ("cid", *sketch, *more)])

    def near(tag_a: str, tag_b: str) -> Column:
        return estimate([F.col(f"{tag_a}_{c}") for c in sketch], [F.col(f"{tag_b}_{c}") for c in sketch]) >= ESTIMATE

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b")).distinct()

    small, large = members.filter(F.col("n") <= SMALL), members.filter(F.col("n") > SMALL)
    x, y = side(small, "x"), side(small, "y")
    few = pairs(x.join(y, (x["band"] == y["band"]) & (F.col("x_cid") < F.col("y_cid")) & near("x", "y")))
    ranked = large.join(company, "cid")
    hubs = cut_lineage(ranked.groupBy("band").agg(F.max_by(F.struct("cid", *sketch), F.struct("company", "cid")).alias("hub")).select("band", F.col("hub.cid").alias("y_cid"), *[F.col(f"hub.{c}").alias(f"y_{c}") for c in sketch]))
    x = side(large, "x")
    star = pairs(x.join(hubs, (x["band"] == hubs["band"]) & (F.col("x_cid") != F.col("y_cid")) & near("x", "y")))
    links = _paired(few.union(star).distinct(), texts)
    labels = components(links)

    if not hubs.isEmpty():
        label = labels.select(F.col("node").alias("cid"), "label")
        named = cut_lineage(large.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid")))
        hub_label = hubs.select("band", F.col("y_cid").alias("cid")).join(label, "cid", "left").select(F.col("band"), F.coalesce("label", "cid").alias("hub_label"))
        rest = named.join(hub_label, "band").filter("label <> hub_label").drop("hub_label")
        rest = cut_lineage(rest)
        salts = cut_lineage(rest.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("salts")))
        # the second sketch of the classes that are compared, once per class
        both_sides = named.join(salts, "band", "left_semi").select("cid").distinct()
        fine = cut_lineage(map_texts(texts.join(both_sides, "cid", "left_semi").select("cid", "set_id", "text"), _fine, FINE).dropDuplicates(["cid"]))
        more = [c for c in fine.columns if c != "cid"]
        x = side(rest.join(salts, "band").join(fine, "cid"), "x", "label", "salts", *more).withColumn("salt", F.pmod(F.xxhash64("x_cid"), F.col("x_salts")).cast("int"))
        y = side(named.join(salts, "band").join(fine, "cid"), "y", "label", "salts", *more).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("y_salts") - 1)))
        later = pairs(x.join(y, (x["band"] == y["band"]) & (x["salt"] == y["salt"]) & (F.col("x_label") != F.col("y_label")) & near("x", "y") & may_link("x", "y")))
        later = cut_lineage(later)
        if not later.isEmpty():
            labels = components(links.union(_paired(later, texts)))

    named = classes.join(labels, classes["cid"] == labels["node"], "left").select("set_id", "first", "n_rows", F.coalesce("label", "cid").alias("label"))
    named = cut_lineage(named)
    smallest = named.groupBy("label").agg(F.min("first").alias("best"))
    found = cut_lineage(salted_left(named.select("set_id", "n_rows", "label"), smallest, "label").select("set_id", "n_rows", "best"))
    # classes with over a thousandth of the rows: a thousand at most, so they can be broadcast
    total = signed.count()
    hot = found.filter(F.col("n_rows") * 1000 > total).select("set_id", F.col("best").alias("hot_best"))
    rest = found.filter(F.col("n_rows") * 1000 <= total).select(F.col("set_id").alias("cool"), "best")
    out = signed.select("doc_id", "th", "set_id", "n_shingles").join(F.broadcast(hot), "set_id", "left")
    cool = F.when(F.col("hot_best").isNull(), F.col("set_id")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id")))
    out = out.withColumn("cool", cool).join(rest, "cool", "left").withColumn("best", F.coalesce("hot_best", "best"))
    alone = F.col("set_id") == ""
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    chosen = alone | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    return out.select("doc_id", "th", "set_id", "n_shingles", component.alias("component_id"), chosen.alias("chosen")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(docs: DataFrame) -> DataFrame:
    """Rows of docs without those that have a kept near copy: of each component one text stays, that of the
    smallest id, or without ids that of smallest hash. Of rows with equal id and text one stays."""
    dropped = linked(docs.select("doc_id", "text")).filter(~F.col("chosen")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    rows = wrapped(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("h", F.xxhash64(F.col("row.text").cast("string")))
    kept = rows.join(dropped, (rows["h"] == dropped["_th"]) & rows["doc_id"].eqNullSafe(dropped["_id"]), "left_anti")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.xxhash64("row")))).filter("n = 1")
    return unwrapped(kept, docs)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sh),
x AS (SELECT doc_id, unnest(s) AS g FROM sh),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 75 * (na.n_shingles + nb.n_shingles - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, n.n_shingles, min(r.b) AS component_id, min(r.b) = n.doc_id AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
