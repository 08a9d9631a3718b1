"""Near-duplicate vectors by product quantisation.

The index is fitted on a sample of ``SAMPLE`` distinct vectors at most: coarse centroids of inverted lists, and codebooks of
``WIDTH``-dimensional pieces of the residuals. Every vector is indexed: it is coded against its home list, and its
code is stored in the ``PROBES`` lists next to it. Every vector then asks its home list with exact coordinates: a table of
inner products with the codewords gives its distances to all codes there (asymmetric lookup), so that each pair meets
if either's home is among the other's probes. A code's own error is known, so the triangle inequality loses no pair
in a list; what passes it is reranked by exact cosines in double precision.

Vectors that are close together go first. The rows of a list, in chunks of about ``CHUNK``, are gathered into balls around
one of them, of a radius under half the threshold's angle. All of a ball link with each other, and two balls whose
centres are close (or far) enough link wholly (or not at all), so a group of copies costs a row each and a pair for two
balls. Only balls in between are compared member by member, each such pair in a task of two chunks at most. No
hot list, group or vector is held by one task: lists are dealt into blocks of queries and blocks of codes.

Defined results: vectors that are null, all zeros, empty or hold a null, NaN or infinite entry link with nothing and are their own
component; shorter vectors count as padded with zeros; equal vectors link, whatever their ids; rows with equal
ids each have their own links; a row without an id is counted as a link of others but names no component (a component of such
rows only has none, and they are kept); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut_lineage, map_texts
from ledgerlane.llm.near_dup import components
from ledgerlane.llm.whitening import matrix, usable

#: Vectors (and bytes of them) the index is fitted on, vectors a list aims at, and the most lists.
SAMPLE, SAMPLE_BYTES, LIST, LISTS = 32_768, 64 << 20, 256, 4_096
#: Dimensions of a subspace, codewords of each, rounds of k-means.
WIDTH, WORDS, ROUNDS = 4, 256, 8
#: Lists a code is stored in.
PROBES = 8
#: Rows gathered into balls together; queries and codes compared together.
CHUNK, QUERIES, CODES = 512, 1_024, 8_192
#: Room for rounding of angles and distances.
ROUNDING = 1e-6
#: Room for distances by lookup, which are summed in single precision.
LOOKUP = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def nearest(rows: np.ndarray, centres: np.ndarray, most: int = 1) -> np.ndarray:
    """(rows, most) numbers of the nearest centres, nearest first."""
    out = np.empty((len(rows), most), dtype=np.int64)
    half = (centres**2).sum(axis=1) / 2
    step = max(1, (1 << 21) // len(centres))
    for at in range(0, len(rows), step):
        far = half - rows[at : at + step] @ centres.T
        if most == 1:
            out[at : at + step, 0] = far.argmin(axis=1)
        else:
            some = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(centres) else np.tile(np.arange(most), (len(far), 1))
            order = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
            out[at : at + step] = np.take_along_axis(some, order, axis=1)
    return out


def k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres (or one per row if there are fewer); a centre without rows stays where it is."""
    k = min(k, len(rows))
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(rows, centres)[:, 0]
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, rows[:, i], minlength=k) for i in range(rows.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class Index:
    """Coarse centres, and codewords (subspaces, words, WIDTH) of residuals. Dimensions are padded to whole subspaces."""

    dims: int
    centres: np.ndarray
    words: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Index:
        rows = unit(sample)
        dims = rows.shape[1]
        rows = np.pad(rows, ((0, 0), (0, -dims % WIDTH)))
        centres = k_means(rows, lists, 1)
        rest = rows - centres[nearest(rows, centres)[:, 0]]
        pieces = rest.reshape(len(rest), -1, WIDTH)
        words = [k_means(pieces[: 1 << 14, m], WORDS, 2 + m) for m in range(pieces.shape[1])]
        return Index(dims, centres, np.stack(words))

    def units(self, lists: pa.Array) -> np.ndarray:
        return np.pad(unit(matrix(lists, self.dims)), ((0, 0), (0, -self.dims % WIDTH)))

    def coded(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the residuals, the part of a distance that a code alone has, and each code's own error."""
        c = self.centres[home]
        pieces = (x - c).reshape(len(x), -1, WIDTH)
        codes = np.stack([nearest(pieces[:, m], self.words[m])[:, 0] for m in range(len(self.words))], axis=1).astype(np.uint8)
        r = self.words[np.arange(len(self.words)), codes].reshape(len(x), -1)
        return codes, (r**2).sum(axis=1) + 2 * (c * r).sum(axis=1), np.linalg.norm(x - c - r, axis=1)

    def tables(self, y: np.ndarray) -> np.ndarray:
        """(subspaces, words, queries) inner products; a code's row is one piece of memory."""
        return np.einsum("qmw,mkw->mkq", y.reshape(len(y), -1, WIDTH), self.words).astype(np.float32)

    def distances(self, y: np.ndarray, tables: np.ndarray, codes: np.ndarray, home: np.ndarray, term: np.ndarray) -> np.ndarray:
        """(codes, queries) distances of exact queries to coded vectors, by lookup; right to about LOOKUP."""
        homes, which = np.unique(home, return_inverse=True)
        c = self.centres[homes]
        near = ((c**2).sum(axis=1)[:, None] - 2 * c @ y.T + (y**2).sum(axis=1)).astype(np.float32)[which] + term.astype(np.float32)[:, None]
        inner = tables[0][codes[:, 0]]
        for m in range(1, codes.shape[1]):
            inner += tables[m][codes[:, m]]
        return np.sqrt(np.maximum(near - 2 * inner, 0))


def fitted(rows: DataFrame, n: int, dims: int) -> Index:
    """An index from the distinct vectors with the smallest hashes. rows: vector."""
    most = max(WORDS, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    share = min(1.0, 2 * most / n)
    hashed = rows.select(F.xxhash64("vector").alias("h"), "vector").filter(F.pmod("h", F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    sample = hashed.groupBy("h").agg(F.first("vector").alias("vector")).orderBy(F.pmod("h", F.lit(1 << 30)), "h").limit(most).select("vector").toArrow()
    if not sample.num_rows:  # copies of few vectors, none of them among the smallest hashes
        sample = rows.limit(1).select("vector").toArrow()
    found = matrix(sample.column(0).combine_chunks(), dims)
    return Index.fit(found, max(1, min(LISTS, n // LIST, len(found) // 8)))


CODED = "rid long, vec_id long, vector array<double>, home int, code binary, term double, error double, probes array<int>"


def coded(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """rows (rid, vec_id, vector) with home list, code, its term and error, and the lists the code is stored in."""
    probes = min(probes, len(index.centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = index.units(batch.column(2))
            lists = nearest(x, index.centres, probes)
            codes, term, error = index.coded(x, lists[:, 0])
            near = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * probes), pa.array(lists.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(term), pa.array(error), near], [f.split()[0] for f in CODED.split(", ")])

    return map_texts(rows.select("rid", "vec_id", "vector"), run, CODED)


GATHERED = "rid long, vec_id long, ball long, members int, radius double, low long, vector array<double>, home int, code binary, term double, error double, probes array<int>"


def gathered(codes: DataFrame, index: Index, theta: float) -> DataFrame:
    """Each row's ball, named by its centre's rid; the centre's row tells members, radius, smallest id and code."""
    close = math.cos(theta / 2 - ROUNDING)

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("rid").combine_chunks()
        rid, x = np.asarray(chunk["rid"]), index.units(chunk["vector"].chunk(0))
        cosines = x @ x.T
        near = cosines >= close
        degree = near.sum(axis=1)
        centre = np.arange(len(x))
        free = np.ones(len(x), dtype=bool)
        for i in np.argsort(-degree, kind="stable")[: int((degree > 1).sum())].tolist():
            if free[i]:
                own = near[i] & free
                own[i] = True
                centre[own] = i
                free &= ~own
        members = np.bincount(centre, minlength=len(x))
        angle = np.where(centre == np.arange(len(x)), 0, np.arccos(np.clip(cosines[np.arange(len(x)), centre], -1, 1)) + ROUNDING)
        radius = np.zeros(len(x))
        np.maximum.at(radius, centre, angle)
        ids = chunk["vec_id"].to_pylist()
        low: list[int | None] = [None] * len(x)
        for i, c in zip(ids, centre.tolist(), strict=True):
            if i is not None and (low[c] is None or i < low[c]):
                low[c] = i
        own = pa.array(centre, mask=centre != np.arange(len(x)))  # null but for centres
        kept = [chunk[c].chunk(0).take(own) for c in ("vector", "home", "code", "term", "error", "probes")]
        columns = [chunk["rid"], chunk["vec_id"], pa.array(rid[centre]), pa.array(members.astype(np.int32)), pa.array(radius), pa.array(low, pa.int64()), *kept]
        return pa.table(dict(zip((f.split()[0] for f in GATHERED.split(", ")), columns, strict=True)))

    # a row a list, LISTS at most
    parts = codes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    dealt = codes.join(F.broadcast(parts), "home").withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("parts")))
    return dealt.select(*codes.columns, "chunk").groupBy("home", "chunk").applyInArrow(lambda t: run(t.drop_columns("chunk")), GATHERED)


def chord(angle: np.ndarray) -> np.ndarray:
    return 2 * np.sin(np.minimum(angle, np.pi) / 2)


def candidates(balls: DataFrame, index: Index, theta: float) -> DataFrame:
    """(a, b), a < b, of the balls whose codes leave a link possible."""

    def run(ask: pa.Table, stored: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if ask.num_rows and stored.num_rows:
            ask, stored = ask.combine_chunks(), stored.combine_chunks()
            q, r, radius = index.units(ask["vector"].chunk(0)), np.asarray(ask["rid"]), np.asarray(ask["radius"])
            codes = np.frombuffer(b"".join(stored["code"].to_pylist()), dtype=np.uint8).reshape(stored.num_rows, -1)
            home, term, error, other, far = (np.asarray(stored[c]) for c in ("at_home", "term", "error", "other", "far"))
            step = max(1, (1 << 20) // len(codes))
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                d = index.distances(q[part], index.tables(q[part]), codes, home, term)
                hit = d <= chord(theta + radius[part] + far[:, None]) + error[:, None] + LOOKUP
                j, i = np.nonzero(hit & (r[part] != other[:, None]))
                one, two = r[part][i], other[j]
                a.append(np.minimum(one, two))
                b.append(np.maximum(one, two))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    stored = balls.select(F.explode("probes").alias("list"), F.col("rid").alias("other"), F.col("home").alias("at_home"), "code", "term", "error", F.col("radius").alias("far"))
    asking = balls.select(F.col("home").alias("list"), "rid", "vector", "radius")
    # a row a list, LISTS at most
    blocks = F.broadcast(asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("asks")))
    parts = F.broadcast(stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CODES).alias("parts")))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """df with its block among ``own`` blocks, once for each of the ``other`` blocks."""
        both = df.join(blocks, "list").join(parts, "list")
        mine, each = F.pmod(F.xxhash64(df.columns[1]), F.col(own)), F.sequence(F.lit(0).cast("long"), F.col(other) - 1)
        return both.withColumn("mine", mine).withColumn("each", F.explode(each)).drop("asks", "parts")

    left, right = dealt(asking, "asks", "parts"), dealt(stored, "parts", "asks")
    return left.groupBy("list", "mine", "each").cogroup(right.groupBy("list", "each", "mine")).applyInArrow(run, "a long, b long").distinct()


JUDGED = "a long, b long, a_members int, b_members int, whole boolean"


def judged(pairs: DataFrame, balls: DataFrame, index: Index, least: float) -> DataFrame:
    """The candidate pairs by exact cosines of their centres: whole, if all of one ball link with all of the other; not
    whole, if members must be compared; pairs without a link are left out."""
    theta = math.acos(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.einsum("ij,ij->i", index.units(batch.column(4)), index.units(batch.column(5)))
            angle, radius = np.arccos(np.clip(cosine, -1, 1)), np.asarray(batch.column(6)) + np.asarray(batch.column(7))
            single = radius == 0
            whole = np.where(single, cosine >= least, angle + radius <= theta - ROUNDING)
            keep = pa.array(whole | (~single & (angle - radius <= theta + ROUNDING)))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(whole)], [f.split()[0] for f in JUDGED.split(", ")])
            yield out.filter(keep)

    a, b = (balls.select(F.col("rid").alias(s), F.col("members").alias(f"{s}_members"), F.col("vector").alias(f"{s}_v"), F.col("radius").alias(f"{s}_r")) for s in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "a_members", "b_members", "a_v", "b_v", "a_r", "b_r")
    return map_texts(both, run, JUDGED)


def member_links(pairs: DataFrame, members: DataFrame, index: Index, least: float) -> DataFrame:
    """(a, b, rid, n): links of each member of the balls a and b to the other ball's members. members: ball, rid, vector."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {"a": [], "b": [], "rid": [], "n": []}
        if left.num_rows and right.num_rows:
            one, two = (index.units(t["vector"].combine_chunks()) for t in (left, right))
            linked = one @ two.T >= least
            for table, counts in ((left, linked.sum(axis=1)), (right, linked.sum(axis=0))):
                keep = counts > 0
                for c in ("a", "b", "rid"):
                    found[c].append(np.asarray(table[c])[keep])
                found["n"].append(counts[keep])
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64), pa.int64()) for c, v in found.items()})

    sides = []
    for side in "ab":
        own = members.select(F.col("ball").alias(side), F.col("rid").alias("rid"), F.col("vector").alias("vector"))
        sides.append(pairs.select(F.col("a").alias("a"), F.col("b").alias("b")).join(own, side).select("a", "b", "rid", "vector").groupBy("a", "b"))
    return sides[0].cogroup(sides[1]).applyInArrow(run, "a long, b long, rid long, n long")


def linked(embeddings: DataFrame, least: float = 0.9, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of embeddings (vec_id, embedding). A link is a cosine of
    ``least`` or more, 0 < least < 1."""
    theta = math.acos(least)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fit: Column = usable(F.col("vector")) & F.exists(F.coalesce("vector", F.array().cast("array<double>")), lambda c: c != 0)
    others = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.filter(fit)
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return others
    index = fitted(rows, n, dims)
    codes = cut_lineage(coded(rows.withColumn("rid", F.monotonically_increasing_id()), index, probes))
    members = cut_lineage(gathered(codes, index, theta))
    balls = members.filter("rid = ball")
    pairs = cut_lineage(judged(candidates(balls, index, theta), balls, index, least))
    whole, partly = pairs.filter("whole"), pairs.filter("not whole")
    asked = partly.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    inside = members.select("ball", "rid").join(asked, "ball").join(codes.select("rid", "vector"), "rid")
    counted = cut_lineage(member_links(partly, inside, index, least)) if not partly.isEmpty() else None

    links = whole.select("a", "b")
    more = whole.select(F.explode(F.array(F.struct(F.col("a").alias("ball"), F.col("b_members").alias("n")), F.struct(F.col("b").alias("ball"), F.col("a_members").alias("n")))).alias("x")).select("x.*")
    more = more.groupBy("ball").agg(F.sum("n").alias("more"))
    if counted is not None:
        links = links.union(counted.select("a", "b").distinct())
    labels = components(links)
    known = balls.select("ball", "members", "low").join(more, "ball", "left").join(labels.withColumnRenamed("node", "ball"), "ball", "left").withColumn("label", F.coalesce("label", "ball"))
    known = cut_lineage(known)
    # a component of one ball needs no meeting; those of more meet by label, after a partial minimum
    lowest = known.groupBy("label").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "label").select("ball", (F.col("members") - 1 + F.coalesce("more", F.lit(0))).alias("n"), "component_id")
    out = members.select("rid", "vec_id", "ball").join(known, "ball")
    if counted is not None:
        out = out.join(counted.groupBy("rid").agg(F.sum("n").alias("partly")), "rid", "left").withColumn("n", F.col("n") + F.coalesce("partly", F.lit(0)))
    out = out.select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(others)
