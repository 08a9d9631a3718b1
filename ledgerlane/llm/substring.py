"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

Seeds are minimizers of 8-word k-mers over 8 neighbouring ones, so an exact run of 15 words has one in
common wherever it stands. A seed's first place (smallest document, then smallest position) stands for it;
every other place is matched with that one only, so a passage in a third of all documents costs a row per
document. Of a seed with over 64 places in a batch of texts only the batch's first document's are passed on to the
task that finds the first of all; the other places are set aside, spread over tasks, and joined with that first later,
so a place's match is the same however rows lie in batches. Per pair of documents matches on one diagonal become
runs, and runs are chained in order in both documents with a gap cost through a Fenwick tree. Each chain is then aligned
on the words themselves: its ends are extended by a banded alignment past changed, added and missing words until its score
falls, and the longest common subsequence gives its identity.

Chains of any length are aligned, single seeds too, but for single seeds whose ends can't reach LEAST_CHAIN
words without a shift: a seed carries 4 bits of each of the 8 words before and after it. Equal words have equal
bits, so the reach by the bits is never below the reach by the words on one diagonal.
Where words repeat ("of of of"), overlapping places of one seed are a stretch: it is matched once, start with
start, over the shorter of both stretches.

A passage counts when an aligned chain covers 50 words of its document or more; chains that touch it belong to it.
The first document that holds it keeps it; the others have it cut. An alignment inside another one of its document is
left out; of those of the same words that with the earliest other document stays.

Defined results: null and empty texts, and texts under 10 words, have no passage; repeats inside one
document don't count; rows without an id are neither matched nor cut; rows with equal ids are one document
for matching, and each text is cut by what was aligned on itself; of chains that reach equally far the earlier
one goes first; other columns are not read by the search and pass through the cut; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlane.llm.common import cut_lineage, hashed_words, map_texts, mix64, rolling, unwrapped, wrapped

#: Words in a seed, and neighbouring seeds of which the smallest is taken.
K, NEIGHBOURS = 8, 8
#: Seeds that a task looks at together, and places among them above which it sets a seed's further places aside. They
#: move work, not results.
LOCAL, FREQUENT = 1 << 19, 64
#: Tasks over which the places of one seed are spread when they meet its first.
SALTS = 16
#: Matches of one diagonal that start more words apart are runs of their own.
RUN_GAP = 40
#: Words between the matches of a stretch.
STEP = 20
#: Words on each side of a seed of which it carries 4 bits; 0 stands for no word.
FLANK = 8
#: Cost of a word that a chain skips in either document, in words.
GAP_COST = 0.1
#: Words of the shortest chain that is kept once it is aligned, and of the shortest passage.
LEAST_CHAIN, LEAST_PASSAGE = 20, 50
#: Words beside a chain in which its ends may be extended; slices start at multiples of GRID.
MARGIN, GRID = 40, 32
#: An extension ends when it is this far below its best; a match brings 1, a mismatch or a word that only one side has
#: costs 2. It stays in a band of so many words about the diagonal.
X_DROP, BAND = 6, 6
LEAST_IDENTITY = 0.8

#: A place of a seed is pos << 32 | span. kind: 0, or 1 if its batch set other places of the seed aside; those are 2.
SEEDS = "h long, doc_id long, place long, flank long, kind int"
MATCHES = "doc_id long, rep_id long, pos int, rep_pos int, weak int"
#: kind 0: a match (a to e as in MATCHES); 1: the first place of a seed (seed, document, place, flank, whether it has
#: several texts); 2: a place that was set aside (seed, document, place, flank).
FIRSTS = "kind int, a long, b long, c long, d long, e long"
CHAINS = "doc_id long, rep_id long, start int, stop int, rep_start int, rep_stop int, seeds int"
SLICES = "doc_id long, lo int, hi int, th long, words array<int>"
ALIGNED = "doc_id long, th long, start int, stop int, rep_id long, rep_start int, rep_stop int, identity double"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def minimizers(words: np.ndarray, k: int = K, neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the seeds of one text's word hashes."""
    mers = rolling(words, k)
    if not len(mers):
        return mers, np.zeros(0, dtype=np.int64)
    if len(mers) <= neighbours:
        at = np.array([int(mers.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(mers, neighbours)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return mers[at], at


def stretches(seeds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, spans) of seeds without those that overlap the place before of the same seed; a
    span is the distance from a seed to the last such place."""
    first = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (np.diff(at) >= K)])[: len(at)])
    last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
    return seeds[first], at[first], at[last] - at[first]


def flanks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """4 bits of each of the FLANK words before (low half) and after (high half) the seeds at ``at``, nearest
    word lowest."""
    codes = np.zeros(len(words) + 2 * FLANK, dtype=np.uint64)
    codes[FLANK : FLANK + len(words)] = (words >> np.uint64(32)) % np.uint64(15) + np.uint64(1)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(FLANK):
        out |= codes[at + FLANK - 1 - j] << np.uint64(4 * j)
        out |= codes[at + FLANK + K + j] << np.uint64(4 * (FLANK + j))
    return out.view(np.int64)


def reach_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most words that an extension can go on the diagonal, before and after, over the words of two flanks; MARGIN for a
    side that the flanks don't tell."""
    differ, some, total = (a ^ b).view(np.uint64), a.view(np.uint64), np.zeros(len(a), dtype=np.int64)
    for side in range(2):
        shifts = np.arange(side * 4 * FLANK, (side + 1) * 4 * FLANK, 4, dtype=np.uint64)
        same = ((differ[:, None] >> shifts) & np.uint64(15) == 0) & ((some[:, None] >> shifts) & np.uint64(15) > 0)
        score = np.cumsum(np.where(same, 1, -2), axis=1)
        fallen = np.logical_or.accumulate(np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > X_DROP, axis=1)
        score[fallen] = -1
        reach = np.where(score.max(axis=1) > 0, score.argmax(axis=1) + 1, 0)
        total += np.where(fallen[:, -1], reach, MARGIN)
    return total


Held = tuple | None


def matched(doc: np.ndarray, place: np.ndarray, flank: np.ndarray, rep: np.ndarray, rep_place: np.ndarray, rep_flank: np.ndarray, several: np.ndarray) -> tuple:
    """Matches (MATCHES) of places with their seed's first place; those of the first's own document have none. Stretches
    give a match every STEP words. weak: the seed alone can't reach LEAST_CHAIN words."""
    at = np.flatnonzero(doc != rep)
    weak = (reach_bound(flank[at], rep_flank[at]) + K < LEAST_CHAIN) & ~several[at]
    low = np.int64(0x7FFFFFFF)
    span = np.where(weak, 0, np.minimum(place[at] & low, rep_place[at] & low))
    n = 1 + -(-span // STEP)
    at, weak = np.repeat(at, n), np.repeat(weak, n)
    step = np.minimum((np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) * STEP, np.repeat(span, n))
    return doc[at], rep[at], (place[at] >> 32) + step, (rep_place[at] >> 32) + step, weak.astype(np.int64)


def paired(h: np.ndarray, doc: np.ndarray, place: np.ndarray, flank: np.ndarray, asked: np.ndarray, held: Held = None) -> tuple[tuple, tuple, Held]:
    """Places of seeds, sorted by h, doc_id and place: the matches of all with their seed's first place; the first
    places (h, doc, place, flank, several texts of its document have it) of the seeds that are done and were ``asked`` for;
    and the last seed's, which is ``held`` for the next call."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(h) != 0) + 1])
    first = [x[starts] for x in (h, doc, place, flank)]
    several, wanted = np.zeros(len(starts), dtype=bool), np.logical_or.reduceat(asked, starts)
    done: list[tuple] = []
    if held is not None and held[0] == h[0]:
        for x, value in zip(first, held, strict=False):
            x[0] = value
        several[0] = held[4]
        wanted[0] |= held[5]
    elif held is not None and held[5]:
        done.append(held[:5])
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    _, rep, rep_place, rep_flank = (np.repeat(x, sizes) for x in first)
    several |= np.logical_or.reduceat((doc == rep) & (place == rep_place) & (flank != rep_flank), starts)
    held = (*(x[-1] for x in first), several[-1], wanted[-1])
    ready = np.flatnonzero(wanted[:-1])
    tops = [np.concatenate([[d[i] for d in done], x[ready]]).astype(np.int64) for i, x in enumerate((*first, several))]
    return matched(doc, place, flank, rep, rep_place, rep_flank, np.repeat(several, sizes)), tuple(tops), held


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds (SEEDS) of rows (doc_id, text)."""

    def made(parts: list[tuple]) -> pa.RecordBatch:
        h, doc, place, flank = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((place, doc, h))
        h, doc, place, flank = (x[order] for x in (h, doc, place, flank))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(h) != 0) + 1])
        sizes = np.diff(np.concatenate([starts, [len(h)]]))
        many, own = np.repeat(sizes > FREQUENT, sizes), doc == np.repeat(doc[starts], sizes)
        return _batch(SEEDS, [h, doc, place, flank, np.where(many, np.where(own, 1, 2), 0).astype(np.int32)])

    parts: list[tuple] = []
    waiting = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, counts, hashes, _, _ in hashed_words(batch.column(1)):
            edges = np.concatenate([[0], np.cumsum(counts)])
            for i in range(last - first):
                words = hashes[edges[i] : edges[i + 1]]
                h, at, span = stretches(*minimizers(words))
                if len(h):
                    parts.append((h.view(np.int64), np.full(len(h), ids[first + i], dtype=np.int64), at << 32 | span, flanks(words, at)))
                    waiting += len(h)
            if waiting >= LOCAL:
                yield made(parts)
                parts, waiting = [], 0
    if parts:
        yield made(parts)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FIRSTS of rows (SEEDS) that come sorted by h, doc_id and place. Only a seed's first place is held, so a seed may
    span batches; places that were set aside are passed on."""
    held: Held = None

    def rows(kind: int, columns: tuple) -> pa.RecordBatch:
        n = len(columns[0])
        return _batch(FIRSTS, [np.full(n, kind, dtype=np.int32), *(np.asarray(c, dtype=np.int64) for c in columns)])

    for batch in batches:
        h, doc, place, flank, kind = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        aside = kind == 2
        if aside.any():
            yield rows(2, (h[aside], doc[aside], place[aside], flank[aside], np.zeros(aside.sum())))
        if not aside.all():
            here = ~aside
            matches, tops, held = paired(h[here], doc[here], place[here], flank[here], kind[here] == 1, held)
            yield rows(0, matches)
            if len(tops[0]):
                yield rows(1, tops)
    if held is not None and held[5]:
        yield rows(1, tuple(np.array([x], dtype=np.int64) for x in held[:5]))


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MATCHES of places that were set aside with their seed's first place."""
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        found = matched(*columns[:6], columns[6] != 0)
        yield _batch(MATCHES, [*found[:2], *(c.astype(np.int32) for c in found[2:])])


def _runs(pos: np.ndarray, rep: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Matches (sorted by pos, rep) as runs on one diagonal: (first pos, last pos, first rep, last rep, seeds)."""
    order = np.lexsort((pos, pos - rep))
    p, d = pos[order], (pos - rep)[order]
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) > RUN_GAP)) + 1
    starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
    return sorted(zip(p[starts].tolist(), p[stops].tolist(), (p - d)[starts].tolist(), (p - d)[stops].tolist(), (stops - starts + 1).tolist(), strict=True))


def chains(pos: np.ndarray, rep: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Best disjoint chains of one pair of documents: (start, stop, rep start, rep stop, seeds) in words.

    A run adds its words; a step between runs costs GAP_COST for each word skipped in either document. Runs
    are met in order of position; a Fenwick tree over the other document's positions holds the best chain
    that ends before each."""
    runs = _runs(pos, rep)
    if len(runs) == 1:
        a, b, c, d, n = runs[0]
        return [(a, b + K, c, d + K, n)]
    ranks = {r: i + 1 for i, r in enumerate(sorted({x[3] for x in runs}))}
    keys = sorted(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    best, before, waiting = [0.0] * len(runs), [-1] * len(runs), []
    for i, (a, b, c, d, _) in enumerate(runs):
        while waiting and waiting[0][0] < a:  # chains whose last seed starts before this one
            _, j = heapq.heappop(waiting)
            value, at = (best[j] + GAP_COST * (runs[j][1] + runs[j][3] + 2 * K), j), ranks[runs[j][3]]
            while at < len(tree):
                tree[at] = max(tree[at], value)
                at += at & -at
        at, top = int(np.searchsorted(keys, c)), (float("-inf"), -1)
        while at:
            top = max(top, tree[at])
            at -= at & -at
        gain = top[0] - GAP_COST * (a + c)
        best[i], before[i] = b + K - a + max(0.0, min(gain, best[top[1]]) if top[1] >= 0 else 0.0), top[1] if gain > 0 else -1
        heapq.heappush(waiting, (b, i))
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        last, first, n = i, i, 0
        while i >= 0 and not used[i]:
            used[i], first, n = True, i, n + runs[i][4]
            i = before[i]
        out.append((runs[first][0], runs[last][1] + K, runs[first][2], runs[last][3] + K, n))
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of rows (doc_id, rep_id, pos, rep_pos, weak) that come sorted; a pair may span batches."""
    held: list[np.ndarray] = []

    def rows(part: np.ndarray) -> Iterator[tuple]:
        edges = np.concatenate([[0], np.flatnonzero(np.any(np.diff(part[:, :2], axis=0) != 0, axis=1)) + 1, [len(part)]])
        open_ = np.flatnonzero((np.diff(edges) > 1) | (part[edges[:-1], 4] == 0))
        for a, b in zip(edges[open_].tolist(), edges[open_ + 1].tolist(), strict=True):
            weak = {(p, r) for p, r, w in part[a:b, 2:].tolist() if w}
            for s, e, rs, re, n in chains(part[a:b, 2], part[a:b, 3]):
                if n > 1 or (s, rs) not in weak:
                    yield int(part[a, 0]), int(part[a, 1]), s, e, rs, re, n

    def made(part: np.ndarray) -> pa.RecordBatch:
        out = list(rows(part))
        return _batch(CHAINS, [[r[i] for r in out] for i in range(7)])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        whole = np.concatenate([*held, part]) if held and np.array_equal(held[-1][-1, :2], part[0, :2]) else None
        if whole is None and held:
            yield made(np.concatenate(held))
            held = []
        part = part if whole is None else whole
        edge = int(np.flatnonzero(np.any(part[:, :2] != part[-1, :2], axis=1)).max(initial=-1)) + 1
        if edge:
            yield made(part[:edge])
        held = [part[edge:]]
    if held:
        yield made(np.concatenate(held))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes (32 bits) of the asked places of rows (doc_id, text, th, asked)."""
    for batch in batches:
        ids, th, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        for first, last, counts, hashes, _, _ in hashed_words(batch.column(1)):
            edges, out = np.concatenate([[0], np.cumsum(counts)]), []
            short = hashes.astype(np.uint32).view(np.int32)
            for i in range(first, last):
                words = short[edges[i - first] : edges[i - first + 1]]
                out += [(ids[i], x["lo"], x["hi"], th[i], words[x["lo"] : x["hi"]]) for x in asked[i].as_py()]
            yield _batch(SLICES, [[r[j] for r in out] for j in range(5)])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by one big-integer step per word of b."""
    if len(a) == len(b) and np.array_equal(a, b):
        return len(a)
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for x in b.tolist():
        hit = state & masks.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def extension(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How far an alignment of two word runs from their beginnings goes in each: over what is equal at once, then row by
    row in a band about the diagonal, until no place is within X_DROP of the best."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return n, n
    i = int(differ[0])
    a, b = a[i:], b[i:]
    width = 2 * BAND + 1
    # the score at column j of row r, relative to the equal words before, stands at j - r + BAND
    lanes = np.arange(width)
    out = np.iinfo(np.int64).min // 2
    score = np.where(lanes >= BAND, -2 * (lanes - BAND), out)
    score[lanes - BAND > len(b)] = out
    padded = np.concatenate([np.full(BAND, -1, dtype=np.int64), b.astype(np.int64), np.full(BAND + 1, -1, dtype=np.int64)])
    best, where = 0, (0, 0)
    for row in range(1, min(len(a), len(b) + BAND) + 1):
        columns = lanes - BAND + row
        lane_words = padded[row - 1 : row - 1 + width] if row - 1 + width <= len(padded) else np.concatenate([padded[row - 1 :], np.full(row - 1 + width - len(padded), -1, dtype=np.int64)])
        across = score + np.where(lane_words == a[row - 1], 1, -2)
        down = np.append(score[1:], out) - 2
        step = np.maximum(across, down)
        step[(columns < 0) | (columns > len(b))] = out
        step[columns == 0] = -2 * row
        score = np.maximum.accumulate(step + 2 * lanes) - 2 * lanes
        score[(columns < 0) | (columns > len(b))] = out
        top = int(score.argmax())
        if score[top] > best:
            best, where = int(score[top]), (row, int(columns[top]))
        elif score[top] < best - X_DROP:
            break
    return i + where[0], i + where[1]


def align(doc: np.ndarray, rep: np.ndarray, start: int, stop: int, rep_start: int, rep_stop: int) -> tuple[int, int, int, int, float]:
    """The chain's places, extended at both ends within the slices, and its identity (0 to 1)."""
    left, rep_left = extension(doc[:start][::-1], rep[:rep_start][::-1])
    right, rep_right = extension(doc[stop:], rep[rep_stop:])
    start, stop, rep_start, rep_stop = start - left, min(len(doc), stop + right), rep_start - rep_left, min(len(rep), rep_stop + rep_right)
    a, b = doc[start:stop], rep[rep_start:rep_stop]
    return start, stop, rep_start, rep_stop, common_words(a, b) / max(len(a), len(b), 1)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, th, rep_id, lo, rlo, s, e, rs, re = (batch.column(i).to_pylist() for i in range(9))
        sides = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy(zero_copy_only=False)) for c in batch.columns[9:11]]
        out = []
        for i in range(batch.num_rows):
            doc, rep = (values[at[i] : at[i + 1]] for values, at in sides)
            if s[i] - lo[i] >= len(doc) or rs[i] - rlo[i] >= len(rep):
                continue  # another text under the same id
            a, b, c, d, identity = align(doc, rep, s[i] - lo[i], e[i] - lo[i], rs[i] - rlo[i], re[i] - rlo[i])
            if identity >= LEAST_IDENTITY and b - a >= LEAST_CHAIN:
                out.append((doc_id[i], th[i], a + lo[i], b + lo[i], rep_id[i], c + rlo[i], d + rlo[i], identity))
        yield _batch(ALIGNED, [[r[j] for r in out] for j in range(8)])


def passages(docs: DataFrame, least_words: int = LEAST_PASSAGE) -> DataFrame:
    """Aligned passages of docs (doc_id, text) that an earlier document holds too: ALIGNED's columns with
    island_start and island_stop, the place that the passage covers with those it touches."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    seeds = map_texts(plain, _seeded, SEEDS)
    # places that were set aside are spread; they only pass through
    task = F.when(F.col("kind") == 2, F.xxhash64("doc_id", "place")).otherwise(F.col("h"))
    firsts = cut_lineage(seeds.repartition(task).sortWithinPartitions("h", "doc_id", "place").mapInArrow(_matched, FIRSTS))
    salt = F.pmod(F.xxhash64("b", "c"), F.lit(SALTS)).cast("int")
    aside = firsts.filter("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("doc_id"), F.col("c").alias("place"), F.col("d").alias("flank"), salt.alias("salt"))
    tops = firsts.filter("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("rep"), F.col("c").alias("rep_place"), F.col("d").alias("rep_flank"), F.col("e").alias("several"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    late = aside.join(tops, ["h", "salt"]).select("doc_id", "place", "flank", "rep", "rep_place", "rep_flank", "several").mapInArrow(_late, MATCHES)
    matches = firsts.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("rep_id"), *[F.col(c).cast("int").alias(n) for c, n in (("c", "pos"), ("d", "rep_pos"), ("e", "weak"))]).unionByName(late)
    matches = matches.repartition("doc_id").sortWithinPartitions("doc_id", "rep_id", "pos", "rep_pos")
    found = matches.mapInArrow(_chained, CHAINS)

    def grid(x: str, up: bool) -> Column:
        return (F.ceil((F.col(x) + MARGIN) / GRID) * GRID if up else F.greatest(F.lit(0), F.floor((F.col(x) - MARGIN) / GRID) * GRID)).cast("int")

    found = cut_lineage(found.withColumns({"lo": grid("start", False), "hi": grid("stop", True), "rlo": grid("rep_start", False), "rhi": grid("rep_stop", True)}))
    asked = found.select("doc_id", "lo", "hi").union(found.select("rep_id", "rlo", "rhi")).distinct()
    # places asked of a document are bounded by its own length
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("asked"))
    texts = plain.join(asked, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("th"), "asked").dropDuplicates(["doc_id", "th"])
    slices = cut_lineage(map_texts(texts, _sliced, SLICES))
    own = slices.select("doc_id", "lo", "hi", "th", F.col("words").alias("doc_words"))
    rep = slices.select(F.col("doc_id").alias("rep_id"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"), F.col("words").alias("rep_words"))
    both = found.join(own, ["doc_id", "lo", "hi"]).join(rep, ["rep_id", "rlo", "rhi"])
    both = both.select("doc_id", "th", "rep_id", "lo", "rlo", "start", "stop", "rep_start", "rep_stop", "doc_words", "rep_words")
    aligned = cut_lineage(map_texts(both, _aligned, ALIGNED))
    # islands of touching passages; a document's own passages only
    order = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("stop"), "rep_id", "rep_start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # what lies inside another alignment tells nothing new of its document
    islands = aligned.withColumn("reach", reach).filter("reach is null or stop > reach")
    islands = islands.withColumn("island", F.sum(F.when(F.col("start") <= F.col("reach") + 2, 0).otherwise(1)).over(order))
    island = Window.partitionBy("doc_id", "th", "island")
    islands = islands.withColumns({"island_start": F.min("start").over(island), "island_stop": F.max("stop").over(island)})
    longest = F.max(F.col("stop") - F.col("start")).over(island)
    return islands.withColumn("longest", longest).filter(F.col("longest") >= least_words).drop("reach", "island", "longest")


def without_passages(docs: DataFrame, least_words: int = LEAST_PASSAGE) -> DataFrame:
    """docs with the passages cut that an earlier document holds; n_chars, if there, follows the text."""
    spans = passages(docs.select("doc_id", "text"), least_words).select("doc_id", "th", F.struct(F.col("island_start").alias("a"), F.col("island_stop").alias("b")).alias("span")).distinct()
    spans = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    rows = wrapped(docs).withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("th", F.xxhash64("row.text"))
    marked = rows.join(spans, ["doc_id", "th"], "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, spans = batch.column(0), batch.column(1)
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                kind, fields = row.type, row.flatten()
                at = kind.get_field_index("text")
                new = fields[at].to_pylist()
                for i in hit.tolist():
                    raw, parts, done = new[i].encode(), [], 0
                    for _, _, _, _, starts, _ in hashed_words(fields[at].slice(i, 1)):
                        for x in spans[i].as_py():
                            parts.append(raw[done : starts[x["a"]]])
                            done = int(starts[x["b"]]) if x["b"] < len(starts) else len(raw)
                    new[i] = b"".join([*parts, raw[done:]]).decode().strip()
                fields[at] = pa.array(new, fields[at].type)
                row = pa.StructArray.from_arrays(fields, fields=[kind.field(i) for i in range(kind.num_fields)])
            yield pa.RecordBatch.from_arrays([row], ["row"])

    out = unwrapped(map_texts(marked, run, marked.select("row").schema), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
