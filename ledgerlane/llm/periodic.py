"""Periodic runs of words by grammar compression, and texts without their repetitions.

A run is a stretch of words with smallest period q (words q apart are identical), of ``LEAST`` words and
``TIMES`` periods or more, that no neighbouring word extends. Texts are taken in blocks, whose words are numbered
exactly. Re-Pair compresses a block's word numbers: in each round a pair of neighbouring symbols becomes a nonterminal
wherever it is more frequent than the pairs that overlap it, until no pair repeats; what is left of a text is a
balanced tree above. Every run lies inside some node and crosses the boundary between its two halves. So the runs that
cross a nonterminal's boundary are computed once, inside its expansion, are translated to all positions it is derived at,
and stretches of one period that overlap by a period are merged to maximal intervals.

A run of four periods has two of them on one side of the boundary, so a period is tried by comparing two neighbouring
blocks there: first words, then hashes of the whole blocks. Hashes only propose: every run found is compared word for
word, and a block in which one fails is done again with other hashes.

Defined results: null texts and texts without words have no run and an empty collapsed text; white space between words
becomes one space; repeated rows and ids are each given the result of their text; a null id stays null; a text may be one
word or millions; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import _powers, map_texts, mix64

#: Words and periods a run has at least.
LEAST, TIMES = 6, 4
#: Bytes of whole texts that are compressed together; a longer text is a block of its own.
BLOCK = 1 << 20
#: Pairs of boundary and period that are tried at once.
CHUNK = 1 << 20

FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Block:
    """The words of some texts: their bytes, one after the other with one space between, and their numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        word = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner], end[inner - 1] = word[inner], word[inner - 1]
        starts = np.flatnonzero(begin)
        lengths = np.flatnonzero(end) + 1 - starts
        #: Words before each text.
        self.edges = np.searchsorted(starts, offsets)
        packed, at = data[word], np.concatenate([[0], np.cumsum(lengths)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(packed)])
        self.ids = np.asarray(words.dictionary_encode().indices).astype(np.int64)
        self.places = at + np.arange(len(at))
        joined = np.full(self.places[-1], 0x20, dtype=np.uint8)
        joined[np.arange(len(packed)) + np.repeat(np.arange(len(lengths)), lengths)] = packed
        self.joined = joined.tobytes()

    def text(self, first: int, last: int) -> bytes:
        """Words first to last (exclusive), one space between."""
        return self.joined[self.places[first] : self.places[last] - 1] if last > first else b""


def grammar(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, boundary, end) of a first expansion of every node of at least LEAST words, and all (node, position)
    at which it is derived. edges: words before each text; no node spans two."""
    symbols, places = ids, np.arange(len(ids))
    sizes = np.ones(len(ids), dtype=np.int64)
    ends = np.zeros(len(ids), dtype=bool)
    ends[edges[1:][edges[1:] > edges[:-1]] - 1] = True
    fresh = int(ids.max(initial=0)) + 1
    known, names = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    nodes, derived, turn = [], [], 0
    number = 0  # nodes of at least LEAST words so far
    numbers: dict[int, int] = {}
    bits = np.uint64(64 - max(12, int(2 * len(ids)).bit_length()))
    while len(symbols) > 1:
        turn += 1
        code = (symbols[:-1] << 32) | symbols[1:]
        mixed = mix64(code.astype(np.uint64) + np.uint64(turn))
        bucket = (mixed >> bits).astype(np.int64)
        free = ~ends[:-1]
        counts = np.bincount(bucket[free], minlength=1 << int(64 - bits))[bucket]
        rank = np.where(free & (counts > 1), (counts << 32) | (mixed & np.uint64(0x7FFFFFFF)).astype(np.int64), 0)
        best = rank > 0
        best[1:] &= rank[1:] >= rank[:-1]
        best[:-1] &= rank[:-1] >= rank[1:]
        # equal neighbours are one pair that overlaps itself: every second place
        index = np.arange(len(best))
        opens = best.copy()
        opens[1:] &= ~best[:-1]
        best &= (index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0
        at = np.flatnonzero(best)
        codes, first, which, often = np.unique(code[at], return_index=True, return_inverse=True, return_counts=True)
        spot = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        old = known[spot] == codes if len(known) else np.zeros(len(codes), dtype=bool)
        take = old | (often > 1)
        if not take.any():
            break
        new = take & ~old
        name = np.where(old, names[spot] if len(known) else 0, 0)
        name[new] = fresh + np.arange(new.sum())
        fresh += int(new.sum())
        total = sizes[at[first]] + sizes[at[first] + 1]
        long = new & (total >= LEAST)
        begin = places[at[first[long]]]
        nodes.append((begin, begin + sizes[at[first[long]]], begin + total[long]))
        numbers |= dict(zip(name[long].tolist(), range(number, number + len(begin)), strict=True))
        number += len(begin)
        chosen = take[which]
        at, made = at[chosen], name[which[chosen]]
        far = sizes[at] + sizes[at + 1] >= LEAST
        derived.append((np.array([numbers[m] for m in made[far].tolist()], dtype=np.int64), places[at[far]]))
        order = np.argsort(both := np.concatenate([known, codes[new]]), kind="stable")
        known, names = both[order], np.concatenate([names, name[new]])[order]
        symbols, sizes, ends = symbols.copy(), sizes.copy(), ends.copy()
        symbols[at], sizes[at], ends[at] = made, sizes[at] + sizes[at + 1], ends[at + 1]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols, sizes, ends, places = symbols[stay], sizes[stay], ends[stay], places[stay]
    # the balanced tree above each text's last symbols
    stops = places + sizes
    owner = np.searchsorted(edges, places, "right")
    while len(places):
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        left = np.flatnonzero((rank % 2 == 0) & np.append(owner[1:] == owner[:-1], False))
        if not len(left):
            break
        far = left[stops[left + 1] - places[left] >= LEAST]
        nodes.append((places[far], places[far + 1], stops[far + 1]))
        derived.append((number + np.arange(len(far)), places[far]))
        number += len(far)
        stay = np.ones(len(places), dtype=bool)
        stay[left + 1] = False
        stops[left] = stops[left + 1]
        places, stops, owner = places[stay], stops[stay], owner[stay]
    none = np.zeros(0, dtype=np.int64)
    start, boundary, end = (np.concatenate([none, *(n[i] for n in nodes)]) for i in range(3))
    node, place = (np.concatenate([none, *(d[i] for d in derived)]) for i in range(2))
    return start, boundary, end, node, place


class Equal:
    """Common extensions of two places by prefix hashes of word numbers."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        self.up = _powers(len(ids) + 1)[0]
        self.sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(seed * 0x51_7CC1_B727)) * self.up[: len(ids)], out=self.sums[1:])

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on are those from j on (i <= j)."""
        return (self.sums[i + n] - self.sums[i]) * self.up[j - i] == self.sums[j + n] - self.sums[j]

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words in which i and j agree onwards (or backwards), ``most`` at most, by bisection."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.same(i - middle, j - middle, middle) if back else self.same(i, j, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def crossing(ids: np.ndarray, equal: Equal, start: np.ndarray, boundary: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(node, from, to, period) rows of stretches inside each node's expansion that cross its boundary."""
    found = []
    for left in (False, True):
        room = (boundary - start if left else end - boundary) // 2
        periods = np.minimum(room, (end - start) // TIMES)
        upto = np.concatenate([[0], np.cumsum(periods)])
        for base in range(0, int(upto[-1]), CHUNK):
            flat = np.arange(base, min(base + CHUNK, int(upto[-1])))
            node = np.searchsorted(upto, flat, "right") - 1
            q = flat - upto[node] + 1
            b = boundary[node]
            i = b - 2 * q if left else b
            hit = ids[i] == ids[i + q]
            node, q, b, i = node[hit], q[hit], b[hit], i[hit]
            hit = (ids[i + q - 1] == ids[i + 2 * q - 1]) & equal.same(i, i + q, q)
            node, q, b, i = node[hit], q[hit], b[hit], i[hit]
            if not len(node):
                continue
            on = equal.reach(i, i + q, end[node] - i - q)
            back = equal.reach(i, i + q, i - start[node], back=True)
            begin, stop = i - back, i + q + on
            keep = (stop - begin >= np.maximum(LEAST, TIMES * q)) & (begin < b) & (stop > b)
            found.append(np.stack([node, begin, stop, q], axis=1)[keep])
    rows = np.concatenate(found) if found else np.zeros((0, 4), dtype=np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]  # of one stretch the smallest period
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows


def merged(begin: np.ndarray, stop: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap by a period become one; of equal intervals the smallest period stays.
    In order of start and period."""
    if not len(begin):
        return begin, stop, q
    order = np.lexsort((begin, q))
    begin, stop, q = begin[order], stop[order], q[order]
    lift = np.cumsum(np.append(0, q[1:] != q[:-1])) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift) - lift
    new = np.append(True, (q[1:] != q[:-1]) | (begin[1:] > reach[:-1] - q[1:]))
    first = np.flatnonzero(new)
    begin, stop, q = begin[first], np.maximum.reduceat(stop, first), q[first]
    order = np.lexsort((q, stop, begin))
    begin, stop, q = begin[order], stop[order], q[order]
    one = np.append(True, (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1]))
    begin, stop, q = begin[one], stop[one], q[one]
    order = np.lexsort((q, begin))
    return begin[order], stop[order], q[order]


def _exact(ids: np.ndarray, edges: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
    """Whether every run is one, word for word, and none can be extended."""
    for s, e, q in zip(*(r.tolist() for r in runs), strict=True):
        if not np.array_equal(ids[s : e - q], ids[s + q : e]):
            return False
        text = np.searchsorted(edges, s, "right")
        if s > edges[text - 1] and ids[s - 1] == ids[s - 1 + q] or e < edges[text] and ids[e] == ids[e - q]:
            return False
    return True


def find_runs(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, smallest period) of all runs of the texts whose words are ids, in order of start and period."""
    start, boundary, end, node, place = grammar(ids, edges)
    order = np.argsort(node, kind="stable")
    place, counts = place[order], np.bincount(node, minlength=len(start))
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for seed in range(1, 9):
        rows = crossing(ids, Equal(ids, seed), start, boundary, end)
        times = counts[rows[:, 0]]
        which = np.repeat(np.arange(len(rows)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        shift = place[firsts[rows[which, 0]] + nth] - start[rows[which, 0]]
        runs = merged(rows[which, 1] + shift, rows[which, 2] + shift, rows[which, 3])
        if _exact(ids, edges, runs):
            return runs
    raise ArithmeticError("hashes of words collide with eight seeds")


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, Block]]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = min(len(texts), max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1))
        yield first, last, Block(data, offsets[first : last + 1])
        first = last


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for first, last, block in _blocks(batch.column(1)):
            begin, stop, q = find_runs(block.ids, block.edges)
            owner = np.searchsorted(block.edges, begin, "right") - 1
            spans = np.searchsorted(owner, np.arange(last - first + 1))
            texts = []
            for i in range(last - first):
                low, high = int(block.edges[i]), int(block.edges[i + 1])
                mine = slice(spans[i], spans[i + 1])
                if spans[i] == spans[i + 1]:
                    texts.append(block.text(low, high))
                    continue
                steps = np.zeros(high - low + 1, dtype=np.int64)
                np.add.at(steps, begin[mine] + q[mine] - low, 1)
                np.add.at(steps, stop[mine] - low, -1)
                gone = np.append(np.cumsum(steps[:-1]) > 0, True)
                turns = np.flatnonzero(np.diff(np.append(True, gone).astype(np.int8)))
                texts.append(b" ".join(block.text(low + a, low + b) for a, b in turns.reshape(-1, 2).tolist()))
            edges = block.edges
            pieces = pa.StructArray.from_arrays([pa.array(begin - edges[owner]), pa.array(stop - begin), pa.array(q)], fields=list(kind.value_type))
            runs = pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(edges)), runs, pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def without_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the collapsed text of every row of docs (doc_id, text): words that
    a run has after its first period are left out."""
    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _collapsed, FOUND)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text, or, where the id's CRC-32 ends in 0, its words made periodic from one of them on."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    check = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(check / 10).cast("long")

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(w, (a + i % p + 1).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a.cast("int")), again)).otherwise(text)

    # bound as a lambda's variable, the words are looked for once a text instead of once a word
    return F.when(check % 10 == 0, F.element_at(F.transform(F.array(words), edited), 1)).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """Runs and collapsed texts of docs after made_periodic, as counts, the greatest run and digests."""
    doc_id = F.col("doc_id").cast("long")
    found = without_runs(docs.select(doc_id.alias("doc_id"), made_periodic(doc_id, F.col("text").cast("string")).alias("text")))
    greatest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    best = F.when(F.size("runs") > 0, greatest)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
