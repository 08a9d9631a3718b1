"""Packing tokenized documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids (with its end id) are cut at multiples of the capacity; full sequences stay whole, and so does
the tail where it fits. Pieces are dealt by hash to groups of about ``GROUP_TOKENS`` or ``GROUP_PIECES``. In a
group every tail starts as a partial partition of k windows; the two partitions with the largest differences
are merged, fullest windows onto emptiest, until one is left. k starts at the fewest windows that can hold the
group and rises while the fullest window exceeds the capacity. Where that takes more than ``LOOSE`` of
padding, a share of the tails (``SHARES``, drawn by hash) is cut at multiples of ``PIECE`` and the largest power of
two of the rest, as filling, and differencing starts again.

Only numbers are shuffled: ids are made, cut and checksummed in one pass over the texts.

Defined results: null and empty texts hold the end id alone; equal rows are packed as often as they come;
rows without an id are packed like others; other columns are not read; an empty table gives no rows. Reruns
give equal sequences.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut_lineage, map_texts

CAPACITY, PIECE, END_ID = 4096, 512, 2
#: Tokens in a group (256 sequences), and pieces in one of short documents.
GROUP_TOKENS, GROUP_PIECES = 256 * CAPACITY, 16_384
#: Share of padding that is let pass, and shares of the tails that are cut as filling.
LOOSE, SHARES = 0.01, (0, 1 / 8, 1 / 4, 1 / 2, 1)
#: Words whose ids a worker remembers; others are made again.
REMEMBERED = 400_000
#: The last letter of the Latin blocks for which letters are made small one by one.
LAST_LATIN = "\u024f"
#: Signs that end a run of letters and make a run of their own with the signs behind them.
SIGNS = b".,;:!?*#$%&|()[]{}<>/-+=~^@\""

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cuts array<long>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plain_letters(word: str) -> bool:
    """Whether a word is of Latin letters, each of which stays one letter in lower case."""
    return word.isalpha() and max(word) <= LAST_LATIN and "\u0130" not in word


class WordIds(dict):
    """Ids (little-endian 16-bit numbers) of white-space-separated words, made when first asked for.

    The tokenizer's tokens never span white space, so a text's ids are those of its words in order. Words
    of Latin letters are one token each before the merges, so the tokenizer's model gets them at once; other
    words go through all of the tokenizer's steps. Texts that may hold a special token's string are
    tokenized whole."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        # byte-level vocabularies write bytes that don't print as characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_marks = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def __missing__(self, word: bytes) -> bytes:
        letters = word.rstrip(SIGNS)
        if len(letters) < len(word) and (letters.isalpha() or plain_letters(letters.decode())):
            made = self[letters] + self[word[len(letters) :]]  # they are tokenized apart
        elif word.isalpha():  # a to z: lower case has been made
            made = array("H", [t.id for t in self.merges(word.decode())]).tobytes()
        elif plain_letters(text := word.decode()):
            text = unicodedata.normalize("NFC", text).lower().encode().decode("latin-1").translate(self.byte_marks)
            made = array("H", [t.id for t in self.merges(text)]).tobytes()
        else:
            made = array("H", self.tokenizer.encode([text], is_pretokenized=True, add_special_tokens=False).ids).tobytes()
        if len(self) < REMEMBERED and len(word) <= 64:  # frequent words come early
            self[word] = made
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as 32-bit numbers."""
        ids, out = self.__getitem__, []
        for text in texts:
            if "<|" in text:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4"))
            else:
                out.append(np.frombuffer(b"".join(map(ids, text.encode().lower().split())), dtype=np.uint16).astype("<u4"))
        return out


_WORKER: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every row of docs (doc_id, text), with checksums of their ids; a tail that can be cut
    further has the lengths and checksums of its cuts, one after the other."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = WordIds(path)
        kind = _WORKER[path]
        names, kinds = [x.split()[0] for x in PIECES.split(", ")], [pa.int64()] * 5 + [pa.list_(pa.int64())]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(at, 256), []
                ids = batch.column(0).to_pylist()
                for doc_id, row in zip(ids, kind.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    row = np.append(row, np.uint32(END_ID)).astype("<u4")
                    n = len(row)
                    full = n // CAPACITY * CAPACITY
                    rows += [(doc_id, a, CAPACITY, zlib.crc32(row[a : a + CAPACITY]), n, []) for a in range(0, full, CAPACITY)]
                    if full < n:
                        edges, last = [*range(full, n, PIECE), n], (n - full - 1) % PIECE + 1
                        if last & (last - 1):
                            edges.insert(-1, n - last + (1 << last.bit_length() - 1))
                        cuts = [x for a, b in zip(edges, edges[1:], strict=False) for x in (b - a, zlib.crc32(row[a:b]))] if len(edges) > 2 else []
                        rows.append((doc_id, full, n - full, zlib.crc32(row[full:]), n, cuts))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k - 1) of every size, by k-way differencing."""
    if k == 1:
        return np.zeros(len(sizes), dtype=np.int64)
    loads: list[np.ndarray | None] = []
    for s in sizes.tolist():
        row = np.zeros(k, dtype=np.int32)
        row[0] = s
        loads.append(row)
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        total = loads[i] + loads[j][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        merges.append((i, j, order.astype(np.int32)))
        loads[i] = loads[j] = None
        loads.append(total - total[-1])
        heapq.heappush(heap, (-int(loads[-1][0]), len(loads) - 1))
    place: dict[int, np.ndarray] = {len(loads) - 1: np.arange(k)}  # window of each slot of a partition
    for n in range(len(merges) - 1, -1, -1):
        i, j, order = merges[n]
        slot = np.empty(k, dtype=np.int64)
        slot[order] = place.pop(len(sizes) + n)
        place[i], place[j] = slot, slot[::-1]
    return np.array([place[i][0] for i in range(len(sizes))], dtype=np.int64)


def windows(sizes: np.ndarray, capacity: int = CAPACITY, most: int | None = None) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows); no window exceeds the capacity. The number is 0 if it would
    have to be above ``most``."""
    k = max(1, math.ceil(int(sizes.sum()) / capacity))
    while most is None or k <= most:
        found = differencing(sizes, k)
        if np.bincount(found, weights=sizes, minlength=k).max() <= capacity:
            return found, k
        k += 1
    return np.zeros(len(sizes), dtype=np.int64), 0


def _cut(tails: pd.DataFrame, share: float) -> pd.DataFrame:
    """tails with those of a share of the hash range cut."""
    drawn = (tails["draw"] < share) & (tails["cuts"].map(len) > 0)
    if not drawn.any():
        return tails
    lengths = [c[::2] for c in tails.loc[drawn, "cuts"]]
    finer = tails[drawn].loc[np.repeat(tails.index[drawn], [len(x) for x in lengths])].copy()
    finer["start"] += np.concatenate([np.cumsum(x) - x for x in lengths])
    finer["length"] = np.concatenate(lengths)
    finer["ids_crc32"] = np.concatenate([c[1::2] for c in tails.loc[drawn, "cuts"]])
    return pd.concat([tails[~drawn], finer], ignore_index=True)


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "start", "copy", "ids_crc32"], kind="stable", na_position="last").reset_index(drop=True)
    whole, tails = group[group["length"] == CAPACITY], group[group["length"] < CAPACITY].reset_index(drop=True)
    k, parts = 0, [whole]
    if len(tails):
        total = int(tails["length"].sum())
        enough = max(math.ceil(total / CAPACITY), int(total / (CAPACITY * (1 - LOOSE))))
        for share in SHARES:
            rest = _cut(tails, share)
            found, k = windows(rest["length"].to_numpy(), most=None if share == SHARES[-1] else enough)
            if k:
                break
        parts.insert(0, rest.assign(window=found))
    parts[-1] = whole.assign(window=k + np.arange(len(whole)))
    out = pd.concat([p for p in parts if len(p)], ignore_index=True)
    out = out.sort_values(["window", "doc_id", "start", "copy"], kind="stable", na_position="last")
    out["offset"] = out.groupby("window")["length"].cumsum() - out["length"]
    # windows of a group are numbered below 2^31
    out["sequence_id"] = out["grp"].astype("int64") * (1 << 31) + out["window"]
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out[[x.split()[0] for x in PACKED.split(", ")]]


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """PACKED's columns for every piece of docs (doc_id, text)."""
    cut = cut_lineage(pieces(docs, tokenizer))
    size = cut.agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces")).first()
    groups = max(1, math.ceil((size["tokens"] or 0) / GROUP_TOKENS), math.ceil(size["pieces"] / GROUP_PIECES))
    keys = [x.split()[0] for x in PIECES.split(", ")][:-1]
    same = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.first("cuts").alias("cuts"))
    runs = same.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / 4096))))
    dealt = runs.withColumn("at", F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.col("m") - F.col("run") * 4096)))).withColumn("copy", (F.col("at") + F.col("run") * 4096).cast("long"))
    draw = F.pmod(F.xxhash64(F.lit(1), "doc_id", "start", "ids_crc32"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    dealt = dealt.withColumns({"grp": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups)), "draw": draw}).select(*keys, "cuts", "copy", "grp", "draw")
    return dealt.groupBy("grp").applyInPandas(_packed, PACKED)
