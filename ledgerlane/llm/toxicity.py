"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms and marks are removed, case is folded, look-alike letters of
other scripts and digits that stand for letters become Latin letters, and everything else a space. A term is
the beginning of a word (the longest that the same texts hold), or a whole word (with a space at its end).
Terms are picked by their log odds in labelled texts and weighed by a logistic fit of their counts, normalised by the root of the text's length.
A hit inside an exception phrase doesn't count.

The lexicon is learned from a bounded sample (``SAMPLE`` texts of each label, those of smallest hash), as are
its weights; every term that is frequent and telling enough there is weighed, and scores cover every row and the whole of each text.

Defined results: null and empty texts score as texts without a hit; without labels of both kinds there is no
lexicon and every score is 0; rows with equal ids are scored one by one; labels of one id that disagree each
count; columns besides the id, the text and the label are not read by a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.llm.common import cut_lineage, map_texts, unwrapped, wrapped

#: Labelled texts of each kind that are learned from, at most.
SAMPLE = {1: 4_000, 0: 8_000}
#: Letters of the shortest term, and of the longest word's beginning that is one; whole words have any length.
SHORTEST, LONGEST = 3, 40
#: Hits of a term above which more of them weigh by their logarithm.
FEW = 8
THRESHOLD = 0.7
#: Phrases in which a term is harmless; plain words after folding.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "garbage trash", "idiot proof", "stupid simple", "pond scum", "soap scum", "oxy moron")

#: Letters that look like Latin ones (Cyrillic, Greek, Armenian, Latin small capitals and
#: variants), and what they look like.
LOOK_ALIKE = (
    ("авгекмнопрстухьёіјѕүһҽӏԁԍԛԝѵґ", "abrekmhonpctyxbeijsyheldgqwvr"),
    ("αβγεικνορστυχηωϲϳ", "abyeikvopotuxnwcj"),
    ("ցզհոսօքյ", "gqhnuofj"),
    ("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "abcdefghijklmnoprstuvwyz"),
    ("ɑəɛɡħıɩłøɔðđŧʋ", "aeeghiilooddtv"),
)
#: Digits and signs that stand for letters.
STAND_IN = ("0123456789@$€£¢", "oizeasgtbgaselc")
#: Characters that are left out, so that they can't split a word.
UNSEEN = "­​‌‍⁠﻿"

_TABLE = {i: " " for i in range(128) if not chr(i).isalnum()}
_TABLE |= {ord(a): b for a, b in zip(*STAND_IN, strict=True)}
_ASCII = str.maketrans(_TABLE)
_WIDE = _ASCII | {ord(a): b for pair in LOOK_ALIKE for a, b in zip(*pair, strict=True)} | {ord(c): None for c in UNSEEN}
_NO_WORD = re.compile(r"[\W_]+")
_MARKS = re.compile("[̀-ͯ]+")


def fold(text: str | None) -> str:
    """Folded words of a text, with one space around each."""
    if not text:
        return " "
    if text.isascii():
        plain = text.lower().translate(_ASCII)
    else:
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().translate(_WIDE)
        plain = _NO_WORD.sub(" ", plain)
    return f" {' '.join(plain.split())} "


def terms_of(folded: str) -> set[str]:
    """Candidate terms of a folded text."""
    found = set()
    for w in set(folded.split()):
        found.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
        if len(w) >= SHORTEST:
            found.add(f"{w} ")
    return found


class Matcher:
    """Counts of terms in folded texts, without hits inside exception phrases."""

    def __init__(self, terms: list[str], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(f" {t}", (i, len(t) + 1))
        for phrase in exceptions:
            p = fold(phrase)
            if p.strip() and p not in self.automaton:
                self.automaton.add_word(p, (-1, len(p)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def counts(self, folded: str) -> dict[int, int]:
        if not len(self.automaton):
            return {}
        hits = list(self.automaton.iter(folded))
        safe = sorted((end - n, end) for end, (i, n) in hits if i < 0)
        starts, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))

        def spared(start: int, end: int) -> bool:
            at = bisect_right(starts, start)
            return at > 0 and reach[at - 1] >= end

        return Counter(i for end, (i, n) in hits if i >= 0 and not spared(end - n, end))


def value(count: int, words: int) -> float:
    """A term's evidence in a text of so many words: its count, which weighs less and less above FEW."""
    return (count if count <= FEW else FEW + math.log2(count / FEW)) * 10 / math.sqrt(words + 30)


def fit(texts: list[dict[int, int]], words: list[int], labels: list[int], n: int, rounds: int = 400, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights of n terms and a constant, by logistic regression with a ridge; weights are 0 or more."""
    row = np.array([i for i, t in enumerate(texts) for _ in t], dtype=np.int64)
    col = np.array([j for t in texts for j in t], dtype=np.int64)
    val = np.array([value(c, words[i]) for i, t in enumerate(texts) for c in t.values()])
    y = np.array(labels, dtype=float)
    weights, const, past, past_c = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), np.full(n, 1e-3), 1e-3
    for _ in range(rounds):
        z = np.bincount(row, weights=val * weights[col], minlength=len(y)) + const
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g, gc = np.bincount(col, weights=val * off[row], minlength=n) + ridge * weights, off.sum()
        past, past_c = past + g * g, past_c + gc * gc
        weights, const = np.maximum(0.0, weights - 0.5 * g / np.sqrt(past)), const - 0.5 * gc / math.sqrt(past_c)
    return weights, float(const)


def learn(labelled: DataFrame) -> dict:
    """Lexicon of labelled (doc_id, text, label 0 or 1): terms, weights, constant."""
    labelled = cut_lineage(labelled)
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return {"terms": [], "weights": [], "const": -30.0}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            kinds = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kinds[label].update(terms_of(fold(text)))
            names = list(kinds[1])  # a term that no toxic text has is of no use
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kinds[1][t] for t in names], pa.int64()), pa.array([kinds[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])
            rest = [t for t in kinds[0] if t not in kinds[1]]
            yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([kinds[0][t] for t in rest], pa.int64())], ["term", "toxic", "clean"])

    sums = map_texts(labelled.select("text", "label"), counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, n = sizes[1], sizes[0]
    odds = F.log((F.col("toxic") + 0.5) / (p + 1)) - F.log((F.col("clean") + 0.5) / (n + 1))
    sums = sums.filter(F.col("toxic") >= max(3, math.ceil(0.004 * p))).withColumn("odds", odds).filter("odds > 2")
    sure = F.col("odds") / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    picked = sums.withColumn("sure", sure).orderBy(F.desc("sure"), "term").collect()  # terms of a bounded sample
    held = {r["term"]: r["toxic"] for r in picked}
    grown = {t[:-1] for t, n in held.items() if t[-1] != " " and n >= 0.95 * held.get(t[:-1], math.inf)}
    # of beginnings that the same texts hold, the longest: it fits the fewest other words
    odds_of = {r["term"]: r["odds"] for r in picked if r["term"] not in grown}
    terms: list[str] = []
    for t in sorted(odds_of, key=lambda t: (len(t), t)):  # a longer term must say clearly more than its beginnings
        if not any(odds_of[t] < odds_of[t[:i]] + 0.7 for i in range(SHORTEST, len(t)) if t[:i] in odds_of):
            terms.append(t)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            folded = [fold(t) for t in batch.column(0).to_pylist()]
            found = [matcher.counts(t) for t in folded]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([t.count(" ") - 1 for t in folded], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.int64())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["label", "words", "term", "n"])

    rows = map_texts(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", F.col("label").cast("long")), matched, "label long, words long, term array<long>, n array<long>").collect()  # SAMPLE rows at most
    weights, const = fit([dict(zip(r["term"], r["n"], strict=True)) for r in rows], [r["words"] for r in rows], [r["label"] for r in rows], len(terms))
    keep = np.flatnonzero(weights > 0.01)
    return {"terms": [terms[i] for i in keep], "weights": weights[keep].tolist(), "const": const}


def sample(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """(doc_id, text, label) of at most SAMPLE different texts of each label, of the ids of smallest hash; an id that is
    repeated with the same text counts once."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(learnable).distinct()
    first = lambda part, most: part.orderBy(F.xxhash64("doc_id"), *[c for c in ("doc_id", "th") if c in part.columns]).limit(most)
    picked = None
    for label, most in SAMPLE.items():
        part = first(rows.filter(F.col("label") == label), most)
        picked = part if picked is None else picked.union(part)
    ids = F.broadcast(picked)  # SAMPLE rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    texts = cut_lineage(texts.withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "label", "th"]))
    few = None  # ids with many texts don't add to the bound
    for label, most in SAMPLE.items():
        part = first(texts.filter(F.col("label") == label), most)
        few = part if few is None else few.union(part)
    return few.drop("th")


def may_learn() -> Column:
    """Rows that labels may be learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


SCORED = "score double, hits long, words long"


def scored(rows: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """SCORED's columns beside those of rows, in one pass without a shuffle: score (0 to 1), hits of the
    lexicon and words. A struct field is named with a point, as in ``row.text``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType()), T.StructField("words", T.LongType())])
    first, _, inner = text.partition(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights, const = Matcher(model["terms"]), model["weights"], model["const"]
        for batch in batches:
            column, out = batch.column(batch.schema.get_field_index(first)), []
            for t in column.field(inner) if inner else column:
                folded = fold(t.as_py())
                words, found = folded.count(" ") - 1, matcher.counts(folded)
                z = const + sum(weights[i] * value(c, words) for i, c in found.items())
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), sum(found.values()), words))
            more = [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "score", "hits", "words"])

    return map_texts(rows, run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(sample(docs, labels, may_learn()))
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "words")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that score below THRESHOLD."""
    model = learn(sample(docs, labels, may_learn()))
    return unwrapped(scored(wrapped(docs), model, "row.text").filter(F.col("score") < THRESHOLD), docs)
