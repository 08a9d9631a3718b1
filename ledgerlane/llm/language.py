"""Language identification by unigram piece models that sum over all segmentations.

The pieces are those of a fixed public vocabulary. For each language a model gives every piece a
probability; a word's likelihood is the sum over all ways to cut it into pieces, found by the forward
algorithm for all languages at once. Words are runs of letters in lower case, so a text's likelihood is a
product over its words and each different word is computed once per worker. Probabilities are learned by
expectation maximisation: the E step runs the forward and backward algorithms on Spark, the M step adds up
expected counts, of which there are pieces times languages.

Learned from a bounded sample (``SAMPLE`` texts of each language, those of smallest hash) and every piece and
word in it; predictions cover every row and the whole of each text. Words over ``LONG`` letters are summed by
logarithms, one by one, so that their probabilities don't vanish; the work is linear in their length.

Defined results: a null text or one without a letter gives ``und`` and score 0; without learnable rows every
text gives ``und``; ties go to the first language in code-point order; rows with equal ids are predicted one
by one; the language column is never read by a prediction; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlane.llm.common import broadcast_up_to, cut_lineage, map_texts

#: Texts of a language that are learned from, at most; rows that are broadcast, at most.
SAMPLE, BROADCAST = 300, 1_000_000
ROUNDS = 3
#: Letters of the longest words that are computed together and without logarithms.
LONG = 40
#: Words whose likelihoods a worker remembers, up to LONG letters; others are computed again.
REMEMBERED = 400_000
#: Expected count that every piece starts with, and the likelihood of a letter outside the vocabulary.
PRIOR, UNKNOWN = 0.05, 1e-7

_ASCII_WORDS = re.compile(r"[a-z]+")
#: A letter (category L) and the letters and combining signs that follow it; numbers that look like letters are none.
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Multiplier of the pieces' hashes.
STEP = 0x9E3779B97F4A7C15
START = "▁"  # the vocabulary's mark of a word's beginning


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return _ASCII_WORDS.findall(text.lower()) if text.isascii() else _WORDS.findall(text.lower())


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of letters (with or without the mark of a word's beginning), in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in found if p == p.lower() and p.removeprefix(START).isalpha()})


class Lattice:
    """Forward and backward sums of words under the models of all languages."""

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        """logs: (pieces + 1, languages) log probabilities, the last row for unknown letters."""
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        # one more entry at the end, so that every search has a place
        self.hashes, self.ids = np.append(hashes[order], np.uint64(0)), np.append(order, len(pieces) + 1)
        self.logs, self.probs = logs, np.exp(logs)
        self.padded = np.concatenate([self.probs, np.zeros((1, logs.shape[1]))])
        self.languages = logs.shape[1]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * STEP + ord(c)) % (1 << 64)
        return h

    def edges(self, word: str) -> list[tuple[list[int], list[int]]]:
        """For each end, the starts and ids of the pieces of START + word that end there."""
        marked, find, unknown = START + word, self.index.get, len(self.index)
        out: list[tuple[list[int], list[int]]] = [([], [])]
        for end in range(1, len(marked) + 1):
            own = [(start, i) for start in range(max(0, end - self.longest), end) if (i := find(marked[start:end])) is not None]
            if not own or own[-1][0] != end - 1:
                own.append((end - 1, unknown))
            out.append(([s for s, _ in own], [i for _, i in own]))
        return out

    def _log_forward(self, edges: list[tuple[list[int], list[int]]]) -> np.ndarray:
        """(length + 1, languages) logs of the sums over all segmentations of each beginning."""
        sums = np.zeros((len(edges), self.languages))
        for end, (starts, ids) in enumerate(edges[1:], 1):
            sums[end] = np.logaddexp.reduce(sums[starts] + self.logs[ids], axis=0)
        return sums

    def log_likelihood(self, word: str) -> np.ndarray:
        """Log of the sum over all segmentations, per language."""
        return self._log_forward(self.edges(word))[-1]

    def _grouped(self, words: list[str]) -> Iterator[tuple[list[int], int, dict[tuple[int, int], np.ndarray]]]:
        """Words of one length together: (their places, length with the mark, ids of the pieces of each
        (start, end), in order of end; a piece that isn't in the vocabulary has the id after the unknown
        letter's). Pieces are found by a 64-bit hash of their letters, for all words at once."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(i)
        unknown = len(self.index)
        for n, rows in by_length.items():
            letters = np.frombuffer("".join(START + words[i] for i in rows).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), n).T.astype(np.uint64)
            ids = {}
            for start in range(n):
                h = np.zeros(len(rows), dtype=np.uint64)
                for end in range(start + 1, min(n, start + self.longest) + 1):
                    h = h * np.uint64(STEP) + letters[end - 1]
                    at = np.searchsorted(self.hashes[:-1], h)
                    known = self.hashes[at] == h
                    if end == start + 1 or known.any():
                        ids[start, end] = np.where(known, self.ids[at], unknown if end == start + 1 else unknown + 1)
            yield rows, n, dict(sorted(ids.items(), key=lambda x: x[0][1]))

    def _forward(self, n: int, size: int, ids: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        sums = np.zeros((n + 1, size, self.languages))
        sums[0] = 1
        for (start, end), own in ids.items():  # in order of end
            sums[end] += sums[start] * self.padded[own]
        return sums

    def batch(self, words: list[str]) -> np.ndarray:
        """(words, languages) log likelihoods; words of one length are computed together."""
        out = np.empty((len(words), self.languages))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.log_likelihood(w)
        for rows, n, ids in self._grouped([words[i] for i in short]):
            out[[short[i] for i in rows]] = np.log(np.maximum(self._forward(n, len(rows), ids)[n], 1e-300))
        return out

    def expected(self, words: list[str], counts: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected uses of each piece in words, seen counts (words, languages) times each."""
        for i, w in enumerate(words):
            if len(w) > LONG:
                self._expected_long(w, counts[i], total)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for rows, n, ids in self._grouped([words[i] for i in short]):
            ahead = self._forward(n, len(rows), ids)
            behind = np.zeros_like(ahead)
            behind[n] = counts[[short[i] for i in rows]] / np.maximum(ahead[n], 1e-300)
            for (start, end), own in reversed(ids.items()):
                part = self.padded[own] * behind[end]
                behind[start] += part
                np.add.at(total, own, part * ahead[start])

    def _expected_long(self, word: str, counts: np.ndarray, total: np.ndarray) -> None:
        edges = self.edges(word)
        ahead = self._log_forward(edges)
        behind = np.full_like(ahead, -np.inf)
        behind[-1] = 0
        for end in range(len(edges) - 1, 0, -1):
            starts, ids = edges[end]
            part = self.logs[ids] + behind[end]
            behind[starts] = np.logaddexp(behind[starts], part)  # each start once
            np.add.at(total, ids, np.exp(part + ahead[starts] - ahead[-1]) * counts)


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log probabilities (pieces + 1, languages) from expected counts."""
    full = counts + PRIOR
    logs = np.log(full / full.sum(axis=0))
    return np.concatenate([logs, np.full((1, counts.shape[1]), np.log(UNKNOWN))])


def learn(labelled: DataFrame, path: str | None = None) -> dict:
    """Models of labelled (text, lang): languages in order, pieces that are used and their log probabilities."""
    pieces = vocabulary(path or default_vocabulary())
    labelled = cut_lineage(labelled)
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # one row per language
    place = {x: i for i, x in enumerate(langs)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((w, place[lang]) for w in words_of(text))
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([found[r] for r in rows], pa.int64())], ["word", "lang", "n"])

    words = map_texts(labelled.select("text", "lang"), counted, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    table = cut_lineage(words.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")))
    logs = np.full((len(pieces) + 1, max(1, len(langs))), -np.log(len(pieces)))
    logs[-1] = np.log(UNKNOWN)
    for _ in range(ROUNDS if langs else 0):

        def expect(batches: Iterator[pa.RecordBatch], logs: np.ndarray = logs) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(pieces, logs), np.zeros((len(pieces) + 2, len(langs)))
            for batch in batches:
                counts = np.zeros((batch.num_rows, len(langs)))
                for i, n in enumerate(batch.column(1).to_pylist()):
                    for lang, k in n:
                        counts[i, lang] = k
                lattice.expected(batch.column(0).to_pylist(), counts, total)
            used = np.argwhere(total[:-2] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)), pa.array(total[used[:, 0], used[:, 1]])], ["piece", "lang", "n"])

        sums = table.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()  # pieces times languages at most
        counts = np.zeros((len(pieces), len(langs)))
        for r in sums:
            counts[r["piece"], r["lang"]] = r["n"]
        logs = _logs(counts)
    return {"langs": langs, "pieces": pieces, "logs": logs}


def sample(docs: DataFrame, learnable: Column) -> DataFrame:
    """(text, lang) of at most SAMPLE different learnable texts of each language, those of smallest hash; an id that is
    repeated with the same text counts once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null").filter(learnable).withColumn("th", F.xxhash64("text"))
    ids = rows.select("doc_id", "lang", "th").distinct().withColumn("h", F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 40)))
    # about 2 * SAMPLE texts of each language reach the window, however many it has
    counts = broadcast_up_to(cut_lineage(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))), BROADCAST)
    near = ids.join(counts, "lang").filter(F.col("h").cast("double") * F.col("of") < F.lit(2.0 * SAMPLE) * F.lit(1 << 40))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "th")
    few = broadcast_up_to(cut_lineage(near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE).select("doc_id", "lang", "th")), BROADCAST)
    return rows.join(few, ["doc_id", "lang", "th"], "left_semi").dropDuplicates(["doc_id", "lang", "th"]).select("text", "lang")


class Scorer:
    """Log likelihoods of texts, with the words' remembered."""

    def __init__(self, model: dict) -> None:
        self.lattice, self.rows, self.table = Lattice(model["pieces"], model["logs"]), {}, np.zeros((1024, len(model["langs"])))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log likelihoods and the number of words of each."""
        split = [words_of(t) for t in texts]
        rows, asked = self.rows, list({w for words in split for w in words})
        if len(rows) + len(asked) > REMEMBERED:
            rows.clear()
        new = sorted((w for w in asked if w not in rows), key=lambda w: len(w) > LONG)
        need = len(rows) + len(new)
        if need > len(self.table):
            self.table = np.concatenate([self.table[: len(rows)], np.zeros((2 * need - len(rows), self.table.shape[1]))])
        if new:
            self.table[len(rows) : need] = self.lattice.batch(new)
            rows.update(zip(new, range(len(rows), need), strict=True))
        counts = np.array([len(w) for w in split])
        out = np.zeros((len(texts), self.table.shape[1]))
        have = np.flatnonzero(counts)
        if len(have):
            at = np.fromiter((rows[w] for words in split for w in words), dtype=np.int64, count=int(counts.sum()))
            out[have] = np.add.reduceat(self.table[at], np.concatenate([[0], np.cumsum(counts[have])[:-1]]), axis=0)
        for w in reversed(new):  # long words came last and aren't remembered
            if len(w) <= LONG:
                break
            del rows[w]
        return out, counts


PREDICTED = "lang_pred string, score double"


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) with PREDICTED's columns: the language of largest likelihood and its share of
    the sum of all, after each log likelihood is divided by the root of the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces times languages
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, langs = Scorer(model), np.array([*model["langs"], "und"], dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                logs, counts = scorer.texts(batch.column(batch.schema.get_field_index("text")).to_pylist()) if model["langs"] else (np.zeros((batch.num_rows, 1)), np.zeros(batch.num_rows, dtype=int))
                best = logs.argmax(axis=1)
                share = 1 / np.exp((logs - logs.max(axis=1, keepdims=True)) / np.maximum(np.sqrt(counts), 1)[:, None]).sum(axis=1)
                und = counts == 0
                best[und], share[und] = len(model["langs"]), 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs[best].tolist(), pa.string()), pa.array(share)], [*batch.schema.names, "lang_pred", "score"])

    return map_texts(docs, run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = learn(sample(docs, part != 0), path)
    rows = predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
