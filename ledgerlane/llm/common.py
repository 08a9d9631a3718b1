"""Helpers shared by the training-data operators.

Word positions and word hashes are computed with numpy over the UTF-8 bytes of
an Arrow batch, so no Python object is made per word. A word is a maximal run
of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.plans.shared import shared_base

#: Bytes of text that are hashed at once; longer texts are cut at white space and joined again.
BLOCK_BYTES = 1 << 17

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared spark.checkpoint.dir; only tests without it get a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later stages survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of whole texts that a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow over rows that hold whole texts, whose length nothing bounds: batches are kept small, for all
    that the session plans from then on."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(run, schema)


def broadcast_up_to(df: DataFrame, most: int) -> DataFrame:
    """df, whose lineage is cut, to be broadcast if it has ``most`` rows or less; otherwise Spark decides."""
    return F.broadcast(df) if df.count() <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit hash."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_block(raw: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of raw; a word also ends at each of breaks."""
    space = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    n = len(raw)
    begin = ~space
    begin[1:] &= space[:-1]
    end = ~space
    end[:-1] &= space[1:]
    inner = breaks[(breaks > 0) & (breaks < n)]
    begin[inner] = ~space[inner]
    end[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64)), starts, ends


def hashed_words(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, counts, hashes, starts, ends) for runs of texts: rows first to last (exclusive), the
    words of each, and all their words' hashes and byte places in their own text. Null texts have no words."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    else:
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        last = min(last, n)
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= 2 * BLOCK_BYTES:
            hashes, starts, ends = _hash_block(data[low:high], offsets[first:last] - low, lower)
        else:  # one very long text
            parts, at = [], low
            while at < high:
                to = min(high, at + BLOCK_BYTES)
                while to < high and not (data[to] == 0x20 or 9 <= data[to] <= 13):
                    to += 1
                h, s, e = _hash_block(data[at:to], np.zeros(0, dtype=np.int64), lower)
                parts.append((h, s + (at - low), e + (at - low)))
                at = to
            hashes, starts, ends = (np.concatenate([p[i] for p in parts]) for i in range(3))
        edges = np.searchsorted(starts, offsets[first : last + 1] - low)
        counts = np.diff(edges)
        shift = np.repeat(offsets[first:last] - low, counts)
        yield first, last, counts, hashes, starts - shift, ends - shift
        first = last


_ROLL = np.array([pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64) for j in range(64)], dtype=np.uint64)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _ROLL[j]
    return mix64(out)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of one text; fewer words make one shingle, none make none."""
    if len(words) >= k:
        return np.unique(rolling(words, k))
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return mix64(np.array([(words * _ROLL[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], dtype=np.uint64))


def set_id(distinct: np.ndarray) -> str:
    """128-bit id of a set of hashes."""
    a = int(mix64(distinct ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    b = int(mix64(distinct + np.uint64(0x1234567890ABCDEF)).sum(dtype=np.uint64))
    return f"{a:016x}{b:016x}"


def wrapped(df: DataFrame) -> DataFrame:
    """df as one struct column ``row``, so that an operator's own columns can't clash with df's names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unwrapped(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in like.columns])


def salted_left(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """left join whose left side may hold a third of its rows under one key: left rows are spread over
    salts, and each right row (unique by key) is repeated once per salt."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


