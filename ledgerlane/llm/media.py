"""Media columns: lossless PNG images in binary columns and perceptual hashes of their samples.

``write_images`` turns a binary payload column into PNG files (8-bit grey, 64 samples a row), and
``read_images`` parses PNG files of any 8-bit grey, grey-alpha, RGB or RGBA form: it checks every
chunk's CRC-32 and the zlib Adler-32, undoes the five row filters with numpy and hashes the
low-frequency cosine coefficients of the picture.

Defined results: a null payload is treated as empty; an empty payload has a null image unless padded
by the caller; a damaged image yields null samples and a reason in ``media_error``; equal payloads give
equal images and hashes; further columns pass through untouched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import map_texts

#: Samples in a row of the images that are written.
WIDTH = 64
#: Fixed by the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Image bytes in one IDAT chunk.
CHUNK = 1 << 16
#: Row filters that are undone for many rows at once, and all that PNG has.
FAST, ALL_FILTERS = (0, 1, 2), (0, 1, 2, 3, 4)
#: Side of the grid the picture is averaged to, and of the block of coefficients that is kept.
GRID, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, up and corner the one nearest to left + up - corner; of equals the first."""
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filter_rows(rows: np.ndarray, filters: tuple[int, ...] = FAST, step: int = 1) -> np.ndarray:
    """Rows with the filter byte in front: for each row the one of ``filters`` (0 None, 1 Sub, 2 Up, 3 Average,
    4 Paeth) whose bytes are the smallest as signed numbers, the first of equals."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, step:], up[1:], corner[1:, step:] = rows[:, :-step], rows[:-1], rows[:-1, :-step]
    tried = []
    for kind in filters:
        if kind < 3:
            tried.append(rows - (0, left, up)[kind])
        else:
            wide = [x.astype(np.int32) for x in (left, up, corner)]
            tried.append(rows - ((wide[0] + wide[1]) // 2 if kind == 3 else _paeth(*wide)).astype(np.uint8))
    cost = np.stack([np.minimum(x, (0 - x).astype(np.uint8)).sum(axis=1, dtype=np.int64) for x in tried])
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), dtype=np.uint8)
    out[:, 0] = np.array(filters, dtype=np.uint8)[best]
    for i, x in enumerate(tried):
        out[best == i, 1:] = x[best == i]
    return out


def to_png(payload: bytes, width: int = WIDTH, level: int = 1, adaptive: bool = True, filters: tuple[int, ...] = FAST) -> bytes:
    """An 8-bit grey PNG whose samples are the payload; its length must be a multiple of width. Rows are
    unfiltered, or (adaptive) filtered by one of ``filters``."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    packed = zlib.compress(filter_rows(rows, filters if adaptive else (0,)).tobytes(), level)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo row filters in place. Runs of rows with None, Sub or Up are undone together; rows with Average
    and Paeth depend on three neighbours and go by diagonals, on which no sample depends on another."""
    n, width = rows.shape
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    same = np.minimum(kinds, 3)
    edges = np.flatnonzero(np.diff(same)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
        kind = int(same[a]) if n else 0
        if kind == 1:
            block = rows[a:b].reshape(b - a, width // step, step)
            rows[a:b] = np.cumsum(block, axis=1, dtype=np.uint8).reshape(b - a, width)
        elif kind == 2:
            if a:
                rows[a] += rows[a - 1]
            rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
        elif kind == 3:
            m, columns = b - a, width // step
            coded = rows[a:b].reshape(m, columns, step)
            done = np.zeros((m + 1, columns + 1, step), dtype=np.int32)  # with the row above and a column of 0
            if a:
                done[0, 1:] = rows[a - 1].reshape(columns, step)
            for diagonal in range(m + columns - 1):
                r = np.arange(max(0, diagonal - columns + 1), min(m, diagonal + 1))
                x = diagonal - r
                left, up, corner = done[r + 1, x], done[r, x + 1], done[r, x]
                guess = np.where(kinds[a + r][:, None] == 3, (left + up) // 2, _paeth(left, up, corner))
                done[r + 1, x + 1] = (coded[r, x] + guess) & 255
            rows[a:b] = done[1:, 1:].reshape(m, width)
    return rows


def from_png(image: bytes) -> np.ndarray:
    """Samples of a PNG as (rows, bytes of a row); ValueError if any part of it is damaged."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(image):
        if at + 12 > len(image):
            raise ValueError("chunk is cut off")
        size = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", image[at + 8 + size : at + 12 + size] or b"\0" * 4)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if header is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit images without palette or interlacing are read")
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))  # tests the Adler-32 too
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != height * (width * step + 1):
        raise ValueError("wrong number of samples")
    table = np.frombuffer(raw, dtype=np.uint8).reshape(height, width * step + 1)
    return unfilter(table[:, 0], table[:, 1:].copy(), step)


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_DCT = _cosines(GRID)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the picture, averaged to a 32 x 32
    grid, exceed their median. The constant coefficient counts as 0."""
    height, width = samples.shape
    table = np.zeros((height + 1, width + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    ys, xs = (np.arange(GRID) * height // GRID), (np.arange(GRID) * width // GRID)
    ye = np.maximum(ys + 1, (np.arange(1, GRID + 1) * height + GRID - 1) // GRID).clip(max=height)
    xe = np.maximum(xs + 1, (np.arange(1, GRID + 1) * width + GRID - 1) // GRID).clip(max=width)
    area = (ye - ys)[:, None] * (xe - xs)[None, :]
    grid = (table[ye][:, xe] - table[ys][:, xe] - table[ye][:, xs] + table[ys][:, xs]) / area
    low = (_DCT @ grid @ _DCT.T).round(6)
    low[0, 0] = 0.0
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def write_images(df: DataFrame, payload: str = "payload", image: str = "media", width: int = WIDTH, filters: tuple[int, ...] = FAST) -> DataFrame:
    """df with a PNG column beside its other columns; payload lengths must be multiples of width."""
    out = df.withColumn(image, F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names = batch.schema.get_field_index(payload), batch.schema.names
            made = [to_png(x, width, filters=filters) if (x := v.as_py()) else None for v in batch.column(at)]
            columns = [pa.array(made, pa.binary()) if n == image else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(out, run, out.schema)


READ_FIELDS = "media_width int, media_height int, samples binary, feature string, media_error string"


def read_image(image: bytes | None) -> tuple:
    """(width, height, samples, cosine hash, error) of one image."""
    if image is None:
        return None, None, None, None, "no image"
    try:
        samples = from_png(image)
    except ValueError as e:
        return None, None, None, None, str(e)
    if not samples.size:
        return samples.shape[1], samples.shape[0], b"", "0" * 16, None
    return samples.shape[1], samples.shape[0], samples.tobytes(), cosine_hash(samples), None


def read_images(df: DataFrame, image: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Kept columns of df beside the decoded ones of READ_FIELDS."""
    keep = [c for c in df.columns if c != image] if keep is None else keep
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(keep).schema) + (", " if keep else "") + READ_FIELDS
    types = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_image(v.as_py()) for v in batch.column(batch.schema.get_field_index(image))]
            more = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + more
            yield pa.RecordBatch.from_arrays(columns, keep + [x.split()[0] for x in READ_FIELDS.split(", ")])

    return map_texts(df, run, schema)


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of unit."""
    return data + b"\0" * (-len(data) % unit or (0 if data else unit))


def padded(payload: Column, unit: int = WIDTH) -> Column:
    """pad for a binary column."""
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / unit)).cast("int") * unit
    return F.rpad(payload, size, F.lit(b"\0"))


def text_media(docs: DataFrame) -> DataFrame:
    """Texts of documents as images in a binary column, and digests of what is read back from that column.

    Without a shuffle; a task holds one Arrow batch of payloads or images. An image that can't be read raises."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), padded(text).alias("payload"))
    stored = write_images(rows.withColumn("media", F.lit(None).cast("binary"))).select("doc_id", "n_bytes", "media")
    read = read_images(stored, keep=["doc_id", "n_bytes", "media"])
    samples = F.when(F.col("media_error").isNull(), F.col("samples")).otherwise(F.raise_error(F.concat(F.lit("stored image can't be read: "), "media_error")).cast("binary"))
    return read.withColumn("samples", samples).select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "media_width", "media_height",
    )
