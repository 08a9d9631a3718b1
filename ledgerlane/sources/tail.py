"""SRC-9: a custody log as a stream, in seq order from a cursor to the head."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType


def _served(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that serves a path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def _files(files: pafs.FileSystem, where: str) -> list[str]:
    """The log's Parquet files; a file that Spark has not finished has another name or folder."""
    found = files.get_file_info(pafs.FileSelector(where, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in f.path[len(where) :].split("/")))


@dataclass
class Range(InputPartition):
    """Events with after < seq <= until."""

    after: int
    until: int


class TailReader(DataSourceStreamReader):
    """The offset is the last seq that was read. A trigger admits ``max_events`` events at most: the files'
    statistics say where seqs lie, so only the row groups that hold the next ones are looked at."""

    def __init__(self, path: str, seq: str, after: int, max_events: int, parts: int, schema: StructType) -> None:
        self.path, self.seq, self.after, self.max_events, self.parts = path, seq, after, max_events, parts
        self.schema = to_arrow_schema(schema)
        self.at: int | None = None
        self.groups: dict[str, list[tuple[int, int, int]]] = {}

    def initialOffset(self) -> dict:  # noqa: N802 (the API's names)
        return {"seq": self.after}

    def _known(self, files: pafs.FileSystem, where: str) -> list[tuple[int, int, str, int]]:
        """(lowest seq, highest seq, file, row group) of the log as it is now; files don't change once written."""
        for path in _files(files, where):
            if path not in self.groups:
                meta = pq.read_metadata(path, filesystem=files)
                leaf = next(j for j in range(meta.num_columns) if meta.schema.column(j).path == self.seq)
                stats = [meta.row_group(i).column(leaf).statistics for i in range(meta.num_row_groups)]
                self.groups[path] = [(s.min, s.max, i) for i, s in enumerate(stats) if s is not None and s.has_min_max]
        return sorted((low, high, path, i) for path, groups in self.groups.items() for low, high, i in groups)

    def admitted(self, start: int) -> int:
        """The seq up to which the next trigger reads: the max_events-th after start, or the head."""
        files, where = _served(self.path)
        ahead = [g for g in self._known(files, where) if g[1] > start]
        next_ones = np.zeros(0, dtype=np.int64)
        for low, _, path, i in ahead:
            if len(next_ones) == self.max_events and low > next_ones[-1]:
                break
            seqs = np.asarray(pq.ParquetFile(path, filesystem=files).read_row_group(i, columns=[self.seq], use_threads=False).column(0))
            next_ones = np.sort(np.concatenate([next_ones, seqs[seqs > start]]))[: self.max_events]
        return int(next_ones[-1]) if len(next_ones) else start

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = self.admitted(self.after if self.at is None else self.at)
        return {"seq": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["seq"], end["seq"]
        self.at = max(high, self.at or high)
        if high <= low:
            return []
        edges = np.unique(np.linspace(low, high, min(self.parts, high - low) + 1).astype(np.int64)).tolist()
        return [Range(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def commit(self, end: dict) -> None:
        # a restarted query tells where it was before it asks for the latest offset
        self.at = max(end["seq"], self.at if self.at is not None else end["seq"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, where = _served(self.path)
        inside = (ds.field(self.seq) > partition.after) & (ds.field(self.seq) <= partition.until)
        table = ds.dataset(_files(files, where), filesystem=files, format="parquet").to_table(columns=self.schema.names, filter=inside, use_threads=False)
        # instants of Spark's files have other units than its rows
        yield from table.sort_by(self.seq).cast(self.schema, safe=False).combine_chunks().to_batches()


class CustodyTail(DataSource):
    """Options: path (of one stream's log), seq (column), after (cursor), max_events (of a trigger), partitions."""

    @classmethod
    def name(cls) -> str:
        return "custody_tail"

    def schema(self) -> StructType:
        files, where = _served(self.options["path"])
        found = _files(files, where)
        if not found:
            raise ValueError(f"no log at {self.options['path']}; give its schema")
        return from_arrow_schema(pq.read_schema(found[0], filesystem=files))

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        o = self.options
        return TailReader(o["path"], o.get("seq", "seq"), int(o.get("after", "0")), int(o.get("max_events", "100000")), int(o.get("partitions", "8")), schema)


def custody_tail(spark: SparkSession, path: str, after: int = 0, max_events: int = 100_000, seq: str = "seq", schema: StructType | None = None, partitions: int = 8) -> DataFrame:
    """SRC-9: events of a stream's log with seq > after, up to the head and on with it; a trigger brings max_events
    at most, in seq order from one trigger to the next. A restarted query goes on behind what it has committed."""
    # Spark plans a Python source in a process of its own, which doesn't see files that were added to the session
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CustodyTail)
    reader = spark.readStream.format("custody_tail").option("path", path).option("after", after).option("max_events", max_events).option("seq", seq).option("partitions", partitions)
    return (reader.schema(schema) if schema is not None else reader).load()
