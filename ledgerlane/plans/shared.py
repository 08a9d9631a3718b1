"""The shared folder of a cluster, and results that must not be computed twice."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Rows that are broadcast at most.
BROADCAST_ROWS = 100_000
#: With this setting a query's shuffled rows are deleted when it has ended, not when the driver's memory is next collected.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once per application, unless they find it by themselves
    (by PYTHONPATH, or because the driver runs in its folder)."""
    root, sc = Path(__file__).resolve().parents[2], spark.sparkContext
    found = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd()]
    if root in found or sc.applicationId in _SHIPPED:
        return
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/ledgerlane", "zip", root, "ledgerlane"))
    _SHIPPED.add(sc.applicationId)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; a query keeps those it was started with."""
    held = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only a session on this machine alone, as in tests, may
    go without that setting; it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below shared_base."""
    base = shared_base(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have few rows: a join with it then leaves the other side where it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """df as a table in the shared folder, in its order and smaller than a checkpoint, for what is read inside only: the
    table is deleted at the end."""
    spark = df.sparkSession
    path = shared_folder(spark, "scratch")
    try:
        with settings(spark, TIDY):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.parquet(path)
    finally:
        where, files = _served(spark, path)
        files.delete(where, True)


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, cut into ranges of an order, with the number of their range in ``_range``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(materialized(rows).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def _served(spark: SparkSession, path: str):
    """A path and the file system that serves it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    where, files = _served(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    where, files = _served(spark, path)
    return files.getFileStatus(where).isDirectory()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there wholly or not at all: written under another name, then renamed."""
    where, files = _served(spark, path)
    draft, _ = _served(spark, f"{where.getParent()}/_{where.getName()}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not files.rename(draft, where):
        raise OSError(f"can't rename {draft} to {where}")
