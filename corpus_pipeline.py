"""A training-corpus pipeline over ``documents``: toxic texts go, one of each group of near copies stays,
repeated passages are cut, sources are mixed to their weights, and the result is packed into sequences.

Each stage reads what the one before it kept. All but the last return the columns of ``documents``.

Defined results: null and empty texts are clean, are nobody's copy, hold no passage, count no words and are
not taken by the mix; rows without an id go through all stages; of equal rows one stays; a null source is a
source of its own; without labels nothing is toxic; further columns pass through; an empty table gives no
pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlane.llm import mixing, near_dup, packing, substring, toxicity
from ledgerlane.llm.common import cut_lineage, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_passages(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("substring", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages draw at random, tokenize and fit models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is cut from its lineage in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
