"""The registered queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import fingerprint, html_text, language, licenses, media, mixing, near_dup, packing, periodic, substring, toxicity, vector_dedup, whitening
from ledgerlane.llm.common import read_table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read_table(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read_table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licensed(licenses.document_files(read_table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(mixing.sized_documents(read_table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.linked(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.passages(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), F.col("rep_id").alias("partner_id"), F.col("rep_start").alias("partner_start"), F.col("rep_stop").alias("partner_end"),
        (F.col("stop") - F.col("start")).alias("n_words"), "identity", F.col("island_start").alias("passage_start"), F.col("island_stop").alias("passage_end"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(read_table(spark, sf_dir, "documents"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.linked(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_media, op2_fingerprint, op3_toxicity, op4_html, op5_language, op6_mixing, op7_licenses, op8_packing, op9_substring, op10_near_dup, op11_whitening, op12_periodic_runs, op13_vector_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fingerprint": fingerprint.ORACLE_SQL,
        "op10_near_dup": near_dup.ORACLE_SQL,
    }
