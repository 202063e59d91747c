"""The registered queries of this subpackage: each applies its operator to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, html_text, language_model, licenses, mixing, near_dup, packing, quality, secrets, suffix_dedup
from tessella.storage import table


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_documents(table(spark, sf_dir, "documents"))
    # Sums of logarithms depend on their order in the last digits.
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find_classes(table(spark, sf_dir, "documents"))


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score_outliers(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("span_list")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_suffix_dedup, op3_token_packing, op4_secret_scan, op5_lm_score, op6_near_duplicates, op7_quality_outliers, op8_license_scan, op9_source_mixing, op10_benchmark_decontamination)}
