"""The queries of this folder: each applies one operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotrain, decontaminate, html_text, lm_score, mixing, quality, secrets, substrings, warc
from .ngram_join import jaccard_components
from .oracles import oracle_sql  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 100 * overlap >= 90 * union over 3-word shingles of every document."""
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of every document; the host is its source."""
    return quality.quality_rules(_table(spark, sf_dir, "documents")).drop("clean_text")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document, with its nearest stretch."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lm_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target are the acceptable labelled ones."""
    good = cotrain.acceptable(_table(spark, sf_dir, "labels")).where("good").select("doc_id")
    return lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under no 35-word window that repeats."""
    out = substrings.remove_repeated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    base = warc.archive_dir(spark)
    warc.write(_table(spark, sf_dir, "pages"), base)
    return warc.read(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and verdict of every document."""
    return cotrain.classify(_table(spark, sf_dir, "documents"), cotrain.acceptable(_table(spark, sf_dir, "labels")))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the documents of every source at tempered weights, over a budget of all their tokens."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
