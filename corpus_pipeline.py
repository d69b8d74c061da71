"""From raw documents to a training mixture: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import cotrain, decontaminate, mixing, secrets
from rankloom.llm.ngram_join import jaccard_components
from rankloom.llm.shared import keep, maybe_broadcast


ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, a hash of all its columns: rows without an id or with the same one are told apart, equal rows are not."""
    return docs.withColumn(ROW, F.xxhash64(*(F.col(c) for c in docs.columns)))


def _without(rows: DataFrame, out: DataFrame) -> DataFrame:
    """The rows whose number is not in `out`."""
    return rows.join(maybe_broadcast(keep(out.select(ROW).distinct(), "out"), 8), ROW, "left_anti").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Each row is judged by itself: a null text as an empty one, null columns as values of their own; rows that share an id share its
    label. Without labels of both kinds all rows stay. An empty table gives no rows."""
    return cotrain.accepted(docs, cotrain.acceptable(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at 0.8 over five-word shingles, that with the least id.

    Rows without an id come last in their group, and so do of rows with the same id those with a greater hash; of rows that are equal in all
    columns one stays. Rows without words link with nothing and all stay."""
    rows = _numbered(docs)
    groups = keep(jaccard_components(rows, ROW, width=5, num=4, den=5).where("n_shingles > 0"), "groups")
    # the rows of groups of several only; their texts are not read
    many = keep(groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"), "many")
    member = groups.join(many, "component_id").select(F.col("component_id").alias("grp"), ROW)
    member = member.join(rows.select(ROW, "doc_id"), ROW).select("grp", ROW, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("order"))
    first = keep(member.groupBy("grp").agg(F.min("order").alias("first")), "first")
    out = member.join(first, "grp").where(f"{ROW} <> first.{ROW}")
    twice = keep(groups.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1").select(ROW), "twice")
    kept = rows.join(maybe_broadcast(keep(out.select(ROW).distinct(), "out"), 8), ROW, "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    twice = maybe_broadcast(twice, 8)
    return kept.join(twice, ROW, "left_anti").union(kept.join(twice, ROW, "left_semi").dropDuplicates([ROW])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Rows are judged one by one, so of rows that share an id only those go that hold an item. A null text is clean, an empty benchmark removes nothing."""
    rows = _numbered(docs)
    return _without(rows, decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text. A null text stays null and keeps its n_chars."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of each document at tempered source weights.

    Rows without a word take no part, a null source is a source of its own, rows that share an id are dealt alike."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mixture),
]

#: The classifier and the decontamination have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
