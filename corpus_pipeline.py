"""Cleaning a corpus in stages; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysafe.llm import decontam, exact, ngram_join, packing, quality
from polysafe.llm.common import read, stored


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids`` (column ``doc_id``), all columns as they were."""
    return docs.join(ids.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def trusted_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language."""
    return _only(docs, quality.judge(docs, read(spark, sf_dir, "labels")).where("kept"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar shingle sets (five words, four fifths shared), that of the least id."""
    groups = ngram_join.similar_components(docs, percent=80, shingle=5)
    return _only(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_passages(docs, read(spark, sf_dir, "benchmark"))


def token_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in full token windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", trusted_language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("packing", token_windows),
]

#: SQL cannot express the language model, the alignments or the packing; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
