"""The training-data pipeline: stages applied to ``documents`` one after another.

Each stage takes the documents that its predecessor kept. All but the last return the columns of
``documents``; the last returns the packed pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rebuy.llm import decontamination, exact_dedup, near_join, quality
from rebuy.llm.common import table
from rebuy.llm.queries import packed_documents, quality_model
from rebuy.session import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of 0.3 or more)."""
    model = quality_model(spark, sf_dir, docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    return quality.score(docs, model, "text", [whole]).filter("score >= 0.3").select("__doc.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    return near_join.near_deduplicate(docs)


def benchmark_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their sequences."""
    return packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_contamination),
    ("best_fit_packing", packing),
]

# The classifier's fit, MinHash candidates and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
