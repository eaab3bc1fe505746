"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that `run`
writes as Parquet and reads again as the next stage's docs. All but the last
keep the columns of `documents`. A stage's decisions take effect: rejected,
duplicate and contaminated documents are gone, and a document that the mix
draws twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialgrid.llm import decontaminate, jaccard, mixing, quality, tokens
from trialgrid.session import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (operator 7) reject go."""
    return quality.kept_documents(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 8) the document with the smallest id stays."""
    return jaccard.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item (operator 3) go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (operator 4) draws them."""
    return mixing.mixed_documents(docs, seed=20)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all texts in files of directly addressable codes (operator 5), read back."""
    return tokens.token_output(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
    ("token output", token_output),
]

#: The stages hold a robust estimate by iteration, a tokenizer and a hash order: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
