"""The corpus pipeline: quality, near-duplicates, benchmark copies, secrets, mixture.

``STAGES`` are functions of (spark, docs, sf_dir); each one's rows are written and read again as the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditspark.llm import decontaminate, mixture, near_dedup, preference, secrets
from auditspark.session import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go; it is fitted on the labels outside the held-out fold."""
    return preference.kept(docs, preference.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def no_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, and each secret in their texts gives way to a mark."""
    return secrets.redacted(docs, secrets.train(docs))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each with the number of copies that the mix takes of it."""
    return mixture.mixed(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", no_benchmark_copies),
    ("secret_scan", no_secrets),
    ("mixture", to_target_weights),
]

#: trained models and banded similarity have no SQL form; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
