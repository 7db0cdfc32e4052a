"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuspark.llm import decontaminate, mixing, near_dedup, pii, quality
from locuspark.llm.common import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail them go, boilerplate lines are cut."""
    return quality.filter_documents(docs)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: one document of each class stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go."""
    return decontaminate.drop_leaky(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span is masked."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are sampled by calibrated probabilities."""
    return mixing.sample_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_first_copies),
    ("decontaminate", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
]

#: No SQL twin: signatures, fingerprints and pattern scores have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
