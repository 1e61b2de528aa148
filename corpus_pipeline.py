"""The corpus pipeline: language, copies, near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run`
writes every stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelsheet.llm import decontamination, exact_dedup, language, mixing, near_dedup
from voxelsheet.llm.arrow import bound_batches
from voxelsheet.session import materialize, ship_package


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those far from every language profile, go."""
    ship_package(spark)
    bound_batches(spark)
    return language.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text the one with the largest id stays."""
    ship_package(spark)
    bound_batches(spark)
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    ship_package(spark)
    bound_batches(spark)
    return near_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("mixing", mixture),
]

#: Language ID and weighted MinHash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
