"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mix, token ids.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and is the next stage's docs.
Stages that hand whole texts to Python bound the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm.decontamination import without_leaks
from tidebook.llm.mixing import mixed
from tidebook.llm.near_dedup import drop_duplicates
from tidebook.llm.quality import keep_good
from tidebook.llm.shared import bound_batches, materialize
from tidebook.llm.token_output import read_shards, write_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    bound_batches(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, 80 % similarity."""
    bound_batches(spark)
    return drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaked benchmark items."""
    bound_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that it takes twice is two rows."""
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in shards, read back."""
    bound_batches(spark)
    return read_shards(write_shards(docs))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: The stages are no SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
