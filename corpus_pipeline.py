"""A training corpus from documents: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a
DataFrame; between stages ``run`` writes Parquet to the shared folder and reads it again. All stages but the last
return the columns of ``documents``; the last gives each row its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.llm import decontamination, kd_sharding, language_id, mixing, near_dedup
from routegraph.llm.common import land, small_batches, table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some learned language is told; texts without letters, and those no language claims, go."""
    small_batches(spark)
    return language_id.accepted(docs.select(DOCUMENTS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id."""
    small_batches(spark)
    return near_dedup.without_near_duplicates(docs.select(DOCUMENTS), width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    small_batches(spark)
    return decontamination.decontaminate(docs.select(DOCUMENTS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources by weights 1, 2, 3, at most three times their words."""
    return mixing.mix(docs.select(DOCUMENTS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 16 and its slot there."""
    return kd_sharding.kd_shards(docs, shards=16)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the language classifier nor the balanced draw; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = land(docs, f"stage-{k}-{name}")
    return docs


def describe(result: DataFrame) -> DataFrame:
    """Rows and bytes of each shard of a finished run."""
    return result.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
