"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing to target weights, sharding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborflow.llm.decontaminate import leaks
from arborflow.llm.mixing import mixed
from arborflow.llm.near_copies import near_copies
from arborflow.llm.quality_rules import quality_rules
from arborflow.llm.sharding import sharded
from arborflow.llm.tables import saved

N_SHARDS = 24


def _rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined to found by doc_id, null like any value; columns of any name pass through."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("a"))
    return rows.join(found.select(F.col("doc_id").alias("b")).distinct(), F.expr("a <=> b"), how).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five-word shingles, a similarity of 0.8."""
    return _rows(docs, near_copies(docs, shingle=5, similarity=0.8).where("doc_id <=> component_id"), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return _rows(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the mix takes, in the order of its slots."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with their shard and slot."""
    return sharded(docs, N_SHARDS)


STAGES = [("quality", keep_quality), ("simhash", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources), ("shard", shard)]

#: The learned rules and the shuffle have no SQL twin; a test holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
