"""The corpus pipeline: stages in order, each on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import cut, table
from tidemark.llm.decontaminate import keep_clean
from tidemark.llm.mixing import training_order
from tidemark.llm.near_dedup import keep_one
from tidemark.llm.quality_rules import keep_passing
from tidemark.llm.queries import POLICY
from tidemark.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return keep_passing(docs, POLICY)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8)."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return training_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with their shard and their slot in it."""
    return assign_shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Quality measurements could be put in SQL, but links of near copies and the heap cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what one gives is computed once before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
