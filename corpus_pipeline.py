"""A training corpus from ``documents``: rules, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the
columns of ``docs``; the last one returns the place of every row in the shards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import decontaminate, dedup, mixing, quality, sharding
from groundwork.llm.common import stage
from groundwork.session import ship


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(fn: Stage) -> Stage:
    """The stage, after the package has been sent to the workers."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@_shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the bounds of their language and source."""
    return quality.keep(docs)


@_shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return dedup.keep(docs)


@_shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any passage of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_shipped
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it: not at all, or up to three times."""
    return mixing.repeat(docs)


@_shipped
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, with its language and source."""
    return sharding.interleave(docs, carry=("lang", "source", "n_chars"))


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixture", mixture), ("shards", shards),
]
#: The thresholds and the subset-sum table can't be written in SQL; a test rebuilds the result in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
