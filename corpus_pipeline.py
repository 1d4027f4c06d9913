"""From raw documents to shards: toxicity, near duplicates, benchmark leaks, mixture, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonewise.llm import decontaminate, jaccard, mixing, sharding, toxicity
from zonewise.session import pin, release

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.7."""
    return toxicity.reject_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component under a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.keep_one(docs, 5, 80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch within the edit bound of a benchmark item."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def order_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place on the Hilbert curve, shard and slot."""
    return sharding.hilbert_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_copies),
    ("decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("sharding", order_shards),
]
#: No SQL scores a text with a learnt machine; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = pin(made)
        release(made)  # the stage before and what this one wrote on the way
    return STAGES[-1][1](spark, docs, sf_dir)
