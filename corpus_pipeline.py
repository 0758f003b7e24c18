"""From documents to shards: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the documents
of the next one. All but the last keep the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, mixing, near_documents, quality, sharding
from foliant.llm.common import fresh, prepared, table
from foliant.session import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the labels, does not reject."""
    prepared(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepared(spark)
    return near_documents.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item."""
    prepared(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, and the one they would have if there were one shard more."""
    prepared(spark)
    shard, grown = fresh(docs, "shard", "grown_shard")
    both = sharding.assign(docs, into=shard)
    return sharding.assign(both, sharding.SHARDS + 1, into=grown)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: A fitted classifier, sampling by hash and rendezvous scores are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
