"""Rendezvous hashing of stable record keys over weighted shards.

A shard's score for a record depends on the record's key, the shard's number and its weight alone; the record goes to
the shard with the highest score. One more shard therefore takes records only into itself, and a removed one gives up
only its own. Built-in expressions only.

Nulls, ties, edges: a null key is a key like any other; equal keys go to the same shard; equal scores go to the lower
shard; records with the same key are told apart in their slots by checksum and size. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh
from foliant.session import materialise

SHARDS = 40
ROW_BYTES = 16
#: Parts of a shard that are numbered on their own.
PARTS = 4096


def scores(key: Column, weights: Sequence[float]) -> Column:
    """An array of (score, -shard) for each shard; -w / ln(u) with u in (0, 1) makes shares proportional to weights."""
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def scored(x: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, x["shard"]), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return F.struct((x["weight"] / -F.log(u)).alias("score"), (-x["shard"]).alias("minus"))

    return F.transform(shards, scored)


def best_shard(found: Column) -> Column:
    return (-F.array_max(found)["minus"]).cast("int")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key."""
    return best_shard(scores(key, weights))


def assign(docs: DataFrame, shards: int | Sequence[float] = SHARDS, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """``docs`` with the shard of each record; nothing is moved."""
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    return docs.withColumn(into, shard_of(F.col(key), weights))


def slots(rows: DataFrame, order: Sequence[str], shard: str = "shard", key: str = "doc_id", into: str = "slot") -> DataFrame:
    """Number the records of each shard without gaps from 0.

    A shard is cut into parts by a hash of the key; records are numbered within their part and parts are offset by the
    counts before them, so no task orders a whole shard.
    """
    part, offset, p, s = fresh(rows, "slot_part", "slot_offset", "slot_p", "slot_s")
    parted = rows.withColumn(part, F.pmod(F.xxhash64(F.lit(shard), F.col(key)), F.lit(PARTS)).cast("int"))
    counts = parted.groupBy(F.col(shard).alias(s), F.col(part).alias(p)).agg(F.count(F.lit(1)).alias(offset))
    before = F.sum(offset).over(Window.partitionBy(s).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn(offset, F.coalesce(before, F.lit(0)))
    number = F.row_number().over(Window.partitionBy(shard, part).orderBy(*order)) - 1
    numbered = parted.withColumn(into, number)
    joined = numbered.join(counts, (F.col(shard) == F.col(s)) & (F.col(part) == F.col(p)))
    return joined.withColumn(into, (F.col(into) + F.col(offset)).cast("long")).drop(part, offset, p, s)


def placed(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, checksum, shard, slot, and the shard that one more shard would give, for each record."""
    weights = [1.0] * (shards + 1)
    found = scores(F.col("doc_id"), weights)
    data = F.encode(F.col(text), "UTF-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(data), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    rows = rows.withColumn("found", found)
    rows = rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), best_shard(F.slice("found", 1, shards)).alias("shard"), best_shard(F.col("found")).alias("grown_shard"))
    return slots(materialise(rows, "shards"), ["doc_id", "text_crc32", "size"])
