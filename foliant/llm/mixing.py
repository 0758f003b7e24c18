"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source is to hold a share of the mix in proportion to its weight, but no source is repeated more than a maximum
number of times. Sources whose share would need more are clamped at that maximum and the excess goes to the others by
weight, until none is above its maximum. A source then gives all its documents ``floor(target / size)`` times, and a
seeded selection of them once more, whose sizes add up to what is left.

Nulls, ties, edges: a null source is a source and comes last; a null or blank text has size 0 and is never taken for
its own sake; rows with the same source and key are one unit, taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh
from foliant.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20
#: Units of a source that are put in order by one task.
CHUNK = 2_000


def n_words(text: Column) -> Column:
    """The number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, share: float = 1.0, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows of (source, source_size, weight): weight times a common level, clamped at the maximum.

    The level rises as sources are clamped. Each round is one sum over the sources; the driver sees two numbers.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, None
    while level != before:
        clamped = F.col("weight") * F.lit(level) > cap
        caps, weights = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not weights:
            break
        before, level = level, max(level, (total - (caps or 0.0)) / weights)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def weighted_sources(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row per source with its size and its weight; weights repeat in code point order of the sources, null last.

    The order is a window over one row per source, not per document.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.countDistinct("doc_id").alias("units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    return sources.withColumn("weight", picked)


def _order(key: Column, chunks: Column, seed: int) -> list[Column]:
    hashed = F.xxhash64(F.lit(seed), key)
    return [F.pmod(hashed, chunks), hashed]


class Plan(NamedTuple):
    """How often each document of a source is taken: ``whole`` times, and once more if its place in the seeded order is at
    most ``cut``, or if it is one of ``picks`` (source, doc_id), which are worth less than one document of each source."""

    sources: DataFrame
    picks: DataFrame


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> Plan:
    """What the mix takes of the documents (doc_id, source, size)."""
    sources = materialise(weighted_sources(sizes, weights), "sources")
    filled = water_fill(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("units") / CHUNK)).cast("long")
    filled = materialise(
        filled.withColumn("whole", whole).withColumn("chunks", chunks).withColumn("lack", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))),
        "targets",
    )
    units = sizes.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    placed = units.join(filled.select(F.col("source").alias("s"), "chunks", "lack"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chunk, hashed = _order(F.col("doc_id"), F.col("chunks"), seed)
    placed = materialise(placed.select("source", "doc_id", "size", "lack", chunk.alias("chunk"), hashed.alias("hashed")), "units")
    sums = placed.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = F.sum("chunk_size").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(before, F.lit(0)).alias("before"))
    running = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("hashed", "doc_id"))
    ordered = placed.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).drop("s", "c")
    ordered = materialise(ordered.withColumn("first", F.col("before") + running <= F.col("lack")), "ordered")
    place = F.struct("chunk", "hashed", "doc_id")
    cuts = ordered.filter("first").groupBy("source").agg(F.max(place).alias("cut"), F.sum("size").alias("got"))
    decided = filled.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    room = decided.select("source", (F.col("lack") - F.coalesce("got", F.lit(0))).alias("room"))
    rest = ordered.filter(~F.col("first") & (F.col("size") > 0)).select("source", "doc_id", "size", "chunk", "hashed")
    return Plan(decided.select("source", "source_size", "target", "whole", "chunks", "cut"), _picked(rest, room))


def _picked(rest: DataFrame, room: DataFrame) -> DataFrame:
    """(source, doc_id): units that fill the room of their sources, round by round.

    In a round the units that fit are taken in order as long as their sum does. Only the chunks that the sum reaches are
    put in order.
    """
    place = F.struct("chunk", "hashed", "doc_id")
    picks = None
    while True:
        given = room.withColumnRenamed("source", "s")
        rest = materialise(rest.join(given, F.col("source").eqNullSafe(F.col("s"))).filter("size <= room").drop("s"), "rest")
        if rest.isEmpty():
            break
        sums = rest.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), before.alias("before"))
        reached = rest.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).filter("before < room").drop("s", "c")
        running = F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("hashed", "doc_id"))
        taken = materialise(reached.withColumn("running", F.col("before") + running).filter("running <= room"), "taken")
        picks = taken.select("source", "doc_id") if picks is None else picks.unionByName(taken.select("source", "doc_id"))
        got = taken.groupBy("source").agg(F.max(place).alias("cut"), (F.max("room") - F.sum("size")).alias("left"))
        got = materialise(got, "got")
        # a source that took nothing has nothing that fits
        room = got.select("source", F.col("left").alias("room"))
        ends = got.select(F.col("source").alias("s"), "cut")
        rest = rest.drop("room").join(ends, F.col("source").eqNullSafe(F.col("s"))).filter(place > F.col("cut")).drop("s", "cut")
    return rest.select("source", "doc_id") if picks is None else picks


def copies(docs: DataFrame, decided: Plan, seed: int = SEED, key: str = "doc_id", source: str = "source", into: str = "copies", keep=()) -> DataFrame:
    """``docs`` with the number of times the mix takes each document, and the columns ``keep`` of the plan."""
    names = fresh(docs, "mix_source", "mix_whole", "mix_chunks", "mix_cut", "mix_picked_source", "mix_picked", "mix_pick")
    s, whole, chunks, cut, of, picked, pick = names
    plan_columns = ["source", "whole", "chunks", "cut"]
    right = decided.sources.select(*[F.col(a).alias(b) for a, b in zip(plan_columns, names[:4], strict=True)], *keep)
    picks = decided.picks.select(F.col("source").alias(of), F.col("doc_id").alias(picked), F.lit(1).alias(pick))
    chunk, hashed = _order(F.col(key), F.col(chunks), seed)
    place = F.struct(chunk.alias("chunk"), hashed.alias("hashed"), F.col(key).alias("doc_id"))
    more = F.coalesce(place <= F.col(cut), F.lit(False)) | F.col(pick).isNotNull()
    out = docs.join(right, F.col(source).eqNullSafe(F.col(s)), "left").join(picks, F.col(source).eqNullSafe(F.col(of)) & F.col(key).eqNullSafe(F.col(picked)), "left")
    return out.withColumn(into, (F.col(whole) + more.cast("long")).cast("long")).drop(*names)


def measured(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Key, source and size of each document, read once and written narrow."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    return materialise(narrow, "sizes")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    (n,) = fresh(docs, "mix_copies")
    taken = copies(docs, plan(measured(docs), weights, 1.0, max_epochs, seed), seed, into=n)
    return taken.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n).cast("int")))).drop(n).select(*docs.columns)
