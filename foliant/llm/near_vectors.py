"""Exact range join of vectors by cosine, within equal labels, on partitions by pivots.

On unit vectors the cosine bound is a Euclidean radius r. A cell of vectors is split by pivots: each vector has its home
with its nearest pivot, and visits the cell of pivot q when a vector at home there can lie within r of it. By the
triangle inequality that needs d(x,q) <= d(x,p) + 2r for its nearest pivot p, and, as the vectors at home are nearer to
q than to any p, also (d(x,q)^2 - d(x,p)^2) / 2d(p,q) <= r for all p. Cells are then joined on their own: vectors at
home with vectors at home and visitors. A pair is seen from the home of either vector, so links are counted once each.

Cells that are still large are split again. A sample of a cell tells how many cells its vectors would visit; where that
is more than ``MOST_VISITS``, splitting saves nothing (as with vectors without clusters in many dimensions) and the cell
is compared as it is. All cells are compared in blocks of bounded size, so no task holds a cell.

Equal vectors are one vector with a number of copies. A block gives link counts and, of its links, only what connects
their ends, so that a dense group costs no row per pair.

Nulls, ties, edges: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label, link with nothing; so do vectors of different lengths. Rows with the same id are vectors of their own. A vector
without an id takes part, and has a null component if no vector with an id is reached.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table
from foliant.llm.components import components
from foliant.session import materialise

LEAST_COSINE = 0.98
#: Vectors at home in a cell that is not split further, and vectors on a side of a block.
CELL, BLOCK = 4_000, 2_000
PIVOTS = 32
LEVELS = 3
MOST_VISITS = 4.0
#: One of so many vectors tells how often a cell's vectors visit other cells.
SAMPLED = 16
SLACK = 1e-9

ROWS = "cell long, gid long, copies long, home boolean, vector array<double>"


def _matrix(rows: pa.Table, column: str = "vector") -> np.ndarray:
    """The vectors of the rows; all of a cell have the same length."""
    if not rows.num_rows:
        return np.zeros((0, 0))
    flat = pa.concat_arrays([c.flatten() for c in rows.column(column).chunks])
    return flat.to_numpy().reshape(rows.num_rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _split(radius: float):
    def run(key: tuple, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        """The home and the visits of each row of a part of a cell."""
        x, p = _unit(_matrix(rows)), _unit(_matrix(pivots, "pivot"))
        if not len(x) or not len(p):
            return pa.Table.from_batches([], pa.schema([("number", pa.int32()), ("cell", pa.int64()), ("gid", pa.int64()), ("copies", pa.int64()), ("home", pa.bool_()), ("vector", pa.list_(pa.float64()))]))
        d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
        between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        near = d <= d.min(1, keepdims=True) + 2 * radius + SLACK
        for q in range(len(p)):
            apart = between[:, q] > 1e-6
            edge = (d[:, q : q + 1] ** 2 - d[:, apart] ** 2) / (2 * between[apart, q])
            near[:, q] &= edge.max(1, initial=-np.inf) <= radius + SLACK
        home = d.argmin(1)
        at_home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
        near[np.arange(len(x))[at_home], home[at_home]] = True
        i, q = np.nonzero(near)
        out = rows.take(pa.array(i))
        return pa.table([pa.array(q, pa.int32()), out.column("cell"), out.column("gid"), out.column("copies"), pa.array(at_home[i] & (home[i] == q)), out.column("vector")], names=["number", "cell", "gid", "copies", "home", "vector"])

    return run


def _parts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Deal the rows of each cell into parts of about a block."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    return rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("gid")), parts).cast("int"))


def split_cells(rows: DataFrame, radius: float, cell_rows: int = CELL, pivots: int = PIVOTS) -> DataFrame:
    """Split the large cells once, where that keeps vectors from visiting many others."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("at_home"))
    large = materialise(sizes.filter(F.col("at_home") > cell_rows).select("cell", "n"), "large")
    if large.isEmpty():
        return rows
    marked = rows.join(large, "cell", "left")
    rest, inside = marked.filter("n is null").drop("n"), marked.filter("n is not null").drop("n")
    # pivots: vectors at home with the least hashes, found by a threshold that leaves a few times as many
    hashed = F.pmod(F.xxhash64(F.lit("pivot"), F.col("gid")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = inside.filter("home").join(large, "cell").filter(hashed < F.lit(4.0 * pivots) / F.col("n"))
    lists = chosen.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct(hashed.alias("h"), "vector"))), 1, pivots).alias("chosen"))
    lists = materialise(lists.select("cell", F.explode("chosen.vector").alias("pivot")), "pivots")

    def run(some: DataFrame, sizes: DataFrame) -> DataFrame:
        dealt = _parts(some, sizes)
        count = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
        for_parts = lists.join(sizes, "cell").select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("for"), "pivot")
        pairs = dealt.groupBy("cell", "part").cogroup(for_parts.groupBy("of", "for"))
        return pairs.applyInArrow(_split(radius), f"number int, {ROWS}")

    tried = inside.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("gid")), F.lit(SAMPLED)) == 0)
    visits = run(tried, large.withColumn("n", F.ceil(F.col("n") / SAMPLED))).groupBy("cell").agg(F.count(F.lit(1)).alias("visits"), F.countDistinct("gid").alias("rows"))
    worth = materialise(visits.filter(F.col("visits") <= F.col("rows") * MOST_VISITS).select("cell").join(large, "cell"), "worth")
    if worth.isEmpty():
        return rows
    kept = inside.join(worth.select("cell"), "cell", "left_anti")
    split = run(inside.join(worth.select("cell"), "cell", "left_semi"), worth)
    split = split.withColumn("cell", F.xxhash64("cell", "number")).drop("number")
    return materialise(rest.unionByName(kept).unionByName(split), "cells")


def _compared(least: float):
    kinds = pa.schema([("gid", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def run(key: tuple, home: pa.Table, others: pa.Table) -> pa.Table:
        """Link counts of the vectors at home, and for both sides a vector that they are connected with in this block."""
        x, y = _unit(_matrix(home)), _unit(_matrix(others, "other_vector"))
        if not len(x) or not len(y):
            return kinds.empty_table()
        a, b = home.column("gid").to_numpy(), others.column("other").to_numpy()
        linked = (x @ y.T >= least) & (a[:, None] != b)
        counts = linked @ others.column("other_copies").to_numpy()
        i, j = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(i):
            return kinds.empty_table()
        sub, top = linked[np.ix_(i, j)], np.iinfo(np.int64).max
        left, right = a[i].copy(), b[j].copy()
        while True:
            new_right = np.minimum(right, np.where(sub, left[:, None], top).min(0))
            new_left = np.minimum(left, np.where(sub, new_right, top).min(1))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        gid, n, other = np.concatenate([a[i], b[j]]), np.concatenate([counts[i], np.zeros(len(j), np.int64)]), np.concatenate([left, right])
        return pa.table([pa.array(gid), pa.array(n), pa.array(other)], schema=kinds)

    return run


def joined_cells(rows: DataFrame, least: float) -> DataFrame:
    """(gid, n, other) of all cells, compared in blocks."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("at_home"))
    sizes = sizes.filter("at_home > 0").select("cell", F.ceil(F.col("at_home") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("n") / BLOCK).cast("int").alias("columns"))
    sized = rows.join(sizes, "cell")
    number = lambda name, of: F.pmod(F.xxhash64(F.lit(name), F.col("gid")), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    home = sized.filter("home").select("cell", number("row", "rows").alias("i"), every("columns").alias("j"), "gid", "vector")
    others = sized.select(F.col("cell").alias("c"), every("rows").alias("k"), number("column", "columns").alias("l"), F.col("gid").alias("other"), F.col("copies").alias("other_copies"), F.col("vector").alias("other_vector"))
    return home.groupBy("cell", "i", "j").cogroup(others.groupBy("c", "k", "l")).applyInArrow(_compared(least), "gid long, n long, other long")


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked(vectors: DataFrame, least: float = LEAST_COSINE, cell_rows: int = CELL, pivots: int = PIVOTS, levels: int = LEVELS) -> DataFrame:
    """Link count, component and keeper of each row of (vec_id, embedding, label)."""
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    usable = F.col("label").isNotNull() & _usable(F.col("vector"))
    keyed = rows.withColumn("k1", F.when(usable, F.xxhash64("vector"))).withColumn("k2", F.when(usable, F.xxhash64(F.lit(1), F.col("vector"))))
    same = ["label", "k1", "k2"]
    groups = keyed.filter("k1 is not null").groupBy(*same).agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    groups = materialise(groups.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    cells = groups.select(F.xxhash64("label", F.size("vector")).alias("cell"), "gid", "copies", F.lit(True).alias("home"), "vector")
    for _ in range(levels):
        split = split_cells(cells, radius, cell_rows, pivots)
        if split is cells:
            break
        cells = split
    found = materialise(joined_cells(cells, least), "compared")
    counts = found.groupBy("gid").agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("gid").alias("a"), F.col("other").alias("b")))
    whole = groups.drop("vector").join(counts, "gid", "left").join(named.withColumnRenamed("node", "gid"), "gid", "left")
    whole = materialise(whole.withColumn("component", F.coalesce("component", "gid")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1), "groups")
    ids = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    members = whole.join(ids, "component").select(*same, "n_links", "component_id")
    out = keyed.drop("vector").join(members, same, "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return linked(table(spark, folder, "embeddings"))
