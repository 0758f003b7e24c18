"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import materialise


#: Rounds whose joins are followed in one plan before the roots are written.
CHAINED = 4


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node that it is connected with.

    In each round a node joins its neighbour of the least seeded priority, if that is less than its own, and links are
    drawn again between what has been joined. A round leaves about half the nodes at most, whatever the shape of the
    graph. Neighbours are only ever aggregated, never gathered.
    """
    links = materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = materialise(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    seed = 0
    while not links.isEmpty():
        seed += 1
        priority = lambda c, seed=seed: F.xxhash64(F.lit(seed), F.col(c))
        ends = links.select("a", "b").union(links.select("b", "a"))
        least = ends.groupBy("a").agg(F.min(F.struct(priority("b").alias("p"), F.col("b").alias("b"))).alias("least"))
        joins = least.select(F.col("a").alias("node"), F.when(F.col("least.p") < priority("a"), F.col("least.b")).otherwise(F.col("a")).alias("to"))
        joins = materialise(joins, "joins")
        links = links.join(joins.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("c"), "b")
        links = links.join(joins.withColumnRenamed("node", "b"), "b").select(F.least("c", "to").alias("a"), F.greatest("c", "to").alias("b"))
        links = materialise(links.filter("a <> b").distinct(), "links")
        roots = roots.join(joins.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if seed % CHAINED == 0:
            roots = materialise(roots, "roots")
    names = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(names, "root").select("node", "component")
