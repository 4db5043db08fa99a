"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _minima(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Least of a node and its neighbours.  Written first, so that a node with very many edges meets it in a
    plain join, whose large side Spark can split."""
    return stored(edges.groupBy(node).agg(F.min(other).alias("_m")).select(node, F.least(node, "_m").alias("least")))


def _sum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); the component is its least node.

    Alternating large-star and small-star steps: each hangs a node's neighbours onto the least of them, until
    every component is one star.  No component is gathered in one task.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _sum(e)
    while before[0]:
        both = stored(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = _minima(both, "a", "b")
        large = stored(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())
        least = _minima(large, "a", "b")
        joined = large.join(least, "a")
        small = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        e = stored(small.union(least.select("a", F.col("least").alias("b"))).distinct())
        after = _sum(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, component) for every node of a forest, given as one row (a, b) per node b with a lesser parent a.

    Every node asks its parent for that one's parent until all point at a root, so the rounds are the logarithm of the
    depth; each round is one join on the narrow rows, whose side of many children Spark can split.
    """
    p = stored(parents.select(F.col("b").alias("node"), F.col("a").alias("up"), F.lit(True).alias("moved")))
    while not p.filter("moved").isEmpty():
        above = p.select(F.col("node").alias("at"), F.col("up").alias("over"))
        p = stored(p.join(above, p["up"] == above["at"], "left").select(
            "node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
    roots = p.select(F.col("up").alias("node")).distinct().withColumn("component", F.col("node"))
    return p.select("node", F.col("up").alias("component")).union(roots)
