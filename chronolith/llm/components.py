"""Connected components by alternating stars (Kiveris et al. 2014), as joins of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or the smaller neighbours of each node to the smallest of them all."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.filter("b < a")
    least = materialize(seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    hung = seen.join(least, "a")  # a node with a third of all edges makes a skewed join, which AQE splits
    if large:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge (a, b)."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        edges = materialize(_star(_star(edges, True), False), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
