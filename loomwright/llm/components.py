"""Connected components by alternating large-star and small-star steps, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: every node links its larger neighbours to the least node around it. Small: its smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star")
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (x, y) -> (id, component) for every node of a link; component is its least node.

    Every step writes its edges to the shared folder, so a lost executor costs one step. A hot
    node's edges meet the one row of its least neighbour in a join whose sides are both plain
    exchanges, which adaptive execution may split. Links to oneself, repeated links and links
    with nulls count for nothing.
    """
    edges = links.filter("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    while not edges.isEmpty():
        edges = scratch.keep(_star(edges, large=True), "edges")
        edges = scratch.keep(_star(edges, large=False), "edges")
        # done when all are stars: no node hangs from two others, or from another and has others hanging from it
        twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if twice.isEmpty() and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    # every edge now goes from a node to the least of its component
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
