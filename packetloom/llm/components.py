"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from packetloom.llm.common import staged


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step. Large: every larger neighbour of a node points to the smallest node around it. Small: the node and
    its smaller neighbours do. ``edges`` has ``u > v``."""
    rows = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = staged(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")  # written: the join below can then split a hub
    joined = rows.join(least, "u")
    if both_ways:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    return staged(out.filter("u > v").distinct(), "stars")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (its smallest reachable node) of every node with an edge; null ends and loops are no edges.

    Rounds repeat until every node points to one node that points nowhere (logarithmically many). Each step is a minimum
    per node and a join that can split hubs; edge sets are written to the shared folder and never reach the driver.
    """
    cur = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    while not _settled(cur):
        cur = _stars(_stars(cur, True), False)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Is the graph a set of stars: no node with two edges upwards, or with edges both ways?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")).distinct())
    return ends.groupBy("x").agg(F.count("*").alias("n"), F.max("up").alias("up")).filter("n > 1 and up = 1").isEmpty()
