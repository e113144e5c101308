"""Connected components of a table of links, by alternating large and small stars.

Every round replaces links by links to smaller neighbours and keeps the components; it ends
when nothing changes, after about the logarithm of the longest path.  The minimum of a node's neighbours is
an aggregate that merges within tasks, and goes back to its links by an equi-join, which Spark splits where a node
has very many.  Nothing is collected; each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links`` (``a``, ``b``); the label is the component's smallest node.

    Nulls and loops are left out, links may repeat and stand either way; no links give an
    empty table.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        found = materialize(_small_star(_large_star(edges)), "links")
        now = found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = found
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()
