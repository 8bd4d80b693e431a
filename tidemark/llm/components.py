"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Hang the neighbours of each node under the least of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    hung = pairs.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = least.where(F.col("u") != F.col("low")).select("u", F.col("low").alias("v"))
    return hung.union(own).where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``links`` (u, v); component is the least node it reaches.

    Each round counts two edges per link at most and is written to the shared folder. It ends when every edge leads
    from a node to the root of a star, which no further step changes.
    """
    edges = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        edges = stored(_star(_both(edges), F.col("v") > F.col("u")), label)
        edges = stored(_star(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")),
                             F.lit(True)), label)
        roots = edges.select(F.col("v").alias("u")).distinct()
        # Stars: no node hangs under two roots, and no root hangs under another.
        twice = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b")
        if edges.join(roots, "u", "left_semi").isEmpty() and twice.isEmpty():
            break
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
