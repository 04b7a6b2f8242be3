"""Connected components of an edge table by alternating star operations.

Large-star links every larger neighbour of a node to its smallest neighbour;
small-star links the smaller neighbours and the node itself to the smallest.
Both keep the components and the rounds grow with the logarithm of a
component's size.  Every round is a grouped minimum and an equality join, and is
written to the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, keep


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as a < b; the neighbours of b that are smaller are its a."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select("b", F.col("m").alias("a")))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the least node.

    Self-links and repeated links are harmless; a null end drops the link; no
    links give no rows.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = keep(edges, "edges")
    seen = _state(edges)
    while seen[0]:
        step = _small_star(_large_star(edges).distinct()).where("a <> b").distinct()
        step = keep(step, "edges")
        now = _state(step)
        forget(spark, edges)
        edges = step
        if now == seen:
            break
        seen = now
    members = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return members.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
