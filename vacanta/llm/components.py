"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's neighbours to the least among them and the node; edges hold u > v.

    The large step takes greater neighbours, seen from either end; the small step the lesser ones and the node.
    """
    seen = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = written(least, "least")
    linked = seen.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return written(out.filter("u <> v").distinct(), "star")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `root`, the least node of its component, for every node of an edge that is not its own root.

    Each step is written out; a node's edges are reduced to their least before they are joined, so a node of any
    degree costs one row per task, and Spark may split the join.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    while not are_stars(now):
        now = star(star(now, True), False)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root that has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter(F.col("up") + F.col("down") > 1).isEmpty()
