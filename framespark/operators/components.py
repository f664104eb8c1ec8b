"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framespark.plans.cuts import cut, discard


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and nothing below it, or is a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    sums = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not sums.where("down > 1 or (down = 1 and up = 1)").take(1)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of the undirected ``edges(a, b)`` of BIGINT; a component is named by its least node.

    Each round is two joins over edges and is written before the next, so lineage stays short; the files of the round before are deleted. Rounds grow with the logarithm
    of the components' diameter and end when all edges are stars. A hub's edges, two numbers each, are split between tasks by adaptive execution. Loops and repeats are allowed; an empty table has no nodes.
    """
    edges = cut(edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct(), "edges")
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for _ in range(most_rounds):
        if _stars(now):
            break
        last, now = now, cut(_small(_large(now)), "edges")
        discard(last)
    else:
        raise RuntimeError("components have not settled")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
    return found.unionByName(loops.join(found, "node", "left_anti"))
