"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, scope, settle


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    # a centre's edges may be split over tasks; repeated edges are left to the small stars
    return both.filter("v > u").join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(apart(least, "u"), "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Every node has one edge out, or only edges in."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out = 1 AND into = 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, c for each node of links (u, v): c is the least node of its component.

    Both star steps keep connectivity; once the edges form disjoint stars, each
    joins a node to its component's least node.  Nodes may be of any orderable type.  A table
    without links gives an empty result.
    """
    with scope(links.sparkSession) as keep:
        edges = links.select("u", "v").filter("u <> v")
        for _ in range(most_rounds):
            edges = settle(_small(_large(edges)), "edges", "merge")
            if _stars(edges):
                break
        else:
            raise RuntimeError("components did not settle")
        return keep(settle(edges.select("u", F.col("v").alias("c")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("c"))).distinct(), "components", "merge"))


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """u, c after more links (u, v) of nodes in classes or outside them: the links are led to the
    components they join, so the work on stars grows with the links and not with the classes."""
    with scope(links.sparkSession) as keep:
        of = classes.hint("merge")
        ends = links.join(of, "u", "left").select(F.coalesce("c", "u").alias("u"), "v")
        ends = ends.join(of.select(F.col("u").alias("v"), "c").hint("merge"), "v", "left").select("u", F.coalesce("c", "v").alias("v"))
        moved = components(settle(ends.filter("u <> v").distinct(), "ends", "merge"))
        now = moved.select(F.col("u").alias("c"), F.col("c").alias("now"))
        old = classes.join(apart(now, "c"), "c", "left").select("u", F.coalesce("now", "c").alias("c"))
        fresh = moved.join(of.select("u"), "u", "left_anti")
        return keep(settle(old.unionByName(fresh), "components", "deal"))
