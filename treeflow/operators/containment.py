"""Trees as tables: interval encoding and the contextual filters as joins.

A node table has path (the tree), pre (order number), post (the last pre of the
subtree), depth, parent_pre, kind and any payload.  Every join carries the path
equality, so it shuffles on path and the interval test stays a residual condition
of a hash or sort-merge join.  Interval joins carry the tile of the point's number as
well: an interval goes to every tile that it reaches, a point to its own, so a huge
tree or a hot path is many keys, and no pair is made twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_encode(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Node table of a hierarchy.

    levels[d] has path, the first d of keys, kind, label and ref (what the node
    stands for); one row a node.
    Numbering is a sort inside each path, so trees are numbered in parallel.
    """
    rows = []
    for depth, level in enumerate(levels):
        cols = [F.col(k).cast("long").alias(f"k{i}") if i < depth else F.lit(None).cast("long").alias(f"k{i}") for i, k in enumerate(keys)]
        rows.append(level.select("path", F.lit(depth).alias("depth"), "kind", "label", "ref", *cols))
    nodes = reduce(DataFrame.unionByName, rows)
    ks = [F.col(f"k{i}").asc_nulls_first() for i in range(len(keys))]
    nodes = nodes.withColumn("pre", F.row_number().over(W.partitionBy("path").orderBy(*ks, "depth", "label", "ref")) - 1)
    post = F.lit(None)
    parent = F.lit(None).cast("int")
    for depth in range(len(levels)):
        inside = W.partitionBy("path", *(f"k{i}" for i in range(depth)))
        last = F.max("pre").over(inside) if depth < len(levels) - 1 else F.col("pre")  # leaves end where they begin, equal keys too
        post = F.when(F.col("depth") == depth, last).otherwise(post)
        if depth:
            above = W.partitionBy("path", *(f"k{i}" for i in range(depth - 1)))
            parent = F.when(F.col("depth") == depth, F.min(F.when(F.col("depth") == depth - 1, F.col("pre"))).over(above)).otherwise(parent)
    return nodes.withColumn("post", post).withColumn("parent_pre", parent).drop(*(f"k{i}" for i in range(len(keys))))


#: Numbers of a tile.
TILE = 4096


def _tiled(intervals: DataFrame, pre: str, post: str) -> DataFrame:
    """intervals once for every tile that they reach."""
    return intervals.withColumn("tile", F.explode(F.sequence(F.expr(f"{pre} div {TILE}"), F.expr(f"{post} div {TILE}"))))


def _placed(points: DataFrame, pre: str) -> DataFrame:
    return points.withColumn("tile", F.expr(f"{pre} div {TILE}"))


def pairs_around(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (path, pre) with a_pre, a_post, a_depth and a_label (where there is one) of each of nodes around or at them."""
    outer = nodes.select("path", *(F.col(c).alias(f"a_{c}") for c in ("pre", "post", "depth", "label") if c in nodes.columns))
    hit = _placed(points, "pre").join(_tiled(outer, "a_pre", "a_post"), ["path", "tile"])
    return hit.filter(F.col("pre").between(F.col("a_pre"), F.col("a_post"))).drop("tile")


def pairs_inside(scopes: DataFrame, points: DataFrame) -> DataFrame:
    """scopes (path, pre, post) with each of points (path, i_pre) in their subtrees."""
    hit = _tiled(scopes, "pre", "post").join(_placed(points, "i_pre"), ["path", "tile"])
    return hit.filter(F.col("i_pre").between(F.col("pre"), F.col("post"))).drop("tile")


def enclosing(matches: DataFrame, nodes: DataFrame, outermost: bool = False) -> DataFrame:
    """matches with a_pre, a_post, a_depth, a_label of the innermost (outermost) of nodes around each; others drop."""
    hit = pairs_around(matches, nodes)
    best = F.min_by if outermost else F.max_by
    rest = [c for c in matches.columns if c not in ("path", "pre")]
    got = hit.groupBy("path", "pre").agg(*(F.first(c).alias(c) for c in rest), best(F.struct("a_pre", "a_post", "a_depth", "a_label"), "a_depth").alias("a"))
    return got.select(*matches.columns, "a.*")


def not_enclosing(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """matches without any of nodes around them."""
    outer = nodes.select("path", F.col("pre").alias("a_pre"), F.col("post").alias("a_post"))
    a, m = _tiled(outer, "a_pre", "a_post").alias("a"), _placed(matches, "pre").alias("m")
    around = (F.col("a.path") == F.col("m.path")) & (F.col("a.tile") == F.col("m.tile")) & F.col("m.pre").between(F.col("a_pre"), F.col("a_post"))
    return m.join(a, around, "left_anti").drop("tile")


def _inside(matches: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, pre of a match for each of nodes in its subtree."""
    return pairs_inside(matches.select("path", "pre", "post"), nodes.select("path", F.col("pre").alias("i_pre"))).select("path", "pre")


def contains(matches: DataFrame, nodes: DataFrame, at_least: int = 1, at_most: int | None = None) -> DataFrame:
    """matches whose subtree holds between at_least and at_most of nodes; counts only when the bounds need it."""
    if at_least == 1 and at_most is None:
        return matches.join(_inside(matches, nodes), ["path", "pre"], "left_semi").select(matches.columns)
    counted = matches.join(_inside(matches, nodes).groupBy("path", "pre").agg(F.count(F.lit(1)).alias("n")), ["path", "pre"], "left")
    n = F.coalesce("n", F.lit(0))
    high = F.lit(True) if at_most is None else n <= at_most
    return counted.filter((n >= at_least) & high).select(matches.columns)


def not_contains(matches: DataFrame, *patterns: DataFrame) -> DataFrame:
    """matches whose subtree holds none of the patterns' nodes."""
    out = matches
    for nodes in patterns:
        out = out.join(_inside(matches, nodes), ["path", "pre"], "left_anti").select(matches.columns)
    return out


def child_count(matches: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """matches with n (named) children."""
    counted = nodes.groupBy("path", F.col("parent_pre").alias("pre")).agg(F.count(F.lit(1)).alias("n"))
    return matches.join(counted, ["path", "pre"], "left").filter(F.coalesce("n", F.lit(0)) == n).drop("n")


def sibling_count(matches: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """matches whose parent has n (named) children."""
    counted = nodes.groupBy("path", "parent_pre").agg(F.count(F.lit(1)).alias("n"))
    return matches.join(counted.filter(F.col("n") == n).drop("n"), ["path", "parent_pre"], "left_semi")


def smallest_covering(ranges: DataFrame, nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """pre, and the columns to carry, of the deepest node covering each range (path, lo, hi in pre numbers)."""
    around = _tiled(nodes.select("path", "pre", "post", "depth", *carry), "pre", "post")
    hit = _placed(ranges, "lo").join(around, ["path", "tile"]).filter((F.col("pre") <= F.col("lo")) & (F.col("post") >= F.col("hi")))
    return hit.groupBy(*ranges.columns).agg(F.max_by(F.struct("pre", *carry), "depth").alias("node")).select(*ranges.columns, "node.*")


def context(matches: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Each match with its k nearest nodes upwards (itself first) of differing label, numbered anc."""
    hit = pairs_around(matches.select("path", "pre"), nodes)
    up = W.partitionBy("path", "pre").orderBy(F.col("a_depth").desc())
    changed = hit.withColumn("prev", F.lag("a_label").over(up)).filter(~F.col("a_label").eqNullSafe(F.col("prev")) | F.col("prev").isNull())
    return changed.withColumn("anc", F.row_number().over(up) - 1).filter(F.col("anc") < k).select("path", "pre", "anc", "a_pre", "a_depth", "a_label")


def first_hit(candidates: DataFrame, by: str) -> DataFrame:
    """The winning candidate of each match (path, pre, rule_ord, anc): rule-major (by='rule') or node-major (by='node')."""
    order = ("rule_ord", "anc") if by == "rule" else ("anc", "rule_ord")
    return candidates.groupBy("path", "pre").agg(F.min(F.struct(*order)).alias("w")).select("path", "pre", "w.rule_ord", "w.anc")
