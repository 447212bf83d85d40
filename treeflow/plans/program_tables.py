"""Rule programs as tables: successors through junctions and surely bound tags, by rounds of joins.

For programs of any size, made of rows rather than text: rules has rule, is_dummy,
is_seed and defined (array of tags); edges has source, target and scope, groups already
expanded (``graph.expand_edges``).  A round joins what the round before found with the
edges, and is written before the next; it ends when a round brings nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialise import discard, keep
from .model import ProgramError


def successors(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """source, scope, target, once each: junctions are replaced by their own targets and scopes."""
    dummies = keep(rules.filter("is_dummy").select(F.col("rule").alias("target")), "junctions")
    onward = keep(edges.join(dummies.withColumnRenamed("target", "source"), "source", "left_semi").select(F.col("source").alias("target"), F.col("scope").alias("next_scope"), F.col("target").alias("next")).distinct(), "onward")
    limit = dummies.count() + 1
    front = keep(edges.select("source", "scope", "target").distinct(), "front")
    found = []
    for _ in range(limit):
        found.append(front.join(dummies, "target", "left_anti").select("source", "scope", "target"))
        through = front.join(dummies, "target", "left_semi").join(onward, "target")
        front = keep(through.select("source", F.col("next_scope").alias("scope"), F.col("next").alias("target")).distinct(), "front")
        if front.isEmpty():
            break
    else:
        raise ProgramError("junctions form a cycle")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()


def assigned(rules: DataFrame, edges: DataFrame, substitutions: list[str]) -> DataFrame:
    """rule, tags (sorted): the tags that are bound on entry of each rule a seed leads to, whatever the way.

    Edges lead from rules to rules.  Of the rules that lead to a rule only those count that
    have been reached; tags of a rule only go once it has been reached, so the rounds end.
    A round sends only what changed: what a rule was told before is in its tags already.
    A rule stays open (live) while its tags can still go, because a rule that leads to it is
    open and some are left beyond the given ones; a seed has just those from the start.
    Closed rules and the edges from them leave after their last word, so rounds get smaller.
    """
    given = F.array(*map(F.lit, sorted(substitutions))).cast("array<string>")
    seed = F.coalesce("is_seed", F.lit(False))
    defined = F.coalesce("defined", F.array().cast("array<string>")).alias("defined")
    state = keep(rules.select("rule", defined, F.when(seed, given).alias("tags"), seed.alias("changed"), (~seed).alias("live")), "assigned")
    ahead, before, parts = edges.select("source", "target"), None, []
    while not state.filter("changed").isEmpty():
        word = F.when(F.col("changed"), F.array_union("tags", "defined"))
        step = keep(ahead.join(state.filter("changed OR live").select(F.col("rule").alias("source"), word.alias("word"), "live"), "source"), "step")
        if before is not None:
            discard(before)
        ahead, before = step.filter("live").select("source", "target"), step
        told = step.groupBy(F.col("target").alias("rule")).agg(F.count("word").alias("ways"), F.max("live").alias("waits"))
        common = step.select(F.col("target").alias("rule"), F.explode("word").alias("tag")).groupBy("rule", "tag").agg(F.count(F.lit(1)).alias("n"))
        common = common.join(told.select("rule", "ways"), "rule").filter("n = ways").groupBy("rule").agg(F.array_sort(F.collect_list("tag")).alias("common"))
        new = state.filter("live").select("rule", "defined", F.col("tags").alias("old")).join(told, "rule", "left").join(common, "rule", "left")
        news = F.coalesce("common", F.array().cast("array<string>"))
        tags = F.when(F.coalesce("ways", F.lit(0)) == 0, F.col("old")).when(F.col("old").isNull(), news).otherwise(F.array_intersect("old", news))
        live = F.coalesce("waits", F.lit(False)) & ~F.col("tags").eqNullSafe(given)
        new = new.withColumn("tags", tags).select("rule", "defined", "tags", (~F.col("tags").eqNullSafe(F.col("old"))).alias("changed"), live.alias("live"))
        parts.append(state.filter("NOT live"))
        state = keep(new, "assigned")
    if before is not None:
        discard(before)
    return reduce(DataFrame.unionByName, [*parts, state]).filter("tags IS NOT NULL").select("rule", "tags")


def unbound(rules: DataFrame, bound: DataFrame) -> DataFrame:
    """rule, tag of every hole or used tag (array used) that neither the rule nor all ways to it bind."""
    lacking = F.array_except(F.array_except("used", "defined"), "tags")
    return rules.join(bound, "rule").select("rule", F.explode(F.array_distinct(lacking)).alias("tag"))
