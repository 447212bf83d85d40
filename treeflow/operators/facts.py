"""Facts: spans with data, kept in step with edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shift_or_void(start: Column, end: Column, edit_start: Column, old_end: Column, new_end: Column) -> Column:
    """struct<start, end, voided> of a span after an edit: before it kept, after it shifted, overlapped voided."""
    delta = new_end - old_end
    return (
        F.when(end <= edit_start, F.struct(start.alias("start"), end.alias("end"), F.lit(False).alias("voided")))
        .when(start >= old_end, F.struct((start + delta).alias("start"), (end + delta).alias("end"), F.lit(False).alias("voided")))
        .otherwise(F.struct(start.alias("start"), end.alias("end"), F.lit(True).alias("voided")))
    )


def with_fact(rows: DataFrame, facts: DataFrame, on: list[str], wanted: dict[str, str]) -> DataFrame:
    """rows with a live fact (data map, voided) of the same keys that has all wanted pairs."""
    test = ~F.col("voided")
    for k, v in wanted.items():
        test &= F.try_element_at("data", F.lit(k)) == v
    return rows.join(facts.filter(test).select(*on).distinct(), on, "left_semi")


def as_text(data: Column) -> Column:
    """A map as sorted k=v pairs."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")


def newlines(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def moved(facts: DataFrame, edits: DataFrame) -> DataFrame:
    """facts after a wave of edits: start, end, row and column moved by what the edits before grew, overlapped ones voided.

    facts has path, start, end, row, column (of start, in bytes) and voided; edits has
    path, start, old_end, column (of start), old_text and new_text, not overlapping each
    other.  Facts and edits of a file are put in one order by position; prefix sums of
    growth give the shift of all spans at once, whatever the number of edits.  A line
    begins where the text said, moved, unless an edit stands between: then after the last
    line feed of its replacement, or where the line of that edit begins.
    """
    rest = [c for c in facts.columns if c not in ("path", "start", "end", "row", "column", "voided")]
    e = edits.select(
        "path",
        F.col("old_end").alias("at"),
        F.lit(0).alias("kind"),
        "start",
        (F.col("start") - F.col("column")).alias("line"),
        (F.octet_length("new_text") - (F.col("old_end") - F.col("start"))).alias("grew"),
        (newlines(F.col("new_text")) - newlines(F.col("old_text"))).alias("rows"),
        F.when(F.contains("new_text", F.lit("\n")), F.octet_length("new_text") - F.octet_length(F.substring_index("new_text", "\n", -1))).alias("feed"),
        F.lit(None).cast(facts.select(F.struct("*")).schema[0].dataType).alias("fact"),
    )
    f = facts.select("path", F.col("start").alias("at"), F.lit(1).alias("kind"), "start", (F.col("start") - F.col("column")).alias("line"), *(F.lit(0).alias(c) for c in ("grew", "rows")), F.lit(None).cast("int").alias("feed"), F.struct("*").alias("fact"))
    order = [F.col("at"), F.col("kind"), F.col("start")]
    before = W.partitionBy("path").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    to_here = before.rowsBetween(W.unboundedPreceding, 0)
    edit = F.col("kind") == 0
    both = e.unionByName(f).withColumns({"shift": F.coalesce(F.sum("grew").over(before), F.lit(0)), "down": F.coalesce(F.sum("rows").over(before), F.lit(0)), "last": F.max(F.when(edit, F.col("at"))).over(before)})
    fresh = F.col("last").isNull() | (F.col("last") < F.col("line"))
    # the new place where the line of a position begins: its own, or what the edit before it left
    both = both.withColumn("own", F.when(fresh, F.col("line") + F.col("shift")))
    left = F.when(edit, F.coalesce(F.col("start") + F.col("shift") + F.col("feed"), F.col("own")))
    both = both.withColumn("begins", F.coalesce("own", F.last(left, True).over(before)))
    ahead = W.partitionBy("path").orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    both = both.withColumn("next", F.min(F.when(edit, F.col("start"))).over(ahead)).filter(~edit)
    start = F.col("start") + F.col("shift")
    hit = F.coalesce(F.col("next") < F.col("fact.end"), F.lit(False))
    keep = hit | F.col("fact.voided")
    new = {"start": start, "end": F.col("fact.end") + F.col("shift"), "row": F.col("fact.row") + F.col("down"), "column": start - F.col("begins")}
    out = [F.when(keep, F.col(f"fact.{c}")).otherwise(v).cast(facts.schema[c].dataType).alias(c) for c, v in new.items()]
    return both.select("path", *out, keep.alias("voided"), *(F.col("fact")[c].alias(c) for c in rest))
