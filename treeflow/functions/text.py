"""Column expressions over text units: byte spans, points, splices, templates, regex captures."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(code: Column, start: Column, end: Column) -> Column:
    """Text of the byte span [start, end) of code."""
    return F.decode(F.substring(F.encode(code, "UTF-8"), start + 1, end - start), "UTF-8")


def splice(code: Column, start: Column, end: Column, replacement: Column) -> Column:
    """code with the byte span [start, end) replaced."""
    raw = F.encode(code, "UTF-8")
    return F.decode(F.concat(F.substring(raw, F.lit(1), start), F.encode(replacement, "UTF-8"), F.substring(raw, end + 1, F.octet_length(code) - end)), "UTF-8")


def point_row(code: Column, offset: Column) -> Column:
    """0-based row of a byte offset."""
    prefix = byte_slice(code, F.lit(0), offset)
    return F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit("\n"), F.lit("")))


def point_column(code: Column, offset: Column) -> Column:
    """0-based column of a byte offset, in bytes."""
    return F.octet_length(F.substring_index(byte_slice(code, F.lit(0), offset), "\n", -1))


def instantiate(template: Column, bindings: dict[str, Column]) -> Column:
    """Replaces @tag and :[tag]; longest tag first, so one tag never eats another's prefix."""
    out = template
    for tag in sorted(bindings, key=lambda t: (-len(t), t)):
        out = F.replace(F.replace(out, F.lit(f"@{tag}"), bindings[tag]), F.lit(f":[{tag}]"), bindings[tag])
    return out


def instantiate_map(template: Column, bindings: Column) -> Column:
    """As instantiate, with the tags in a map column."""
    entries = F.array_sort(F.map_entries(bindings), lambda a, b: F.when(F.length(a.key) > F.length(b.key), -1).when(F.length(a.key) < F.length(b.key), 1).when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
    return F.aggregate(entries, template, lambda acc, e: F.replace(F.replace(acc, F.concat(F.lit("@"), e.key), e.value), F.concat(F.lit(":["), e.key, F.lit("]")), e.value))


def collapse_blank_lines(code: Column) -> Column:
    return F.regexp_replace(code, r"\n(\s*\n)+(\s*\n)", "\n$2")


def without_space(code: Column) -> Column:
    return F.regexp_replace(code, r"\s+", "")


def same_but_space(a: Column, b: Column) -> Column:
    return without_space(a) == without_space(b)


class Rgx:
    """A regular-expression pattern with named groups, as Spark expressions.

    Group names are numbered for the JVM; patterns with look-around or back
    references are refused, since the dialect does not have them.
    """

    def __init__(self, pattern: str):
        if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
            raise ValueError(f"look-around and back-references are not part of the dialect: {pattern}")
        pattern = re.sub(r"\(\?P?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern)
        self.tags = dict(re.compile(pattern).groupindex)
        self.groups = re.compile(pattern).groups
        self.java = re.sub(r"\(\?P<\w+>", "(", pattern)
        #: Whether a match may depend on what stands around it.
        self.anchored = re.search(r"\\[bBAZzG]|(?<!\[)\^|\$", pattern) is not None

    def matches(self, code: Column) -> Column:
        """array of matched strings in source order."""
        return F.regexp_extract_all(code, F.lit(self.java), F.lit(0))

    def capture(self, matched: Column, tag: str) -> Column:
        return F.regexp_extract(matched, f"^(?:{self.java})$", self.tags[tag])

    def captures(self, code: Column) -> Column:
        """array<struct<matched, tag...>> in source order: whole matches are found once and groups taken
        from each, or, where a match depends on what stands around it, each group by a scan of its own."""
        if not self.anchored:
            return F.transform(self.matches(code), lambda m: F.struct(m.alias("matched"), *(self.capture(m, t).alias(t) for t in self.tags)))
        parts = [F.regexp_extract_all(code, F.lit(self.java), F.lit(i)).alias(n) for n, i in {"matched": 0, **self.tags}.items()]
        return F.arrays_zip(*parts)

    def count(self, code: Column) -> Column:
        """Number of matches; nothing is kept of them."""
        return F.regexp_count(code, F.lit(self.java))
