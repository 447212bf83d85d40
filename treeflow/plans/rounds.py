"""Which units a round has to visit: rule instances joined with the files that hold their values.

Instances are rows, one for each distinct capture of a global or directory edge.  An
inverted index of words (``postings``: word, path) and the three-letter grams of the
words (``grams``: gram, word) lead from the values of an instance to the files that
hold them, by equi joins alone; directory scopes join on the folder, recursive ones on
each folder above a file.  After a round the index grows by the words of edited units,
so both new instances meet all units and edited units meet all instances, and no pair
is run twice: a round's work follows the new (instance, file) pairs.

An instance without a value to look for (no holes, or values under three letters, true
or false, or a query that says what must not be) visits every unit of the state, or of
its folder.  Only such instances without a folder reach the driver; the program's rules
bound them.
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import RuleGraph
from .materialise import keep
from .model import Instance, Rule

WORD = r"[\p{L}\p{N}_]+"
MESSAGE = "rule string, bindings map<string,string>, directory string, recursive boolean"
INSTANCE = "o string, directory string, recursive boolean, lookup array<struct<value: string, core: string>>"


def message(i: Instance) -> str:
    return json.dumps({"rule": i.rule.name, "bindings": dict(i.bindings), "directory": i.directory, "recursive": i.recursive}, sort_keys=True)


def instance(graph: RuleGraph, text: str) -> Instance:
    return _read(id(graph), text, graph)


@lru_cache(maxsize=50_000)
def _read(_: int, text: str, graph: RuleGraph) -> Instance:
    d = json.loads(text)
    return Instance(graph.rules[d["rule"]], tuple(sorted(d["bindings"].items())), d["directory"], d["recursive"])


def sought(rule: Rule) -> list[str]:
    """The holes whose values a file must hold for the rule to match."""
    if "#not-" in rule.query:
        return []
    return sorted(h for h in rule.holes if f"@{h}" in rule.query or f":[{h}]" in rule.query)


def instances(messages: DataFrame, graph: RuleGraph) -> DataFrame:
    """INSTANCE rows of messages (o)."""
    holes = F.create_map(*(x for n, r in graph.rules.items() for x in (F.lit(n), F.array(*map(F.lit, sought(r))).cast("array<string>"))))
    d = messages.select("o", F.from_json("o", MESSAGE).alias("d")).select("o", "d.*")
    words = F.transform(F.transform(holes[F.col("rule")], lambda h: F.try_element_at("bindings", h)), _looked_up)
    usable = F.filter(words, lambda w: (F.char_length(w["core"]) >= 3) & ~F.lower(w["value"]).isin("true", "false"))
    return d.select("o", "directory", "recursive", F.coalesce(usable, F.array()).alias("lookup"))


def _looked_up(value: Column) -> Column:
    longest = F.array_max(F.transform(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))
    return F.struct(value.alias("value"), longest["w"].alias("core"))


def postings(units: DataFrame) -> DataFrame:
    """word, path of units (path, content), once each."""
    return units.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(WORD), F.lit(0)))).alias("word"))


def grams(words: DataFrame) -> DataFrame:
    """gram, word for every three letters of every word of postings."""
    w = words.select("word").filter(F.char_length("word") >= 3).distinct()
    at = F.sequence(F.lit(1), F.char_length("word") - 2)
    return w.select("word", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(3))))).alias("gram"))


class Index:
    """The postings and grams of all units, in tables that edited units add to."""

    def __init__(self, units: DataFrame):
        self.words = self._add(units)
        self.latest = self.words

    def _add(self, units: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = keep(postings(units), "postings")
        return p, keep(grams(p), "grams")

    def edited(self, units: DataFrame) -> None:
        self.latest = self._add(units)
        self.words = tuple(a.unionByName(b) for a, b in zip(self.words, self.latest, strict=True))


def folder() -> Column:
    return F.regexp_extract("path", "^(.*)/[^/]*$", 1)


def _in_scope() -> Column:
    below = F.startswith(F.concat(folder(), F.lit("/")), F.concat(F.regexp_replace("directory", "/+$", ""), F.lit("/")))
    return F.col("directory").isNull() | (folder() == F.col("directory")) | (F.col("recursive") & below)


def value_pairs(found: DataFrame, index: tuple[DataFrame, DataFrame]) -> DataFrame:
    """path, o, value: the units that hold a word with the core of one of an instance's values, in its scope."""
    words, pieces = index
    v = found.select("o", "directory", "recursive", F.explode("lookup").alias("v")).select("o", "directory", "recursive", "v.*", F.substring("v.core", 1, 3).alias("gram"))
    hit = v.join(pieces, "gram").filter(F.contains("word", F.col("core"))).select("o", "directory", "recursive", "value", "word")
    return hit.join(words, "word").filter(_in_scope()).select("path", "o", "value").distinct()


def folder_pairs(found: DataFrame, paths: DataFrame) -> DataFrame:
    """path, o of instances without a value, confined to a folder."""
    some = found.filter((F.size("lookup") == 0) & F.col("directory").isNotNull())
    exact = some.filter(~F.col("recursive")).select("o", F.col("directory").alias("folder"))
    below = some.filter("recursive").select("o", F.regexp_replace("directory", "/+$", "").alias("folder"))
    parts = F.split(folder(), "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))
    own = paths.select("path", folder().alias("folder"))
    return own.join(exact, "folder").select("path", "o").unionByName(above.join(below, "folder").select("path", "o")).distinct()
