"""Parsed nodes as tables keyed by path and content, so that a unit is parsed again only when it has changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree_plan
from .materialise import discard, keep


class NodeStore:
    """Nodes of all units that were asked for; each call adds the versions that no call before has parsed."""

    def __init__(self, language: str, dirty: bool = False):
        self.language, self.dirty = language, dirty
        self.parts: list[DataFrame] = []
        self.keys: list[DataFrame] = []
        #: How many units each call has parsed.
        self.parsed: list[int] = []

    def nodes(self, units: DataFrame) -> DataFrame:
        """tree_plan.NODES of units (path, content)."""
        wanted = units.select("path", "content", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("version"))
        new = wanted
        if self.keys:
            new = wanted.join(reduce(DataFrame.unionByName, self.keys), ["path", "version"], "left_anti")
        key = keep(new.select("path", "version"), "versions")
        self.parsed.append(key.count())
        if self.parsed[-1]:
            self.keys.append(key)
            self.parts.append(keep(tree_plan.parsed(new, self.language, self.dirty).join(key, "path"), "nodes"))
        every = reduce(DataFrame.unionByName, self.parts) if self.parts else tree_plan.parsed(new, self.language, self.dirty).withColumn("version", F.lit(""))
        return every.join(wanted.select("path", "version"), ["path", "version"], "left_semi").select(*(c.split()[0] for c in tree_plan.NODES.split(", ")))

    def forget(self) -> None:
        """Deletes the tables; plans over them must be done."""
        for df in [*self.parts, *self.keys]:
            discard(df)
        self.parts, self.keys = [], []
