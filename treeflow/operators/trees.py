"""Concrete syntax trees: nodes with byte spans, and their table form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from dataclasses import field as factory
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(eq=False, slots=True)
class Node:
    kind: str
    start: int
    end: int
    named: bool = True
    field: str | None = None
    error: bool = False
    children: list[Node] = factory(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        """Pre-order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n.children:
                stack.extend(n.children[::-1])

    def named_children(self) -> list[Node]:
        return [c for c in self.children if c.named]

    def by_field(self, name: str) -> Node | None:
        return next((c for c in self.children if c.field == name), None)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class Tree:
    """A parsed text: bytes, root, and text by node."""

    def __init__(self, code: str, root: Node):
        self.code, self.raw, self.root = code, code.encode(), root
        stack, self.n_errors = [root], int(root.error)
        while stack:
            n = stack.pop()
            for c in n.children:
                c.parent = n
                self.n_errors += c.error
                if c.children:
                    stack.append(c)

    @cached_property
    def places(self) -> dict[Node, int]:
        """The index of every node among its siblings."""
        return {c: i for n in self.root.walk() for i, c in enumerate(n.children)}

    @cached_property
    def words(self) -> dict[Node, str]:
        """Trimmed texts of the leaves."""
        return {n: self.text(n).strip() for n in self.root.walk() if not n.children}

    def text(self, n: Node) -> str:
        return self.raw[n.start : n.end].decode("utf-8", "replace")

    def errors(self) -> int:
        return self.n_errors

    def smallest(self, start: int, end: int) -> Node:
        """Deepest node that covers the span."""
        n = self.root
        while True:
            inner = next((c for c in n.children if c.start <= start and c.end >= end), None)
            if inner is None:
                return n
            n = inner

    def point(self, offset: int) -> tuple[int, int]:
        row = self.raw.count(b"\n", 0, offset)
        return row, offset - (self.raw.rfind(b"\n", 0, offset) + 1)


NODES = "path string, pre int, post int, parent_pre int, depth int, child_idx int, named_idx int, kind string, field string, is_named boolean, is_error boolean, start_byte int, end_byte int, text string"


def table_rows(path: str, tree: Tree, texts: bool) -> list[tuple]:
    """Interval-encoded rows of a tree; post is the last pre of the subtree."""
    rows: list[list] = []
    stack: list[tuple[Node, int | None, int, int, int | None]] = [(tree.root, None, 0, 0, 0)]
    trail: list[tuple[int, int]] = []
    while stack:
        n, parent, depth, child, named = stack.pop()
        pre = len(rows)
        while trail and trail[-1][1] >= depth:
            rows[trail.pop()[0]][2] = pre - 1
        trail.append((pre, depth))
        rows.append([path, pre, pre, parent, depth, child, named, n.kind, n.field, n.named, n.error, n.start, n.end, tree.text(n) if texts else None])
        k, kids = 0, []
        for i, c in enumerate(n.children):
            kids.append((c, pre, depth + 1, i, k if c.named else None))
            k += c.named
        stack.extend(reversed(kids))
    for pre, _ in trail:
        rows[pre][2] = len(rows) - 1
    return [tuple(r) for r in rows]


def node_table(units: DataFrame, parser: Callable[[str], Tree], texts: bool = False) -> DataFrame:
    """Node table of units (path, content); parsing is per file, so it shuffles nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NODES.split(", ")]
        kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
        types = [kinds[c.split()[1]] for c in NODES.split(", ")]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = list(zip(*table_rows(path, parser(content or ""), texts), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return units.select("path", F.col("content")).mapInArrow(run, NODES)
