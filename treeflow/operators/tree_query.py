"""Tree queries: S-expression patterns over syntax trees.

Surface: named nodes, wildcards ``(_)`` and ``_``, anonymous tokens in quotes,
fields ``f:``, negated fields ``!f``, alternations ``[a b]``, groups, quantifiers
``* + ?``, anchors ``.``, captures ``@tag`` and the predicates eq?, not-eq?,
match?, not-match?, any-of?.  Anything else is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as factory
from functools import lru_cache

from .trees import Node, Tree

LEX = re.compile(r'\s+|;[^\n]*|([()\[\]])|"((?:\\.|[^"\\])*)"|@([\w.-]+)|#([\w?!.-]+)|([\w-]+):|(!)([\w-]+)|([*+?.])|([\w-]+)')


class QueryError(ValueError):
    """The text is not a query of the supported surface."""


@dataclass
class Pattern:
    kind: str  # node kind, "_" for any node, "(_)" for any named node, "alt", "group"
    named: bool = True
    field: str | None = None
    without: list[str] = factory(default_factory=list)
    items: list[Pattern] = factory(default_factory=list)
    captures: list[str] = factory(default_factory=list)
    quantifier: str = ""
    anchor_before: bool = False
    anchor_after: bool = False


@dataclass
class Query:
    patterns: list[Pattern]
    predicates: list[list[tuple]]  # per pattern: (name, [("tag", x) | ("text", x)])
    tags: list[str]
    used: set[str]


def _lex(text: str) -> list[tuple[str, str]]:
    out, pos = [], 0
    names = {1: "punct", 2: "text", 3: "tag", 4: "pred", 5: "field", 8: "op", 9: "name"}
    while pos < len(text):
        m = LEX.match(text, pos)
        if not m:
            raise QueryError(f"Cannot parse query at {text[pos : pos + 20]!r}")
        pos = m.end()
        if m[6]:
            out.append(("without", m[7]))
        elif m.lastindex:
            k = m.lastindex
            value = m[k]
            if k == 2:
                value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1] if e[1] in '"\\' else e[0]), value)
            out.append((names[k], value))
    return out


class _Reader:
    def __init__(self, text: str):
        self.toks, self.i = _lex(text), 0
        self.tags: list[str] = []
        self.used: set[str] = set()
        self.found: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.toks[self.i] if self.i < len(self.toks) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.i += 1
        return t

    def query(self) -> Query:
        patterns, predicates = [], []
        while self.peek()[0] != "end":
            self.found = []
            patterns.append(self.item())
            while self.peek() == ("punct", "(") and self.i + 1 < len(self.toks) and self.toks[self.i + 1][0] == "pred":
                self.next()
                self.predicate()
            predicates.append(self.found)
        if not patterns:
            raise QueryError("Cannot parse an empty query")
        return Query(patterns, predicates, self.tags, self.used)

    def predicate(self) -> None:
        name = self.next()[1]
        if name not in ("eq?", "not-eq?", "match?", "not-match?", "any-of?"):
            raise QueryError(f"Unknown predicate #{name}")
        args = []
        while self.peek() != ("punct", ")"):
            kind, value = self.next()
            if kind == "tag":
                self.used.add(value)
                args.append(("tag", value))
            elif kind in ("text", "name"):
                args.append(("text", value))
            else:
                raise QueryError(f"Cannot parse predicate #{name}")
        self.next()
        if name.endswith("match?"):
            re.compile(args[1][1])
        self.found.append((name, args))

    def item(self) -> Pattern:
        kind, value = self.next()
        if kind == "field":
            p = self.item()
            p.field = value
            return p
        if (kind, value) == ("punct", "["):
            p = Pattern("alt")
            while self.peek() != ("punct", "]"):
                if self.peek()[0] == "end":
                    raise QueryError("Cannot parse query: [ is not closed")
                p.items.append(self.item())
            self.next()
        elif kind == "text":
            p = Pattern(value, named=False)
        elif kind == "name" and value == "_":
            p = Pattern("_")
        elif (kind, value) == ("punct", "("):
            if self.peek()[0] == "name":
                name = self.next()[1]
                p = Pattern("(_)" if name == "_" else name)
                if self.peek() == ("op", "."):
                    pass
                self.children(p)
            elif self.peek()[0] == "text":
                p = Pattern(self.next()[1], named=False)
                self.children(p)
            else:
                p = Pattern("group")
                self.children(p)
                if len(p.items) == 1 and not p.items[0].quantifier:
                    p = p.items[0]
        else:
            raise QueryError(f"Cannot parse query at {value!r}")
        while True:
            kind, value = self.peek()
            if kind == "tag":
                p.captures.append(value)
                if value not in self.tags:
                    self.tags.append(value)
            elif kind == "op" and value in "*+?":
                p.quantifier = value
            else:
                return p
            self.next()

    def children(self, p: Pattern) -> None:
        anchored = False
        while self.peek() != ("punct", ")"):
            kind, value = self.peek()
            if kind == "end":
                raise QueryError("Cannot parse query: ( is not closed")
            if (kind, value) == ("op", "."):
                self.next()
                if self.peek() == ("punct", ")") and p.items:
                    p.items[-1].anchor_after = True
                anchored = True
            elif kind == "without":
                p.without.append(self.next()[1])
            elif (kind, value) == ("punct", "(") and self.i + 1 < len(self.toks) and self.toks[self.i + 1][0] == "pred":
                self.next()
                self.predicate()
            else:
                c = self.item()
                c.anchor_before, anchored = anchored, False
                p.items.append(c)
        self.next()


@lru_cache(maxsize=4096)
def compile_query(text: str) -> Query:
    return _Reader(text).query()


Binding = tuple[tuple[str, Node], ...]


def _fits(p: Pattern, n: Node) -> bool:
    if p.kind == "_":
        return True
    if p.kind == "(_)":
        return n.named
    return n.kind == p.kind and n.named == p.named


def _one(p: Pattern, n: Node) -> Iterator[Binding]:
    """Bindings of p at node n, captures in pattern order."""
    if p.field is not None and n.field != p.field:
        return
    own = tuple((t, n) for t in p.captures)
    if p.kind == "alt":
        for a in p.items:
            for b in _one(a, n):
                yield own + b
        return
    if p.kind == "group" or not _fits(p, n) or any(n.by_field(f) for f in p.without):
        return
    if not p.items:
        yield own
        return
    for b in _sequence(p.items, 0, n.children, 0, None):
        yield own + b


def _skippable(nodes: list[Node], a: int, b: int) -> bool:
    """No named node but comments in nodes[a:b]."""
    return not any(x.named and "comment" not in x.kind for x in nodes[a:b])


def _sequence(items: list[Pattern], k: int, nodes: list[Node], at: int, last: int | None) -> Iterator[Binding]:
    """Bindings of items[k:] as an in-order subsequence of nodes[at:]."""
    if k == len(items):
        yield ()
        return
    p = items[k]

    def placed(i: int) -> bool:
        if p.anchor_before and not _skippable(nodes, 0 if last is None else last + 1, i):
            return False
        return not (p.anchor_after and not _skippable(nodes, i + 1, len(nodes)))

    if p.kind == "group":
        if p.quantifier in ("?", "*"):
            matched = False
            for b in _sequence([*p.items, *items[k + 1 :]], 0, nodes, at, last):
                matched = True
                yield b
            if not matched:
                yield from _sequence(items, k + 1, nodes, at, last)
        else:
            yield from _sequence([*p.items, *items[k + 1 :]], 0, nodes, at, last)
        return
    if p.quantifier in ("*", "+"):
        # the longest run of neighbours (comments and tokens between them aside) from the first fit
        for i in range(at, len(nodes)):
            first = next(_one(p, nodes[i]), None)
            if first is None or not placed(i) and p.anchor_before:
                continue
            runs = [(first, i)]
            for m in range(i + 1, len(nodes)):
                b = next(_one(p, nodes[m]), None)
                if b is not None:
                    runs.append((runs[-1][0] + b, m))
                elif nodes[m].named and "comment" not in nodes[m].kind:
                    break
            for got, j in reversed(runs):
                if p.anchor_after and not _skippable(nodes, j + 1, len(nodes)):
                    continue
                hit = False
                for rest in _sequence(items, k + 1, nodes, j + 1, j):
                    hit = True
                    yield got + rest
                if hit:
                    return
        if p.quantifier == "*":
            yield from _sequence(items, k + 1, nodes, at, last)
        return
    optional = p.quantifier == "?"
    hit = False
    for i in range(at, len(nodes)):
        if p.anchor_before and not placed(i):
            if not _skippable(nodes, 0 if last is None else last + 1, i):
                break
            continue
        for b in _one(p, nodes[i]):
            if not placed(i):
                continue
            for rest in _sequence(items, k + 1, nodes, i + 1, i):
                hit = True
                yield b + rest
        if hit and optional:
            return
    if optional and not hit:
        yield from _sequence(items, k + 1, nodes, at, last)


def _holds(predicates: list[tuple], binding: Binding, tree: Tree) -> bool:
    texts: dict[str, list[str]] = {}
    for t, n in binding:
        texts.setdefault(t, []).append(tree.text(n))
    for name, args in predicates:
        left = texts.get(args[0][1], []) if args[0][0] == "tag" else [args[0][1]]
        if name == "any-of?":
            options = {v for _, v in args[1:]}
            if not all(x in options for x in left):
                return False
            continue
        if args[1][0] == "tag":
            right = texts.get(args[1][1], [])
            if not left or not right:
                continue
            same = left == right
        elif name.endswith("match?"):
            if not left:
                continue
            same = all(re.search(args[1][1], x) for x in left)
            if name == "not-match?":
                same = any(re.search(args[1][1], x) for x in left)
        else:
            if not left:
                continue
            same = all(x == args[1][1] for x in left)
            if name == "not-eq?":
                same = any(x == args[1][1] for x in left)
        if same == name.startswith("not-"):
            return False
    return True


@dataclass
class TreeMatch:
    start: int
    end: int
    captures: dict[str, str]
    outer: tuple[int, int]
    reach: tuple[int, int]  # the nodes that the patterns were matched at


def _of_span(node: Node) -> Iterator[Node]:
    """node and the nodes below it of the same span, in pre-order."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if c.start == node.start and c.end == node.end)


def find_all(tree: Tree, node: Node, text: str, recursive: bool = True, replace_node: str | None = None, replace_idx: int | None = None) -> list[TreeMatch]:
    """Matches under node, last in the file first.

    Raw matches are grouped by the span of their first capture; a group counts
    only with exactly as many raw matches as the query has patterns.  The span of
    replace_node (its replace_idx-th named child, if given) is the match's span.
    """
    q = compile_query(text)
    groups: dict[tuple[int, int], list[Binding]] = {}
    reach: dict[tuple[int, int], tuple[int, int]] = {}
    for n in node.walk() if recursive else _of_span(node):
        for p, preds in zip(q.patterns, q.predicates, strict=True):
            if p.kind not in ("alt", "group") and not _fits(p, n):
                continue
            for b in _one(p, n):
                if b and _holds(preds, b, tree):
                    first = b[0][1]
                    span = first.start, first.end
                    groups.setdefault(span, []).append(b)
                    low, high = reach.get(span, span)
                    reach[span] = min(low, n.start), max(high, n.end)
    out = []
    for span, found in groups.items():
        if len(found) != len(q.patterns) or not recursive and span != (node.start, node.end):
            continue
        captured: dict[str, list[str]] = {t: [] for t in q.tags}
        target: Node | None = None
        for b in found:
            for t, n in b:
                captured[t].append(tree.text(n))
                if target is None and t == replace_node:
                    target = n
        start, end = span
        if replace_node:
            if target is None:
                raise QueryError(f"no capture is named {replace_node}")
            if replace_idx is not None:
                kids = target.named_children()
                if replace_idx >= len(kids):
                    continue
                target = kids[replace_idx]
            start, end = target.start, target.end
        out.append(TreeMatch(start, end, {t: "\n".join(v) for t, v in captured.items()}, span, reach[span]))
    return sorted(out, key=lambda m: (-m.start, m.end))
