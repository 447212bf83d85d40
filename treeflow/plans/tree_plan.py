"""Tree queries and programs that only look, as DataFrame plans over a table of nodes.

Units are parsed once into rows (``parsed``), the only Python there is; of a tree, only
the nodes that the program's queries can ask for (``Wanted``) become rows.  A pattern
then becomes joins: a node test is a filter; a child is an equi join on the parent's
number, in order by the children's positions; an anchor compares counts of solid
siblings; an alternation is a union; a negated field an anti join; a closing run
(``* +``) an island of neighbours that fit; ``?`` keeps the first place that leads to
a whole match.  A binding is a row with its captures in order and the trail of choices
that makes it; bindings with the same first capture form a match where there are as
many as the query has patterns.  Filters are interval joins over tiles of the node
numbers (``containment.TILE``), so a large tree or a hot path is many keys.

``why_not`` says what keeps a program from being planned: edits, edges, other dialects,
patterns that take over captures of the match, runs before other items, regular
expressions that the JVM reads differently.  ``execute.execute`` then runs the loop.
Paths are keys: units with equal paths are for the loop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import instantiate as put
from ..functions.text import point_column, point_row
from ..operators import containment as ct
from ..operators import languages, tree_query
from ..operators.tree_query import Pattern, Query
from ..operators.trees import Node
from .graph import RuleGraph
from .materialise import discard, keep
from .model import Filter, Instance, Options, Rule, dialect, instantiate

NODES = "path string, pre int, post int, parent_pre int, depth int, child_idx int, named_idx int, kind string, field string, is_named boolean, start int, end int, solid_before int, solid_after int, n_children int, n_named int, error string"
PATTERN_CAPTURE = "struct<tag: string, pre: int, start: int, end: int, text: string>"
LAST = 2**31 - 1


class NotPlanned(ValueError):
    """What a plan does not express; the loop does."""


# nodes ------------------------------------------------------------------------------


class Wanted:
    """Which nodes some tree queries can ask for: those that a node test of theirs fits, tested below what its parent's test fits."""

    def __init__(self, texts: list[str], parents: bool = False, inner: bool = False):
        self.tests: list[tuple[Pattern | None, Pattern | str]] = []  # (the parent's test, the node's, or a field that must not be there)
        self.parents = parents  # the nodes above them as well
        self.inner = inner  # every node with children as well
        self.known: dict[tuple, bool] = {}
        for t in texts:
            for p in tree_query.compile_query(t).patterns:
                self.add(p, None)

    def add(self, p: Pattern, parent: Pattern | None) -> None:
        if p.kind in ("alt", "group"):
            for c in p.items:
                self.add(c, parent)
            return
        self.tests += [(parent, p), *((p, f) for f in p.without)]
        for c in p.items:
            self.add(c, p)

    def __call__(self, n: Node) -> bool:
        if self.inner and n.children:
            return True
        up = n.parent
        key = (n.kind, n.named, n.field, up and up.kind, up and up.named)
        got = self.known.get(key)
        if got is None:
            above = [t for p, t in self.tests if p is None or up is not None and tree_query._fits(p, up)]
            got = self.known[key] = any(t == n.field if isinstance(t, str) else tree_query._fits(t, n) for t in above)
        return got


def _rows(path: str, content: str, language: languages.Language, dirty: bool, wanted: Wanted | None = None) -> tuple[list[tuple], str | None]:
    tree = language.parse(content)
    if not dirty and tree.errors():
        return [], f"{path}: syntax error"
    nodes = list(tree.root.walk())
    number = {n: i for i, n in enumerate(nodes)}
    post = list(range(len(nodes)))
    depth = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if kids := nodes[i].children:
            post[i] = post[number[kids[-1]]]
    for i in range(1, len(nodes)):
        depth[i] = depth[number[nodes[i].parent]] + 1
    some = nodes
    if wanted is not None:
        # nodes of one span stand for each other in filters
        spans = {(n.start, n.end) for n in nodes if wanted(n)}
        some = [n for n in nodes if (n.start, n.end) in spans]
        if wanted.parents:
            more = {number[n.parent] for n in some if n.parent is not None}
            some = [nodes[i] for i in sorted(more | {number[n] for n in some})]
    places: dict[Node | None, dict[Node, tuple]] = {None: {tree.root: (0, 0, 0, 0)}}
    rows = []
    for n in some:
        at, up = number[n], n.parent
        if up not in places:
            places[up] = _places(up.children)
        child, named, before, after = places[up][n]
        rows.append((path, at, post[at], None if up is None else number[up], depth[at], child, named, n.kind, n.field, n.named, n.start, n.end, before, after, len(n.children), sum([c.named for c in n.children]), None))
    return rows, None


def _places(kids: list[Node]) -> dict[Node, tuple]:
    """Of each child: its index, its index among named ones, and how many solid siblings stand before and after it."""
    solid = [c.named and "comment" not in c.kind for c in kids]
    out, named, seen, left = {}, 0, 0, sum(solid)
    for i, c in enumerate(kids):
        left -= solid[i]
        out[c] = (i, named if c.named else None, seen, left)
        seen += solid[i]
        named += c.named
    return out


#: Rows that wait for one Arrow batch; a tree is never cut.
ROWS_A_BATCH = 8192


def parsed(units: DataFrame, language: str, dirty: bool = False, wanted: Wanted | None = None) -> DataFrame:
    """NODES of units (path, content), or those that are wanted; a unit that can't be parsed is one row with its error."""
    lang = languages.language(language)
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in NODES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows, error = _rows(path, content or "", lang, dirty, wanted)
                except Exception as e:  # whatever a file does to its parser is that file's error, not the job's
                    rows, error = [], str(e) if isinstance(e, ValueError) else f"{path}: {type(e).__name__}: {e}"[:500]
                done += rows or ([(path, *[None] * (len(names) - 2), error)] if wanted is None or error is not None else [])
                if len(done) >= ROWS_A_BATCH:
                    yield batch(done)
                    done = []
        if done:
            yield batch(done)

    return units.select("path", "content").mapInArrow(run, NODES)


# patterns ---------------------------------------------------------------------------


def portable(regex: str) -> str:
    """The regex for the JVM, read as the loop reads it; refused where the two may differ."""
    if re.search(r"\(\?[^:=!<]|\(\?<[^=!]|&&|\\[ZzGAhHvVRXpPkQEuUxN0-9]|[*+?}]\+", regex) or re.search(r"\[[^\]]*\[", regex):
        raise NotPlanned(f"regular expression {regex}")
    return f"(?dU){regex}"


def check(query: Query) -> None:
    """Raises NotPlanned for what ``bindings`` does not express."""

    def look(p: Pattern, last: bool, top: bool = False) -> None:
        if p.kind == "group":
            if top or p.quantifier:
                raise NotPlanned("a group with a quantifier or at the top")
        elif p.quantifier in ("*", "+"):
            leaf = not p.items or p.kind == "alt" and not any(a.items or a.quantifier or a.without for a in p.items)
            if top or not last or not leaf or p.without or p.anchor_before and p.anchor_after:
                raise NotPlanned("a run that is not of plain nodes at the end")
        elif top and p.quantifier:
            raise NotPlanned("a quantifier at the top")
        items = _flat(p.items) if p.kind != "alt" else p.items
        for i, c in enumerate(items):
            look(c, p.kind != "alt" and i == len(items) - 1)

    for p in query.patterns:
        look(p, False, True)
    for preds in query.predicates:
        for name, args in preds:
            if name.endswith("match?"):
                portable(args[1][1])


def _flat(items: list[Pattern]) -> list[Pattern]:
    """Items with plain groups opened."""
    return [x for p in items for x in (_flat(p.items) if p.kind == "group" and not p.quantifier else [p])]


def _fits(p: Pattern) -> Column:
    test = F.lit(True) if p.kind == "_" else F.col("is_named") if p.kind == "(_)" else (F.col("kind") == p.kind) & (F.col("is_named") == p.named)
    return test if p.field is None else test & (F.col("field") == p.field)


def _own(p: Pattern) -> Column:
    got = [F.struct(F.lit(t).alias("tag"), F.col("pre"), F.col("start"), F.col("end"), F.lit(None).cast("string").alias("text")) for t in p.captures]
    return (F.array(*got) if got else F.array()).cast(f"array<{PATTERN_CAPTURE}>")


def bindings(nodes: DataFrame, p: Pattern) -> DataFrame:
    """path, pre, post, parent_pre, child_idx, start, end, solid, solid_before, solid_after, trail, caps of every way in which p matches at a node."""
    solid = (F.col("is_named") & ~F.contains("kind", F.lit("comment"))).cast("int")
    columns = ["path", "pre", "post", "parent_pre", "child_idx", "start", "end", solid.alias("solid"), "solid_before", "solid_after"]
    if p.kind == "alt":
        parts = []
        for i, a in enumerate(p.items):
            some = nodes if p.field is None else nodes.filter(F.col("field") == p.field)
            b = bindings(some if not a.items else nodes, a)
            if p.field is not None and a.items:
                b = b.join(some.select("path", "pre"), ["path", "pre"], "left_semi").select(b.columns)
            parts.append(b.withColumn("trail", F.concat(F.array(F.lit(i)), "trail")).withColumn("caps", F.concat(_own(p), "caps")))
        return reduce(DataFrame.unionByName, parts)
    base = nodes.filter(_fits(p))
    for f in p.without:
        has = nodes.filter(F.col("field") == f).select("path", F.col("parent_pre").alias("pre"))
        base = base.join(has, ["path", "pre"], "left_anti")
    base = base.select(*columns, F.array().cast("array<int>").alias("trail"), _own(p).alias("caps"))
    return _sequence(nodes, base, _flat(p.items)) if p.items else base


def _sequence(nodes: DataFrame, base: DataFrame, items: list[Pattern]) -> DataFrame:
    """base with the items placed among each node's children, in order."""
    now = base.withColumn("at", F.lit(-1)).withColumn("passed", F.lit(0))
    choices: list[str] = []
    for k, p in enumerate(items):
        if p.quantifier in ("*", "+"):
            now = _closing_run(nodes, now, p)
            break
        b = bindings(nodes, p)
        if p.anchor_after:
            b = b.filter("solid_after = 0")
        b = b.select("path", F.col("parent_pre").alias("pre"), *(F.col(c).alias(f"b_{c}") for c in ("child_idx", "solid", "solid_before", "trail", "caps")))
        if p.quantifier == "?":
            now = now.withColumn(f"trail_{k}", F.col("trail"))
        place = F.col("b_child_idx") > F.col("at")
        if p.anchor_before:
            place &= F.col("b_solid_before") == F.col("passed")
        hit = now.join(b, ["path", "pre"]).filter(place)
        hit = hit.withColumns(
            {
                "at": F.col("b_child_idx"),
                "passed": F.col("b_solid_before") + F.col("b_solid"),
                "trail": F.concat("trail", F.array("b_child_idx"), "b_trail"),
                "caps": F.concat("caps", "b_caps"),
            }
        )
        if p.quantifier == "?":
            choices.append(str(k))
            hit, now = hit.withColumn(f"choice_{k}", F.col("b_child_idx")), now.withColumn(f"choice_{k}", F.lit(LAST))
            now = hit.select(now.columns).unionByName(now)
        else:
            now = hit.select(now.columns)
    for k in choices:  # the first place of an optional item that the rest agrees with; left out where there is none
        first = F.min(f"choice_{k}").over(W.partitionBy("path", "pre", f"trail_{k}"))
        now = now.withColumn("first", first).filter(F.col(f"choice_{k}") == F.col("first"))
    return now.select(base.columns)


def _closing_run(nodes: DataFrame, now: DataFrame, p: Pattern) -> DataFrame:
    """The last item's longest run of neighbouring children that fit, from the first that may begin it."""
    fits = bindings(nodes, p)
    if p.kind == "alt":  # of several alternatives that a node fits, the first counts
        fits = fits.groupBy("path", "parent_pre", "child_idx").agg(*(F.min_by(c, F.col("trail")[0]).alias(c) for c in ("solid", "solid_before", "solid_after", "caps")))
    order = W.partitionBy("path", "parent_pre").orderBy("child_idx")
    broken = F.col("solid_before") > F.lag(F.col("solid_before") + F.col("solid"), 1, 0).over(order)
    fits = fits.withColumn("island", F.sum(F.when(broken, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    closes = F.min("solid_after").over(W.partitionBy("path", "parent_pre", "island")) == 0
    each = F.struct("child_idx", "solid_before", "island", closes.alias("closes"), "caps")
    runs = fits.withColumn("each", each).groupBy("path", F.col("parent_pre").alias("pre")).agg(F.sort_array(F.collect_list("each")).alias("runs"))

    def may_begin(x: Column) -> Column:
        test = x["child_idx"] > F.col("at")
        if p.anchor_before:
            test &= x["solid_before"] == F.col("passed")
        return test & x["closes"] if p.anchor_after else test

    got = now.join(runs, ["path", "pre"], "left" if p.quantifier == "*" else "inner")
    begin = F.filter("runs", may_begin)
    got = got.withColumn("begin", F.when(F.size(begin) > 0, F.element_at(begin, 1)))
    if p.quantifier == "+":
        got = got.filter(F.when(F.col("at") >= -1, F.col("begin").isNotNull()))  # kept above the join that brings the runs
    run = F.filter("runs", lambda x: (x["child_idx"] >= F.col("begin.child_idx")) & (x["island"] == F.col("begin.island")))
    caps = F.when(F.col("begin").isNull(), F.col("caps")).otherwise(F.concat("caps", F.flatten(F.transform(run, lambda x: x["caps"]))))
    return got.withColumn("caps", caps).select(now.columns)


def with_texts(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows with the text of every capture, cut from the unit's bytes (raw)."""
    raw = units.select("path", F.encode(F.coalesce("content", F.lit("")), "UTF-8").alias("raw"))
    fill = F.transform("caps", lambda c: F.struct(c["tag"].alias("tag"), c["pre"].alias("pre"), c["start"].alias("start"), c["end"].alias("end"), F.substring(F.col("raw"), c["start"] + 1, c["end"] - c["start"]).cast("string").alias("text")))
    return rows.join(raw, "path").withColumn("caps", fill)


def _texts(kind: str, value: str) -> Column:
    if kind == "text":
        return F.array(F.lit(value))
    return F.transform(F.filter("caps", lambda c: c["tag"] == value), lambda c: c["text"])


def _among(values: list[str]):
    return lambda x: x.isin(values)


def _found(regex: str):
    return lambda x: x.rlike(regex)


def _holds(predicates: list[tuple]) -> Column:
    out = F.lit(True)
    for name, args in predicates:
        left = _texts(*args[0])
        if name == "any-of?":
            out &= F.forall(left, _among([v for _, v in args[1:]]))
            continue
        if args[1][0] == "tag":
            right = _texts(*args[1])
            free, same = (F.size(left) == 0) | (F.size(right) == 0), left == right
        else:
            test = _found(portable(args[1][1])) if name.endswith("match?") else _among([args[1][1]])
            free, same = F.size(left) == 0, F.exists(left, test) if name.startswith("not-") else F.forall(left, test)
        out &= free | (~same if name.startswith("not-") else same)
    return out


def raw_matches(units: DataFrame, nodes: DataFrame, text: str, texts: bool = True) -> DataFrame:
    """path, root, root_post, root_start, root_end, pattern, trail, caps and the span (start, end) of the first capture."""
    q = tree_query.compile_query(text)
    check(q)
    parts = []
    for i, (p, preds) in enumerate(zip(q.patterns, q.predicates, strict=True)):
        b = bindings(nodes, p).filter(F.size("caps") > 0)
        if preds or texts:
            b = with_texts(b, units)
            if preds:  # said of the bytes as well, so that the test isn't moved below the join that brings them
                b = b.filter(F.when(F.octet_length("raw") >= 0, _holds(preds)))
        parts.append(b.select("path", "pre", "start", "end", "trail", "caps", F.lit(i).alias("pattern")))
    rows = reduce(DataFrame.unionByName, parts)
    head = F.element_at("caps", 1)
    return rows.select("path", F.col("pre").alias("root"), F.col("start").alias("root_start"), F.col("end").alias("root_end"), "pattern", "trail", "caps", head["start"].alias("start"), head["end"].alias("end"))


def find_all(units: DataFrame, nodes: DataFrame, text: str, replace_node: str | None = None, replace_idx: int | None = None) -> DataFrame:
    """path, start, end, captures (map), outer_start, outer_end of every match, as ``tree_query.find_all``."""
    q = tree_query.compile_query(text)
    each = F.struct("root", "pattern", "trail", "caps")
    groups = raw_matches(units, nodes, text).groupBy("path", F.col("start").alias("outer_start"), F.col("end").alias("outer_end")).agg(F.sort_array(F.collect_list(each)).alias("found"))
    groups = groups.filter(F.size("found") == len(q.patterns)).withColumn("caps", F.flatten(F.transform("found", lambda x: x["caps"])))
    values = [F.array_join(_texts("tag", t), "\n") for t in q.tags]
    captures = F.map_from_arrays(F.array(*map(F.lit, q.tags)), F.array(*values)) if q.tags else F.create_map().cast("map<string,string>")
    out = groups.withColumn("captures", captures)
    if not replace_node:
        return out.select("path", F.col("outer_start").alias("start"), F.col("outer_end").alias("end"), "captures", "outer_start", "outer_end")
    target = F.filter("caps", lambda c: c["tag"] == replace_node)
    out = out.withColumn("target", F.when(F.size(target) > 0, F.element_at(target, 1)).otherwise(F.raise_error(F.lit(f"no capture is named {replace_node}")).cast(PATTERN_CAPTURE)))
    if replace_idx is None:
        return out.select("path", "target.start", "target.end", "captures", "outer_start", "outer_end")
    kids = nodes.filter((F.col("named_idx") == replace_idx) & F.col("is_named")).select("path", F.col("parent_pre").alias("target_pre"), "start", "end")
    return out.withColumn("target_pre", F.col("target.pre")).join(kids, ["path", "target_pre"]).select("path", "start", "end", "captures", "outer_start", "outer_end")


# filters ----------------------------------------------------------------------------


def whole_hits(units: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """path, pre, post, depth of the nodes that match the query as a whole: by bindings rooted in nodes of their own span."""
    k = len(tree_query.compile_query(text).patterns)
    raw = raw_matches(units, nodes, text, texts=False).filter("root_start = start AND root_end = end").select("path", "start", "end", "root")
    chain = nodes.select("path", "start", "end", "pre", "post", "depth")
    hit = chain.join(raw, ["path", "start", "end"]).filter(F.col("root").between(F.col("pre"), F.col("post")))
    return hit.groupBy("path", "pre", "post", "depth").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")


def matches_inside(scopes: DataFrame, units: DataFrame, nodes: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and n: how many matches of the query the subtree of each scope (path, pre, post) holds; none for no match."""
    k = len(tree_query.compile_query(text).patterns)
    raw = raw_matches(units, nodes, text, texts=False).select("path", F.col("root").alias("i_pre"), F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    inside = ct.pairs_inside(scopes, raw)
    groups = inside.groupBy(*keys, "i_start", "i_end").agg(F.count(F.lit(1)).alias("raw")).filter(F.col("raw") == k)
    return groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


#: What a match is known by; its node's numbers go along.
KEY = ["path", "start", "end"]


def _climbed(found: DataFrame, hits: DataFrame, outermost: bool) -> DataFrame:
    """found with the numbers of the node that its scope lies in; a leaf is not its own ancestor."""
    scopes = found.select(*KEY, F.col("scope_pre").alias("pre"), "scope_leaf")
    pairs = ct.pairs_around(scopes, hits).filter(~F.col("scope_leaf") | (F.col("a_pre") < F.col("pre")))
    best = (F.min_by if outermost else F.max_by)(F.struct("a_pre", "a_post"), "a_depth")
    got = pairs.groupBy(*KEY).agg(best.alias("a"))
    return found.drop("scope_pre", "scope_post", "scope_leaf").join(got, KEY).select("*", F.col("a.a_pre").alias("scope_pre"), F.col("a.a_post").alias("scope_post"), F.lit(False).alias("scope_leaf")).drop("a")


def passing(found: DataFrame, f: Filter, units: DataFrame, nodes: DataFrame, facts: DataFrame | None, substitutions: Mapping[str, str]) -> DataFrame:
    """The matches that pass a filter; patterns hold no captures of theirs."""
    columns, get = found.columns, lambda p: instantiate(p, substitutions, pattern=True)
    if f.fact_filter:
        if facts is None:
            return found.filter(F.lit(False))
        test, own = F.lit(True), found.select(*KEY, "captures")
        for k, v in f.fact_filter:
            test &= F.try_element_at("data", F.lit(k)) == _filled(v, substitutions, own)
        held = own.join(facts.select("path", "data"), "path").filter(test).select(*KEY)
        found = found.join(held, KEY, "left_semi").select(columns)
    if f.child_count is not None:
        return found.filter(F.col("node_named") == f.child_count)
    if f.sibling_count is not None:
        above = nodes.filter(F.col("n_named") == f.sibling_count).select("path", F.col("pre").alias("node_parent"))
        return found.join(above, ["path", "node_parent"], "left_semi").select(columns)
    scoped = found.withColumns({"scope_pre": F.col("node_pre"), "scope_post": F.col("node_post"), "scope_leaf": F.col("node_leaf")})
    if f.enclosing_node:
        scoped = _climbed(scoped, whole_hits(units, nodes, get(f.enclosing_node)), False)
    if f.outermost_enclosing_node:
        scoped = _climbed(scoped, whole_hits(units, nodes, get(f.outermost_enclosing_node)), True)
    if f.not_enclosing_node:
        at = found.withColumns({"scope_pre": F.col("node_pre"), "scope_post": F.col("node_post"), "scope_leaf": F.col("node_leaf")})
        scoped = scoped.join(_climbed(at, whole_hits(units, nodes, get(f.not_enclosing_node)), False).select(*KEY), KEY, "left_anti")
    scopes = scoped.select(*KEY, F.col("scope_pre").alias("pre"), F.col("scope_post").alias("post"))
    if f.contains:
        n = matches_inside(scopes, units, nodes, get(f.contains), KEY)
        if f.at_least == 0:
            test = F.coalesce("n", F.lit(0))
            scoped = scoped.join(n, KEY, "left").filter(F.lit(True) if f.at_most is None else test <= f.at_most)
        else:
            scoped = scoped.join(n.filter(F.col("n").between(f.at_least, LAST if f.at_most is None else f.at_most)), KEY)
    for p in f.not_contains:
        scoped = scoped.join(matches_inside(scopes, units, nodes, get(p), KEY), KEY, "left_anti")
    return scoped.select(columns)


# programs ---------------------------------------------------------------------------

TAG = re.compile(r"@([\w.-]+)|:\[([\w.-]+)\]")


def _filled(template: str, substitutions: Mapping[str, str], found: DataFrame) -> Column:
    """A template with captures and substitutions put in; captures win."""
    tags = {a or b for a, b in TAG.findall(template)}
    values = {k: F.lit(v) for k, v in substitutions.items()} | {t: F.try_element_at("captures", F.lit(t)) for t in tags if t not in substitutions}
    values |= {t: F.coalesce(F.try_element_at("captures", F.lit(t)), F.lit(substitutions[t])) for t in tags & set(substitutions)}
    return put(F.lit(template), values)


def why_not(graph: RuleGraph, options: Options, active: list[Instance]) -> str | None:
    """What keeps a program from being planned, or None."""
    if options.delete_consecutive_new_lines:
        return "blank lines are edited"
    for i in active:
        r = i.rule
        if not (r.is_match_only or r.fact):
            return f"rule {r.name} edits"
        if not graph.ends(r.name):
            return f"rules follow {r.name}"
        try:
            _check_rule(r, i.query, options.substitutions)
        except NotPlanned as e:
            return f"rule {r.name}: {e}"
    return None


def _check_rule(r: Rule, query: str, substitutions: Mapping[str, str]) -> None:
    if dialect(query) != "tree":
        raise NotPlanned("another dialect")
    q = tree_query.compile_query(query)
    check(q)
    for _, v in r.fact:
        if not {a or b for a, b in TAG.findall(v)} <= set(q.tags) | set(substitutions):
            raise NotPlanned("a fact of captures of other rules")
    for f in r.filters:
        for p in (f.enclosing_node, f.outermost_enclosing_node, f.not_enclosing_node, f.contains, *f.not_contains):
            if not p:
                continue
            if dialect(p) != "tree":
                raise NotPlanned("another dialect")
            if any(f"@{t}" in p or f":[{t}]" in p for t in q.tags):
                raise NotPlanned("a filter that takes over captures")
            check(tree_query.compile_query(instantiate(p, substitutions, pattern=True)))
        for _, v in f.fact_filter:
            if not {a or b for a, b in TAG.findall(v)} <= set(q.tags) | set(substitutions):
                raise NotPlanned("a fact filter with unknown tags")


def rule_matches(units: DataFrame, nodes: DataFrame, inst: Instance, facts: DataFrame | None, substitutions: Mapping[str, str]) -> DataFrame:
    """path, start, end, captures of the matches of one rule that pass its filters."""
    found = find_all(units, nodes, inst.query).select(*KEY, "captures")
    if inst.rule.filters:
        # a match's node is the deepest of its span
        at = nodes.select(*KEY, F.struct(F.col("pre").alias("node_pre"), F.col("post").alias("node_post"), (F.col("n_children") == 0).alias("node_leaf"), F.col("parent_pre").alias("node_parent"), F.col("n_named").alias("node_named")).alias("node"))
        at = at.join(found.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.max("node").alias("node"))
        found = found.join(at, KEY).select(*KEY, "captures", "node.*")
        for f in inst.rule.filters:
            found = passing(found, f, units, nodes, facts, substitutions)
    return found.select(*KEY, "captures")


def asked(active: list[Instance], substitutions: Mapping[str, str]) -> Wanted:
    """The nodes that rules and their filters can ask for."""
    filters = [f for i in active for f in i.rule.filters]
    inner = [p for f in filters for p in (f.enclosing_node, f.outermost_enclosing_node, f.not_enclosing_node, f.contains, *f.not_contains) if p]
    return Wanted([i.query for i in active] + [instantiate(p, substitutions, pattern=True) for p in inner], parents=any(f.sibling_count is not None for f in filters))


def run(units: DataFrame, active: list[Instance], options: Options, schema, store=None) -> DataFrame:
    """Summaries (columns of the loop's) of the units that hold matches or facts, or failed.

    With a NodeStore, only units that it hasn't parsed are parsed."""
    units = keep(units.select("path", "content"), "units")  # read by every part below
    nodes = keep(parsed(units, options.language, options.allow_dirty_ast, asked(active, options.substitutions)), "nodes") if store is None else store.nodes(units)
    errors = nodes.filter("error IS NOT NULL").select("path", "error")
    real = nodes.filter("pre IS NOT NULL")
    parts, facts = [], None
    for order, i in enumerate(active):
        found = rule_matches(units, real, i, facts, options.substitutions).withColumn("order", F.lit(order)).withColumn("rule", F.lit(i.rule.name))
        if i.rule.fact:
            filled = [(F.lit(k), _filled(v, options.substitutions, found)) for k, v in i.rule.fact]
            found = found.withColumn("data", F.create_map(*(x for pair in filled for x in pair)))
            mine = found.select("path", "start", "end", "order", "data")
            facts = mine if facts is None else facts.unionByName(mine)
        parts.append(found.select(*KEY, "order", "rule", "captures", *(F.col("data") if i.rule.fact else F.lit(None).cast("map<string,string>").alias("data") for _ in (0,))))
    found = reduce(DataFrame.unionByName, parts)
    found = found.join(units.select("path", "content"), "path").withColumn("raw", F.encode("content", "UTF-8"))

    def point(offset: str) -> Column:
        return F.struct(point_row(F.col("content"), F.col(offset)).cast("int").alias("row"), point_column(F.col("content"), F.col(offset)).cast("int").alias("column"))

    span = F.struct(F.col("start").cast("long").alias("start_byte"), F.col("end").cast("long").alias("end_byte"), point("start").alias("start_point"), point("end").alias("end_point"))
    text = F.substring(F.col("raw"), F.col("start") + 1, F.col("end") - F.col("start")).cast("string")
    m = F.struct("rule", F.struct(text.alias("matched_string"), span.alias("range"), F.col("captures").alias("matches")).alias("m"))
    fact = F.struct(span.alias("range"), "data", F.lit(False).alias("voided"))
    found = found.select("path", "order", (-F.col("start")).alias("back"), "end", F.when(F.col("data").isNull(), m).alias("m"), F.when(F.col("data").isNotNull(), fact).alias("f"), F.to_json("data").alias("as_text"))
    # equal facts of a span count once, whichever rule came first
    once = F.row_number().over(W.partitionBy("path", "back", "end", "as_text").orderBy("order"))
    found = found.withColumn("once", once).filter("m IS NOT NULL OR once = 1")
    listed = found.groupBy("path").agg(*(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("order", "back", "end", F.col(c).alias("x")))), _by_place).alias(c) for c in ("m", "f")))
    empty = {"rewrites": "array()"}
    done = units.select("path", "content").join(listed.join(errors, "path", "full"), "path")
    values = {
        "original_content": F.col("content"),
        "matches": F.coalesce(F.transform("m", lambda e: e["x"]), F.array()),
        "facts": F.coalesce(F.transform("f", lambda e: e["x"]), F.array()),
        **{k: F.expr(v) for k, v in empty.items()},
    }
    names = [f.name for f in schema.fields if f.name not in ("bindings", "outgoing", "todo", "ran")]
    out = keep(done.select(*(values.get(c, F.col(c)).cast(schema[c].dataType).alias(c) for c in names)), "summary")
    discard(units)
    if store is None:
        discard(nodes)
    return out


def _by_place(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for c in ("end", "back", "order"):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out
