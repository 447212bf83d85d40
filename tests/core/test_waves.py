"""Edits of filtered rules in waves are those made one by one, and don't cost a parse each."""

import time

import pytest

from treeflow.operators import tree_query
from treeflow.operators.rewrite import Unit
from treeflow.plans.graph import RuleGraph
from treeflow.plans.model import Filter, Options, Rule

METHOD = "((method_declaration name: (identifier) @m) @d)"
FILTERS = [
    Filter(enclosing_node=METHOD),
    Filter(enclosing_node=METHOD, contains='((method_invocation name: (identifier) @k) @kk (#eq? @k "keep"))'),
    Filter(enclosing_node=METHOD, not_contains=('((method_invocation name: (identifier) @k) @kk (#eq? @k "fresh"))',)),
    Filter(not_enclosing_node="(if_statement) @i"),
    Filter(outermost_enclosing_node="(block) @b", contains="(method_invocation) @mi", at_most=2),
    Filter(sibling_count=1),
]


def run(code, f, replace="fresh@a", wave=True):
    rule = Rule("r", '((method_invocation name: (identifier) @n arguments: (_) @a) @c (#eq? @n "old"))', replace_node="c", replace=replace, filters=(f,))
    graph = RuleGraph([rule])
    unit = Unit("/a.java", code, graph, Options())
    if not wave:
        unit.wave = lambda inst, node: []
    unit.run(graph.seeds({}))
    return unit


#: The last replacement has a fixpoint only under the filter that looks for it.
CASES = [(f, r) for f in FILTERS for r in ("fresh@a", "fresh(@n)")] + [(FILTERS[2], "fresh(old@a)")]


@pytest.mark.parametrize(("f", "replace"), CASES)
def test_waves_equal_single_edits(f, replace):
    code = "class A { /* é */ void a() { old(1); keep(); old(2); } void b() { if (x) { old(3); } } void c() { fresh(0); old(4); } void d() { old(5); keep(); } int e = old(6); }"
    a, b = run(code, f, replace), run(code, f, replace, wave=False)
    assert a.code == b.code
    assert sorted((e.match.text, e.replacement) for e in a.rewrites) == sorted((e.match.text, e.replacement) for e in b.rewrites)


def test_many_filtered_edits_of_a_file():
    code = "class A { " + " ".join(f"void m{i}() {{ old({i}); keep(); }}" for i in range(800)) + " }"
    began = time.time()
    unit = run(code, FILTERS[1])
    assert len(unit.rewrites) == 800 and "old" not in unit.code and time.time() - began < 10


def test_edits_without_filters_are_looked_for_once_a_pass(monkeypatch):
    calls, find_all = [], tree_query.find_all
    monkeypatch.setattr(tree_query, "find_all", lambda *a: (calls.append(a), find_all(*a))[1])
    r = Rule("r", "((argument_list . (identifier) @a . (decimal_integer_literal) @b) @list)", replace_node="list", replace_idx=1, replace="N@b")
    g = RuleGraph([r])
    u = Unit("A.java", "class A { int f() { p(a, 1); return p(b, 2); } }", g, Options())
    u.run(g.seeds({}))
    assert u.code == "class A { int f() { p(a, N1); return p(b, N2); } }" and len(u.rewrites) == 2
    assert len(calls) == 2  # one that finds both, one that finds none
