"""Tree queries and looking programs as plans, against the per-file engine."""

import pytest

from treeflow import plan_queries
from treeflow.operators import containment as ct
from treeflow.operators import languages, tree_query
from treeflow.plans import execute as ex
from treeflow.plans import tree_plan as tp
from treeflow.plans.graph import RuleGraph
from treeflow.plans.materialise import keep
from treeflow.plans.model import Edge, Filter, Options, ProgramError, Rule

CODES = [
    "class A { int f(int a, int b) { g(a, b); g(a, a);\n return g(1); } /* é */ void h() { x.y(); done(); } }",
    "class B { // c1\n int z = 1, w; void k() { p(/* c */ 1, 2, 3); if (a) { q(); } else { q(q(1)); } } }",
    "class C {}",
    "class D { void m(String s) throws E1, E2 { try { m(); } catch (E1 e) { } finally { } } @Ann(1) int q; }",
]
PATTERNS = [
    "((method_invocation name: (identifier) @n arguments: (argument_list . (_) @a . (_) @b .)) @call)",
    "((method_invocation name: (identifier) @n arguments: (argument_list (_) @a)) @call)",
    "((method_invocation arguments: (argument_list (_)* @a)) @call)",
    "((argument_list . (_) @first (_)+ @rest .) @l)",
    "((argument_list (identifier)? @i (decimal_integer_literal) @d) @l)",
    "((method_invocation !object name: (_) @n) @c)",
    "[(if_statement) (return_statement)] @s",
    "((block [(expression_statement) (return_statement)]+ @s) @b)",
    '((method_invocation name: (identifier) @n) @c (#match? @n "^[gq]$"))',
    '((method_invocation name: (identifier) @n) @c (#not-eq? @n "g"))',
    "((method_invocation name: (identifier) @n arguments: (argument_list (method_invocation name: (identifier) @m))) @c (#eq? @n @m))",
    '((method_invocation name: (identifier) @n) @c (#any-of? @n "p" "q" "done"))',
    "(identifier) @a (identifier) @b",
    '((if_statement "else" @e) @s)',
    "((block (_) @a . (_) @b) @blk)",
    "((class_body (method_declaration)? @m (field_declaration)? @f) @b)",
    "((class_body (comment)* @m) @b)",
]
METHOD = "((method_declaration name: (identifier) @em) @ed)"
CALL = "((method_invocation name: (identifier) @n) @call)"
PROGRAMS = [
    [Rule("r", CALL)],
    [Rule("r", CALL, filters=(Filter(enclosing_node='((method_declaration name: (identifier) @em) @ed (#eq? @em "f"))'),))],
    [Rule("r", CALL, filters=(Filter(enclosing_node="(block) @blk", contains="(method_invocation) @mi", at_least=2),))],
    [Rule("r", CALL, filters=(Filter(outermost_enclosing_node="(block) @blk", contains="(method_invocation) @mi", at_least=0, at_most=3),))],
    [Rule("r", CALL, filters=(Filter(not_enclosing_node="(if_statement) @st"),))],
    [Rule("r", METHOD, filters=(Filter(not_contains=("(if_statement) @st", "(try_statement) @st")),))],
    [Rule("r", "(block) @b", filters=(Filter(child_count=2),)), Rule("s", "(identifier) @i", filters=(Filter(sibling_count=2),))],
    [
        Rule("facts", METHOD, fact=(("name", "@em"), ("flag", "@flag"))),
        Rule("again", "((method_declaration name: (identifier) @em) @x)", fact=(("name", "@em"), ("flag", "@flag"))),
        Rule("r", CALL, filters=(Filter(fact_filter=(("name", "h"), ("flag", "on"))),)),
    ],
]


@pytest.fixture(scope="module")
def java(spark):
    units = keep(spark.createDataFrame([(f"/f{i}", c) for i, c in enumerate(CODES)], "path string, content string"), "units")
    return units, keep(tp.parsed(units, "java"), "nodes").filter("pre IS NOT NULL")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_equal_the_engine(java, pattern):
    units, nodes = java
    parse = languages.language("java").parse
    want = [(f"/f{i}", m.start, m.end, sorted(m.captures.items()), m.outer) for i, c in enumerate(CODES) for t in [parse(c)] for m in tree_query.find_all(t, t.root, pattern)]
    got = [(r.path, r.start, r.end, sorted(r.captures.items()), (r.outer_start, r.outer_end)) for r in tp.find_all(units, nodes, pattern).collect()]
    assert sorted(got) == sorted(want)


def test_replaced_nodes(java):
    units, nodes = java
    tree = languages.language("java").parse(CODES[0])
    for idx in (None, 0, 1):
        want = [(m.start, m.end) for m in tree_query.find_all(tree, tree.root, "((method_invocation arguments: (_) @args) @c)", replace_node="args", replace_idx=idx)]
        got = tp.find_all(units, nodes, "((method_invocation arguments: (_) @args) @c)", "args", idx).filter("path = '/f0'")
        assert sorted((r.start, r.end) for r in got.collect()) == sorted(want)


def rows(df):
    return sorted(df.collect(), key=lambda r: r["path"])


@pytest.mark.parametrize("rules", PROGRAMS)
def test_both_paths_are_equal(spark, rules):
    units = spark.createDataFrame([*((f"/f{i}", c) for i, c in enumerate(CODES)), ("/bad", "class {{"), ("/none", None)], "path string, content string")
    options = Options(substitutions={"flag": "on"})
    plan, loop = (rows(ex.execute(units, RuleGraph(rules), options, path=p)) for p in ("plan", "loop"))
    assert plan == loop
    assert any(r["error"] for r in plan) and any(r["matches"] or r["facts"] for r in plan)


def test_what_is_not_planned(spark):
    units = spark.createDataFrame([("/f", CODES[0])], "path string, content string")
    taking = Rule("r", CALL, filters=(Filter(enclosing_node='((method_declaration name: (identifier) @em) @ed (#eq? @em "@n"))'),))
    for rules, edges in (([Rule("r", CALL, replace_node="call", replace="x()")], []), ([Rule("r", "rgx a")], []), ([taking], []), ([Rule("a", CALL), Rule("b", CALL)], [Edge("a", ("b",), "Global")])):
        with pytest.raises(ProgramError, match="no plan"):
            ex.execute(units, RuleGraph(rules, edges), path="plan")
    with pytest.raises(ProgramError):
        ex.execute(units, RuleGraph([taking]), path="neither")
    for pattern in ("((block (expression_statement)+ @a (return_statement) @r) @b)", '((identifier) @i (#match? @i "(?i)a"))'):
        with pytest.raises(tp.NotPlanned):
            tp.check(tree_query.compile_query(pattern))


def test_a_tree_of_many_tiles(spark):
    """Intervals that reach over several tiles pair with each node inside once."""
    n = 3 * ct.TILE + 7
    tree = spark.createDataFrame([("p", 0, n, 0, "top"), ("p", 5, n - 5, 1, "mid"), *(("p", i, i, 2, "leaf") for i in range(6, n - 5, 997))], "path string, pre int, post int, depth int, label string")
    leaves, outer = tree.filter("label = 'leaf'"), tree.filter("label <> 'leaf'")
    k = len(range(6, n - 5, 997))
    assert ct.pairs_around(leaves.select("path", "pre"), outer).count() == 2 * k
    assert {r.a_label for r in ct.enclosing(leaves.select("path", "pre"), outer).collect()} == {"mid"}
    assert {r.a_label for r in ct.enclosing(leaves.select("path", "pre"), outer, outermost=True).collect()} == {"top"}
    assert ct.not_enclosing(leaves.select("path", "pre"), outer).count() == 0
    assert ct.contains(outer, leaves, at_least=k, at_most=k).count() == 2 and ct.contains(outer, leaves).count() == 2
    assert ct.not_contains(outer, leaves).count() == 0 and ct.not_contains(leaves, leaves.limit(0)).count() == k
    ranges = spark.createDataFrame([("p", 7, n - 6), ("p", 3, n - 6)], "path string, lo int, hi int")
    assert {(r.lo, r.pre) for r in ct.smallest_covering(ranges, tree).collect()} == {(7, 5), (3, 0)}


def node_rows(monkeypatch, module, f):
    """What f gives, and how many rows of nodes were kept for it."""
    kept, sizes = module.keep, []

    def counted(df, name):
        out = kept(df, name)
        sizes.append(out.count() if name == "nodes" else 0)
        return out

    monkeypatch.setattr(module, "keep", counted)
    return f(), sum(sizes)


CALLS = "class C { int o1() { p1(f, 3); done(); return 1; } int o2() { p2(o, 7); return 2; } }"


@pytest.mark.parametrize(("pattern", "f", "most"), [("(expression_statement) @e", Filter(sibling_count=3), 8), ('((method_invocation name: (identifier) @n arguments: (argument_list . (_) @a . (_) @b .)) @call (#match? @n "^p"))', Filter(not_enclosing_node='((method_declaration name: (identifier) @em) @ed (#match? @em "2$"))'), 24), ('((method_invocation name: (identifier) @n arguments: (argument_list . (_) @a . (_) @b .)) @call (#match? @n "^p"))', Filter(enclosing_node='((method_declaration name: (identifier) @em) @ed (#match? @em "2$"))'), 24)])
def test_nodes_that_no_query_asks_for_are_not_kept(spark, monkeypatch, pattern, f, most):
    units = spark.createDataFrame([("A.java", CALLS)], "path string, content string")
    graph = RuleGraph([Rule("r", pattern, filters=(f,))])
    got, n = node_rows(monkeypatch, tp, lambda: ex.execute(units, graph, path="plan").collect())
    want = ex.execute(units, graph, path="loop").collect()
    assert got == want and got[0].matches
    assert 0 < n <= most


def test_nodes_of_queries_are_those_asked_for(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(15, 1, "F", "1-URGENT"), (27, 1, "O", "2-HIGH")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got, n = node_rows(monkeypatch, plan_queries, lambda: plan_queries.plan_two_patterns(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [("/c/1.java", "o15")] and n <= 18
    got, n = node_rows(monkeypatch, plan_queries, lambda: plan_queries.plan_smallest_covering(spark, str(tmp_path)).collect())
    assert sorted(r.text for r in got) == ["(f, 5)", "(o, 7)", "{ p1(f, 5); done(); return 1; }"] and n <= 36
