"""Plans: scans, text columns, node tables, program execution and streaming."""

import json

import pytest

from treeflow import api
from treeflow.functions import text as tx
from treeflow.operators import containment as ct
from treeflow.operators import languages, trees
from treeflow.plans import execute as ex
from treeflow.plans.graph import RuleGraph
from treeflow.plans.model import Edge, Options, ProgramError, Rule
from treeflow.sources import scan
from treeflow.streaming import watch


def test_globs():
    import re

    for glob, path, want in (("**/a*", "x/y/abc", True), ("*.java", "q/r.java", True), ("/r/[!x]?/", "/r/ab/", True), ("/r/[!x]?/", "/r/xb/", False), ("a.b", "axb", False)):
        assert bool(re.match(scan.glob_to_regex(glob), path)) == want


def test_grep_values():
    assert scan.grep_pattern(["b", "a", "", "True", "false", "a"]) == "a|b"
    assert scan.grep_pattern(["true"]) is None and scan.grep_pattern(["a.b"], escape=True) == "a\\.b"


def test_byte_columns(spark):
    df = spark.createDataFrame([("é\nxyz",)], "c string")
    row = df.select(tx.splice(df.c, tx.F.lit(3), tx.F.lit(4), tx.F.lit("Ü")).alias("s"), tx.point_row(df.c, tx.F.lit(4)).alias("r"), tx.point_column(df.c, tx.F.lit(4)).alias("k"), tx.byte_slice(df.c, tx.F.lit(0), tx.F.lit(2)).alias("b")).first()
    assert (row.s, row.r, row.k, row.b) == ("é\nÜyz", 1, 1, "é")
    with pytest.raises(ValueError):
        tx.Rgx("(?=a)")


def test_regex_captures_in_context(spark):
    """Groups are the same whether a match is looked at alone or where it stands."""
    import re

    text = "xa, ab é a,b aab ,a"
    df = spark.createDataFrame([(text,)], "c string")
    for pattern in (r"(?P<x>a+?)(?P<y>b?)", r"\b(?P<x>,)", r"(?P<x>[^a]|a)(?P<y>a)", r"\B(?P<x>a)", r"(?P<x>a)$"):
        r = tx.Rgx(pattern)
        got = df.select(r.captures(df.c).alias("m"), r.count(df.c).alias("n")).first()
        want = [(m[0], *(m[t] or "" for t in r.tags)) for m in re.finditer(pattern, text)]
        assert [tuple(x) for x in got.m] == want and got.n == len(want)


def test_node_table_and_joins(spark):
    units = spark.createDataFrame([("1", "<nav><a>x</a></nav><p><a>y</a><a>z</a>"), ("2", None)], "path string, content string")
    n = trees.node_table(units, languages.language("html").parse, texts=True).withColumn("label", tx.F.col("kind")).cache()
    a = n.filter("kind = 'a'")
    assert ct.enclosing(a.select("path", "pre"), n.filter("kind IN ('nav', 'document')")).filter("a_label = 'nav'").count() == 1
    assert ct.not_enclosing(a, n.filter("kind = 'nav'")).count() == 2
    assert [r.kind for r in ct.contains(n.filter("kind IN ('p', 'nav')"), a, 2).collect()] == ["p"]
    assert [r.kind for r in ct.not_contains(n.filter("kind IN ('p', 'nav')"), n.filter("text = 'y' and kind = 'text'")).collect()] == ["nav"]
    assert ct.sibling_count(a, n.filter("is_named"), 2).count() == 2
    deep = ct.smallest_covering(a.filter("text LIKE '%y%'").select("path", tx.F.col("pre").alias("lo"), tx.F.col("pre").alias("hi")), n.filter("kind <> 'a'"))
    assert deep.join(n, ["path", "pre"]).first().kind == "p"
    n.unpersist()


def test_a_file_that_breaks_its_parser_fails_alone(spark):
    deep = "class A { int x = " + "(" * 30_000 + "1" + ")" * 30_000 + "; }"
    units = spark.createDataFrame([("/a/x.java", deep), ("/a/y.java", "class OldX { }")], "path string, content string")
    got = {r.path: r for r in ex.execute(units, program("Global")).collect()}
    assert got["/a/x.java"].error and got["/a/x.java"].content == deep and len(got["/a/y.java"].matches) == 1


def program(scope):
    a = Rule("a", '((class_declaration name: (identifier) @c) @k (#match? @c "^Old"))')
    b = Rule("b", '((type_identifier) @t (#eq? @t "@c"))', "t", replace="New", holes=frozenset({"c"}), is_seed_rule=False)
    return RuleGraph([a, b], [Edge("a", ("b",), scope)])


def test_execute_rounds(spark):
    units = spark.createDataFrame([("/a/x.java", "class OldX { }"), ("/a/y.java", "class Y { OldX f; }"), ("/b/z.java", "class Z { OldX f; }"), ("/b/e.java", "class { ;"), ("/b/n.java", None)], "path string, content string")
    got = {r.path: r for r in ex.execute(units, program("Global")).collect()}
    assert got["/a/y.java"].content == "class Y { New f; }" and got["/b/z.java"].content == "class Z { New f; }"
    assert "syntax error" in got["/b/e.java"].error and "/b/n.java" not in got
    assert len(got["/a/x.java"].matches) == 1
    m = got["/a/y.java"].rewrites[0].p_match
    assert m.matched_string == "OldX" and m.range.start_byte == 10 and m.range.start_point.column == 10
    near = {r.path: r.content for r in ex.execute(units, program("Directory")).collect()}
    assert near["/a/y.java"] == "class Y { New f; }" and "/b/z.java" not in near


def test_api_files_and_stream(spark, tmp_path):
    code = tmp_path / "code"
    (code / "sub").mkdir(parents=True)
    (code / "a.java").write_text("class OldX { OldX f; }")
    (code / "sub" / "b.java").write_text("class B { OldX f; }")
    (code / "c.txt").write_text("OldX")
    g = program("Global")
    out = {r.path: r.content for r in api.run(spark, Options(), [str(code)], rule_graph=g, exclude=["**/sub/**"]).collect()}
    assert list(out.values()) == ["class OldX { New f; }"] and "OldX f" in (code / "a.java").read_text()
    api.run(spark, Options(dry_run=False), [str(code)], rule_graph=g)
    assert (code / "a.java").read_text() == "class OldX { New f; }" and (code / "sub" / "b.java").read_text() == "class B { New f; }"
    with pytest.raises(ProgramError):
        api.run(spark, Options(), [str(code)], code_snippet="x", rule_graph=g)
    snip = api.run(spark, Options(), code_snippet="class OldQ { OldQ f; }", rule_graph=g)
    assert json.loads(ex.to_json(snip).first().value)["content"] == "class OldQ { New f; }"
    seen = []
    stream = watch.units_stream(spark, str(code), "java")
    watch.run_stream(stream, g, Options(), lambda s, k: seen.extend(r.path.rsplit("/", 1)[1] for r in s.collect()), str(tmp_path / "ck"), available_now=True).awaitTermination(60)
    assert seen == ["a.java"]


def test_entry_has_every_key():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_sql_functions(spark):
    from treeflow.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([(1, "class A { int é = f(1); }"), (2, None)], "id int, code string").createOrReplaceTempView("codes")
    got = spark.sql("SELECT id, m.* FROM codes, LATERAL tree_matches('java', code, '((method_invocation name: (identifier) @n) @c)') m").collect()
    assert [(r.id, r.matched, r.captures["n"], r.start_byte) for r in got] == [(1, "f(1)", "f", 19)]
    assert [r.captures["a"] for r in spark.sql("SELECT m.* FROM codes, LATERAL tmpl_matches('java', code, 'f(:[a])') m").collect()] == ["1"]
    assert [(r.matched, r.start_byte) for r in spark.sql("SELECT m.* FROM codes, LATERAL rgx_matches(code, '(?P<d>[0-9])') m").collect()] == [("1", 21)]
    assert json.loads(spark.sql("SELECT parse_template('a(:[x*])') AS t").first().t)["items"] == [{"literal": "a("}, {"capture": "x", "mode": "*"}, {"literal": ")"}]


def test_two_pass_program(spark):
    from treeflow.plans.programs import Step, replacements, run_steps

    units = spark.createDataFrame([("a.java", "class A { int k = old(1); int j = old(2); int h = other(3); }"), ("b.java", "class {")], "path string, content string")
    find = RuleGraph([Rule("find", '((method_invocation name: (identifier) @n arguments: (argument_list (_) @a)) @c (#eq? @n "old"))')])
    made = lambda found: replacements({c["c"]: f"renewed({int(c['a']) * 10})" for _, c in found}, '((method_invocation) @c (#eq? @c "@from"))', "c")
    out, log = run_steps(units, [Step("find", find), Step("renew", made)])
    assert {r.path: r.content for r in out.collect()} == {"a.java": "class A { int k = renewed(10); int j = renewed(20); int h = other(3); }", "b.java": "class {"}
    assert {(r.step, r.n) for r in log.collect()} == {("find", 2), ("renew", 1)}
