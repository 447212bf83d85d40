"""Queries that run programs through the engine (``plans.execute``) over code made of table rows.

A customer is a class, each of its orders a method; the SQL beside a query says from
the same rows what the program must find or leave.  Comments and strings hold
characters of several bytes, so offsets are byte offsets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import execute as ex
from .plans.graph import RuleGraph
from .plans.materialise import delete, keep, shared_dir
from .plans.model import Edge, Filter, Options, Rule, Scope
from .queries import query, read
from .sources import scan

#: Fixed in both dialects: an order's method and a customer's class.
METHOD = "'int o' || o_orderkey || '() { p' || substr(o_orderpriority, 1, 1) || '(' || lower(o_orderstatus) || ', ' || o_orderkey % 10 || '); ' || CASE WHEN o_orderstatus = 'F' THEN 'done(); ' ELSE '' END || 'return ' || o_orderkey % 7 || '; }'"
ORDERS = "(SELECT o_orderkey AS k, o_custkey AS c, substr(o_orderpriority, 1, 1) AS p, lower(o_orderstatus) AS s, '/c/' || o_custkey || '.java' AS path, o_orderkey % 10 AS d, o_orderkey % 7 AS r FROM orders JOIN customer ON o_custkey = c_custkey)"
HEAD, TAIL = "class C { /* ünï → */ ", " }"


def customer_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a class for each customer with orders, methods by order key."""
    made = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", F.expr(METHOD).alias("m"))
    methods = made.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "m"))).alias("ms"))
    return methods.select(F.concat(F.lit("/c/"), "o_custkey", F.lit(".java")).alias("path"), F.concat(F.lit(HEAD), F.array_join("ms.m", " "), F.lit(TAIL)).alias("content"))


def matches(units: DataFrame, graph: RuleGraph, captures: list[str], options: Options | None = None, rule: str | None = None) -> DataFrame:
    """path and the captures of every match (of one rule)."""
    out = ex.execute(units, graph, options).select("path", F.explode("matches").alias("x"))
    out = out if rule is None else out.filter(F.col("x.rule") == rule)
    return out.select("path", *(F.col("x.m.matches")[c].alias(c) for c in captures))


def one(pattern: str, *filters: Filter, **rule) -> RuleGraph:
    return RuleGraph([Rule("r", pattern, filters=filters, **rule)])


CALL = "((method_invocation name: (identifier) @n) @call)"
P_CALL = '((method_invocation name: (identifier) @n arguments: (argument_list . (_) @a . (_) @b .)) @call (#match? @n "^p"))'
DONE = '((method_invocation name: (identifier) @dn) @dcall (#eq? @dn "done"))'
DECL = "((method_declaration name: (identifier) @m) @decl)"
ANY_METHOD = "(method_declaration) @em"


def method_named(regex: str) -> str:
    return f'((method_declaration name: (identifier) @em) @ed (#match? @em "{regex}"))'


# filters ----------------------------------------------------------------------------


@query(f"SELECT path, s AS a, CAST(d AS VARCHAR) AS b FROM {ORDERS} WHERE d = 7")
def engine_enclosing_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(customer_units(spark, sf_dir), one(P_CALL, Filter(enclosing_node=method_named("7$"))), ["a", "b"])


@query(f"SELECT path, 'done()' AS call FROM {ORDERS} WHERE s = 'f' AND c IN (SELECT c FROM {ORDERS} WHERE s = 'f' GROUP BY c HAVING count(*) BETWEEN 3 AND 5)")
def engine_outermost_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Filter(outermost_enclosing_node="(class_declaration) @oc", contains=DONE, at_least=3, at_most=5)
    return matches(customer_units(spark, sf_dir), one('((method_invocation name: (identifier) @xn) @call (#eq? @xn "done"))', f), ["call"])


@query(f"SELECT path, 'p' || p AS n FROM {ORDERS} WHERE d <> 3")
def engine_not_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(customer_units(spark, sf_dir), one(P_CALL, Filter(not_enclosing_node=method_named("3$"))), ["n"])


@query(f"SELECT path, 'o' || k AS m FROM {ORDERS} WHERE s = 'f'")
def engine_contains_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(customer_units(spark, sf_dir), one(DECL, Filter(contains="(method_invocation) @inner", at_least=2, at_most=2)), ["m"])


@query(f"SELECT path, 'o' || k AS m FROM {ORDERS} WHERE s <> 'f' AND p <> '1'")
def engine_not_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p1 = '((method_invocation name: (identifier) @pn) @pcall (#eq? @pn "p1"))'
    return matches(customer_units(spark, sf_dir), one(DECL, Filter(not_contains=(DONE, p1))), ["m"])


@query(f"SELECT path, CAST(count(*) AS BIGINT) AS n FROM {ORDERS} WHERE s = 'f' GROUP BY path")
def engine_child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three statements."""
    return matches(customer_units(spark, sf_dir), one("(block) @b", Filter(child_count=3)), ["b"]).groupBy("path").agg(F.count("b").alias("n"))


@query(f"SELECT path, 'p' || p || '(f, ' || d || ');' AS e FROM {ORDERS} WHERE s = 'f' UNION ALL SELECT path, 'done();' FROM {ORDERS} WHERE s = 'f'")
def engine_sibling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(customer_units(spark, sf_dir), one("(expression_statement) @e", Filter(sibling_count=3)), ["e"])


@query(f"SELECT path, 'o' || k AS m FROM {ORDERS} WHERE s = 'f'")
def engine_fact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of finished methods become facts; a later rule keeps the methods that its captures find among the facts."""
    fact = Rule("finished", DECL, filters=(Filter(contains=DONE),), fact=(("name", "@m"), ("kind", "finished")))
    use = Rule("use", DECL, filters=(Filter(fact_filter=(("name", "@m"), ("kind", "finished"))),))
    return matches(customer_units(spark, sf_dir), RuleGraph([fact, use]), ["m"], rule="use")


@query(f"SELECT o.path, 'o' || o.k AS m FROM {ORDERS} o WHERE o.d = 2 AND EXISTS (SELECT 1 FROM {ORDERS} x WHERE x.c = o.c AND x.d = 1)")
def engine_filter_instantiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter pattern that is completed by the match's own captures and the user's substitutions."""
    f = Filter(enclosing_node="(class_declaration) @ec", contains=f'((method_declaration name: (identifier) @on) @od (#match? @on "@wanted"))')
    g = one('((method_declaration name: (identifier) @m) @decl (#match? @m "2$"))', f)
    return matches(customer_units(spark, sf_dir), g, ["m"], Options(substitutions={"wanted": "1$"}))


@query("SELECT '/s/' || n_nationkey || '.java' AS path, n_nationkey % 3 = 0 AS failed FROM nation")
def engine_syntax_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that do not parse are refused, one by one, with a reason; deep nesting is a reason too."""
    n = F.col("n_nationkey")
    bad = F.when(n % 2 == 0, "class C { int x = ; void ( }").otherwise(F.concat(F.lit("class C { int x = "), F.repeat(F.lit("("), 20_000), F.lit("1"), F.repeat(F.lit(")"), 20_000), F.lit("; }")))
    u = read(spark, sf_dir, "nation").select(F.concat(F.lit("/s/"), n, F.lit(".java")).alias("path"), F.when(n % 3 == 0, bad).otherwise("class C { int x = 1; }").alias("content"))
    return ex.execute(u, one("(field_declaration) @f")).select("path", F.col("error").isNotNull().alias("failed"))


# tree queries ---------------------------------------------------------------------------


@query(f"SELECT path, 'o' || k AS m FROM {ORDERS} WHERE s IN ('o', 'p') AND p = '5'")
def engine_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#eq?, #not-eq?, #match? and #not-match? in one query."""
    q = '((method_declaration name: (identifier) @m body: (block . (expression_statement (method_invocation name: (identifier) @n arguments: (argument_list . (identifier) @a (_) @b))))) @decl (#eq? @n "p5") (#not-eq? @a "f") (#match? @m "^o[0-9]+$") (#not-match? @b "[^0-9]"))'
    return matches(customer_units(spark, sf_dir), one(q), ["m"])


@query(f"SELECT path, 'p' || p || '(' || s || ', ' || d || ');' || CASE WHEN s = 'f' THEN chr(10) || 'done();' ELSE '' END AS calls FROM {ORDERS}")
def engine_tag_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantified capture holds its nodes' texts, one a line."""
    return matches(customer_units(spark, sf_dir), one("((block (expression_statement)+ @calls) @b)"), ["calls"])


@query(f"SELECT path, '{HEAD}' || string_agg('int o' || k || '() {{ p' || p || '(' || s || ', N' || d || '); ' || CASE WHEN s = 'f' THEN 'done(); ' ELSE '' END || 'return ' || r || '; }}', ' ' ORDER BY k) || '{TAIL}' AS content FROM {ORDERS} GROUP BY path")
def engine_replace_idx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replace_idx names a named child of the replaced node."""
    g = RuleGraph([Rule("r", "((argument_list . (identifier) @a . (decimal_integer_literal) @b) @list)", replace_node="list", replace_idx=1, replace="N@b")])
    return ex.execute(customer_units(spark, sf_dir), g).select("path", "content")


@query(f"SELECT path, n_first, n_last FROM (SELECT path, 'o' || max(k) AS n_first, 'o' || min(k) AS n_last FROM {ORDERS} GROUP BY path)")
def engine_match_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a tree query come by falling start."""
    out = ex.execute(customer_units(spark, sf_dir), one(DECL)).select("path", F.transform("matches", lambda x: x.m.matches["m"]).alias("ms"))
    return out.select("path", F.element_at("ms", 1).alias("n_first"), F.element_at("ms", -1).alias("n_last"))


# regular expressions -------------------------------------------------------------------


PREFIX = "'class N { /* ünï → */ String s = \"' || n_name || 'é\"; int k' || n_nationkey || '; }'"


def nation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("/n/"), "n_nationkey", F.lit(".java")).alias("path"), F.expr(PREFIX).alias("content"))


@query(f"SELECT '/n/' || n_nationkey || '.java' AS path, 'k' || n_nationkey AS name, CAST(strlen(split_part({PREFIX}, ' k', 1)) + 1 AS BIGINT) AS start_byte, CAST(0 AS INTEGER) AS point_row FROM nation WHERE n_nationkey % 10 <> 4")
def engine_rgx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular expression with a filter runs in the engine; offsets count bytes."""
    g = RuleGraph([Rule("r", r"rgx int (?P<name>k[0-9]+)", filters=(Filter(not_enclosing_node='((field_declaration declarator: (variable_declarator name: (identifier) @fn)) @fd (#match? @fn "4$"))'),))])
    out = ex.execute(nation_classes(spark, sf_dir), g).select("path", F.explode("matches.m").alias("m"))
    return out.select("path", F.col("m.matches")["name"].alias("name"), (F.col("m.range.start_byte") + 4).alias("start_byte"), F.col("m.range.start_point.row").alias("point_row"))


@query("SELECT '/n/' || n_nationkey || '.java' AS path, 'class N { /* ünï → */ String s = \"' || n_name || 'é\"; long ü' || n_nationkey || '; }' AS content FROM nation")
def engine_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits behind characters of several bytes; a replaced group of a regular expression."""
    g = RuleGraph([Rule("a", r"rgx int (?P<name>k(?P<no>[0-9]+))", replace_node="name", replace="ü@no"), Rule("b", '((integral_type) @t (#eq? @t "int"))', replace_node="t", replace="long")])
    return ex.execute(nation_classes(spark, sf_dir), g).select("path", "content")


# templates ----------------------------------------------------------------------------------


def template_rows(spark: SparkSession, sf_dir: str, template: str, captures: list[str]) -> DataFrame:
    return matches(customer_units(spark, sf_dir), one(f"cs {template}"), captures)


@query(f"SELECT DISTINCT path, 'p' || p AS f, s AS a, CAST(r AS VARCHAR) AS v FROM {ORDERS} WHERE s = 'f'")
def template_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of three statements slides over siblings."""
    return template_rows(spark, sf_dir, ":[f](:[a], :[b]); done(); return :[v];", ["f", "a", "v"]).distinct()


@query(f"SELECT DISTINCT path, 'o' || k AS m, CASE WHEN s = 'f' THEN 'done();' ELSE '' END AS rest FROM {ORDERS}")
def template_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:[x*] takes any number of siblings, none too."""
    return template_rows(spark, sf_dir, "int :[m]() { :[f](:[a], :[b]); :[rest*] return :[v]; }", ["m", "rest"]).distinct()


@query(f"SELECT DISTINCT path, 'o' || k AS m, 'p' || p || '(' || s || ', ' || d || ');' || CASE WHEN s = 'f' THEN ' done();' ELSE '' END AS body FROM {ORDERS}")
def template_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_rows(spark, sf_dir, "int :[m]() { :[body+] return :[v]; }", ["m", "body"]).distinct()


@query(f"SELECT DISTINCT path, 'o' || k AS m, CASE WHEN s = 'f' THEN 'done();' ELSE '' END AS maybe FROM {ORDERS}")
def template_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:[x?] takes one sibling or none."""
    return template_rows(spark, sf_dir, "int :[m]() { :[f](:[a], :[b]); :[maybe?] return :[v]; }", ["m", "maybe"]).distinct()


@query(f"SELECT DISTINCT path, 'o' || k AS m, CAST(d AS VARCHAR) AS n FROM {ORDERS} WHERE d = r")
def template_equal_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture that occurs twice has one text."""
    return template_rows(spark, sf_dir, "int :[m]() { :[f](:[a], :[n]); :[rest*] return :[n]; }", ["m", "n"]).distinct()


@query(f"SELECT DISTINCT path, 'p' || p AS f FROM {ORDERS} WHERE s <> 'o' AND p NOT IN ('2', '3')")
def template_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """in, not in, matches and not matches."""
    return template_rows(spark, sf_dir, ':[f](:[a], :[b]) |> :[f] not in ["p2", "p3"], :[f] matches /^p/, :[a] not matches /^o$/', ["f"]).distinct()


@query(f"SELECT DISTINCT path, 'o' || k AS m FROM {ORDERS} WHERE s = 'f' AND p <> '1'")
def template_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contains and not contains hold a template against a capture."""
    return template_rows(spark, sf_dir, "int :[m]() @body |> @body contains /done()/, @body not contains /p1(:[x], :[y])/", ["m"]).distinct()


@query(f"SELECT DISTINCT path, s AS a FROM {ORDERS}")
def template_node_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a capture and of the node that is matched."""
    return template_rows(spark, sf_dir, ':[f](:[a], :[b]) |> :[a].node_type in ["identifier"], :[b].node_type in ["decimal_integer_literal"], root.node_type in ["method_invocation"]', ["a"]).distinct()


# edits, options --------------------------------------------------------------------------------


LINES = "'class P {' || chr(10) || '  // about ' || p_partkey || chr(10) || '  int old' || p_size || '; // gone' || chr(10) || chr(10) || chr(10) || chr(10) || '  int kept;' || chr(10) || '}' || chr(10)"


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), "p_partkey", F.lit(".java")).alias("path"), F.expr(LINES.replace("chr(10)", "char(10)")).alias("content"))


DROP = RuleGraph([Rule("drop", '((field_declaration declarator: (variable_declarator name: (identifier) @n)) @f (#match? @n "^old"))', replace_node="f", replace="")])


@query("SELECT '/p/' || p_partkey || '.java' AS path, 'class P {' || chr(10) || '  // about ' || p_partkey || ' // gone' || chr(10) || chr(10) || chr(10) || chr(10) || '  int kept;' || chr(10) || '}' || chr(10) AS content FROM part")
def engine_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion takes the blank lead-in of its node; comments stay."""
    return ex.execute(part_lines(spark, sf_dir), DROP).select("path", "content")


@query("SELECT '/p/' || p_partkey || '.java' AS path, 'class P {' || chr(10) || chr(10) || '  int kept;' || chr(10) || '}' || chr(10) AS content FROM part")
def engine_delete_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With cleanup_comments the comments beside and above go too; blank lines are collapsed."""
    return ex.execute(part_lines(spark, sf_dir), DROP, Options(cleanup_comments=True, delete_consecutive_new_lines=True)).select("path", "content")


@query("SELECT '/p/' || p_partkey || '.java' AS path, 'k' || p_size AS fact, CAST(strlen('class P { /* ü */ int ') + CASE WHEN p_size % 2 = 0 THEN 3 ELSE 0 END AS BIGINT) AS start_byte FROM part WHERE p_size % 3 <> 0")
def engine_fact_shift_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts behind an edit move by its growth in bytes, facts inside it are void."""
    size = F.col("p_size").cast("string")
    u = read(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), "p_partkey", F.lit(".java")).alias("path"), F.concat(F.lit("class P { /* ü */ int k"), size, F.lit("; }")).alias("content"), (F.col("p_size") % 2 == 0).alias("even"), (F.col("p_size") % 3 == 0).alias("third"))
    u = u.select("path", F.when(F.col("even"), F.replace("content", F.lit("int"), F.lit("byte"))).otherwise(F.col("content")).alias("content"), "third").select("path", F.when(F.col("third"), F.replace("content", F.lit(" k"), F.lit(" third, k"))).otherwise(F.col("content")).alias("content"))
    fact = Rule("name", '((variable_declarator name: (identifier) @n) @d (#match? @n "^k"))', fact=(("n", "@n"),))
    widen = Rule("widen", '((integral_type) @t (#eq? @t "byte"))', replace_node="t", replace="longer")
    void = Rule("void", '((field_declaration (variable_declarator name: (identifier) @x) (variable_declarator name: (identifier) @y)) @f (#eq? @x "third"))', replace_node="f", replace="int @y;")
    out = ex.execute(u, RuleGraph([fact, widen, void])).select("path", F.explode("facts").alias("f")).filter("NOT f.voided")
    return out.select("path", F.col("f.data")["n"].alias("fact"), F.col("f.range.start_byte").alias("start_byte"))


@query("SELECT '/p/' || p_partkey || '.java' AS path, 'class P { int a = ' || p_size || '; }' AS content FROM part")
def engine_instantiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer tags first; captures over substitutions; hole values in a query."""
    u = read(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), "p_partkey", F.lit(".java")).alias("path"), F.concat(F.lit("class P { int a = f("), "p_size", F.lit("); }")).alias("content"))
    g = RuleGraph([Rule("r", '((method_invocation name: (identifier) @n arguments: (argument_list (_) @name)) @call (#eq? @n "@flag"))', replace_node="call", replace=":[name]", holes=frozenset({"flag"}))])
    return ex.execute(u, g, Options(substitutions={"flag": "f", "na": "wrong", "name": "overridden"})).select("path", "content")


# scopes and edges --------------------------------------------------------------------------------


NEST = "'class P { void f() { { if (a' || p_partkey || ') { g(' || p_size || '); } } } void h() { g(0); } }'"


def nested_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), "p_partkey", F.lit(".java")).alias("path"), F.expr(NEST).alias("content"))


SEED = Rule("seed", '((method_invocation name: (identifier) @n arguments: (argument_list (_) @v)) @call (#eq? @n "g") (#not-eq? @v "0"))', replace_node="call", replace="done(@v)")
ON_IF = Rule("on_if", "((if_statement) @i)", replace_node="i", replace="wasIf();", is_seed_rule=False)
ON_BLOCK = Rule("on_block", '((block . (expression_statement (method_invocation name: (identifier) @dn)) .) @b (#eq? @dn "done"))', replace_node="b", replace="{ wasBlock(); }", is_seed_rule=False)


def _parents(spark: SparkSession, sf_dir: str, scope: str, k: int) -> DataFrame:
    g = RuleGraph([SEED, ON_IF, ON_BLOCK], [Edge("seed", ("on_if", "on_block"), scope)])
    out = ex.execute(nested_units(spark, sf_dir), g, Options(number_of_ancestors_in_parent_scope=k))
    return out.select("path", "content", F.array_join("rewrites.matched_rule", ",").alias("rules"))


def _parent_sql(inner: str, rules: str) -> str:
    return f"SELECT '/p/' || p_partkey || '.java' AS path, 'class P {{ void f() {{ {{ ' || {inner} || ' }} }} void h() {{ g(0); }} }}' AS content, '{rules}' AS rules FROM part"


@query(_parent_sql("'wasIf();'", "seed,on_if"))
def engine_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent edges try each rule on all ancestors before the next rule."""
    return _parents(spark, sf_dir, "Parent", 4)


@query(_parent_sql("'if (a' || p_partkey || ') { wasBlock(); }'", "seed,on_block"))
def engine_parent_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ParentIterative edges try all rules on each ancestor before the next one."""
    return _parents(spark, sf_dir, "ParentIterative", 4)


@query(_parent_sql("'if (a' || p_partkey || ') { done(' || p_size || '); }'", "seed"))
def engine_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors beyond number_of_ancestors_in_parent_scope are out of reach."""
    return _parents(spark, sf_dir, "Parent", 2)


@query("SELECT '/p/' || p_partkey || '.java' AS path, 'class P { void f() { { if (a' || p_partkey || ') { seen(' || p_size || '); } } } void h() { g(0); } }' AS content FROM part")
def engine_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope of one's own confines the successor to the enclosing method."""
    method = Scope("Here", (("((method_declaration name: (identifier) @mn) @md)", '((method_declaration name: (identifier) @zn) @zd (#eq? @zn "@mn"))'),))
    other = Rule("other", '((method_invocation name: (identifier) @on) @oc (#match? @on "^(g|done)$"))', replace_node="on", replace="seen", is_seed_rule=False)
    return ex.execute(nested_units(spark, sf_dir), RuleGraph([SEED, other], [Edge("seed", ("other",), "Here")], [method])).select("path", "content")


@query("SELECT '/p/' || p_partkey || '.java' AS path, 'if (a' || p_partkey || ') { done(' || p_size || '); }' AS replacement, true AS same FROM part")
def engine_identity_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match-only rule behind a Parent edge is logged as an edit that changes nothing."""
    look = Rule("look", "((if_statement) @i)", is_seed_rule=False)
    out = ex.execute(nested_units(spark, sf_dir), RuleGraph([SEED, look], [Edge("seed", ("look",), "Parent")])).select("path", F.explode("rewrites").alias("w"))
    return out.filter("w.matched_rule = 'look'").select("path", F.col("w.replacement_string").alias("replacement"), (F.col("w.replacement_string") == F.col("w.p_match.matched_string")).alias("same"))


@query("SELECT '/t/u' || r_regionkey || '.java' AS path, 'class U { String s = \"' || (SELECT min(r_name) FROM region) || '\"; }' AS content FROM region")
def engine_global_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag with the global prefix reaches the other files; of several values the least does."""
    r = read(spark, sf_dir, "region")
    units = r.select(F.concat(F.lit("/t/k"), "r_regionkey", F.lit(".java")).alias("path"), F.concat(F.lit('class K { String KEY = "'), "r_name", F.lit('"; }')).alias("content")).unionByName(r.select(F.concat(F.lit("/t/u"), "r_regionkey", F.lit(".java")).alias("path"), F.lit("class U { String s = use(); }").alias("content")))
    key = Rule("key", '((variable_declarator name: (identifier) @kn value: (string_literal) @G_key) @d (#eq? @kn "KEY"))')
    use = Rule("use", '((method_invocation name: (identifier) @un) @uc (#eq? @un "use"))', replace_node="uc", replace="@G_key", is_seed_rule=False)
    out = ex.execute(units, RuleGraph([key, use], [Edge("key", ("use",), "Global")]), Options(global_tag_prefix="G_"))
    return out.filter(F.size("rewrites") > 0).select("path", "content")


@query("SELECT '/n/' || n_nationkey || '.java' AS path, 'k' || n_nationkey AS last FROM nation")
def engine_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later capture of a tag replaces the earlier one."""
    u = read(spark, sf_dir, "nation").select(F.concat(F.lit("/n/"), "n_nationkey", F.lit(".java")).alias("path"), F.concat(F.lit("class N { int k"), "n_nationkey", F.lit("; int first; int end = here(); }")).alias("content"))
    name = Rule("name", "((field_declaration declarator: (variable_declarator name: (identifier) @x !value)) @f)")
    use = Rule("use", '((method_invocation name: (identifier) @hn) @h (#eq? @hn "here"))', replace_node="h", replace="@x")
    out = ex.execute(u, RuleGraph([name, use])).select("path", F.explode("rewrites.replacement_string").alias("last"))
    return out


@query("SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand")
def engine_instances_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files ask for the same rule of another file; it runs there once for each brand."""
    p = read(spark, sf_dir, "part")
    ask = p.filter("p_size > 25").select(F.concat(F.lit("/a/"), "p_partkey", F.lit(".java")).alias("path"), F.concat(F.lit("class A { int ask = b"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit("; }")).alias("content"))
    seek = Rule("ask", '((variable_declarator name: (identifier) @an value: (identifier) @b) @d (#eq? @an "ask"))')
    hit = Rule("hit", '((identifier) @i (#eq? @i "@b"))', holes=frozenset({"b"}), is_seed_rule=False)
    out = ex.execute(ask, RuleGraph([seek, hit], [Edge("ask", ("hit",), "Global")])).select("path", F.explode("matches").alias("x")).filter("x.rule = 'hit'")
    return out.groupBy(F.concat(F.lit("Brand#"), F.expr("substring(x.m.matched_string, 2)")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))


# files, snippets ----------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, 'class N { String s = \"' || n_name || '\"; }' || chr(10) AS content FROM nation WHERE n_nationkey BETWEEN 10 AND 19 AND n_nationkey <> 13")
def codebase_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder tree with globs, read whole, as a code base."""
    where = f"{shared_dir(spark)}/treeflow-core/code-base-{uuid.uuid4().hex}"
    made = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('class N { String s = "'), "n_name", F.lit('"; }')).alias("value"))
    made.write.partitionBy("n_nationkey").text(where)
    units = scan.codebase(spark, [where], "txt", include=["**/n_nationkey=1?/*"], exclude=["**/n_nationkey=13/*"])
    out = keep(units.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).alias("nation"), "content"), "scanned")
    delete(spark, where)
    return out


@query("SELECT r_name AS name, 'sample.java' AS path, 'class S { Object o = f(found); }' AS content FROM region")
def snippet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over a snippet for each value, as from the command line."""
    out = None
    for name in [r.r_name for r in read(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]:
        g = RuleGraph([Rule("r", '((string_literal) @i (#eq? @i "\\"@value\\""))', replace_node="i", replace="found", holes=frozenset({"value"}))])
        one_ = ex.execute(scan.snippet(spark, f'class S {{ Object o = f("{name}"); }}', "java"), g, Options(substitutions={"value": name}))
        one_ = one_.select(F.lit(name).alias("name"), "path", "content")
        out = one_ if out is None else out.unionByName(one_)
    return out
