"""Queries that run tree queries and looking programs as DataFrame plans (``plans.tree_plan``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .engine_queries import ORDERS, customer_units
from .functions import text as tx
from .operators import containment as ct
from .operators import facts as fc
from .plans import execute as ex
from .plans import program_tables, tree_plan
from .plans.graph import RuleGraph
from .plans.materialise import discard, keep
from .plans.model import Filter, Options, Rule
from .queries import java_units, query, read
from .sources import scan


def found(units: DataFrame, language: str, pattern: str, captures: list[str]) -> DataFrame:
    """path, start and one column a capture of every match of a tree query."""
    units = keep(units, "units")
    nodes = keep(tree_plan.parsed(units, language, True, tree_plan.Wanted([pattern])), "nodes")
    rows = tree_plan.find_all(units, nodes.filter("pre IS NOT NULL"), pattern)
    out = keep(rows.select("path", "start", *(F.col("captures")[c].alias(c) for c in captures)), "found")
    discard(nodes)
    discard(units)
    return out


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.spread(scan.text_table(read(spark, sf_dir, "pages"), F.col("page_id"), "html"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.spread(customer_units(spark, sf_dir))


@query(f"SELECT path, 'o' || k AS m, 'p' || p AS n, s AS a, 'return ' || r || ';' AS ret FROM {ORDERS} WHERE s <> 'f'")
def plan_nested_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, nesting and anchors: a method whose body is one call and a return."""
    q = "((method_declaration name: (identifier) @m body: (block . (expression_statement (method_invocation name: (identifier) @n arguments: (argument_list . (identifier) @a))) . (return_statement) @ret .)) @d)"
    return found(calls(spark, sf_dir), "java", q, ["m", "n", "a", "ret"]).drop("start")


@query(f"SELECT path, s || chr(10) || d AS v FROM {ORDERS}")
def plan_alternation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over an alternation: the arguments of a call, joined in order."""
    return found(calls(spark, sf_dir), "java", "((argument_list [(identifier) @v (decimal_integer_literal) @v]+) @l)", ["v"]).drop("start")


@query(f"SELECT path, 'p' || p || '(' || s || ', ' || d || ');' AS a, CASE WHEN s = 'f' THEN 'done();' ELSE '' END AS b, 'return ' || r || ';' AS c FROM {ORDERS}")
def plan_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional item between two others."""
    q = "((block . (expression_statement) @a . (expression_statement)? @b (return_statement) @c .) @blk)"
    return found(calls(spark, sf_dir), "java", q, ["a", "b", "c"]).drop("start")


@query("SELECT '/src/' || (p_size % 5) || '/C' || p_partkey || '.java' AS path, 'h' AS n FROM part WHERE p_size % 2 = 0")
def plan_negated_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call without an object."""
    called = F.when(F.col("p_size") % 2 == 0, "h(b)").otherwise("this.h(b)")
    part = read(spark, sf_dir, "part")
    code = F.concat(F.lit("class C { int f() { return "), called, F.lit("; } }"))
    units = part.select(F.concat(F.lit("/src/"), F.col("p_size") % 5, F.lit("/C"), "p_partkey", F.lit(".java")).alias("path"), code.alias("content"))
    return found(scan.spread(units), "java", "((method_invocation !object name: (identifier) @n) @c)", ["n"]).drop("start")


@query(f"SELECT path, 'o' || k AS n FROM {ORDERS} WHERE s = 'f' AND d <> 4")
def plan_two_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patterns of one first capture: both must hold of a method, once each."""
    q = '((method_declaration name: (identifier) @n) @d (#match? @d "done\\\\(")) ((method_declaration body: (block . (expression_statement (method_invocation arguments: (argument_list (decimal_integer_literal) @i))))) @d (#not-eq? @i "4"))'
    return found(calls(spark, sf_dir), "java", q, ["n"]).drop("start")


@query("SELECT CAST(page_id AS VARCHAR) AS path, unnest(regexp_extract_all(html, '<li[^>]*>(<a [^>]*>[^<]*</a>)</li>', 1)) AS link FROM pages")
def plan_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are all of a list item."""
    return found(page_units(spark, sf_dir), "html", "((li . (a) @link .) @item)", ["link"]).drop("start")


@query("SELECT CAST(page_id AS VARCHAR) AS path, array_to_string(regexp_extract_all(html, '<li[^>]*>.*?</li>'), chr(10)) AS items FROM pages WHERE html LIKE '%<li%'")
def plan_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of items of each list."""
    return found(page_units(spark, sf_dir), "html", "((ul (li)+ @items) @list)", ["items"]).drop("start")


@query(f"SELECT path, 'o' || k AS m, row, 4 AS col FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS row FROM {ORDERS}) WHERE d BETWEEN 2 AND 5")
def plan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of matches in units of many lines, before which stand characters of several bytes."""
    lines = F.expr("replace(replace(content, '/* ünï → */ ', '/* ünï → */\n'), '; } int ', '; }\nint ')")
    units = calls(spark, sf_dir).withColumn("content", lines)
    decl = '((identifier) @m (#match? @m "^o[0-9]+$"))'
    inside = Filter(enclosing_node="((method_declaration) @d (#match? @d \"[a-z], [2-5]\\\\)\"))")
    out = ex.execute(units, RuleGraph([Rule("r", decl, filters=(inside,))]), path="plan").select("path", F.explode("matches.m").alias("x"))
    return out.select("path", F.col("x.matches")["m"].alias("m"), F.col("x.range.start_point.row").cast("long").alias("row"), F.col("x.range.start_point.column").alias("col"))


@query("SELECT '/src/' || (p_size % 5) || '/C' || p_partkey || '.java' AS path, 'flag' AS kind, p_size || '!' AS value FROM part WHERE p_size > 25")
def plan_fact_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one rule gate another; both are planned."""
    first = Rule("sizes", '((argument_list (decimal_integer_literal) @n) @l (#match? @n "^(2[6-9]|[345][0-9])$"))', fact=(("kind", "flag"), ("value", "@n!")))
    second = Rule("named", "((class_declaration name: (identifier) @c) @d)", filters=(Filter(fact_filter=(("kind", "flag"),)),))
    out = ex.execute(java_units(spark, sf_dir), RuleGraph([first, second]), Options(), path="plan")
    facts = out.filter(F.exists("matches", lambda m: m["rule"] == "named")).select("path", F.explode("facts").alias("f"))
    return facts.select("path", F.col("f.data")["kind"].alias("kind"), F.col("f.data")["value"].alias("value"))


# rule programs made of table rows -----------------------------------------------------------

CHAIN = "(SELECT o_orderkey AS k, lead(o_orderkey) OVER w AS next, o_orderstatus = 'F' AS dummy, o_orderpriority AS scope FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus IN ('O', 'F') ORDER BY o_orderkey))"


@query(f"WITH RECURSIVE e AS (SELECT * FROM {CHAIN} WHERE next IS NOT NULL), reach AS (SELECT k AS source, scope, next AS target FROM e UNION ALL SELECT r.source, e.scope, e.next FROM reach r JOIN e ON r.target = e.k WHERE e.dummy) SELECT source, scope, target FROM reach WHERE target IN (SELECT k FROM {CHAIN} WHERE NOT dummy)")
def plan_junction_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a rule, followed by the customer's next one; finished orders are junctions."""
    o = read(spark, sf_dir, "orders")
    w = W.partitionBy("o_custkey", F.col("o_orderstatus").isin("O", "F")).orderBy("o_orderkey")
    rows = o.select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("is_dummy"), F.lead("o_orderkey").over(w).alias("next"))
    rules = rows.select(F.col("o_orderkey").alias("rule"), "is_dummy")
    edges = rows.filter("next IS NOT NULL").select(F.col("o_orderkey").alias("source"), F.col("next").alias("target"), F.col("o_orderpriority").alias("scope"))
    return program_tables.successors(rules, edges)


PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
LINES = f"(SELECT o, n, f, first_value(f) OVER (PARTITION BY o ORDER BY n) AS f1 FROM (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PLACE)}) AS n, l_returnflag AS f FROM lineitem))"


def line_program(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each line of an order is a rule that defines its flag; lines 1 and 3 are seeds, lines follow their forerunner and line 1."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*PLACE))
    line = keep(read(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), "l_returnflag"), "lines")
    name = F.concat_ws("-", "l_orderkey", "n")
    rules = line.select(name.alias("rule"), F.lit(False).alias("is_dummy"), F.col("n").isin(1, 3).alias("is_seed"), F.array("l_returnflag").alias("defined"), F.array(F.lit("A"), F.lit("N")).alias("used"))
    ways = F.array_distinct(F.array(F.col("n") - 1, F.lit(1)))
    later = line.filter("n > 1").select("l_orderkey", name.alias("target"), F.explode(ways).alias("way"))
    edges = later.select(F.concat_ws("-", "l_orderkey", "way").alias("source"), "target", F.lit("Parent").alias("scope"))
    return rules, edges


BOUND = f"(SELECT o, n, f, CASE WHEN n = 2 OR n > 3 AND EXISTS (SELECT 1 FROM {LINES} y WHERE y.o = x.o AND y.n BETWEEN 3 AND x.n - 1 AND y.f = x.f1) THEN f1 ELSE '' END AS tags FROM {LINES} x)"


@query(f"SELECT o || '-' || n AS rule, tags FROM {BOUND}")
def plan_assigned_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags bound on entry of each rule, whatever the way to it."""
    rules, edges = line_program(spark, sf_dir)
    return program_tables.assigned(rules, edges, []).select("rule", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT o || '-' || n AS rule, t.tag AS tag FROM {BOUND}, (VALUES ('A'), ('N')) t(tag) WHERE t.tag <> f AND t.tag <> tags")
def plan_unbound_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags that a rule uses and that may be unbound."""
    rules, edges = line_program(spark, sf_dir)
    return program_tables.unbound(rules, program_tables.assigned(rules, edges, []))


# facts --------------------------------------------------------------------------------------

OLD_UNIT = "(SELECT c_custkey AS c, '/* ünï → */ ' || string_agg('int o' || o_orderkey || CASE o_orderstatus WHEN 'F' THEN ' drop;' WHEN 'O' THEN ' keep;' ELSE ' lines;' END, ' ' ORDER BY o_orderkey) AS old FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey)"
NEW_UNIT = f"(SELECT c, replace(replace(old, ' drop;', ';'), ' lines;', chr(10) || 'é' || chr(10) || ' ;') AS new FROM {OLD_UNIT})"
BEFORE = "substr(new, 1, strpos(new, 'int o' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN ' ' WHEN 'F' THEN ';' ELSE chr(10) END) - 1)"


@query(f"SELECT o_orderkey, strlen(b) AS span_start, length(b) - length(replace(b, chr(10), '')) AS row, strlen(string_split(b, chr(10))[-1]) AS col FROM (SELECT o_orderkey, {BEFORE} AS b FROM orders JOIN {NEW_UNIT} ON c = o_custkey)")
def plan_moved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts at the orders of a unit after an edit at every third of them or so, points included."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tail = F.when(F.col("o_orderstatus") == "F", " drop;").when(F.col("o_orderstatus") == "O", " keep;").otherwise(" lines;")
    code = F.concat(F.lit("int o"), "o_orderkey")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, -1)
    sized = o.select("o_orderkey", "o_orderstatus", F.concat(F.lit("/c/"), "o_custkey").alias("path"), code.alias("code"), tail.alias("tail"), F.coalesce(F.sum(F.char_length(code) + F.char_length(tail) + 1).over(w), F.lit(0)).alias("at"))
    lead = F.octet_length(F.lit("/* ünï → */ "))
    placed = sized.withColumn("start", (F.col("at") + lead).cast("int")).withColumn("stop", (F.col("start") + F.char_length("code")).cast("int"))
    facts = placed.select("o_orderkey", "path", "start", F.col("stop").alias("end"), F.lit(0).alias("row"), F.col("start").alias("column"), F.lit(False).alias("voided"))
    new = F.when(F.col("o_orderstatus") == "F", ";").otherwise("\né\n ;")
    edits = placed.filter("o_orderstatus <> 'O'").select("path", F.col("stop").alias("start"), (F.col("stop") + F.char_length("tail")).cast("int").alias("old_end"), F.col("stop").alias("column"), F.col("tail").alias("old_text"), new.alias("new_text"))
    got = fc.moved(facts, edits).filter("NOT voided")
    return got.select("o_orderkey", F.col("start").alias("span_start"), "row", F.col("column").alias("col"))


@query(f"SELECT path, 'argument_list' AS kind, '(' || s || ', ' || d || ')' AS text FROM {ORDERS} UNION ALL SELECT path, 'block', '{{ p' || p || '(' || s || ', ' || d || '); done(); return ' || r || '; }}' FROM {ORDERS} WHERE s = 'f'")
def plan_smallest_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest nodes that hold both arguments of a call, and both statements of a body that has a call of done."""
    units = keep(calls(spark, sf_dir), "units")
    wanted = tree_plan.Wanted([f"({k})" for k in ("identifier", "decimal_integer_literal", "expression_statement", "return_statement")], inner=True)
    nodes = keep(tree_plan.parsed(units, "java", wanted=wanted).select("path", "pre", "post", "parent_pre", "depth", "kind", "start", "end"), "nodes")
    inner = nodes.filter("post > pre").withColumnsRenamed({"start": "from", "end": "to"})  # a leaf holds no two nodes
    both = []
    for first, last in (("identifier", "decimal_integer_literal"), ("expression_statement", "return_statement")):
        a = nodes.filter(F.col("kind") == first).select("path", "parent_pre", F.col("pre").alias("lo"))
        b = nodes.filter(F.col("kind") == last).select("path", "parent_pre", F.col("post").alias("hi"))
        both.append(a.join(b, ["path", "parent_pre"]).filter("lo < hi").groupBy("path", "parent_pre").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("lo").alias("n")).filter(F.lit(first == "identifier") | (F.col("n") == 2)))
    ranges = both[0].unionByName(both[1]).select("path", "lo", "hi")
    at = ct.smallest_covering(ranges, inner, ("kind", "from", "to")).join(units, "path")
    out = keep(at.select("path", "kind", tx.byte_slice(F.col("content"), F.col("from"), F.col("to")).alias("text")), "found")
    discard(nodes)
    discard(units)
    return out
