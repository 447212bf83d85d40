"""Registered queries of the engine, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import containment as ct
from .operators import facts as fc
from .operators import languages, trees
from .operators import templates as tm
from .plans import execute as ex
from .plans import tree_plan
from .plans.graph import RuleGraph, expand_edges
from .plans.materialise import discard, keep
from .plans.model import Edge, Options, Rule
from .sources import config, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# scans -----------------------------------------------------------------------

DOC_PATH = "'/repo/' || source || '/' || lang || '/' || doc_id || '.txt'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.expr(DOC_PATH).alias("path"), F.col("text").alias("content"))


@query(f"SELECT doc_id, {DOC_PATH} AS path FROM documents WHERE {DOC_PATH} LIKE '/repo/src1%/%' AND NOT {DOC_PATH} LIKE '%/fr/%'")
def scan_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(scan.path_filter(F.col("path"), ["/repo/src1*/**"], ["**/fr/**"])).select("doc_id", "path")


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '\\.([^./]+)$', 1) = 'html'")
def scan_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").filter(scan.path_filter(F.col("url"), extension="html")).select("page_id", "url")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'License|idiot')")
def grep_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.grep(documents(spark, sf_dir), ["License", "idiot", "true", ""]).select("doc_id")


# regular expressions ------------------------------------------------------------

MAIL = r"(?P<user>[A-Za-z0-9_]+)@(?P<host>[a-z0-9.]+)"
MAIL_RE2 = r"([A-Za-z0-9_]+)@([a-z0-9.]+)"


@query(f"SELECT {DOC_PATH} AS path, CAST(i - 1 AS INTEGER) AS ord, regexp_extract_all(text, '{MAIL_RE2}')[i] AS matched, regexp_extract_all(text, '{MAIL_RE2}', 1)[i] AS user, regexp_extract_all(text, '{MAIL_RE2}', 2)[i] AS host FROM (SELECT *, unnest(generate_series(1, len(regexp_extract_all(text, '{MAIL_RE2}')))) AS i FROM documents)")
def rgx_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.regex_matches(documents(spark, sf_dir), Rule("mail", f"rgx {MAIL}"), {})


@query("SELECT " + DOC_PATH + " AS path, CAST(i - 1 AS INTEGER) AS ord, regexp_extract_all(text, 'License[^\\n]*')[i] AS matched, regexp_extract_all(text, 'License[^\\n]*')[i] AS lic FROM (SELECT *, unnest(generate_series(1, len(regexp_extract_all(text, 'License[^\\n]*')))) AS i FROM documents)")
def rgx_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = Rule("license_line", "rgx (?P<lic>@word[^\n]*)", holes=frozenset({"word"}))
    return ex.regex_matches(documents(spark, sf_dir), rule, {"word": "License"})


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]+')[1] AS first_number, regexp_extract_all(text, '[0-9]+')[-1] AS last_number FROM documents WHERE regexp_matches(text, '[0-9]+')")
def rgx_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).withColumn("m", tx.Rgx("[0-9]+").matches(F.col("content"))).filter(F.size("m") > 0)
    return found.select("doc_id", F.element_at("m", 1).alias("first_number"), F.element_at("m", -1).alias("last_number"))


@query("SELECT doc_id, CAST(o AS BIGINT) AS byte_offset, CAST(length(p) - length(replace(p, chr(10), '')) AS INTEGER) AS point_row, CAST(strlen(regexp_extract(p, '[^\\n]*$')) AS INTEGER) AS point_column FROM (SELECT doc_id, strlen(p) AS o, p FROM (SELECT doc_id, substr(text, 1, instr(text, ' on') - 1) AS p FROM documents WHERE instr(text, ' on') > 0))")
def rgx_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("i", F.instr("content", " on")).filter("i > 0")
    d = d.withColumn("o", F.octet_length(F.substring(F.col("content"), F.lit(1), F.col("i") - 1)))
    return d.select("doc_id", F.col("o").cast("long").alias("byte_offset"), tx.point_row(F.col("content"), F.col("o")).alias("point_row"), tx.point_column(F.col("content"), F.col("o")).alias("point_column"))


@query(f"SELECT rule, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'mail' AS rule, len(regexp_extract_all(text, '{MAIL_RE2}')) AS n FROM documents UNION ALL SELECT 'number', len(regexp_extract_all(text, '[0-9]+')) FROM documents) GROUP BY rule")
def match_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan.spread(documents(spark, sf_dir).select("content"))
    counts = [tx.Rgx(p).count(F.col("content")).cast("long").alias(r) for r, p in (("mail", MAIL), ("number", "[0-9]+"))]
    return d.select(*counts).agg(F.sum("mail").alias("mail"), F.sum("number").alias("number")).unpivot([], ["mail", "number"], "rule", "n")


# containment over the customer > order > line tree ---------------------------------


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("label"), F.col("c_custkey").cast("string").alias("ref"))
    o = read(spark, sf_dir, "orders")
    orders = o.select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", F.lit("order").alias("kind"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").cast("string").alias("ref"))
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", "l_linenumber", F.lit("line").alias("kind"), F.col("l_returnflag").alias("label"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("ref"))
    return ct.interval_encode([c, orders, lines], ["o_orderkey", "l_linenumber"])


def of_kind(nodes: DataFrame, kind: str, label: Column | None = None) -> DataFrame:
    got = nodes.filter(F.col("kind") == kind)
    return got if label is None else got.filter(label)


LINES = "(SELECT l_orderkey || ':' || l_linenumber AS ref, l_returnflag, o_orderpriority, o_orderkey, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ref FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY o_orderkey HAVING count(*) BETWEEN 2 AND 3")
def contains_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.contains(of_kind(n, "order"), of_kind(n, "line", F.col("label") == "R"), 2, 3).select("ref")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ref FROM orders o JOIN customer ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'N')")
def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.contains(of_kind(n, "order"), of_kind(n, "line", F.col("label") == "N")).select("ref")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ref FROM orders o JOIN customer ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag IN ('R', 'A'))")
def not_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    line = lambda f: of_kind(n, "line", F.col("label") == f)
    return ct.not_contains(of_kind(n, "order"), line("R"), line("A")).select("ref")


@query(f"SELECT ref, o_orderpriority AS a_label, 1 AS a_depth FROM {LINES} WHERE l_returnflag = 'R' AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders) UNION ALL SELECT ref, c_mktsegment, 0 FROM {LINES} WHERE l_returnflag = 'R' AND o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) AND c_mktsegment = 'BUILDING'")
def enclosing_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    first = read(spark, sf_dir, "orders").agg(F.min("o_orderpriority").alias("p"))
    around = of_kind(n, "order").join(first, F.col("label") == F.col("p")).drop("p").unionByName(of_kind(n, "customer", F.col("label") == "BUILDING"))
    return ct.enclosing(of_kind(n, "line", F.col("label") == "R"), around).select("ref", "a_label", "a_depth")


@query(f"SELECT ref, c_mktsegment AS a_label, 0 AS a_depth FROM {LINES} WHERE l_returnflag = 'A'")
def outermost_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.enclosing(of_kind(n, "line", F.col("label") == "A"), n.filter("kind <> 'line'"), outermost=True).select("ref", "a_label", "a_depth")


@query(f"SELECT ref FROM {LINES} WHERE c_mktsegment <> 'BUILDING'")
def not_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.not_enclosing(of_kind(n, "line"), of_kind(n, "customer", F.col("label") == "BUILDING")).select("ref")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS ref FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(l_linenumber) = 3")
def child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.child_count(of_kind(n, "order"), n.filter("parent_pre IS NOT NULL"), 3).select("ref")


@query(f"SELECT ref FROM (SELECT ref, count(*) OVER (PARTITION BY o_orderkey) AS n FROM {LINES}) WHERE n = 2")
def sibling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.sibling_count(of_kind(n, "line"), n.filter("parent_pre IS NOT NULL"), 2).select("ref")


@query(f"SELECT ref, 0 AS anc, l_returnflag AS a_label FROM {LINES} UNION ALL SELECT ref, 1, o_orderpriority FROM {LINES}")
def context_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    lines = of_kind(n, "line")
    return ct.context(lines, n, 2).join(lines.select("path", "pre", "ref"), ["path", "pre"]).select("ref", "anc", "a_label")


def _candidates(n: DataFrame) -> DataFrame:
    """Lines with the (rule, ancestor) pairs whose label test holds: 0 BUILDING, 1 urgent, 2 returned."""
    c = ct.context(of_kind(n, "line"), n, 3)
    tests = F.array(F.when(F.col("a_label") == "BUILDING", 0), F.when(F.col("a_label").startswith("1"), 1), F.when(F.col("a_label") == "R", 2))
    return c.select("path", "pre", "anc", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("rule_ord"))


@query(f"SELECT ref, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 2 END AS rule_ord FROM {LINES} WHERE c_mktsegment = 'BUILDING' OR o_orderpriority LIKE '1%' OR l_returnflag = 'R'")
def parent_rule_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.first_hit(_candidates(n), "rule").join(of_kind(n, "line").select("path", "pre", "ref"), ["path", "pre"]).select("ref", "rule_ord")


@query(f"SELECT ref, CASE WHEN l_returnflag = 'R' THEN 2 WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS rule_ord FROM {LINES} WHERE c_mktsegment = 'BUILDING' OR o_orderpriority LIKE '1%' OR l_returnflag = 'R'")
def parent_node_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = order_tree(spark, sf_dir)
    return ct.first_hit(_candidates(n), "node").join(of_kind(n, "line").select("path", "pre", "ref"), ["path", "pre"]).select("ref", "rule_ord")


@query(f"SELECT o_orderkey || '' AS ref, min(ref) AS first_line FROM {LINES} WHERE o_orderpriority LIKE '1%' GROUP BY o_orderkey")
def scope_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines re-located inside the enclosing unit named by their order."""
    n = order_tree(spark, sf_dir)
    scope = of_kind(n, "order", F.col("label").startswith("1"))
    hit = ct.enclosing(of_kind(n, "line"), scope)
    return hit.join(scope.select("path", F.col("pre").alias("a_pre"), F.col("ref").alias("o")), ["path", "a_pre"]).groupBy(F.col("o").alias("ref")).agg(F.min("ref").alias("first_line"))


# facts --------------------------------------------------------------------------


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("data"), F.lit(False).alias("voided"))


@query("SELECT event_id, 'k=' || coalesce(json_extract_string(props, '$.k'), '') || ',type=' || event_type AS fact FROM events")
def fact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_facts(spark, sf_dir).select("event_id", fc.as_text(F.col("data")).alias("fact"))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') = '7')")
def fact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return fc.with_fact(e, event_facts(spark, sf_dir), ["user_id"], {"type": "purchase", "k": "7"}).select("event_id")


@query("SELECT event_id, CAST(CASE WHEN e <= 40 THEN s WHEN s >= 60 THEN s - 15 ELSE s END AS BIGINT) AS span_start, CAST(CASE WHEN e <= 40 THEN e WHEN s >= 60 THEN e - 15 ELSE e END AS BIGINT) AS span_end, NOT (e <= 40 OR s >= 60) AS voided FROM (SELECT event_id, event_id % 90 AS s, event_id % 90 + 1 + event_id % 7 AS e FROM events)")
def fact_shift_void(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans after the edit that replaces bytes 40 to 60 by five bytes."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 90).alias("s"), (F.col("event_id") % 90 + 1 + F.col("event_id") % 7).alias("e"))
    moved = fc.shift_or_void(F.col("s"), F.col("e"), F.lit(40), F.lit(60), F.lit(45))
    return e.select("event_id", moved.alias("m")).select("event_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), "m.voided")


# text edits ------------------------------------------------------------------------


@query("SELECT doc_id, substr(text, 1, 5) || '<cut>' || substr(text, 13) AS content FROM documents WHERE strlen(text) = length(text) AND length(text) > 20")
def splice_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).filter((F.octet_length("content") == F.char_length("content")) & (F.char_length("content") > 20))
    return d.select("doc_id", tx.splice(F.col("content"), F.lit(5), F.lit(12), F.lit("<cut>")).alias("content"))


@query("SELECT n_nationkey, n_name || ' in ' || r_name || ', ' || r_name || 's' AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def template_instantiate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", tx.instantiate(F.lit("@name in :[reg], @regions"), {"name": F.col("n_name"), "reg": F.col("r_name"), "regions": F.concat("r_name", F.lit("s"))}).alias("label"))


@query("SELECT p_partkey, p_brand || '/' || p_type || '?' || p_size AS label FROM part")
def template_instantiate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("t"), F.col("p_type"), F.lit("to"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", tx.instantiate_map(F.lit("@to/:[t]?@size"), m).alias("label"))


@query("SELECT c_custkey, c_name || chr(10) || chr(10) || c_mktsegment || chr(10) || 'end' AS content FROM customer")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_name", F.lit("\n \n\n\n"), "c_mktsegment", F.lit("\nend"))
    return read(spark, sf_dir, "customer").select("c_custkey", tx.collapse_blank_lines(text).alias("content"))


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 3 = 1 AND NOT contains(text, 'e') AS same FROM documents WHERE length(text) > 0")
def ws_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against itself with other white space, with a letter changed, or with one more at its end."""
    d = documents(spark, sf_dir).filter(F.char_length("content") > 0)
    spaced = F.concat(F.lit("\n "), F.regexp_replace("content", "[ \n]", "\t "))
    other = F.when(F.col("doc_id") % 3 == 0, spaced).when(F.col("doc_id") % 3 == 1, F.replace(spaced, F.lit("e"), F.lit("E"))).otherwise(F.concat(spaced, F.lit(" x")))
    return d.select("doc_id", tx.same_but_space(F.col("content"), other).alias("same"))


@query("SELECT conv_id, string_agg(role, chr(10) ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def tag_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join("t.role", "\n").alias("roles"))


@query("SELECT event_id, 'GLOBAL_TAG.u=' || user_id AS tags FROM events")
def global_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("GLOBAL_TAG.u"), F.col("user_id").cast("string"), F.lit("local"), F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", fc.as_text(F.map_filter(m, lambda k, v: k.startswith("GLOBAL_TAG."))).alias("tags"))


# rule graphs --------------------------------------------------------------------------


def small_graph() -> RuleGraph:
    def r(name: str, *groups: str, query: str = "(identifier) @x", seed: bool = True, holes: tuple = ()) -> Rule:
        return Rule(name, query, groups=frozenset(groups), is_seed_rule=seed, holes=frozenset(holes))

    rules = [r("a", "g"), r("b", "g", "h", query="((identifier) @y (#eq? @y @x))", seed=False), r("c", "h", query="rgx (?P<z>@x)", seed=False, holes=("x",)), r("mid", query="", seed=False), r("d", query="(method_declaration) @m", seed=False)]
    return RuleGraph(rules, [Edge("g", ("h", "mid"), "Parent"), Edge("mid", ("d",), "Global"), Edge("c", ("d",), "Parent")])


@query("SELECT * FROM (VALUES ('a','b','Parent'),('a','c','Parent'),('a','mid','Parent'),('b','b','Parent'),('b','c','Parent'),('b','mid','Parent'),('mid','d','Global'),('c','d','Parent')) t(from_rule, to_rule, scope)")
def group_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small_graph()
    rows = [(n, n) for n in g.rules] + [(k, n) for k, v in g.groups.items() for n in v]
    return expand_edges(g.edges_table(spark), spark.createDataFrame(rows, "grp string, name string"))


@query("SELECT * FROM (VALUES ('a','Parent','b'),('a','Parent','c'),('a','Global','d'),('b','Parent','b'),('b','Parent','c'),('b','Global','d'),('c','Parent','d'),('mid','Global','d')) t(from_rule, scope, to_rule)")
def dummy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = small_graph()
    return spark.createDataFrame([(n, s, t) for n in g.rules for s, ts in g.successors(n).items() for t in ts], "from_rule string, scope string, to_rule string")


@query("SELECT * FROM (VALUES ('a',''),('b','x'),('c','x'),('d','x'),('mid','x')) t(rule, tags)")
def definite_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, ",".join(sorted(t))) for n, t in small_graph().assigned([]).items()], "rule string, tags string")


@query("SELECT p_brand AS name, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand")
def rule_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule instances of equal name, query, replacement and directory are one."""
    i = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("query"), F.lit("").alias("replace"), F.lit(None).cast("string").alias("directory"))
    return i.dropDuplicates(["name", "query", "replace", "directory"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('boolean_literal_cleanup', '(own) @x'), ('flag', '(identifier) @x')) t(name, query)")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user rule hides the built-in one of its name."""
    g = RuleGraph([Rule("boolean_literal_cleanup", "(own) @x"), Rule("flag", "(identifier) @x")]).merged(config.built_in("java"))
    return spark.createDataFrame([(n, g.rules[n].query) for n in ("boolean_literal_cleanup", "flag")], "name string, query string")


# trees -----------------------------------------------------------------------------------


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.node_table(scan.text_table(read(spark, sf_dir, "pages"), F.col("page_id"), "html"), languages.language("html").parse)


@query("SELECT CAST(page_id AS VARCHAR) AS path, kind, n FROM (SELECT page_id, 'li' AS kind, len(regexp_extract_all(html, '<li[ >]')) AS n FROM pages UNION ALL SELECT page_id, 'a', len(regexp_extract_all(html, '<a[ >]')) FROM pages UNION ALL SELECT page_id, 'h1', len(regexp_extract_all(html, '<h1[ >]')) FROM pages) WHERE n > 0")
def html_kind_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = page_nodes(spark, sf_dir).filter(F.col("kind").isin("li", "a", "h1"))
    return n.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(page_id AS VARCHAR) AS path, len(regexp_extract_all(regexp_extract(html, '<nav>.*</nav>', 0, 's'), '<a[ >]')) AS n FROM pages WHERE html LIKE '%<nav>%'")
def html_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside the navigation of each page, by containment of intervals."""
    n = page_nodes(spark, sf_dir).withColumn("label", F.col("kind"))
    links = ct.enclosing(n.filter("kind = 'a'").select("path", "pre"), n.filter("kind = 'nav'"))
    return links.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def tree_matches(units: DataFrame, language: str, pattern: str, captures: list[str]) -> DataFrame:
    """path, start_byte, one column a capture: a tree query over each unit, as a plan over its nodes."""
    nodes = keep(tree_plan.parsed(units, language, dirty=True), "nodes")
    found = tree_plan.find_all(units, nodes.filter("pre IS NOT NULL"), pattern)
    out = keep(found.select("path", F.col("start").cast("long").alias("start_byte"), *(F.col("captures")[c].alias(c) for c in captures)), "found")
    discard(nodes)
    return out


def template_matches(units: DataFrame, language: str, pattern: str, captures: list[str]) -> DataFrame:
    """path, start_byte, one column a capture: a concrete-syntax template over each unit."""
    schema = "path string, start_byte bigint" + "".join(f", `{c}` string" for c in captures)

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                tree = languages.language(language).parse(content or "")
                rows += [(path, m.start, *(m.captures[c].text if c in m.captures else None for c in captures)) for m in tm.find_all(tree, tree.root, pattern)]
            yield pd.DataFrame(rows, columns=["path", "start_byte", *captures])

    return units.select("path", "content").mapInPandas(run, schema)


@query("SELECT CAST(event_id AS VARCHAR) AS path, '\"k\"' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = scan.text_table(read(spark, sf_dir, "events"), F.col("event_id"), "props")
    return tree_matches(u, "json", '((pair key: (string) @key value: (number) @value) @p (#eq? @key "\\"k\\""))', ["key", "value"]).select("path", "key", "value")


JAVA_UNIT = "'class C' || p_partkey || ' { int f(int a) { int b = g(a, ' || p_size || '); return h(b) + ' || p_size || '; } }'"


def java_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat(F.lit("/src/"), F.col("p_size") % 5, F.lit("/C"), "p_partkey", F.lit(".java")).alias("path"), F.expr(JAVA_UNIT).alias("content"))


PART_PATH = "'/src/' || (p_size % 5) || '/C' || p_partkey || '.java'"


@query(f"SELECT {PART_PATH} AS path, 'g' AS name, CAST(p_size AS VARCHAR) AS second FROM part")
def tree_query_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "((method_invocation name: (identifier) @name arguments: (argument_list . (_) . (_) @second .)) @call)"
    return tree_matches(java_units(spark, sf_dir), "java", q, ["name", "second"]).drop("start_byte")


@query(f"SELECT {PART_PATH} AS path, 'a, ' || p_size AS args FROM part")
def template_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_matches(java_units(spark, sf_dir), "java", "g(:[args+])", ["args"]).drop("start_byte")


@query(f"SELECT {PART_PATH} AS path, 'h(b)' AS left FROM part WHERE p_size IN (7, 9)")
def template_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ':[left] + :[n] |> :[n] in ["7", "9"], :[left] matches /^h/'
    return template_matches(java_units(spark, sf_dir), "java", q, ["left"]).select("path", "left").distinct()


# rewriting ------------------------------------------------------------------------------------

FLAG = config.parse_graph(
    r"""
[[rules]]
name = "replace_flag"
query = '''((method_invocation name: (identifier) @name arguments: (argument_list (string_literal) @literal)) @call (#eq? @name "isOn") (#eq? @literal "\"@flag\""))'''
replace_node = "call"
replace = "@treated"
holes = ["flag", "treated"]
groups = ["replace_expression_with_boolean_literal"]
"""
)
CODE_SQL = """CASE p_size % 4
 WHEN 0 THEN 'class C {' || chr(10) || '  int f() {' || chr(10) || '    boolean x = flags.isOn("' || p_brand || '");' || chr(10) || '    if (x || other()) {' || chr(10) || '      return ' || p_size || ';' || chr(10) || '    }' || chr(10) || '    return 0;' || chr(10) || '  }' || chr(10) || '}'
 WHEN 1 THEN 'class C { void f() { if (!flags.isOn("' || p_brand || '")) { a(); } else { b(' || p_size || '); } } }'
 WHEN 2 THEN 'class C { int f() { return flags.isOn("' || p_brand || '") && t() ? ' || p_size || ' : 999; } }'
 ELSE 'class C { void f() { c(' || p_size || '); } }' END"""
DONE_SQL = """CASE p_size % 4
 WHEN 0 THEN 'class C {' || chr(10) || '  int f() {' || chr(10) || '    return ' || p_size || ';' || chr(10) || '  }' || chr(10) || '}'
 WHEN 1 THEN 'class C { void f() { b(' || p_size || '); } }'
 ELSE 'class C { int f() { return t() ? ' || p_size || ' : 999; } }' END"""


def flag_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.expr(PART_PATH).alias("path"), F.expr(CODE_SQL).alias("content"), "p_brand")


@query(f"SELECT {PART_PATH} AS path, {DONE_SQL} AS content, CAST(NULL AS VARCHAR) AS error FROM part WHERE p_size % 4 <> 3 AND p_brand = (SELECT min(p_brand) FROM part)")
def flag_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale-flag cleanup of synthesised classes: seed, boolean simplification, inlining, dead code."""
    units = flag_units(spark, sf_dir)
    brand = units.agg(F.min("p_brand").alias("b")).first()["b"]
    options = Options(substitutions={"flag": brand, "treated": "true"})
    return ex.execute(units, FLAG.merged(config.built_in("java")), options).select("path", "content", "error")


@query(f"SELECT rule, count(*) AS n FROM (SELECT unnest(CASE p_size % 4 WHEN 0 THEN ['replace_flag','delete_variable_declaration','replace_identifier_with_value','simplify_true_or_something','simplify_if_statement_true','remove_unnecessary_nested_block','delete_all_statements_after_return'] WHEN 1 THEN ['replace_flag','simplify_not_true','simplify_if_statement_false','remove_unnecessary_nested_block'] WHEN 2 THEN ['replace_flag','simplify_true_and_something'] ELSE [] END) AS rule FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) GROUP BY rule")
def rewrite_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = flag_units(spark, sf_dir)
    brand = units.agg(F.min("p_brand").alias("b")).first()["b"]
    options = Options(substitutions={"flag": brand, "treated": "true"})
    return ex.frequency(ex.execute(units, FLAG.merged(config.built_in("java")), options))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'class C { int x = ' || p_size || '; }' AS content FROM part")
def fixpoint_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule is applied until it matches nowhere."""
    g = config.parse_graph('[[rules]]\nname = "parens"\nquery = "((parenthesized_expression (_) @inner) @outer)"\nreplace_node = "outer"\nreplace = "@inner"\n')
    u = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("class C { int x = "), F.expr("repeat('(', 1 + p_size % 3)"), "p_size", F.expr("repeat(')', 1 + p_size % 3)"), F.lit("; }")).alias("content"))
    return ex.execute(u, g).select("path", "content")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, 'classC{voidf(){g(' || CASE p_size % 3 WHEN 2 THEN 'b' ELSE 'b,c' END || ');}}' AS content FROM part")
def delete_with_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting an argument takes its comma along; compared without white space."""
    g = config.parse_graph('[[rules]]\nname = "drop"\nquery = "((argument_list (identifier) @old) @list (#eq? @old \\"old\\"))"\nreplace_node = "old"\nreplace = ""\n')
    args = F.when(F.col("p_size") % 3 == 0, "old, b, c").when(F.col("p_size") % 3 == 1, "b, old, c").otherwise("b, old")
    u = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("class C { void f() { g("), args, F.lit("); } }")).alias("content"))
    return ex.execute(u, g).select("path", tx.without_space(F.col("content")).alias("content"))


HOLDER = '[[rules]]\nname = "holder"\nquery = """((field_declaration declarator: (variable_declarator name: (identifier) @key value: (string_literal) @value)) @field)"""\n\n[[rules]]\nname = "inline"\nquery = """((identifier) @use (#eq? @use "@key"))"""\nreplace_node = "use"\nreplace = "@value"\nholes = ["key", "value"]\nis_seed_rule = false\n[[rules.filters]]\nnot_enclosing_node = "(field_declaration) @f"\n'


def nation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A holder of a constant for each region, and a user of it for each nation, in the region's folder or below."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("/r/"), "r_regionkey", F.lit("/Keys.java")).alias("path"), F.concat(F.lit("class Keys { String KEY"), "r_regionkey", F.lit(' = "'), "r_name", F.lit('"; }')).alias("content"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("/r/"), "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "/N").otherwise("/sub/N"), "n_nationkey", F.lit(".java")).alias("path"), F.concat(F.lit("class N { Object o() { return f(KEY"), "n_regionkey", F.lit("); } }")).alias("content"))
    return r.unionByName(n)


def _propagated(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    g = config.parse_graph(HOLDER, f'[[edges]]\nscope = "{scope}"\nfrom = "holder"\nto = ["inline"]\n')
    out = ex.execute(nation_units(spark, sf_dir), g)
    return out.filter(F.size("rewrites") > 0).select("path", "content")


USER_SQL = "SELECT '/r/' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '/N' ELSE '/sub/N' END || n_nationkey || '.java' AS path, 'class N { Object o() { return f(\"' || r_name || '\"); } }' AS content FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(USER_SQL)
def global_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _propagated(spark, sf_dir, "Global")


@query(USER_SQL + " WHERE n_nationkey % 2 = 0")
def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _propagated(spark, sf_dir, "Directory")


@query(USER_SQL)
def directory_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _propagated(spark, sf_dir, "DirectoryRecursive")


@query("SELECT '/r/' || r_regionkey || '/Keys.java' AS path, 'key=KEY' || r_regionkey AS fact, CAST(13 AS BIGINT) AS start_byte FROM region")
def fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = config.parse_graph('[[rules]]\nname = "key"\nquery = """((field_declaration declarator: (variable_declarator name: (identifier) @key)) @field)"""\n[rules.fact]\nkey = "@key"\n')
    out = ex.execute(nation_units(spark, sf_dir), g).select("path", F.explode("facts").alias("f"))
    return out.select("path", fc.as_text(F.col("f.data")).alias("fact"), F.col("f.range.start_byte").alias("start_byte"))


@query("SELECT '/r/' || r_regionkey || '/Keys.java' AS path, 'holder' AS rule, CAST(1 AS BIGINT) AS n FROM region")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only units with a match, a rewrite or a fact are reported; the JSON form has the same matches."""
    g = config.parse_graph(HOLDER.split("[[rules]]\nname = \"inline\"")[0])
    out = ex.to_json(ex.execute(nation_units(spark, sf_dir), g))
    got = F.from_json("value", "path string, matches array<struct<rule: string>>")
    return out.select(got.alias("v")).select("v.path", F.explode("v.matches.rule").alias("rule")).groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_cleanup(spark, sf_dir)
