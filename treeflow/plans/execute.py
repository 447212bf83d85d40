"""Running programs over unit tables.

Units are evaluated to a fixpoint inside executors, in parallel by file.  Rule
instances meant for other files are rows: after a round they are joined with the files
that hold their values (``rounds``), and only those files are visited again, with the
instances that they haven't run.  A round writes the units that it visited, in the
shared folder; the last version of a unit counts.  What reaches the driver are counts,
one value for each global tag, and instances that no value or folder confines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Rgx
from ..operators.rewrite import Edit, Fact, Match, Unit
from ..sources import scan, sink
from . import rounds, tree_plan
from .graph import RuleGraph
from .materialise import keep, shared_dir
from .model import Instance, Options, ProgramError, Rule, dialect, instantiate

ROWS_A_BATCH = 256  # units that wait in memory for one Arrow batch
POINT = "struct<row: int, column: int>"
RANGE = f"struct<start_byte: bigint, end_byte: bigint, start_point: {POINT}, end_point: {POINT}>"
MATCH = f"struct<matched_string: string, range: {RANGE}, matches: map<string, string>>"
SUMMARY = f"path string, original_content string, content string, matches array<struct<rule: string, m: {MATCH}>>, rewrites array<struct<p_match: {MATCH}, replacement_string: string, matched_rule: string>>, facts array<struct<range: {RANGE}, data: map<string, string>, voided: boolean>>, bindings map<string, string>, outgoing array<string>, todo array<string>, ran array<string>, error string"
INTERNAL = ("bindings", "outgoing", "todo", "ran")


def _point(raw: bytes, offset: int) -> dict:
    return {"row": raw.count(b"\n", 0, offset), "column": offset - (raw.rfind(b"\n", 0, offset) + 1)}


def _range(raw: bytes, start: int, end: int) -> dict:
    return {"start_byte": start, "end_byte": end, "start_point": _point(raw, start), "end_point": _point(raw, end)}


def _out_match(raw: bytes, m: Match) -> dict:
    return {"matched_string": m.text, "range": _range(raw, m.start, m.end), "matches": list(m.captures.items())}


def _in_match(d: dict) -> Match:
    return Match(d["range"]["start_byte"], d["range"]["end_byte"], d["matched_string"], dict(d["matches"]))


def _evaluator(graph: RuleGraph, options: Options, tags: dict[str, str], schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for b in batches:
            done = []
            for row in b.to_pylist():
                if row["error"] is None:
                    try:
                        u = Unit(row["path"], row["content"] or "", graph, options, {**dict(row["bindings"] or ()), **tags})
                        u.matches = [(x["rule"], _in_match(x["m"])) for x in row["matches"]]
                        u.rewrites = [Edit(x["matched_rule"], _in_match(x["p_match"]), x["replacement_string"]) for x in row["rewrites"]]
                        u.facts = [Fact(x["range"]["start_byte"], x["range"]["end_byte"], dict(x["data"]), x["voided"]) for x in row["facts"]]
                        u.run([rounds.instance(graph, x) for x in [*row["ran"], *row["todo"]]])
                        raw = u.code.encode()
                        row |= {
                            "content": u.code,
                            "matches": [{"rule": n, "m": _out_match(raw, m)} for n, m in u.matches],
                            "rewrites": [{"p_match": _out_match(raw, e.match), "replacement_string": e.replacement, "matched_rule": e.rule} for e in u.rewrites],
                            "facts": [{"range": _range(raw, f.start, f.end), "data": list(f.data.items()), "voided": f.voided} for f in u.facts],
                            "bindings": list(u.bindings.items()),
                            "outgoing": sorted({rounds.message(i) for i in u.outgoing}),
                        }
                    except Exception as e:  # whatever a file does to its parser or rules is that file's error, not the job's
                        row |= {"error": str(e) if isinstance(e, ValueError) else f"{row['path']}: {type(e).__name__}: {e}"[:500], "outgoing": []}
                done.append(row | {"ran": [*row["ran"], *row["todo"]], "todo": []})
                if len(done) == ROWS_A_BATCH:
                    yield pa.RecordBatch.from_pylist(done, schema=out)
                    done = []
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)

    return run


def execute(units: DataFrame, graph: RuleGraph, options: Options | None = None, max_rounds: int = 50, path: str = "auto", store=None) -> DataFrame:
    """Summaries (SUMMARY without bindings and outgoing) of the units that matched, changed, hold facts or failed.

    units has path and content.  A unit that fails keeps its text and says why in error.
    Programs that only look run as DataFrame plans over a node table (``tree_plan``),
    others as a loop for each file; path "plan" or "loop" asks for one of them.  A
    ``store.NodeStore`` keeps the nodes that plans have parsed for the next program.
    """
    options = options or Options()
    if path not in ("auto", "plan", "loop"):
        raise ProgramError(f"no path of execution is named {path}")
    if options.should_validate and (found := graph.warnings(options.substitutions)):
        raise ProgramError("; ".join(found))
    active = graph.seeds(options.substitutions)
    if not active:
        raise ProgramError("the program has no seed rule")
    values = [v for i in active for _, v in i.bindings]
    units = scan.spread(units.select("path", "content"))
    start = scan.grep(units, values)
    schema = units.sparkSession.createDataFrame([], SUMMARY).schema
    if path != "loop":
        hindrance = tree_plan.why_not(graph, options, active)
        if hindrance is None:
            return tree_plan.run(start, active, options, schema, store)
        if path == "plan":
            raise ProgramError(f"no plan: {hindrance}")
    return _rounds(units, start, graph, options, active, schema, max_rounds)


def _rounds(units: DataFrame, start: DataFrame, graph: RuleGraph, options: Options, active: list[Instance], schema, max_rounds: int) -> DataFrame:
    """The loop over files, in rounds; ``_visited`` of the result says how many units each round ran."""
    empty = {"matches": "array()", "rewrites": "array()", "facts": "array()", "bindings": "map()", "outgoing": "array()", "todo": "array()", "ran": "array()", "error": "null"}

    def fresh(df: DataFrame, todo: list[str], more=None) -> DataFrame:
        first = F.array(*map(F.lit, todo)).cast("array<string>")
        values = {**{k: F.expr(v) for k, v in empty.items()}, "original_content": F.col("content"), "todo": first if more is None else F.concat(first, more)}
        return df.select(*(values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))

    everywhere = [rounds.message(i) for i in active]
    deltas: list[DataFrame] = []
    visited: list[int] = []
    tags: dict[str, str] = {}
    known = index = None
    work = fresh(start, everywhere)
    spreads = any(s in ("Global", "Directory", "DirectoryRecursive") for out in graph.out.values() for s, _ in out)
    for k in range(max_rounds):
        delta = keep(work.mapInArrow(_evaluator(graph, options, dict(tags), schema), schema), "units")
        visited.append(delta.count())
        if not visited[-1] and k:
            break
        deltas.append(delta.withColumn("round", F.lit(k)))
        if not spreads:
            break
        asked = delta.select(F.explode("outgoing").alias("o")).distinct().filter(~F.col("o").isin(everywhere))
        told = units.sparkSession.createDataFrame([], rounds.INSTANCE) if known is None else known
        new = keep(rounds.instances(asked.join(told, "o", "left_anti"), graph), "instances")
        prefix = options.global_tag_prefix
        shared = delta.select(F.explode("bindings")).filter(F.col("key").startswith(prefix)).groupBy("key").agg(F.min("value").alias("value")).collect()  # one row a tag
        unseen = {r["key"]: r["value"] for r in shared if r["key"] not in tags}
        tags |= unseen
        news = new.count()
        edited = delta.filter("content <> original_content AND error IS NULL").select("path", "content")
        if index is None:
            if not news:
                break
            index = rounds.Index(units)
        if not news and edited.isEmpty():
            break
        index.edited(edited)
        some = [] if known is None else [rounds.value_pairs(known, index.latest)]  # edits may bring an earlier instance's value into a file
        pairs = reduce(DataFrame.unionByName, some + ([rounds.value_pairs(new, index.words)] if news else []))
        known = new if known is None else known.unionByName(new)
        free = [r["o"] for r in new.filter("size(lookup) = 0 AND directory IS NULL").orderBy("o").collect()]
        work = _next(units, deltas, rounds.folder_pairs(new, _latest(deltas)) if news else None, pairs, everywhere, free, bool(news and unseen), fresh)
        everywhere += free
    else:
        raise ProgramError(f"no fixpoint after {max_rounds} rounds")
    every = reduce(DataFrame.unionByName, deltas)
    last = every.join(_latest(deltas), ["path", "round"]) if len(deltas) > 1 else every
    some = (F.size("matches") + F.size("rewrites") + F.size("facts") > 0) | F.col("error").isNotNull()
    out = last.filter(some).select(*(f.name for f in schema.fields if f.name not in INTERNAL))
    out._visited = visited
    return out


def _latest(deltas: list[DataFrame]) -> DataFrame:
    """path, round of the last version of every unit of the state."""
    return reduce(DataFrame.unionByName, [d.select("path", "round") for d in deltas]).groupBy("path").agg(F.max("round").alias("round"))


def _next(units: DataFrame, deltas: list[DataFrame], in_folders: DataFrame | None, pairs: DataFrame, everywhere: list[str], free: list[str], all_units: bool, fresh) -> DataFrame:
    """The units of the next round with what they have to run: those of the state, and those that a value leads to first now."""
    now = reduce(DataFrame.unionByName, deltas).join(_latest(deltas), ["path", "round"])
    unseen = units.join(_latest(deltas).select("path"), "path", "left_anti")
    texts = now.filter("error IS NULL").select("path", "content").unionByName(unseen)
    held = texts.join(pairs, "path").filter(F.contains("content", F.col("value"))).select("path", "o")
    asked = held if in_folders is None else held.unionByName(in_folders)
    asked = keep(asked.groupBy("path").agg(F.array_sort(F.collect_set("o")).alias("asked")), "asked")
    known = now.filter("error IS NULL").join(asked, "path", "left" if free or all_units else "inner")
    todo = F.array_except(F.coalesce("asked", F.array().cast("array<string>")), "ran")
    if free:
        todo = F.concat(F.array(*map(F.lit, free)), todo)
    columns = deltas[0].columns[:-1]
    again = known.withColumn("todo", todo).withColumn("outgoing", F.array().cast("array<string>"))
    again = (again if all_units else again.filter(F.size("todo") > 0)).select(columns)
    return again.unionByName(fresh(unseen.join(asked, "path"), [*everywhere, *free], F.col("asked")).select(columns))


def regex_matches(units: DataFrame, rule: Rule, substitutions: dict[str, str]) -> DataFrame:
    """path, ord, matched, one column a tag: a match-only regex rule as a plain Catalyst plan."""
    if dialect(rule.query) != "rgx" or not rule.is_match_only or rule.filters:
        raise ProgramError("the declarative path takes match-only regex rules without filters")
    bound = {h: substitutions[h] for h in rule.holes}
    rgx = Rgx(instantiate(rule.query[4:], bound, pattern=True))
    texts = scan.spread(scan.grep(units, bound.values()).select("path", "content"))
    return texts.select("path", F.posexplode(rgx.captures(F.col("content"))).alias("ord", "c")).select("path", "ord", "c.*")


def frequency(summary: DataFrame) -> DataFrame:
    """rule, n over matches and rewrites."""
    a = summary.select(F.explode("matches.rule").alias("rule"))
    b = summary.select(F.explode("rewrites.matched_rule").alias("rule"))
    return a.unionByName(b).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def to_json(summary: DataFrame) -> DataFrame:
    """One JSON document a row, without the original text."""
    return summary.select(F.to_json(F.struct(*(c for c in summary.columns if c not in ("original_content", "error")))).alias("value"))


def persist(summary: DataFrame, options: Options) -> None:
    """Puts changed files where they were read, all or none (``sources.sink``); nothing under dry_run; empties go if so wanted."""
    if options.dry_run:
        return
    content = F.when(F.col("content") == "", F.lit(None)).otherwise(F.col("content")) if options.delete_file_if_empty else F.col("content")
    changed = summary.filter("error IS NULL AND content <> original_content").select("path", content.alias("content"))
    spark = summary.sparkSession
    folder = sink.stage(changed, f"{shared_dir(spark)}/treeflow-core/manifests-{uuid.uuid4().hex}")
    sink.put_in_place(spark, folder)
