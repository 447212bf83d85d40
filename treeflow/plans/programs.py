"""Programs of several steps: each step's graph may be made from what earlier steps matched."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .execute import execute
from .graph import RuleGraph
from .materialise import discard, keep
from .model import Edge, Options, Rule
from .store import NodeStore

#: From the distinct captures of a step (rule, captures) to the next graph.
GraphMaker = Callable[[list[tuple[str, dict[str, str]]]], RuleGraph]


@dataclass
class Step:
    """A named step: a graph, or a maker of one from the captures of the step before it."""

    name: str
    graph: RuleGraph | GraphMaker
    substitutions: dict[str, str] | None = None


def captures_of(summary: DataFrame, most: int = 10_000) -> list[tuple[str, dict[str, str]]]:
    """Distinct (rule, captures) of all matches and rewrites; more than most is an error, as each becomes a rule."""
    rows = summary.select(F.explode("matches").alias("x")).select("x.rule", F.col("x.m.matches").alias("c"))
    rows = rows.unionByName(summary.select(F.explode("rewrites").alias("x")).select(F.col("x.matched_rule").alias("rule"), F.col("x.p_match.matches").alias("c")))
    found = rows.select("rule", F.array_sort(F.map_entries("c")).alias("c")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} distinct captures")
    return sorted(((r["rule"], {e["key"]: e["value"] for e in r["c"]}) for r in found), key=lambda x: (x[0], sorted(x[1].items())))


def run_steps(units: DataFrame, steps: Iterable[Step], options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(units after all steps, step / path / rule / n of what each did).

    A file that fails in a step goes on unchanged to the next one.  Steps that only look
    share one store of nodes, so a unit that no step changed is parsed once.
    """
    options = options or Options()
    store = NodeStore(options.language, options.allow_dirty_ast)
    current, done, captured = units.select("path", "content"), None, []
    for step in steps:
        graph = step.graph if isinstance(step.graph, RuleGraph) else step.graph(captured)
        if not graph.rules:
            continue
        o = options if step.substitutions is None else replace(options, substitutions=step.substitutions)
        summary = keep(execute(current, graph, o, store=store), "step")
        captured = captures_of(summary)
        did = summary.select("path", F.explode(F.concat("matches.rule", "rewrites.matched_rule")).alias("rule")).groupBy("path", "rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step.name).alias("step"), "path", "rule", "n")
        did = keep(did, "did")
        done = did if done is None else done.unionByName(did)
        new = summary.select("path", F.col("content").alias("new"))
        before = current
        current = keep(current.join(new, "path", "left").select("path", F.coalesce("new", "content").alias("content")), "units")
        discard(summary)
        if hasattr(before, "_kept"):
            discard(before)
    store.forget()
    if done is None:
        raise ValueError("no step had a rule")
    return current, done


def replacements(mapping: dict[str, str], query: str, node: str, scope: str | None = None) -> RuleGraph:
    """One rule for each pair: query with @from replaced, its node by the new text; chained by scope if given."""
    rules = [Rule(f"replace_{i}", query.replace("@from", a), node, replace=b) for i, (a, b) in enumerate(sorted(mapping.items()))]
    edges = [Edge(a.name, (b.name,), scope) for a, b in zip(rules, rules[1:], strict=False)] if scope else []
    return RuleGraph(rules, edges)
