"""Rule graphs: groups, junctions, merging, successors and static analysis."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import templates, tree_query
from .model import STANDARD_SCOPES, Edge, Instance, ProgramError, Rule, Scope, bind, dialect


class RuleGraph:
    """Rules by name (the first of a name wins) and their outgoing (scope, rule) lists."""

    def __init__(self, rules: Iterable[Rule] = (), edges: Iterable[Edge] = (), scopes: Iterable[Scope] = ()):
        self.rule_list, self.edge_list, self.scopes = list(rules), list(edges), {s.name: s for s in scopes}
        self.rules: dict[str, Rule] = {}
        groups: dict[str, list[str]] = {}
        for r in self.rule_list:
            if r.name not in self.rules:
                self.rules[r.name] = r
            for g in sorted(r.groups):
                groups.setdefault(g, []).append(r.name)
        self.groups = groups
        self.out: dict[str, list[tuple[str, str]]] = {}
        for e in self.edge_list:
            if e.scope not in STANDARD_SCOPES and e.scope not in self.scopes:
                raise ProgramError(f"edge {e.source}: unknown scope {e.scope}")
            for a in self.members(e.source):
                for t in e.targets:
                    for b in self.members(t):
                        if (e.scope, b) not in self.out.setdefault(a, []):
                            self.out[a].append((e.scope, b))

    def members(self, name: str) -> list[str]:
        """The rule of that name, else the rules of that group."""
        return [name] if name in self.rules else self.groups.get(name, [])

    def merged(self, other: RuleGraph) -> RuleGraph:
        """Own rules and edges before other's."""
        return RuleGraph([*self.rule_list, *other.rule_list], [*self.edge_list, *other.edge_list], [*self.scopes.values(), *other.scopes.values()])

    def size(self) -> tuple[int, int]:
        return len(self.rules), sum(map(len, self.out.values()))

    def successors(self, name: str) -> dict[str, list[str]]:
        """Targets by scope; junctions are replaced by their own successors and scopes."""
        out: dict[str, list[str]] = {s: [] for s in STANDARD_SCOPES}

        def follow(n: str, trail: tuple[str, ...]) -> None:
            for scope, target in self.out.get(n, ()):
                if self.rules[target].is_dummy:
                    if target in trail:
                        raise ProgramError(f"junctions form a cycle: {' > '.join((*trail, target))}")
                    follow(target, (*trail, target))
                elif target not in out.setdefault(scope, []):
                    out[scope].append(target)

        follow(name, ())
        return out

    def ends(self, name: str) -> bool:
        """Whether no rule follows."""
        return not self.out.get(name)

    def next_of(self, name: str, bindings: Mapping[str, str]) -> dict[str, list[Instance]]:
        return {s: [bind(self.rules[t], bindings) for t in ts] for s, ts in self.successors(name).items()}

    def seeds(self, substitutions: Mapping[str, str]) -> list[Instance]:
        return [bind(r, substitutions) for r in self.rules.values() if r.is_seed_rule and not r.is_dummy]

    # static analysis
    @staticmethod
    def defined(rule: Rule) -> set[str]:
        if not rule.query:
            return set()
        kind = dialect(rule.query)
        if kind == "rgx":
            return set(re.findall(r"\(\?P?<([A-Za-z_]\w*)>", rule.query))
        if kind == "cs":
            return set(templates.compile_template(rule.query[3:].strip()).tags)
        return set(tree_query.compile_query(rule.query).tags)

    @staticmethod
    def used(rule: Rule) -> set[str]:
        if not rule.query or dialect(rule.query) == "cs":
            return set()
        if dialect(rule.query) == "rgx":
            return set(re.findall(r"@(\w+)", rule.query))
        return set(tree_query.compile_query(rule.query).used)

    def assigned(self, substitutions: Iterable[str]) -> dict[str, set[str]]:
        """Tags surely bound on entry of each reachable rule: a forward fixpoint with intersection at joins."""
        bound: dict[str, set[str] | None] = dict.fromkeys(self.rules)
        work = [r.name for r in self.rules.values() if r.is_seed_rule]
        for n in work:
            bound[n] = set(substitutions)
        while work:
            n = work.pop(0)
            leaving = (bound[n] or set()) | self.defined(self.rules[n])
            for _, t in self.out.get(n, ()):
                now = leaving if bound[t] is None else bound[t] & leaving
                if now != bound[t]:
                    bound[t] = set(now)
                    work.append(t)
        return {n: b for n, b in bound.items() if b is not None}

    def warnings(self, substitutions: Iterable[str] = ()) -> list[str]:
        out = []
        for n, bound in self.assigned(substitutions).items():
            r = self.rules[n]
            lacking = sorted((self.used(r) | set(r.holes)) - self.defined(r) - bound)
            if lacking:
                out.append(f"rule {n}: {', '.join(lacking)} may be unbound")
        return out

    # tables
    def rules_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.name, r.query, r.replace_node, r.replace, sorted(r.groups), sorted(r.holes), r.is_seed_rule, r.is_dummy) for i, r in enumerate(self.rule_list)]
        return spark.createDataFrame(rows, "ord int, name string, query string, replace_node string, replace string, groups array<string>, holes array<string>, is_seed_rule boolean, is_dummy boolean")

    def edges_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.source, list(e.targets), e.scope) for e in self.edge_list], "source string, targets array<string>, scope string")

    def dot(self) -> str:
        """The graph in DOT: groups as clusters, junctions dashed, edges by scope."""
        esc = lambda s: s.replace('"', '\\"')
        lines = ["digraph rules {", "  rankdir=LR;"]
        for k, (g, names) in enumerate(sorted(self.groups.items())):
            lines += [f"  subgraph cluster_{k} {{", f'    label="{esc(g)}";', *(f'    "{esc(n)}";' for n in names), "  }"]
        for r in self.rules.values():
            lines.append(f'  "{esc(r.name)}"' + (" [style=dashed];" if r.is_dummy else ";"))
        for a, targets in sorted(self.out.items()):
            lines += [f'  "{esc(a)}" -> "{esc(b)}" [label="{esc(s)}"];' for s, b in targets]
        return "\n".join([*lines, "}"])


def expand_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """source, target, scope of edges(source, targets, scope) with groups expanded through members(grp, name)."""
    flat = edges.select("source", F.explode("targets").alias("target"), "scope")
    a = members.select(F.col("grp").alias("source"), F.col("name").alias("from_rule"))
    b = members.select(F.col("grp").alias("target"), F.col("name").alias("to_rule"))
    return flat.join(a, "source").join(b, "target").select("from_rule", "to_rule", "scope").distinct()
