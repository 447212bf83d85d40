"""Programs from TOML: rules.toml, edges.toml and scope_config.toml."""

from __future__ import annotations

import tomllib
from importlib import resources
from pathlib import Path

from ..plans.graph import RuleGraph
from ..plans.model import Edge, Filter, ProgramError, Rule, Scope
from ..rules.families import expand


def _load(text: str, name: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ProgramError(f"{name} is not TOML: {e}") from e


def read_filter(d: dict) -> Filter:
    known = {k: v for k, v in d.items() if k in Filter.__dataclass_fields__}
    known["not_contains"] = tuple(known.get("not_contains", ()))
    known["fact_filter"] = tuple(sorted(known.get("fact_filter", {}).items()))
    return Filter(**known)


def read_rule(d: dict) -> Rule:
    known = {k: v for k, v in d.items() if k in Rule.__dataclass_fields__}
    for k in ("groups", "holes"):
        known[k] = frozenset(known.get(k, ()))
    known["filters"] = tuple(map(read_filter, known.get("filters", ())))
    known["keep_comment_regexes"] = tuple(known.get("keep_comment_regexes", ()))
    known["fact"] = tuple(sorted(known.get("fact", {}).items()))
    return Rule(**known)


def parse_graph(rules: str = "", edges: str = "", scopes: str = "") -> RuleGraph:
    """A graph from TOML texts; unknown keys are ignored, malformed text is an error."""
    program = _load(rules, "rules")
    rs = [read_rule(d) for d in [*expand(program), *program.get("rules", ())]]
    es = [Edge(d.get("from", d.get("frm", "")), tuple(d["to"]), d["scope"]) for d in _load(edges, "edges").get("edges", ())]
    ss = [Scope(d["name"], tuple((r["enclosing_node"], r["scope"]) for r in d.get("rules", ()))) for d in _load(scopes, "scope_config").get("scopes", ())]
    return RuleGraph(rs, es, ss)


def read_graph(folder: str) -> RuleGraph:
    """A graph from a folder; a missing file is an empty one."""
    text = lambda n: p.read_text() if (p := Path(folder, n)).exists() else ""
    return parse_graph(text("rules.toml"), text("edges.toml"), text("scope_config.toml"))


def built_in(language: str) -> RuleGraph:
    """The rule pack that comes with the package, empty where there is none."""
    pack = resources.files("treeflow.rules").joinpath(language)
    text = lambda n: p.read_text() if (p := pack.joinpath(n)).is_file() else ""
    return parse_graph(text("rules.toml"), text("edges.toml"), text("scope_config.toml"))
