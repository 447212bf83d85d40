"""Rules that follow from truth tables, made from a description of a language's grammar.

A pack's ``[folding]`` table says how its grammar spells things; the rules are worked out here:

* ``constants``: for each truth value, ``node`` (a pattern for an operand that is this constant) and
  ``where`` (predicates or constraints that go with it);
* ``negation``, ``and``, ``or``: patterns with ``{x}``, or ``{left}`` and ``{right}``, for the operands, and ``{where}``;
* ``operand``, ``kept``: any operand, and how a replacement speaks of it;
* ``prefix``: what the names of the rules begin with; ``groups``; ``replace_node``.

``[[equality]]`` tables describe comparisons of two literals: ``pattern`` with ``{op}``, ``{one}``, ``{other}``, the
literal ``kinds`` of the grammar, and the names of the rules for operands of one text (``same``) and of two
(``different``), by operator.  Kinds that have several spellings of one value belong only to ``same``.
"""

from __future__ import annotations

from collections.abc import Iterator

TRUTH = {"true": True, "false": False}


def _say(value: bool) -> str:
    return "true" if value else "false"


def folding(g: dict) -> Iterator[dict]:
    """Rules for negated constants, and for conjunctions and disjunctions with a constant on either side."""
    common = {"replace_node": g.get("replace_node", "whole"), "groups": g["groups"], "is_seed_rule": False}
    prefix, operand, kept = g.get("prefix", ""), g["operand"], g["kept"]
    for word, value in TRUTH.items():
        constant = g["constants"][word]
        yield common | {"name": f"{prefix}not_{word}", "query": g["negation"].format(x=constant["node"], where=constant["where"]), "replace": _say(not value)}
        for op, meaning in (("and", lambda a, b: a and b), ("or", lambda a, b: a or b)):
            outcomes = {meaning(value, other) for other in TRUTH.values()}
            result = _say(outcomes.pop()) if len(outcomes) == 1 else kept
            sides = {f"{word}_{op}_something": (constant["node"], operand), f"something_{op}_{word}": (operand, constant["node"])}
            for name, (left, right) in sides.items():
                yield common | {"name": prefix + name, "query": g[op].format(left=left, right=right, where=constant["where"]), "replace": result}


def equality(g: dict) -> Iterator[dict]:
    """Rules for comparisons of literals whose outcome their texts decide."""
    for alike, kinds in (("same", g["kinds"] + g.get("same_only", [])), ("different", g["kinds"])):
        for op, name in g.get(alike, {}).items():
            any_of = "[" + " ".join(f"({k})" for k in kinds) + "]"
            test = "#eq?" if alike == "same" else "#not-eq?"
            body = g["pattern"].format(op=op, one=f"{any_of} @one", other=f"{any_of} @other")
            yield {"name": name, "query": f"({body} @whole ({test} @one @other))", "replace_node": "whole", "replace": _say((op == "==") == (alike == "same")), "groups": g["groups"], "is_seed_rule": False}


def expand(program: dict) -> list[dict]:
    """Rule tables for a program's descriptions, before those it spells out."""
    out = list(folding(program["folding"])) if "folding" in program else []
    for g in program.get("equality", ()):
        out += equality(g)
    return out
