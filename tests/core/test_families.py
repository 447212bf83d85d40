"""Rules made from a grammar's description fold as the truth tables say, in every pack."""

from dataclasses import replace

import pytest

from treeflow.operators.rewrite import Unit
from treeflow.plans.graph import RuleGraph
from treeflow.plans.model import Options
from treeflow.sources.config import built_in, parse_graph

AROUND = {
    "java": "class A { boolean f() { return %s; } }",
    "java_cs": "class A { boolean f() { return %s; } }",
    "go": "package p\nfunc f() bool { return %s }\n",
    "kt": "fun f() = %s\n",
    "swift": "func f() -> Bool { return %s }",
}


def folded(pack, expression):
    rules = [replace(r, is_seed_rule=True) for r in built_in(pack).rules.values() if "boolean_expression_simplify" in r.groups]
    graph = RuleGraph(rules)
    u = Unit("/s/a", AROUND[pack] % expression, graph, Options(language=pack))
    u.run(graph.seeds({}))
    before, after = AROUND[pack].split("%s")
    assert u.code.startswith(before) and u.code.endswith(after)
    return u.code[len(before) : len(u.code) - len(after)], [e.rule for e in u.rewrites]


@pytest.mark.parametrize("pack", AROUND)
def test_constants_fold(pack):
    table = {"&&": lambda a, b: a and b, "||": lambda a, b: a or b}
    say = lambda v: "true" if v else "false"
    for v in (True, False):
        for written in (say(v), f"({say(v)})"):
            assert folded(pack, f"!{written}")[0] == say(not v)
        for op, meaning in table.items():
            outcomes = {meaning(v, True), meaning(v, False)}
            want = say(outcomes.pop()) if len(outcomes) == 1 else "g(1)"
            word = {"&&": "and", "||": "or"}[op]
            for expression, name in ((f"{say(v)} {op} g(1)", f"{say(v)}_{word}_something"), (f"g(1) {op} {say(v)}", f"something_{word}_{say(v)}")):
                got, rules = folded(pack, expression)
                assert got == want, (pack, expression, got)
                assert rules[-1].removeprefix("simplify_") == name
            assert folded(pack, f"g(1) {op} h()")[0] == f"g(1) {op} h()"


@pytest.mark.parametrize(
    ("pack", "expression", "want"),
    [
        ("java", "true == true", "true"),
        ("java", "true != false", "true"),
        ("java_cs", "false != false", "false"),
        ("kt", "1e5 == 1e5", "true"),
        ("kt", "1.0f != 1.0f", "false"),
        ("kt", "1 == 2", "false"),
        ("kt", "1.0 == 1.00", "1.0 == 1.00"),
        ("kt", "a == a", "a == a"),
        ("go", "1.5 == 1.5", "true"),
        ("go", '"a" != "a"', "false"),
        ("go", "a == b", "a == b"),
        ("swift", "g(1) ? h(2) : h(2)", "h(2)"),
        ("swift", "g(1) ? h(2) : h(3)", "g(1) ? h(2) : h(3)"),
    ],
)
def test_comparisons_that_texts_decide(pack, expression, want):
    assert folded(pack, expression)[0] == want


def test_descriptions_in_a_program_of_ones_own():
    graph = parse_graph('[folding]\nnegation = "((not {x}) @whole{where})"\nand = "((a {left} {right}) @whole{where})"\nor = "((o {left} {right}) @whole{where})"\noperand = "(_) @kept"\nkept = "@kept"\ngroups = []\nconstants.true = {node = "(t)", where = ""}\nconstants.false = {node = "(f)", where = ""}\n')
    made = {r.name: (r.query, r.replace) for r in graph.rules.values()}
    assert len(made) == 10
    assert made["not_true"] == ("((not (t)) @whole)", "false")
    assert made["something_or_false"] == ("((o (_) @kept (f)) @whole)", "@kept")
    assert made["false_and_something"] == ("((a (f) (_) @kept) @whole)", "false")
