"""Facts under many edits, the store of nodes, and files written back with commit."""

import random

import pytest

from treeflow.operators import facts as fc
from treeflow.plans import execute as ex
from treeflow.plans import program_tables
from treeflow.plans.graph import RuleGraph
from treeflow.plans.model import Edge, Options, ProgramError, Rule
from treeflow.plans.store import NodeStore
from treeflow.sources import sink


def point(raw, at):
    return raw.count(b"\n", 0, at), at - (raw.rfind(b"\n", 0, at) + 1)


def test_facts_move_as_the_text_does(spark):
    rng = random.Random(3)
    facts, edits, want = [], [], []
    for k in range(60):
        path = f"/{k}"
        raw = "".join(rng.choice("ab é\n") for _ in range(rng.randrange(4, 60))).encode()
        bounds = [i for i in range(len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        cuts, at = [], 0
        while True:
            free = [b for b in bounds if b >= at]
            if len(free) < 2 or len(cuts) > 4:
                break
            s = rng.choice(free)
            e = rng.choice([b for b in bounds if s <= b <= s + 8])
            cuts.append((s, e, "".join(rng.choice("xy→\n") for _ in range(rng.randrange(4)))))
            at = e + 1
        new, last = b"", 0
        for s, e, t in cuts:
            new, last = new + raw[last:s] + t.encode(), e
            edits.append((path, s, e, point(raw, s)[1], raw[s:e].decode(), t))
        new += raw[last:]
        for _ in range(12):
            s = rng.choice(bounds)
            e = rng.choice([b for b in bounds if b >= s])
            facts.append((path, s, e, *point(raw, s), False, f"{k}-{len(facts)}"))
            if any(a < e and b > s and not b <= s for a, b, _ in cuts):
                want.append((path, s, e, *point(raw, s), True, facts[-1][-1]))
            else:
                d = sum(len(t.encode()) - (b - a) for a, b, t in cuts if b <= s)
                want.append((path, s + d, e + d, *point(new, s + d), False, facts[-1][-1]))
    f = spark.createDataFrame(facts, "path string, start int, end int, row int, column int, voided boolean, id string")
    e = spark.createDataFrame(edits, "path string, start int, old_end int, column int, old_text string, new_text string")
    assert sorted(map(tuple, fc.moved(f, e).select(f.columns).collect())) == sorted(want)


def test_store_parses_changed_units_only(spark):
    rows = [(f"/{i}.java", f"class A{i} {{ int x; }}") for i in range(6)]
    graph = RuleGraph([Rule("r", "((class_declaration name: (identifier) @c) @k)")])
    store = NodeStore("java")

    def names(rows):
        out = ex.execute(spark.createDataFrame(rows, "path string, content string"), graph, path="plan", store=store)
        return {(r.path, r.matches[0].m.matches["c"]) for r in out.collect()}

    assert names(rows) == {(f"/{i}.java", f"A{i}") for i in range(6)}
    changed = [*rows[:4], ("/4.java", "class B { }"), ("/7.java", "class C { }")]
    assert names(changed) == {(f"/{i}.java", f"A{i}") for i in range(4)} | {("/4.java", "B"), ("/7.java", "C")}
    assert names(rows[:2]) == {("/0.java", "A0"), ("/1.java", "A1")}
    assert store.parsed == [6, 2, 0]
    store.forget()


def test_files_are_written_all_or_none(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    folder = str(tmp_path / "manifests")
    rows = [(str(tmp_path / "a"), "né\n"), (str(tmp_path / "b"), None)]
    sink.stage(spark.createDataFrame(rows, "path string, content string"), folder)
    assert (tmp_path / "a").read_text() == "a" and (tmp_path / "b").exists()  # staged only
    for _ in range(2):
        sink.put_in_place(spark, folder)
        assert (tmp_path / "a").read_text() == "né\n" and not (tmp_path / "b").exists() and (tmp_path / "c").read_text() == "c"
    bad = [(str(tmp_path / "c"), "new"), (str(tmp_path / "no" / "such" / "place"), "x")]
    with pytest.raises(Exception, match="place|Failed|abort"):
        sink.stage(spark.createDataFrame(bad, "path string, content string").coalesce(1), str(tmp_path / "m2"))
    assert (tmp_path / "c").read_text() == "c" and not list(tmp_path.glob("*.staged"))
    with pytest.raises(ValueError, match="nothing was committed"):
        sink.put_in_place(spark, str(tmp_path / "m2"))


def test_empty_files_go_when_asked(spark, tmp_path):
    for keeps in (True, False):
        f = tmp_path / f"{keeps}.java"
        f.write_text("class A { }")
        rule = Rule("r", "((class_declaration) @k)", "k", replace="")
        out = ex.execute(spark.createDataFrame([(str(f), "class A { }")], "path string, content string"), RuleGraph([rule]))
        ex.persist(out, Options(dry_run=False, delete_file_if_empty=not keeps))
        assert f.exists() == keeps


def random_program(rng):
    """Rules with tags t0-t3, junctions that lead onward only, and edges with cycles among other rules."""
    names = [f"r{i}" for i in range(14)]
    dummy = {n for n in names if rng.random() < 0.3}
    rules = [Rule(n, "" if n in dummy else f"((identifier) @t{rng.randrange(4)})", is_seed_rule=n not in dummy and rng.random() < 0.2 or n == "r0" and n not in dummy) for n in names]
    edges = []
    for i, a in enumerate(names):
        for _ in range(rng.randrange(4)):
            j = rng.randrange(i + 1, 14) if a in dummy and i < 13 else None if a in dummy else rng.randrange(14)
            if j is not None:
                edges.append(Edge(a, (names[j],), rng.choice(["Parent", "Global", "Directory"])))
    return RuleGraph(rules, edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_programs_as_tables(spark, seed):
    graph = random_program(random.Random(seed))
    rules = spark.createDataFrame([(r.name, r.is_dummy, r.is_seed_rule, sorted(graph.defined(r))) for r in graph.rules.values()], "rule string, is_dummy boolean, is_seed boolean, defined array<string>")
    edges = spark.createDataFrame([(a, b, s) for a, out in graph.out.items() for s, b in out], "source string, target string, scope string")
    want = {(n, s, t) for n in graph.rules for s, ts in graph.successors(n).items() for t in ts}
    assert {(r.source, r.scope, r.target) for r in program_tables.successors(rules, edges).collect()} == want
    got = {r.rule: set(r.tags) for r in program_tables.assigned(rules, edges, ["t3", "u"]).collect()}
    assert got == graph.assigned(["t3", "u"])


def test_junctions_in_a_circle(spark):
    rules = spark.createDataFrame([("a", False), ("j", True), ("k", True)], "rule string, is_dummy boolean")
    edges = spark.createDataFrame([("a", "j", "x"), ("j", "k", "x"), ("k", "j", "x")], "source string, target string, scope string")
    with pytest.raises(ProgramError, match="circle|cycle"):
        program_tables.successors(rules, edges)


def test_rounds_over_what_changed(spark, monkeypatch):
    """A chain of 8 rules beside 200 that are settled at once: rounds write the open rules, not all."""
    rows = [(f"a{i}", not i, ["t"] if i else []) for i in range(8)] + [(f"b{i}", not i, ["u"]) for i in range(200)] + [("lost", False, ["t"])]
    rules = spark.createDataFrame(rows, "rule string, is_seed boolean, defined array<string>")
    edges = spark.createDataFrame([("a0", f"a{i}") for i in (1, 1, 2)] + [(f"a{i}", f"a{i + 1}") for i in range(7)] + [("b0", f"b{i}") for i in range(1, 200)] + [("lost", "a3")], "source string, target string")
    kept, sizes = program_tables.keep, []

    def counted(df, name):
        out = kept(df, name)
        sizes.append(out.count() if name == "assigned" else 0)
        return out

    monkeypatch.setattr(program_tables, "keep", counted)
    got = {r.rule: r.tags for r in program_tables.assigned(rules, edges, []).collect()}
    assert got == {"a0": [], "a1": [], "a2": [], **{f"a{i}": ["t"] for i in range(3, 8)}, "b0": [], **{f"b{i}": ["u"] for i in range(1, 200)}}
    assert sum(sizes) < 3 * len(rows)
