"""Rounds visit the files that new instances lead to, and no others."""

from treeflow.plans import execute as ex
from treeflow.plans import rounds
from treeflow.plans.graph import RuleGraph
from treeflow.plans.model import Edge, Instance, Rule

OLD = Rule("old", '((class_declaration name: (identifier) @c) @k (#match? @c "^Old"))')
NEW = Rule("new", '((type_identifier) @t (#eq? @t "@c"))', "t", replace="Fresh@c", holes=frozenset({"c"}), is_seed_rule=False)


def units(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def run(spark, rows, rules, edges):
    out = ex.execute(units(spark, rows), RuleGraph(rules, edges), path="loop")
    return {r.path: r for r in out.collect()}, out._visited


def test_only_files_with_the_value_are_visited_again(spark):
    rows = [("/a/x.java", "class OldX { }"), ("/a/y.java", "class Y { OldX f; }"), ("/b/in.java", "class Z { int notOldXYet; OldXY f; }")]
    rows += [(f"/n/{i}.java", f"class N{i} {{ int old; }}") for i in range(40)]
    got, visited = run(spark, rows, [OLD, NEW], [Edge("old", ("new",), "Global")])
    assert got["/a/y.java"].content == "class Y { FreshOldX f; }" and "/b/in.java" not in got
    assert visited == [43, 3, 0]  # x itself, y, and the file whose longer words hold the value


def test_edits_bring_values_into_files(spark):
    """A file that gets an instance's value only by an edit is visited in the next round."""
    note = Rule("note", '((field_declaration declarator: (variable_declarator name: (identifier) @v)) @f (#eq? @v "trigger"))')
    name = Rule("name", '((identifier) @i (#eq? @i "@v"))', "i", replace="OldName", holes=frozenset({"v"}), is_seed_rule=False)
    seed = Rule("seed", '((class_declaration name: (identifier) @c) @k (#eq? @c "OldName"))')
    use = Rule("use", '((type_identifier) @t (#eq? @t "@c"))', "t", replace="Done", holes=frozenset({"c"}), is_seed_rule=False)
    rows = [("/a.java", "class OldName { }"), ("/b.java", "class B { int trigger; }"), ("/c.java", "class C { int trigger2; OldName f; }"), ("/d.java", "class D { }")]
    got, visited = run(spark, rows, [note, name, seed, use], [Edge("note", ("name",), "Global"), Edge("seed", ("use",), "Global")])
    assert got["/b.java"].content == "class B { int OldName; }" and got["/c.java"].content == "class C { int trigger2; Done f; }"
    assert "/d.java" not in got and visited[0] == 4 and visited[1] == 3 and visited[2] == 1 and visited[-1] == 0


def test_folders_without_values(spark):
    """Instances without a hole visit the units of their folder, recursive ones those below it as well."""
    seed = Rule("seed", '((class_declaration name: (identifier) @c) @k (#eq? @c "Mark"))')
    look = Rule("look", '((identifier) @i (#eq? @i "seen"))', is_seed_rule=False)
    rows = [("/r/m/Mark.java", "class Mark { }"), ("/r/m/a.java", "class A { int seen; }"), ("/r/m/deep/b.java", "class B { int seen; }"), ("/r/mm/c.java", "class C { int seen; }"), ("/r/d.java", "class D { int seen; }")]
    for scope, want in (("Directory", {"/r/m/a.java"}), ("DirectoryRecursive", {"/r/m/a.java", "/r/m/deep/b.java"}), ("Global", {p for p, c in rows if "seen" in c})):
        got, visited = run(spark, rows, [seed, look], [Edge("seed", ("look",), scope)])
        assert {p for p, r in got.items() if any(m.rule == "look" for m in r.matches)} == want
        assert visited[0] == 5 and visited[1] == (5 if scope == "Global" else 1 + len(want))


def test_messages_and_lookup(spark):
    graph = RuleGraph([NEW, Rule("not", '((identifier) @i (#not-eq? @i "@c"))', holes=frozenset({"c"}))])
    made = [Instance(NEW, (("c", 'a "wordy" x'),), "/d", True), Instance(NEW, (("c", "true"),)), Instance(NEW, (("c", "ab"),)), Instance(graph.rules["not"], (("c", "wordy"),))]
    assert [rounds.instance(graph, rounds.message(i)) for i in made] == made
    rows = rounds.instances(spark.createDataFrame([(rounds.message(i),) for i in made], "o string"), graph).collect()
    assert [[(w.value, w.core) for w in r.lookup] for r in rows] == [[('a "wordy" x', "wordy")], [], [], []]
    assert (rows[0].directory, rows[0].recursive) == ("/d", True)
