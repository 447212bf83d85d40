"""Per-file evaluation: match, filter, edit, propagate, to a fixpoint.

Everything here is local to one unit and runs inside executors; what must reach
other units leaves as rule instances.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from dataclasses import field as factory

import numpy as np

from ..plans.graph import RuleGraph
from ..plans.model import Filter, Instance, Options, ProgramError, Rule, dialect, instantiate
from . import languages, templates, tree_query
from .trees import Node, Tree


TAG = re.compile(r"@([\w.-]+)|:\[([\w.-]+)\]")


@dataclass
class Match:
    start: int
    end: int
    text: str
    captures: dict[str, str]
    delete_from: int | None = None
    delete_to: int | None = None
    reach: tuple[int, int] | None = None  # what the match was read from, where that is known


@dataclass
class Edit:
    rule: str
    match: Match
    replacement: str


@dataclass
class Fact:
    start: int
    end: int
    data: dict[str, str]
    voided: bool = False


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", "", text)


@dataclass
class Unit:
    path: str
    code: str
    graph: RuleGraph
    options: Options
    bindings: dict[str, str] = factory(default_factory=dict)
    matches: list[tuple[str, Match]] = factory(default_factory=list)
    rewrites: list[Edit] = factory(default_factory=list)
    facts: list[Fact] = factory(default_factory=list)
    outgoing: list[Instance] = factory(default_factory=list)
    steps: int = 0

    def __post_init__(self) -> None:
        self.original = self.code
        self.language = languages.language(self.options.language)
        self.bindings = {**self.options.substitutions, **self.bindings}
        self.parse()
        if self.tree.errors() and not self.options.allow_dirty_ast:
            raise ProgramError(f"{self.path}: syntax error")

    def parse(self) -> None:
        self.tree: Tree = self.language.parse(self.code)
        self.byte_at: np.ndarray | None = None

    def offset(self, char: int) -> int:
        """The byte offset of a character."""
        if self.code.isascii():
            return char
        if self.byte_at is None:
            c = np.frombuffer(self.code.encode("utf-32-le"), np.uint32)
            self.byte_at = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])
        return int(self.byte_at[char])

    # matching
    def raw_matches(self, pattern: str, node: Node, recursive: bool = True, replace_node: str | None = None, replace_idx: int | None = None) -> list[Match]:
        kind = dialect(pattern)
        tree = self.tree
        if kind == "rgx":
            out = []
            for m in re.finditer(pattern[4:], self.code):
                if m.start() == m.end():
                    continue
                s, e = self.offset(m.start()), self.offset(m.end())
                inside = node.start <= s and e <= node.end if recursive else (s, e) == (node.start, node.end)
                if inside:
                    text = m[0]
                    if replace_node and replace_node in m.re.groupindex and m[replace_node] is not None:
                        s, e = self.offset(m.start(replace_node)), self.offset(m.end(replace_node))
                        text = m[replace_node]
                    out.append(Match(s, e, text, {k: v for k, v in m.groupdict().items() if v is not None}))
            return out
        if kind == "cs":
            found = templates.find_all(tree, node, pattern[3:].strip(), recursive, replace_node)
            return [Match(m.start, m.end, tree.raw[m.start : m.end].decode("utf-8", "replace"), {k: c.text for k, c in m.captures.items()}) for m in found]
        found = tree_query.find_all(tree, node, pattern, recursive, replace_node, replace_idx)
        return [Match(m.start, m.end, tree.raw[m.start : m.end].decode("utf-8", "replace"), m.captures, reach=m.reach) for m in found]

    def rule_matches(self, inst: Instance, node: Node, recursive: bool = True) -> Iterator[Match]:
        """The rule's matches that pass its filters, last in the file first."""
        r = inst.rule
        for m in self.raw_matches(inst.query, node, recursive, r.replace_node or None, r.replace_idx):
            if not r.filters or (at := self.tree.smallest(m.start, m.end)) and all(self.passes(f, at, m) for f in r.filters):
                yield m

    def climb(self, node: Node, pattern: str) -> Node | None:
        """The innermost node around (or at) node that matches the pattern as a whole; a leaf is not its own ancestor."""
        n: Node | None = node if node.children else node.parent
        while n is not None:
            if self.raw_matches(pattern, n, recursive=False):
                return n
            n = n.parent
        return None

    def passes(self, f: Filter, node: Node, m: Match) -> bool:
        subs = {**self.options.substitutions, **m.captures}
        get = lambda p: instantiate(p, subs, pattern=True)
        if f.fact_filter:
            want = {k: instantiate(v, subs) for k, v in f.fact_filter}
            if not any(not x.voided and want.items() <= x.data.items() for x in self.facts):
                return False
        if f.child_count is not None:
            return len(node.named_children()) == f.child_count
        if f.sibling_count is not None:
            return node.parent is not None and len(node.parent.named_children()) == f.sibling_count
        scope = node
        if f.enclosing_node:
            scope = self.climb(node, get(f.enclosing_node))
            if scope is None:
                return False
        if f.outermost_enclosing_node:
            outer, n = None, scope
            while n is not None and (hit := self.climb(n, get(f.outermost_enclosing_node))) is not None:
                outer, n = hit, hit.parent
            if outer is None:
                return False
            scope = outer
        if f.not_enclosing_node and self.climb(node, get(f.not_enclosing_node)) is not None:
            return False
        if f.contains:
            n = len(self.raw_matches(get(f.contains), scope))
            if n < f.at_least or f.at_most is not None and n > f.at_most:
                return False
        return not any(self.raw_matches(get(p), scope) for p in f.not_contains)

    # deletion
    def widen(self, m: Match, rule: Rule) -> tuple[int, int]:
        """The span that goes with a deletion: a comma, comments and the blank lead-in of the node."""
        node = self.tree.smallest(m.start, m.end)
        start, end = m.start, m.end
        if (node.start, node.end) != (start, end) or node.parent is None:
            return start, end
        while node.parent is not None and (node.parent.start, node.parent.end) == (start, end):
            node = node.parent
        if node.parent is None:
            return start, end
        sib = node.parent.children
        i = next(j for j, x in enumerate(sib) if x is node)
        comment = lambda x: x.kind in self.language.comments
        after = next((x for x in sib[i + 1 :] if not comment(x)), None)
        before = next((x for x in reversed(sib[:i]) if not comment(x)), None)
        if after is not None and after.kind == ",":
            end = after.end
        elif before is not None and before.kind == ",":
            start = before.start
        if self.options.cleanup_comments:
            kept = lambda x: any(re.search(k, self.tree.text(x)) for k in rule.keep_comment_regexes)
            row = self.tree.point(end)[0]
            for x in sib[i + 1 :]:
                if comment(x) and self.tree.point(x.start)[0] == row and not kept(x) and x.start >= end:
                    end = x.end
                    break
            n, level = node, 0
            while n is not None and n.parent is not None and level < self.options.cleanup_comments_buffer:
                own = n.parent.children
                j = next(k for k, x in enumerate(own) if x is n) - 1
                while j >= 0 and comment(own[j]) and not kept(own[j]):
                    lone = j == 0 or self.tree.point(own[j - 1].end)[0] != self.tree.point(own[j].start)[0]
                    if not lone or own[j].end > start:
                        break
                    start = own[j].start
                    j -= 1
                if n.start != n.parent.start:
                    break
                n, level = n.parent, level + 1
        floor = max((x.end for x in sib if x.end <= start), default=0)
        lead = self.tree.raw[floor:start]
        blank = len(lead) - len(lead.rstrip(b" \t"))
        if blank < len(lead) and lead[: len(lead) - blank].endswith(b"\n"):
            start -= blank + 1
        return start, end

    def apply(self, inst: Instance, m: Match, replacement: str) -> None:
        self.steps += 1
        if self.steps > self.options.max_iterations:
            raise ProgramError(f"{self.path}: no fixpoint after {self.options.max_iterations} edits")
        start, end = (m.start, m.end) if replacement.strip() else self.widen(m, inst.rule)
        before = self.tree.errors()
        raw = self.tree.raw[:start] + replacement.encode() + self.tree.raw[end:]
        self.code = raw.decode("utf-8", "replace")
        self.parse()
        if self.tree.errors() > before:
            raise ProgramError(f"{self.path}: rule {inst.rule.name} leaves a syntax error: {replacement[:80]!r}")
        self.move_facts(start, end, len(replacement.encode()) - (end - start))

    def move_facts(self, start: int, end: int, delta: int) -> None:
        for f in self.facts:
            if not f.voided:
                if f.start >= end:
                    f.start, f.end = f.start + delta, f.end + delta
                elif f.end > start:
                    f.voided = True

    # rules
    def run(self, instances: Iterable[Instance]) -> None:
        for inst in instances:
            if inst.applies_to(self.path):
                self.run_rule(inst, None)
        if self.options.delete_consecutive_new_lines:
            code = re.sub(r"\n(\s*\n)+(\s*\n)", r"\n\2", self.code)
            if code != self.code:
                self.code = code
                self.parse()

    def run_rule(self, inst: Instance, scope: str | None) -> None:
        r = inst.rule
        while True:
            node = self.scope_node(scope)
            if r.is_match_only or r.fact:
                for m in list(self.rule_matches(inst, node)):
                    if r.fact:
                        data = {k: instantiate(v, {**self.bindings, **m.captures}) for k, v in r.fact}
                        if not any((f.start, f.end, f.data) == (m.start, m.end, data) for f in self.facts):
                            self.facts.append(Fact(m.start, m.end, data))
                    elif not any(n == r.name and (x.start, x.end) == (m.start, m.end) and x.text == m.text for n, x in self.matches):
                        self.matches.append((r.name, m))
                    self.bindings.update(m.captures)
                    self.propagate(r.name, m, None)
                return
            wave = self.wave(inst, node) if self.graph.ends(r.name) else None
            if wave and len(wave) > 1 and self.edit_all(inst, wave):
                continue
            first = next(self.rule_matches(inst, node) if wave is None or r.filters else iter(wave), None)
            if first is None:
                return
            self.edit(inst, first, instantiate(inst.replace, {**self.bindings, **first.captures}))

    def wave(self, inst: Instance, node: Node) -> list[Match]:
        """Matches of a rule that no other follows which may be edited together; those that wait come in a later wave.

        Without filters these are all.  With filters, and replacements made of the match's
        own captures, a match goes along where what it and its filters were read from ends
        before that of the match before it begins, so none of the edits can change it.
        """
        r = inst.rule
        if not r.filters:
            return list(self.rule_matches(inst, node))
        out: list[Match] = []
        floor = len(self.tree.raw) + 1
        for m in self.rule_matches(inst, node):
            tags = set(TAG.findall(inst.replace))
            reach = self.reach(r, m)
            if reach is None or not all(a in m.captures or b in m.captures for a, b in tags):
                return []
            if reach[1] < floor:
                out.append(m)
                floor = reach[0]
        return out

    def reach(self, r: Rule, m: Match) -> tuple[int, int] | None:
        """The span that holds all that the match and its filters were read from; None where that may be the whole file."""
        if m.reach is None:
            return None
        at = self.tree.smallest(m.start, m.end)
        low, high = m.reach
        for f in r.filters:
            patterns = (f.enclosing_node, f.contains, *f.not_contains)
            if f.fact_filter or f.outermost_enclosing_node or f.not_enclosing_node or any(p and dialect(p) != "tree" for p in patterns):
                return None
            scope = at
            if f.enclosing_node:
                scope = self.climb(at, instantiate(f.enclosing_node, {**self.options.substitutions, **m.captures}, pattern=True))
            elif f.sibling_count is not None:
                scope = at.parent
            low, high = min(low, scope.start), max(high, scope.end)
        return low, high

    def edit_all(self, inst: Instance, found: list[Match]) -> bool:
        """Applies the matches of one scan together, where that is the same as one by one; False where it may not be.

        The rule looks at nothing but its own matches and tells no other rule, and the
        matches stand apart, each before the last one, so no edit moves or changes another.
        """
        if any(b.end > a.start for a, b in zip(found, found[1:])):
            return False
        bindings, edits = dict(self.bindings), []
        for m in found:
            edits.append((m, instantiate(inst.replace, {**bindings, **m.captures})))
            bindings.update(m.captures)
        if any(not text.strip() for _, text in edits) or self.steps + len(edits) > self.options.max_iterations:
            return False
        before, code = self.tree.errors(), self.code
        parts, at = [], len(self.tree.raw)
        for m, text in edits:
            parts += [self.tree.raw[m.end : at], text.encode()]
            at = m.start
        self.code = b"".join([self.tree.raw[:at], *reversed(parts)]).decode("utf-8", "replace")
        self.parse()
        if self.tree.errors() > before:
            self.code = code
            self.parse()
            return False
        self.bindings, self.steps = bindings, self.steps + len(edits)
        for m, text in edits:
            self.rewrites.append(Edit(inst.rule.name, m, text))
            self.move_facts(m.start, m.end, len(text.encode()) - (m.end - m.start))
        return True

    def edit(self, inst: Instance, m: Match, replacement: str) -> None:
        self.apply(inst, m, replacement)
        self.rewrites.append(Edit(inst.rule.name, m, replacement))
        self.bindings.update(m.captures)
        self.propagate(inst.rule.name, m, replacement)

    def scope_node(self, scope: str | None) -> Node:
        """Where a scope query matches now; the whole file when it is none or found nowhere."""
        if scope:
            for m in self.raw_matches(scope, self.tree.root):
                return self.tree.smallest(m.start, m.end)
        return self.tree.root

    def context(self, node: Node) -> list[Node]:
        """node and its ancestors of differing text, as many as the options say."""
        out, last = [node], _squeezed(self.tree.text(node))
        for a in node.ancestors():
            text = _squeezed(self.tree.text(a))
            if text != last:
                out.append(a)
                last = text
            if len(out) >= self.options.number_of_ancestors_in_parent_scope:
                break
        return out[: self.options.number_of_ancestors_in_parent_scope]

    def propagate(self, name: str, m: Match, replacement: str | None) -> None:
        if self.graph.ends(name):
            return
        queue: list[tuple[str | None, Instance]] = []
        at, size = m.start, len((m.text if replacement is None else replacement).encode())
        while True:
            step = self.graph.next_of(name, self.bindings)
            span = min(at, len(self.tree.raw)), min(at + size, len(self.tree.raw))
            node = self.tree.smallest(*span)
            for scope, instances in step.items():
                if scope in ("Parent", "ParentIterative"):
                    continue
                for i in instances:
                    if scope == "Global":
                        self.outgoing.append(i)
                    elif scope in ("Directory", "DirectoryRecursive"):
                        where = self.path.rsplit("/", 1)[0] if "/" in self.path else ""
                        self.outgoing.append(Instance(i.rule, i.bindings, where, scope == "DirectoryRecursive"))
                    else:
                        queue.append((self.locate(scope, node), i))
            found = self.parent_edit(step["Parent"], node, "rule") or self.parent_edit(step["ParentIterative"], node, "node")
            if found is None:
                break
            inst, hit, replacement = found
            if inst.rule.is_match_only:
                self.rewrites.append(Edit(inst.rule.name, hit, hit.text))
                self.bindings.update(hit.captures)
                name, at, size = inst.rule.name, hit.start, hit.end - hit.start
                if _squeezed(hit.text) == "":
                    break
                # a match changes nothing, so only its successors can go on
                if not any(self.graph.successors(name).values()):
                    break
                continue
            self.apply(inst, hit, replacement)
            self.rewrites.append(Edit(inst.rule.name, hit, replacement))
            self.bindings.update(hit.captures)
            name, at, size = inst.rule.name, hit.start, len(replacement.encode())
        while queue:
            scope, inst = queue.pop()
            self.run_rule(inst, scope)

    def parent_edit(self, instances: list[Instance], node: Node, major: str) -> tuple[Instance, Match, str] | None:
        if not instances:
            return None
        nodes = self.context(node)
        pairs = [(i, n) for i in instances for n in nodes] if major == "rule" else [(i, n) for n in nodes for i in instances]
        for inst, n in pairs:
            if inst.rule.fact:
                continue
            for m in self.rule_matches(inst, n, recursive=False):
                return inst, m, instantiate(inst.replace, {**self.bindings, **m.captures})
        return None

    def locate(self, scope: str, node: Node) -> str | None:
        """The concrete query of a named scope around node."""
        n: Node | None = node
        while n is not None:
            for enclosing, query in self.graph.scopes[scope].rules:
                for m in self.raw_matches(enclosing, n, recursive=False):
                    return instantiate(query, m.captures, pattern=True)
            n = n.parent
        return None

    def global_tags(self) -> dict[str, str]:
        return {k: v for k, v in self.bindings.items() if k.startswith(self.options.global_tag_prefix)}
