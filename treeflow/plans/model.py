"""Programs: rules, filters, edges, scopes and options, with their validation."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from dataclasses import field as factory

from ..operators import templates, tree_query

STANDARD_SCOPES = ("Parent", "ParentIterative", "Global", "Directory", "DirectoryRecursive")


class ProgramError(ValueError):
    """A program that cannot run as written."""


def dialect(pattern: str) -> str:
    """rgx, cs or tree, by prefix."""
    if pattern.startswith("rgx "):
        return "rgx"
    return "cs" if pattern.startswith("cs ") else "tree"


def check_pattern(pattern: str) -> None:
    """Raises unless the pattern parses in its dialect; holes may still stand in it."""
    if not pattern:
        return
    kind = dialect(pattern)
    try:
        if kind == "rgx":
            re.compile(pattern[4:])
        elif kind == "cs":
            templates.compile_template(pattern[3:].strip())
        else:
            tree_query.compile_query(pattern)
    except (re.error, ValueError) as e:
        raise ProgramError(f"Cannot parse {kind} pattern: {e}: {pattern}") from e


def instantiate(text: str, bindings: Mapping[str, str], pattern: bool = False) -> str:
    """Replaces @tag and :[tag], longest tag first; in patterns a value's newlines are escaped."""
    for tag in sorted(bindings, key=lambda t: (-len(t), t)):
        value = bindings[tag].replace("\n", "\\n") if pattern else bindings[tag]
        text = text.replace(f"@{tag}", value).replace(f":[{tag}]", value)
    return text


@dataclass(frozen=True)
class Filter:
    enclosing_node: str = ""
    outermost_enclosing_node: str = ""
    not_enclosing_node: str = ""
    not_contains: tuple[str, ...] = ()
    contains: str = ""
    at_least: int = 1
    at_most: int | None = None
    child_count: int | None = None
    sibling_count: int | None = None
    fact_filter: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        counts = (self.child_count is not None) + (self.sibling_count is not None)
        nodes = bool(self.enclosing_node or self.outermost_enclosing_node or self.not_enclosing_node or self.contains or self.not_contains)
        if self.contains and self.not_contains:
            raise ProgramError("a filter takes contains or not_contains, not both")
        if (self.at_least != 1 or self.at_most is not None) and not self.contains:
            raise ProgramError("at_least and at_most need contains")
        if self.at_most is not None and self.at_least > self.at_most:
            raise ProgramError("at_least must not exceed at_most")
        if counts > 1 or counts and nodes:
            raise ProgramError("child_count and sibling_count stand alone in a filter")
        for p in (self.enclosing_node, self.outermost_enclosing_node, self.not_enclosing_node, self.contains, *self.not_contains):
            check_pattern(p)


@dataclass(frozen=True)
class Rule:
    name: str
    query: str = ""
    replace_node: str = ""
    replace_idx: int | None = None
    replace: str = ""
    groups: frozenset[str] = frozenset()
    holes: frozenset[str] = frozenset()
    filters: tuple[Filter, ...] = ()
    is_seed_rule: bool = True
    keep_comment_regexes: tuple[str, ...] = ()
    fact: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.fact and (self.replace or self.replace_node):
            raise ProgramError(f"rule {self.name} has a fact and a replacement")
        check_pattern(self.query)

    @property
    def is_dummy(self) -> bool:
        return not self.query and not self.replace_node

    @property
    def is_match_only(self) -> bool:
        return bool(self.query) and not self.replace_node and not self.fact


@dataclass(frozen=True)
class Edge:
    source: str
    targets: tuple[str, ...]
    scope: str


@dataclass(frozen=True)
class Scope:
    """A named scope: the first (enclosing pattern, scope query) whose pattern encloses a match."""

    name: str
    rules: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Instance:
    """A rule with its holes bound, and the directory it is confined to."""

    rule: Rule
    bindings: tuple[tuple[str, str], ...] = ()
    directory: str | None = None
    recursive: bool = False

    @property
    def query(self) -> str:
        return instantiate(self.rule.query, dict(self.bindings), pattern=True)

    @property
    def replace(self) -> str:
        return instantiate(self.rule.replace, dict(self.bindings))

    def key(self) -> tuple:
        return self.rule.name, self.replace, self.query, self.directory, self.recursive

    def applies_to(self, path: str) -> bool:
        if self.directory is None:
            return True
        parent = path.rsplit("/", 1)[0] if "/" in path else ""
        return parent == self.directory or self.recursive and (parent + "/").startswith(self.directory.rstrip("/") + "/")


def bind(rule: Rule, bindings: Mapping[str, str], directory: str | None = None, recursive: bool = False) -> Instance:
    missing = sorted(h for h in rule.holes if h not in bindings)
    if missing:
        raise ProgramError(f"rule {rule.name}: no value for hole(s) {', '.join(missing)}")
    return Instance(rule, tuple(sorted((h, bindings[h]) for h in rule.holes)), directory, recursive)


@dataclass
class Options:
    """What a run does besides its program; dry_run is the default, so nothing is written unasked."""

    language: str = "java"
    substitutions: dict[str, str] = factory(default_factory=dict)
    delete_file_if_empty: bool = True
    delete_consecutive_new_lines: bool = False
    global_tag_prefix: str = "GLOBAL_TAG."
    number_of_ancestors_in_parent_scope: int = 4
    cleanup_comments_buffer: int = 2
    cleanup_comments: bool = False
    dry_run: bool = True
    allow_dirty_ast: bool = False
    should_validate: bool = False
    max_iterations: int = 10_000
