"""Languages by name: extension, parser and comment kinds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .brackets import bracket_parser
from .golang import parse_go
from .java import parse_java
from .kotlin import parse_kotlin
from .markup import parse_html, parse_json, parse_lines, parse_scm
from .python import parse_python
from .swift import parse_swift
from .trees import Tree


@dataclass(frozen=True)
class Language:
    name: str
    extension: str
    parse: Callable[[str], Tree]
    comments: frozenset[str] = frozenset()


REGISTRY = {
    x.name: x
    for x in (
        Language("java", "java", parse_java, frozenset({"line_comment", "block_comment"})),
        Language("java_cs", "java", parse_java, frozenset({"line_comment", "block_comment"})),
        Language("go", "go", parse_go, frozenset({"comment"})),
        Language("kt", "kt", parse_kotlin, frozenset({"line_comment", "multiline_comment", "comment"})),
        Language("swift", "swift", parse_swift, frozenset({"comment", "multiline_comment"})),
        Language("python", "py", parse_python, frozenset({"comment"})),
        *(Language(n, x, bracket_parser(), frozenset({"comment"})) for n, x in (("typescript", "ts"), ("tsx", "tsx"), ("thrift", "thrift"), ("scala", "scala"))),
        Language("ruby", "rb", bracket_parser("#", None), frozenset({"comment"})),
        Language("yaml", "yaml", bracket_parser("#", None), frozenset({"comment"})),
        Language("html", "html", parse_html, frozenset({"comment"})),
        Language("json", "json", parse_json),
        Language("scm", "scm", parse_scm, frozenset({"comment"})),
        Language("strings", "strings", parse_lines),
        Language("text", "txt", parse_lines),
    )
}


ALIASES = {"kotlin": "kt", "ts": "typescript", "py": "python", "yml": "yaml", "rb": "ruby"}


def language(name: str) -> Language:
    name = ALIASES.get(name, name)
    if name not in REGISTRY:
        raise ValueError(f"no parser for language {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]
