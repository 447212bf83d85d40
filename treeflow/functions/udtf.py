"""Pattern matching from SQL: table functions for LATERAL joins, and the template parser as a function.

    SELECT d.doc_id, m.* FROM docs d, LATERAL tree_matches('java', d.code, '((identifier) @x)') m
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import languages, templates, tree_query

ROWS = "ord int, start_byte bigint, end_byte bigint, matched string, captures map<string, string>"


class TreeMatches:
    """tree_matches(language, code, query): last in the file first."""

    def eval(self, language: str, code: str, query: str):
        if code is None:
            return
        tree = languages.language(language).parse(code)
        for i, m in enumerate(tree_query.find_all(tree, tree.root, query)):
            yield i, m.start, m.end, tree.raw[m.start : m.end].decode("utf-8", "replace"), m.captures


class TemplateMatches:
    """tmpl_matches(language, code, template): in pre-order."""

    def eval(self, language: str, code: str, template: str):
        if code is None:
            return
        tree = languages.language(language).parse(code)
        for i, m in enumerate(templates.find_all(tree, tree.root, template)):
            yield i, m.start, m.end, tree.raw[m.start : m.end].decode("utf-8", "replace"), {k: c.text for k, c in m.captures.items()}


class RegexMatches:
    """rgx_matches(code, pattern): in source order, with byte spans."""

    def eval(self, code: str, pattern: str):
        at = pos = 0
        for i, m in enumerate(re.finditer(pattern, code or "")):
            at += len(code[pos : m.start()].encode())
            pos = m.start()
            yield i, at, at + len(m[0].encode()), m[0], {k: v for k, v in m.groupdict().items() if v is not None}


def parse_template(template: str) -> str:
    """A template as JSON: items and constraints."""
    t = templates.compile_template(template)
    items = [{"literal": x} if isinstance(x, str) else {"capture": x[0], "mode": x[1]} for x in t.items]
    checks = [{"capture": k, "op": c.op, "value": sorted(c.value) if isinstance(c.value, frozenset) else c.value, "negated": c.negated} for k, cs in t.constraints.items() for c in cs]
    return json.dumps({"items": items, "constraints": checks})


def register(spark: SparkSession) -> None:
    for name, cls in (("tree_matches", TreeMatches), ("tmpl_matches", TemplateMatches), ("rgx_matches", RegexMatches)):
        spark.udtf.register(name, F.udtf(cls, returnType=ROWS))
    spark.udf.register("parse_template", parse_template, "string")
