"""Entry points: run a program over code bases or a snippet, from Python or the command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from .operators.languages import language
from .plans.execute import execute, frequency, persist, to_json
from .plans.graph import RuleGraph
from .plans.model import Options, ProgramError
from .sources import config, scan


def program(options: Options, graph: RuleGraph | None = None, path_to_configurations: str = "", path_to_custom_builtin_rules: str = "") -> RuleGraph:
    """User rules (from the folder, else graph) before the language's pack (or the folder that replaces it)."""
    user = config.read_graph(path_to_configurations) if path_to_configurations else graph or RuleGraph()
    base = config.read_graph(path_to_custom_builtin_rules) if path_to_custom_builtin_rules else config.built_in(options.language)
    return user.merged(base)


def run(
    spark: SparkSession,
    options: Options,
    paths_to_codebase: Iterable[str] = (),
    code_snippet: str = "",
    rule_graph: RuleGraph | None = None,
    path_to_configurations: str = "",
    path_to_custom_builtin_rules: str = "",
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    files: Iterable[str] = (),
) -> DataFrame:
    """Summaries of the run; changed files are written back unless options.dry_run."""
    paths, files = list(paths_to_codebase), list(files)
    if bool(paths or files) == bool(code_snippet):
        raise ProgramError("give either a code base or a code snippet")
    extension = language(options.language).extension
    units = scan.snippet(spark, code_snippet, extension) if code_snippet else scan.codebase(spark, paths, extension, include, exclude, files)
    summary = execute(units, program(options, rule_graph, path_to_configurations, path_to_custom_builtin_rules), options)
    if not code_snippet:
        persist(summary, options)
    return summary


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Structural search and rewrite over code bases, on Spark.")
    p.add_argument("-c", "--paths-to-codebase", nargs="*", default=[])
    p.add_argument("-t", "--code-snippet", default="")
    p.add_argument("-f", "--path-to-configurations", required=True)
    p.add_argument("-l", "--language", default="java")
    p.add_argument("-s", "--substitutions", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("-j", "--path-to-output-summary", default="")
    p.add_argument("--path-to-custom-builtin-rules", default="")
    p.add_argument("--include", nargs="*", default=[])
    p.add_argument("--exclude", nargs="*", default=[])
    p.add_argument("--write", action="store_true", help="write changed files back; without it nothing is written")
    for f in fields(Options):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool" and f.name != "dry_run":
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        elif f.type == "int":
            p.add_argument(flag, type=int, default=f.default)
    p.add_argument("--global-tag-prefix", default="GLOBAL_TAG.")
    a = p.parse_args(argv)
    known = {f.name for f in fields(Options)}
    options = Options(**{k: v for k, v in vars(a).items() if k in known and k != "substitutions"}, dry_run=not a.write, substitutions=dict(s.split("=", 1) for s in a.substitutions))
    spark = SparkSession.builder.appName("treeflow").getOrCreate()
    summary = run(spark, options, a.paths_to_codebase, a.code_snippet, None, a.path_to_configurations, a.path_to_custom_builtin_rules, a.include, a.exclude)
    if a.path_to_output_summary:
        with open(a.path_to_output_summary, "w", encoding="utf-8") as out:
            json.dump([json.loads(r["value"]) for r in to_json(summary).toLocalIterator()], out, indent=2)
    for r in frequency(summary).orderBy("rule").toLocalIterator():
        print(f"{r['rule']}\t{r['n']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
