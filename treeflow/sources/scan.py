"""Code bases and text tables as unit DataFrames (path, content)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression over whole paths; * and ? cross separators, ** too."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^(?s:{out})$"


def path_filter(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = (), extension: str | None = None) -> Column:
    """Any include (all when empty), no exclude, exact extension."""
    include, exclude = list(include), list(exclude)
    keep = reduce(lambda a, b: a | b, (path.rlike(glob_to_regex(g)) for g in include)) if include else F.lit(True)
    for g in exclude:
        keep &= ~path.rlike(glob_to_regex(g))
    if extension is not None:
        keep &= F.regexp_extract(path, r"\.([^./]+)$", 1) == extension
    return keep


def grep_pattern(values: Iterable[str], escape: bool = False) -> str | None:
    """Alternation over hole values; empty values and true / false are left out."""
    found = sorted({v for v in values if v and v.lower() not in ("true", "false")})
    return "|".join(re.escape(v) if escape else v for v in found) or None


def grep(units: DataFrame, values: Iterable[str], escape: bool = False) -> DataFrame:
    """Units whose content can match; stands below the parse, where Catalyst cannot put it."""
    pattern = grep_pattern(values, escape)
    return units if pattern is None else units.filter(F.col("content").rlike(pattern))


def spread(units: DataFrame) -> DataFrame:
    """Units dealt over all cores where they come from fewer files than there are cores.

    A small file is one task whatever is done to its rows, and parsing costs far more
    than moving them.  Tables of many files are left as they are, so nothing is
    shuffled there.
    """
    cores = units.sparkSession.sparkContext.defaultParallelism
    return units.repartition(cores) if len(units.inputFiles()) < cores else units


def codebase(spark: SparkSession, paths: list[str], extension: str, include: Iterable[str] = (), exclude: Iterable[str] = (), files: Iterable[str] = ()) -> DataFrame:
    """path, content of every file under paths with the extension, and of files, which globs do not apply to."""
    parts = []
    if paths:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(paths, wholetext=True)
        units = read.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("path"), F.col("value").alias("content"))
        parts.append(units.filter(path_filter(F.col("path"), include, exclude, extension)))
    if files := list(files):
        parts.append(spark.read.text(files, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("path"), F.col("value").alias("content")))
    if not parts:
        raise ValueError("a code base needs a path or a file")
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["path"]) if len(parts) > 1 else parts[0]


def snippet(spark: SparkSession, code: str, extension: str) -> DataFrame:
    return spark.createDataFrame([(f"sample.{extension}", code)], "path string, content string")


def text_table(df: DataFrame, path: Column, content: str) -> DataFrame:
    """Any table with a text column as units."""
    return df.select(path.cast("string").alias("path"), F.col(content).alias("content"))
