"""URL filter: explicit host/path rules, then gradient-boosted trees on lexical features.

Everything that touches the table is DataFrame expressions: the features, the
rule lookup and the trees, which are read out of the fitted model and become
nested CASE expressions, so scoring stays inside code generation.  The trees are
fitted on ``labelled_urls``, a bounded set (``n`` rows, 6000 by default) of URLs
built by rule; the statistic of each public suffix (last host label) is learned
from the same rows and held in one literal map.

Defined results: a null URL or one without ``://`` has an empty host and path and
no rule and is judged by the trees on its empty features; rows are judged one by
one; other columns are kept by ``judge_urls``, whose own columns replace columns
of the same names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAMES = ("f_length", "f_host_length", "f_depth", "f_digit_ratio", "f_host_digits", "f_entropy", "f_params", "f_hyphens", "f_labels", "f_encoded", "f_longest_label", "f_suffix_rate")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return urls.withColumns({"host": F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), "path": F.regexp_extract(u, pattern, 2)})


def _entropy(text: Column) -> Column:
    n = F.char_length(text)
    counts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def with_features(parts: DataFrame, url: str, suffix_rate: dict[str, float], prior: float) -> DataFrame:
    """NAMES beside the columns that with_parts gives."""
    u, host, path = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), F.col("host"), F.col("path")
    digits = lambda c: F.char_length(F.regexp_replace(c, r"[^0-9]", ""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    suffix = F.substring_index(host, ".", -1)
    rates = F.create_map(*(F.lit(x) for kv in sorted(suffix_rate.items()) for x in kv)) if suffix_rate else None
    columns = (
        F.char_length(u),
        F.char_length(host),
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        digits(u) / F.greatest(F.char_length(u), F.lit(1)),
        digits(host),
        _entropy(host),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit(""))),
        F.size(F.split(host, r"\.")),
        F.char_length(u) - F.char_length(F.replace(u, F.lit("%"), F.lit(""))),
        F.array_max(F.transform(F.split(host, r"\."), F.char_length)),
        F.coalesce(F.try_element_at(rates, suffix), F.lit(prior)) if rates is not None else F.lit(prior),
    )
    return parts.withColumns({n: c.cast("double") for n, c in zip(NAMES, columns, strict=True)})


def labelled_urls(spark: SparkSession, n: int = 6000, seed: int = 7) -> DataFrame:
    """url, label (1: block): half ordinary shapes, half the shapes of spam and trackers."""
    pick = lambda k, xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(seed * 100 + k)), F.lit(len(xs))) + 1).cast("int"))
    num = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed * 100 + k)), F.lit(m)).cast("string")
    word = lambda k: F.concat(pick(k, ("stone", "river", "garden", "north", "paper", "green", "house", "light")), pick(k + 1, ("", "", "field", "works", "press", "hill", "notes")))
    spam = lambda k: pick(k, ("cheap", "best", "free", "win", "bonus", "casino", "pills", "loan", "deal", "offer"))
    good = F.concat(pick(1, ("http", "https", "https")), F.lit("://"), pick(2, ("", "www.", "blog.", "m.", "news.")), word(3), pick(6, (".example", "")), pick(5, (".org", ".net", ".com", ".edu", ".de", ".fr")), F.lit("/"), pick(7, ("en/", "de/", "fr/", "es/", "", "archive/", "blog/2021/")), pick(8, ("", "about", "index")), num(9, 60_000), pick(10, ("", ".html", "/", "#top", "?page=2", "?page=2&ref=x", "?utm_source=feed")))
    bad = F.concat(pick(11, ("http", "http", "https")), F.lit("://"), pick(12, ("", "www.", "click.", "track.", "blog.", "m.")), spam(13), F.lit("-"), spam(14), pick(15, ("", "-", "-now-", "-x")), pick(16, ("", "24", "777", "4u", "365")), pick(21, (".example", "")), pick(17, (".biz", ".info", ".net", ".com", ".top", ".click", ".org")), F.lit("/"), pick(18, ("", "go/", "en/", "de/", "r/x/", "out/")), num(19, 900_000_000), pick(20, ("", ".html", "?id=83829&aff=9917&sub=22&t=8", "?a=1&b=2&c=3&u=%68%74%74", "?utm_source=feed", "#top")))
    rows = spark.range(n).withColumn("label", (F.col("id") % 2).cast("double"))
    return rows.select(F.when(F.col("label") == 0, good).otherwise(bad).alias("url"), "label")


class UrlModel:
    """Boosted trees as Spark expressions."""

    def __init__(self, trees: list, weights: list[float], rates: dict[str, float], prior: float):
        self.trees, self.weights, self.rates, self.prior = trees, weights, rates, prior

    @classmethod
    def fit(cls, labelled: DataFrame, url: str = "url", label: str = "label", rounds: int = 12, depth: int = 3) -> UrlModel:
        """labelled must be bounded; it is cached for the rounds."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        parts = with_parts(labelled, url)
        found = parts.groupBy(F.substring_index("host", ".", -1).alias("s")).agg(F.sum(label).alias("bad"), F.count(F.lit(1)).alias("n")).orderBy("s").collect()
        prior = sum(r.bad for r in found) / max(1, sum(r.n for r in found))
        rates = {r.s: (r.bad + 4 * prior) / (r.n + 4) for r in found}
        rows = VectorAssembler(inputCols=list(NAMES), outputCol="v").transform(with_features(parts, url, rates, prior)).select("v", label).coalesce(2).cache()
        model = GBTClassifier(featuresCol="v", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=32, seed=1).fit(rows)
        rows.unpersist()

        def read(node) -> tuple | float:
            if node.getClass().getSimpleName() == "LeafNode":
                return float(node.prediction())
            return int(node.split().featureIndex()), float(node.split().threshold()), read(node.leftChild()), read(node.rightChild())

        return cls([read(t._java_obj.rootNode()) for t in model.trees], list(model.treeWeights), rates, prior)

    def score(self) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            k, at, left, right = node
            return F.when(F.col(NAMES[k]) <= at, walk(left)).otherwise(walk(right))

        margin = reduce(lambda a, b: a + b, (walk(t) * F.lit(float(w)) for t, w in zip(self.trees, self.weights, strict=True)))
        return 1 / (1 + F.exp(-2 * margin))


def rule_of() -> Column:
    """struct<n, rule, verdict> of the longest rule that fits host and path, else null."""
    host, path = F.col("host"), F.col("path")
    fits = [F.when(((host == h) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p)), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in RULES]
    return F.array_max(F.array(*fits))


def judge_urls(urls: DataFrame, model: UrlModel, url: str = "url") -> DataFrame:
    """Adds host, path, rule, score (of block) and verdict; no shuffle."""
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "score", "verdict")]
    inner = urls.select(*(F.col(f"`{c}`") for c in own), *([] if url in own else [F.col(f"`{url}`").alias("__url")]))
    url = url if url in own else "__url"
    scored = with_features(with_parts(inner, url), url, model.rates, model.prior).withColumn("score", model.score()).withColumn("__r", rule_of())
    return scored.select(*(F.col(f"`{c}`") for c in own), "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = UrlModel.fit(labelled_urls(spark))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", "score")
