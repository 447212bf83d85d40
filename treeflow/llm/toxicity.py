"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows: at most ``per_class`` (2500) of
each label, those of least hash of their id, whose texts have at most
``text_bytes`` (1 MiB) each and ``class_bytes`` (32 MiB) together, so what reaches
the driver and is broadcast is bounded in rows and bytes.  Features are all
lower-cased words of the examples.  A feature's weight is TF-IDF times ``FAINT``
plus the root of its chi-square against the label (greatest: 1): none is left out,
so an example is its own nearest at cosine 1, and words that speak of the label
count most.  The examples lie in an inverted index whose postings are cut into
blocks of ``BLOCK`` examples with the greatest weight of each, alike examples side
by side; a query visits blocks by falling upper bound and stops when the bound is
under its k-th best cosine, so the k nearest are exact.  The distance-weighted
vote of the neighbours, reweighted to the labels' true shares, is calibrated on
leave-one-out votes of the examples by isotonic regression.  ``evidence`` names
the nearest examples.

Only labels, and which ids they belong to, are learned from; score inputs are the
text alone.

Defined results: null or empty texts, and texts without a word of any example, get
the calibrated score of an empty vote; with labels of one class or none the score is
that class's share (0 without any); rows are scored by their own text alone, a text
that repeats in a batch once, so repeated rows give equal results; conflicting labels of an id count as toxic; null ids are never
examples; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BLOCK = 256
FAINT = 1e-3
STRIP = b".,;:!?\"'()[]{}*#$%&-"


def counts(text: str | None) -> Counter:
    """Feature counts of a text."""
    out: Counter = Counter()
    for w, n in Counter((text or "").lower().encode("utf-8", "surrogatepass").split()).items():
        w = w.strip(STRIP)
        if w:
            out[w] += n
    return out


class Index:
    """Block-max inverted index of unit TF-IDF vectors.

    A cell is the postings of one term in one block.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        doc = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        key = term * self.blocks + doc // BLOCK
        by = np.lexsort((doc, key))
        self.doc, self.weight = doc[by], weight[by]
        cells, start = np.unique(key[by], return_index=True)
        self.start = np.append(start, len(by))
        self.block = cells % self.blocks
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.cells_of = np.searchsorted(cells, np.arange(terms + 1) * self.blocks)

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, best first, ties by example."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        cell, n = spread(self.cells_of[terms], self.cells_of[terms + 1])
        q = np.repeat(q, n)
        home = self.block[cell]
        bound = np.bincount(home, weights=q * self.most[cell], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        docs, sims = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 6
        while at < len(order):
            floor = sims[k - 1] if len(sims) >= k else 0.0
            part = order[at : at + step]
            part = part[bound[part] >= max(floor, 1e-12)]
            if not len(part):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[part] = True
            own = np.flatnonzero(chosen[home])
            post, n = spread(self.start[cell[own]], self.start[cell[own] + 1])
            total = np.bincount(self.doc[post], weights=self.weight[post] * np.repeat(q[own], n), minlength=self.n)
            if skip >= 0:
                total[skip] = 0.0
            least = max(floor, 1e-12)
            if len(total) > k:
                least = max(least, float(np.partition(total, -k)[-k]))
            found = np.flatnonzero(total >= least)
            docs, sims = np.concatenate([docs, found]), np.concatenate([sims, total[found]])
            by = np.lexsort((docs, -sims))[:k]
            docs, sims = docs[by], sims[by]
            at, step = at + step, step * 2
        return docs, sims


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the ranges one after another, length of each range)."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class ToxicModel:
    def __init__(self, examples: list[tuple], shares: dict[int, int], k: int = 24, power: float = 2.0):
        """examples: (id, text, label); shares: labelled rows by label."""
        self.k, self.power = k, power
        self.ids = [e[0] for e in examples]
        self.label = np.array([e[2] for e in examples], np.float64)
        total = sum(shares.values())
        self.prior = shares.get(1, 0) / total if total else 0.0
        seen = [counts(e[1]) for e in examples]
        n1, n0 = int(self.label.sum()), int((1 - self.label).sum())
        self.single = not n1 or not n0
        self.vocab: dict[bytes, int] = {}
        self.curve = (np.array([0.0]), np.array([self.prior]))
        if self.single:
            return
        # weight of an example of each label, so that the sample stands for all labelled rows
        self.stand = np.where(self.label == 1, shares[1] / n1, shares[0] / n0)
        with_, toxic = Counter(), Counter()
        for c, y in zip(seen, self.label, strict=True):
            with_.update(c.keys())
            if y:
                toxic.update(c.keys())
        n = len(examples)
        self.vocab = {f: i for i, f in enumerate(sorted(with_))}
        m = np.array([with_[f] for f in self.vocab], np.float64)
        a = np.array([toxic[f] for f in self.vocab], np.float64)
        apart = np.sqrt(n * (a * n - m * n1) ** 2 / (m * (n - m) * n1 * n0 + 1e-9))
        self.factor = (np.log((1 + n) / (1 + m)) + 1) * (FAINT + apart / max(apart.max(initial=0.0), 1e-9))
        order = self.alike(seen)
        self.ids, seen = [self.ids[i] for i in order], [seen[i] for i in order]
        self.label, self.stand = self.label[order], self.stand[order]
        vectors = [self.vector(c) for c in seen]
        self.index = Index(vectors, len(self.vocab))
        votes = np.array([self.vote(*self.index.nearest(*v, self.k, skip=i)) for i, v in enumerate(vectors)])
        self.curve = isotonic(votes, self.label, self.stand)

    def alike(self, seen: list[Counter], pivots: int = 16) -> np.ndarray:
        """An order of the examples in which those nearest to the same of some pivots, by plain counts, stand together, so that blocks differ in their bounds."""
        weights, self.factor = self.factor, np.ones(len(self.vocab))
        plain = [self.vector(c) for c in seen]
        self.factor = weights
        index = Index([plain[i] for i in np.linspace(0, len(seen) - 1, min(pivots, len(seen))).astype(int)], len(self.vocab))
        best = [index.nearest(*v, 1)[0] for v in plain]
        return np.argsort([b[0] if len(b) else -1 for b in best], kind="stable")

    def vector(self, c: Counter) -> tuple[np.ndarray, np.ndarray]:
        known = [(i, n) for i, n in zip(map(self.vocab.get, c), c.values(), strict=True) if i is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        t, n = np.array(known, np.int64).T
        w = (1 + np.log(n)) * self.factor[t]
        return t, w / np.sqrt((w * w).sum())

    def vote(self, docs: np.ndarray, sims: np.ndarray) -> float:
        """Distance-weighted share of toxic neighbours; a faint prior vote settles empty ones."""
        w = sims**self.power * self.stand[docs]
        return float(((w * self.label[docs]).sum() + 1e-3 * self.prior) / (w.sum() + 1e-3))

    def judge(self, text: str | None) -> tuple[float, list[tuple]]:
        if self.single:
            return self.prior, []
        docs, sims = self.index.nearest(*self.vector(counts(text)), self.k)
        score = float(np.interp(self.vote(docs, sims), *self.curve))
        return score, [(self.ids[d], float(s), int(self.label[d])) for d, s in zip(docs[:3].tolist(), sims[:3].tolist(), strict=True)]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing weighted fit of y on x (pool adjacent violators)."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, sum, x weighted
    for i in by:
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    mean = np.array([p[1] / p[0] for p in pools])
    at = np.array([p[2] / p[0] for p in pools])
    return at, np.clip(mean, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 2500, class_bytes: int = 32 << 20, text_bytes: int = 1 << 20, text: str = "text", id_: str = "doc_id", **options) -> ToxicModel:
    """Learn from labels (doc_id, toxic) of rows of docs that usable admits; at most 2 * per_class texts of 2 * class_bytes bytes reach the driver."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(usable)
    shares = {int(r["toxic"]): int(r["n"]) for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = None
    for y in sorted(shares):
        part = marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    if some is None:
        return ToxicModel([], {}, **options)
    small = some.select(F.col("doc_id").cast(docs.schema[id_].dataType).alias("id"), "toxic", F.xxhash64("doc_id").alias("h"))
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_}`").alias("id"), t.alias("t")).filter(F.octet_length("t") <= text_bytes).join(F.broadcast(small), "id")
    rows = rows.groupBy("id", "toxic", "h").agg(F.min("t").alias("t"))
    held = F.sum(F.octet_length("t")).over(Window.partitionBy("toxic").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("held", held).filter(F.col("held") <= class_bytes).select("id", "t", "toxic")
    return ToxicModel(sorted((tuple(r) for r in rows.collect()), key=lambda r: r[0]), shares, **options)


def score(docs: DataFrame, model: ToxicModel, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """doc_id, score, predicted, evidence; narrow, no shuffle."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())])))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            kind = pa.list_(pa.struct([("doc_id", b.column(0).type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            texts = b.column(1).dictionary_encode("encode")
            once = [own.judge(x.as_py()) for x in texts.dictionary]
            got = [once[i] for i in texts.indices.to_pylist()]
            s = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array([[dict(zip(("doc_id", "cosine", "toxic"), e, strict=True)) for e in g[1]] for g in got], kind)], names=schema.names)

    return docs.select(F.col(f"`{id_}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, schema)


def part_of(column: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), part_of("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (part_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")
