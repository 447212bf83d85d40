"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

A benchmark item of m words is looked for in every m-word window that starts
near a shingle (five words, or m words where an item has fewer; ASCII lower case)
the benchmark knows; elsewhere the similarity is 0.  A window's 64-bit SimHash over
its shingle counts is looked up in eight byte-indexed blocks: each block maps a byte
to the bitmap of the items whose byte lies within ``radius // 8`` bits of it, which
by the pigeonhole principle finds every item fingerprint within ``radius`` bits.
Each candidate is then verified exactly: sum of least over sum of greatest
shingle counts must reach ``threshold`` (0.8).

Radius 21 holds four standard deviations of the distance of a pair of similarity 0.8
whose shingles differ from each other (a change that repeats one shingle many times can
lie farther out and is then not found).  At that radius a block admits 2 of 8 bits and the eight of them some 70 % of unrelated pairs,
so the lists are held as bitmaps and windows are probed in chunks of at most
``PAIRS`` window-item pairs, however many items share a length.

Items are broadcast behind a check of their size: a block of them has at most
``block_bytes`` of text and the documents are scanned once for each block, so once
for a benchmark of up to that size.

Defined results: null texts and texts without words match nothing; a text of
fewer words than an item is one window; an item of fewer than five words is one
shingle of its own length and is found wherever these words stand in a row; each
(row, item) gives at most one row, the window of greatest similarity, first place on
ties; repeated rows and items each report; an empty table on either side gives an
empty result; columns of the documents other than id and text are ignored by
``find`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, batches_by_bytes, string_buffer, table, word_shingles

WORDS, BITS, BLOCKS = 5, 64, 8
PAIRS = 1 << 22
DIFFER = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, off = string_buffer(texts)
    return word_shingles(LOWER[raw], off, words)


def signs(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 / -1 by the bits of each hash."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """(n, 8) bytes of the SimHash for (n, 64) sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


@dataclass
class Group:
    """The items of one length in words."""

    words: int
    ids: list = field(default_factory=list)
    counts: list = field(default_factory=list)
    prints: list = field(default_factory=list)
    near: np.ndarray | None = None  # (blocks, byte value, items / 8): bitmap of the items within the block's radius

    def index(self, radius: int) -> None:
        self.prints = np.array(self.prints)
        self.near = np.stack([np.packbits(DIFFER[:, self.prints[:, j]] <= radius // BLOCKS, axis=1) for j in range(BLOCKS)])

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all fingerprints of windows and items within radius bits."""
        found = []
        own = self.prints.view(np.uint64).ravel()
        step = max(1, PAIRS // len(self.ids))
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            hit = self.near[0][part[:, 0]]
            for j in range(1, BLOCKS):
                hit = hit | self.near[j][part[:, j]]
            w, k = np.nonzero(np.unpackbits(hit, axis=1, count=len(self.ids)))
            away = np.bitwise_count(part.view(np.uint64).ravel()[w] ^ own[k])
            near = np.flatnonzero(away <= radius)
            found.append((w[near] + at, k[near], away[near]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Items:
    """The items of a block by words in a shingle: five, or the item's own number where it has fewer."""

    def __init__(self, rows: list[tuple], radius: int):
        self.radius = radius
        texts = pa.array([t or "" for _, t in rows], pa.string())
        size = np.minimum(shingles(texts)[2], WORDS)
        self.sizes = {int(k): Part([rows[i] for i in np.flatnonzero(size == k)], int(k), radius) for k in np.unique(size) if k}


class Part:
    def __init__(self, rows: list[tuple], words: int, radius: int):
        self.radius, self.size = radius, words
        self.groups: dict[int, Group] = {}
        h, bounds, words = shingles(pa.array([t for _, t in rows], pa.string()), words)
        for i, (item, _) in enumerate(rows):
            own = h[bounds[i] : bounds[i + 1]]
            g = self.groups.setdefault(int(words[i]), Group(int(words[i])))
            g.ids.append(item)
            g.counts.append(Counter(own.tolist()))
            g.prints.append(fingerprint(signs(own).sum(axis=0, keepdims=True))[0])
        for g in self.groups.values():
            g.index(radius)
        self.known = np.unique(h)
        self.longest = max(self.groups)
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.known & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def seeds(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.filter[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[i] == h[at]]

    def search(self, h: np.ndarray, seeds: np.ndarray, words: int, threshold: float) -> list[tuple]:
        """(item, start, words, hamming, similarity) of one text, from its shingles and seed places."""
        best: dict[tuple, tuple] = {}
        breaks = np.flatnonzero(np.diff(seeds) > self.longest)
        for part in np.split(seeds, breaks + 1):
            lo, hi = max(0, int(part[0]) - self.longest), min(len(h), int(part[-1]) + self.longest + 1)
            total = np.zeros((hi - lo + 1, BITS), np.int32)
            np.cumsum(signs(h[lo:hi]), axis=0, out=total[1:])
            for m, g in self.groups.items():
                width = min(max(1, m - self.size + 1), len(h))
                mark = np.zeros(hi - lo + 1, np.int32)
                np.add.at(mark, np.clip(part - width + 1, lo, hi - width) - lo, 1)
                np.add.at(mark, np.minimum(part, hi - width) - lo + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[: hi - lo - width + 1] > 0) + lo
                prints = fingerprint(total[starts + width - lo] - total[starts - lo])
                for w, k, away in zip(*g.within(prints, self.radius), strict=True):
                    s = int(starts[w])
                    a, b = g.counts[k], Counter(h[s : s + width].tolist())
                    least = sum(min(c, b[x]) for x, c in a.items() if x in b)
                    sim = least / (a.total() + b.total() - least)
                    key = (m, int(k))
                    if sim >= threshold and (key not in best or (-sim, s) < (-best[key][4], best[key][1])):
                        best[key] = (g.ids[k], s, min(m, words), int(away), sim)
        return list(best.values())


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 21, block_bytes: int = 32 << 20, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity; narrow over docs, which are scanned once for each block of items."""
    spark = docs.sparkSession
    id_type = docs.schema[id_].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hamming", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    source = docs.select(F.col(f"`{id_}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))

    def scan(block: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            known, out = Items(sent.value, radius), to_arrow_schema(schema)
            for batch in batches if known.sizes else ():
                for b in batches_by_bytes(batch, "t", 1 << 20):
                    rows = []
                    for size, part in known.sizes.items():
                        h, bounds, words = shingles(b.column(1), size)
                        seeds = part.seeds(h)
                        owner = np.searchsorted(bounds, seeds, side="right") - 1
                        who, first = np.unique(owner, return_index=True)
                        for i, own in zip(who.tolist(), np.split(seeds, first[1:]), strict=True) if len(who) else ():
                            for hit in part.search(h[bounds[i] : bounds[i + 1]], own - bounds[i], int(words[i]), threshold):
                                rows.append((b.column(0)[i].as_py(), *hit))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(v, out.field(j).type) for j, v in enumerate(zip(*rows, strict=True))], names=out.names)

        return source.mapInArrow(run, schema)

    found, block, held = None, [], 0
    for item, words in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        size = len(words or "") * 4
        if block and held + size > block_bytes:
            found = scan(block) if found is None else found.unionByName(scan(block))
            block, held = [], 0
        block.append((item, words))
        held += size
    if block or found is None:
        found = scan(block) if found is None else found.unionByName(scan(block))
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose text holds no benchmark item, with their own columns."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(F.xxhash64(t).alias("k"), F.octet_length(t).alias("n")).alias("u"), t.alias("t"))
    hit = find(keyed, items, text="t", id_="u", **options).select(F.col("doc_id").alias("__u")).distinct()
    rows = docs.withColumn("__u", F.struct(F.xxhash64(t).alias("k"), F.octet_length(t).alias("n")))
    return rows.join(hit, "__u", "left_anti").drop("__u")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
