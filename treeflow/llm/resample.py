"""Importance resampling towards a target distribution, with hashed n-grams whose CRCs are combined.

The features of a text are its runs of 1 to ``max_n`` words, joined by one space; a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``.  No such string is
ever made: each word's CRC is computed once, and the CRC of a run follows from
those of its parts, crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where the shift by
2**i zero bytes is a 32 x 32 matrix over GF(2), held as four tables of 256 rows.
Words of any length are taken in blocks of 32 bytes that are combined likewise.

Two scans of the texts: one counts the buckets of documents and target (map-side, so
a task sends one row a bucket), one sums the buckets' gains per document.  Ranks come
from a range-partitioned sort and the sizes of its partitions.  What reaches the
driver, and every task, is one gain a bucket: bounded by ``buckets``.

Defined results: a null or empty text, or one without words, has no features, weight
0 and a score from its id alone; a null id counts as the empty string in the draw and
stands after other ids among ties; repeated rows are rows of their own with equal
scores and following ranks; an empty table gives none; only the id and text columns
are read, so others, clashing names included, don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, batches_by_bytes, settle, string_buffer, table

POLYNOMIAL = 0xEDB88320
BLOCK = 32
#: Word bytes: digits, letters and everything beyond ASCII, after A-Z are lower-cased.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


@dataclass(frozen=True)
class Draw:
    max_n: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


BYTE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A GF(2) matrix, as four tables by byte of the vector, times each crc."""
    return tables[0][crc & 0xFF] ^ tables[1][(crc >> 8) & 0xFF] ^ tables[2][(crc >> 16) & 0xFF] ^ tables[3][crc >> 24]


@lru_cache(maxsize=64)
def shift_tables(power: int) -> np.ndarray:
    """The matrix that appends 2**power zero bytes; each is the square of the one before."""
    vectors = np.arange(256, dtype=np.uint32)
    each = [vectors << np.uint32(8 * k) for k in range(4)]
    if power == 0:
        return np.stack([BYTE[v & 0xFF] ^ (v >> np.uint32(8)) for v in each])
    half = shift_tables(power - 1)
    return np.stack([_apply(half, _apply(half, v)) for v in each])


def shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each crc after as many zero bytes as its entry of zeros."""
    out, power = crc.copy(), 0
    while True:
        at = np.flatnonzero((zeros >> power) & 1)
        if len(at):
            out[at] = _apply(shift_tables(power), out[at])
        power += 1
        if not len(zeros) or int(zeros.max()) >> power == 0:
            return out


def combine(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRCs of concatenations from those of both parts and the lengths of the right ones."""
    return shift(left, right_bytes) ^ right


def word_crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:end], one byte of every block at a step."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = end - start
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(start)), blocks)
    first = np.cumsum(blocks) - blocks
    at = start[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
    length = np.minimum(end[owner] - at, BLOCK)
    order = np.argsort(-length, kind="stable")
    at, crc = at[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = len(order) - np.searchsorted(length[order][::-1], np.arange(int(length.max())), side="right")
    for k, n in enumerate(live.tolist()):
        c = crc[:n]
        crc[:n] = BYTE[(c ^ raw[at[:n] + k]) & 0xFF] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    if len(owner) == len(start):
        return out
    after = end[owner] - (start[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK) - length
    return np.bitwise_xor.reduceat(shift(out, after), first)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and each row's number of words."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = WORD[raw]
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begin[cut] = inside[cut]
    finish = inside[:-1] & ~inside[1:]
    finish[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def features(column: pa.Array, draw: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the rows' word counts."""
    raw, offsets = string_buffer(column)
    raw = LOWER[raw]
    start, end, count = words_of(raw, offsets)
    word = word_crcs(raw, start, end)
    last = np.repeat(np.cumsum(count), count)  # one past the last word of a word's row
    row = np.repeat(np.arange(len(count)), count)
    size, i = end - start, np.arange(len(word))
    run, crc = [word], word
    rows = [row]
    space = np.array([BYTE[(0xFF ^ 0x20)] ^ (0xFFFFFFFF >> 8) ^ 0xFFFFFFFF], np.uint32)
    for n in range(2, draw.max_n + 1):
        keep = i + n <= last[i]
        i, crc = i[keep], crc[keep]
        spaced = combine(crc, np.broadcast_to(space, len(i)), np.ones(len(i), np.int64))
        crc = combine(spaced, word[i + n - 1], size[i + n - 1])
        run.append(crc)
        rows.append(row[i])
    return (np.concatenate(run) % np.uint32(draw.buckets)).astype(np.int64), np.concatenate(rows), count


def bucket_counts(texts: DataFrame, text: str, draw: Draw) -> DataFrame:
    """bucket, n: how many features of the whole column fall into each bucket that any falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for b in batches_by_bytes(batch, "t", 4 << 20):
                total += np.bincount(features(b.column(0), draw)[0], minlength=draw.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = texts.select(F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, draw: Draw) -> np.ndarray:
    """floor(1000 ln(P_target / P_documents)) of every bucket, add-one smoothed."""
    sides = []
    for df, column in ((docs, text), (target, target_text)):
        n = np.zeros(draw.buckets, np.int64)
        for r in bucket_counts(df, column, draw).collect():  # one row a bucket at most
            n[r["bucket"]] = r["n"]
        sides.append(n.tolist())
    s, t = sides
    all_s, all_t = sum(s) + draw.buckets, sum(t) + draw.buckets
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def gumbel(name: str) -> int:
    h = int(hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str, text: str, draw: Draw) -> DataFrame:
    """key, n_words, n_features, weight, score of every row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_by_bytes(batch, "t", 4 << 20):
                bucket, row, words = features(b.column(2), draw)
                n = np.bincount(row, minlength=b.num_rows)
                weight = np.bincount(row, gain[bucket], b.num_rows).astype(np.int64)  # doubles hold these sums exactly
                noise = np.array([gumbel(f"{draw.seed}:{i}") for i in b.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, n, weight, weight + noise))], names=schema.names)

    ids = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`"), ids.alias("i"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list, share: tuple[int, int]) -> DataFrame:
    """rows (a settled table) with rank: 1, 2, ... in order for the first floor(n * share), else null.

    Range partitions are sorted each by itself; the sizes of those before give where each
    begins.  ``__row`` parts rows that the order leaves equal, so none of them is hot."""
    by = [*order, F.col("__row")]
    parts = settle(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "draw")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # one row a partition
    first = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), (F.floor(F.sum("__n").over(W.partitionBy()) * share[0] / share[1])).alias("__drawn"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*by)).cast("long") + F.col("__before")
    out = parts.join(F.broadcast(first), "__part").withColumn("__place", place)
    return out.withColumn("rank", F.when(F.col("__place") <= F.col("__drawn"), F.col("__place"))).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", draw: Draw | None = None) -> DataFrame:
    """key, n_words, n_features, weight, score and rank (null where not drawn) of every row of docs."""
    draw = draw or Draw()
    gain = gains(docs, target, text, target_text, draw)
    rows = settle(scores(docs, gain, key, text, draw).withColumn("__row", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= draw.min_words
    drawn = ranked(rows.filter(able), [F.col("score").desc(), F.col(f"`{key}`").asc_nulls_last()], (draw.percent, 100))
    return drawn.unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))).drop("__row")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte, for the distinct words alone.
ORACLE = r"""
WITH crc_of_byte AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), wanted AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), distinct_words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM wanted)),
hashed AS (
    SELECT w, xor(list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
    FROM distinct_words, crc_of_byte
), s AS (SELECT b, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY b),
gain AS (
    SELECT g.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000))))::BIGINT AS gain
    FROM (SELECT unnest(range(10000)) AS b) g LEFT JOIN s USING (b) LEFT JOIN t USING (b)
), per_doc AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
    SELECT d.doc_id, coalesce(p.n, 0) AS n_features, coalesce(p.weight, 0) AS weight,
        coalesce(p.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents d LEFT JOIN per_doc p USING (doc_id)
), ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM scored LEFT JOIN ordered USING (doc_id)
"""
