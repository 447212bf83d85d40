"""Language-model scoring by deleted interpolation.

P(w | v) = l2 c(vw)/c(v) + l1 c(w)/N + l0/(V+1); the weights depend on the bucket
floor(log2 c(v)) + 1 (0 for an unseen context) and are learned by expectation-
maximisation on deleted counts: every training token is taken out of the counts
and predicted from the rest, so each is held out once.

Counts cover all training documents and are exact.  Documents are dealt into
groups of about ``group_bytes``.  A group sends its distinct words and word pairs
with their counts, sorted and delta-packed, to hash-range buckets; a bucket adds
up the counts of all groups and answers in the order asked, so a word or pair
costs one entry a group however often it occurs.  Groups and buckets grow in number
with the input, never in size, and are dealt over twice as many partitions as there
are of them, so the largest task stays as it is; packs without entries are not sent,
so there are never more rows than distinct entries of the groups, as if each entry
were a row of its own.  The second visit to the same groups turns answers into per-token counts (``terms``), from which the weights
(via a histogram of bounded size) and the scores are computed.

Defined results: a null or empty text is one end token; documents of equal id
have equal parts in training (crc32 of the id as text; null counts as ''); rows
are scored one by one, so repeated rows give repeated results (and count twice in
training); with no training text all probabilities are uniform; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, batches_by_bytes, groups_for, mix, settle, string_buffer, table, word_hash, word_spans

START, END = np.uint64(0x51ED270B2F6E3A8D), np.uint64(0xC2B2AE3D27D4EB4F)
STEPS = 8  # histogram cells per power of two


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, hashes of (previous token, token), and the rows' bounds; each row ends in END."""
    raw, off = string_buffer(texts)
    raw = LOWER[raw]
    s, e, row = word_spans(raw, off)
    rows = len(off) - 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows) + 1)])
    w = np.full(bounds[-1], END, np.uint64)
    if len(s):
        w[np.arange(len(s)) + row] = word_hash(raw, s, e)
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[bounds[:-1]] = START
    with np.errstate(over="ignore"):
        return w, mix(before * np.uint64(3) + w), bounds


def _group_tokens(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], [np.zeros(1, np.int64)]
    for batch in t.select([column]).to_batches():
        for b in batches_by_bytes(batch, column, 1 << 20):
            w, p, bounds = tokens(b.column(0))
            parts.append((w, p))
            at.append(bounds[1:] + at[-1][-1])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(at)


def pack(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; ascending uint64 should be differenced first."""
    import zstandard

    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


def _unique(h: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, their counts among trained tokens, and each token's place."""
    u, inverse = np.unique(h, return_inverse=True)
    return u, np.bincount(inverse[trained], minlength=len(u)).astype(np.int64), inverse


def _gaps(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.diff(h, prepend=h[:1] * np.uint64(0))


def _asker(buckets: int):
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    types = pa.schema([("g", pa.int64()), ("b", pa.int64()), ("words", pa.binary()), ("word_n", pa.binary()), ("pairs", pa.binary()), ("pair_n", pa.binary())])

    def ask(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        w, p, bounds = _group_tokens(t, "t")
        trained = np.repeat(~t.column("held").to_numpy(), np.diff(bounds))
        rows = []
        cuts = []
        for h in (w, p):
            u, n, _ = _unique(h, trained)
            cuts.append((u, n, np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])))
        (u, n, cu), (v, m, cv) = cuts
        for b in range(buckets):
            x, y = slice(cu[b], cu[b + 1]), slice(cv[b], cv[b + 1])
            if cu[b + 1] > cu[b] or cv[b + 1] > cv[b]:
                rows.append((g, b, pack(_gaps(u[x])), pack(n[x]), pack(_gaps(v[y])), pack(m[y])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return ask


def _answer(t: pa.Table) -> pa.Table:
    """Sums the counts of a bucket over all groups; v, the distinct trained words, rides on one row."""
    order = np.argsort(t.column("g").to_numpy(), kind="stable")
    out, vocabulary = [], 0
    for kind, (hashes, counts) in enumerate((("words", "word_n"), ("pairs", "pair_n"))):
        hs = [np.cumsum(unpack(t.column(hashes)[int(i)].as_py(), np.uint64), dtype=np.uint64) for i in order]
        u, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.concatenate([unpack(t.column(counts)[int(i)].as_py(), np.int64) for i in order])
        total = np.zeros(len(u), np.int64)
        np.add.at(total, inverse, n)
        if kind == 0:
            vocabulary = int((total > 0).sum())
        size = np.cumsum([len(h) for h in hs])[:-1]
        out.append([pack(x) for x in np.split(total[inverse], size)])
    v = np.zeros(len(order), np.int64)
    v[:1] = vocabulary
    return pa.table({"g": t.column("g").take(pa.array(order)), "b": t.column("b").take(pa.array(order)), "word_n": pa.array(out[0], pa.binary()), "pair_n": pa.array(out[1], pa.binary()), "v": pa.array(v)})


def _terms(left: pa.Table, right: pa.Table) -> pa.Table:
    w, p, bounds = _group_tokens(left, "t")
    order = np.argsort(right.column("b").to_numpy(), kind="stable")
    columns = []
    for h, name in ((w, "word_n"), (p, "pair_n")):
        _, inverse = np.unique(h, return_inverse=True)
        n = np.concatenate([unpack(right.column(name)[int(i)].as_py(), np.int64) for i in order])
        columns.append(n[inverse])
    cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())
    rows = left.num_rows
    v = np.zeros(rows, np.int64)
    v[:1] = int(right.column("v").to_numpy().sum())
    narrow = np.int32 if max((int(c.max(initial=0)) for c in columns), default=0) < 2**31 else np.int64
    return pa.table({"doc_id": left.column("doc_id"), "held": left.column("held"), "n_tokens": pa.array(np.diff(bounds)), "bits": pa.array(np.full(rows, np.dtype(narrow).itemsize * 8, np.int32)), "word_n": cut(columns[0].astype(narrow)), "pair_n": cut(columns[1].astype(narrow)), "v": pa.array(v)})


def terms(docs: DataFrame, held: object, text: str = "text", id_: str = "doc_id", group_bytes: int = 12 << 20) -> DataFrame:
    """Per row the training counts of its tokens (word_n) and of its token pairs (pair_n)."""
    n = groups_for(docs, text, group_bytes)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    dealt = docs.select(F.pmod(F.xxhash64(F.col(f"`{id_}`"), t), F.lit(n)).alias("g"), F.col(f"`{id_}`").alias("doc_id"), held.alias("held"), t.alias("t"))
    binary = "word_n binary, pair_n binary"
    dealt = dealt.repartition(2 * n, "g")
    asked = dealt.groupBy("g").applyInArrow(_asker(n), "g bigint, b bigint, words binary, word_n binary, pairs binary, pair_n binary")
    told = asked.repartition(2 * n, "b").groupBy("b").applyInArrow(_answer, f"g bigint, b bigint, {binary}, v bigint")
    id_type = docs.schema[id_].dataType.simpleString()
    return settle(dealt.groupBy("g").cogroup(told.repartition(2 * n, "g").groupBy("g")).applyInArrow(_terms, f"doc_id {id_type}, held boolean, n_tokens bigint, bits int, {binary}, v bigint"), "terms")


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, c(w), c(vw) and c(v) of each token; the start context is as frequent as the end token."""
    for i in range(b.num_rows):
        kind = np.int32 if b.column(2)[i].as_py() == 32 else np.int64
        w = np.frombuffer(b.column(3)[i].as_py(), kind).astype(np.int64)
        p = np.frombuffer(b.column(4)[i].as_py(), kind).astype(np.int64)
        v = np.empty_like(w)
        v[1:], v[0] = w[:-1], w[-1]
        yield i, w, p, v


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0)


def _cell(num: np.ndarray, den: np.ndarray | int) -> np.ndarray:
    """Histogram cell of num / den: 0 for none, else 1 more than -STEPS * log2, rounded."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.rint(-STEPS * np.log2(num / den))
    return np.where((num > 0) & (np.asarray(den) > 0), q + 1, 0).astype(np.int64)


def _histogram(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for i, w, p, v in _rows(b):
                if not b.column(1)[i].as_py():
                    keys.append((bucket_of(v - 1) << 40) | (_cell(p - 1, v - 1) << 20) | _cell(w - 1, max(1, total - 1)))
            if keys:
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["cell", "n"])

    return run


def learn_weights(cells: list[tuple[int, int]], vocabulary: int, rounds: int = 40) -> np.ndarray:
    """(bucket, 3) weights of pair, word and uniform estimates by expectation-maximisation."""
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (66, 1))
    weights[0] = [0, 0.5, 0.5]
    k = np.array([c for c, _ in cells], np.int64)
    n = np.array([m for _, m in cells], np.float64)
    back = lambda q: np.where(q > 0, 2.0 ** (-(q - 1) / STEPS), 0.0)
    p = np.stack([back((k >> 20) & 0xFFFFF), back(k & 0xFFFFF), np.full(len(k), 1 / (vocabulary + 1))], axis=1)
    where = k >> 40
    for _ in range(rounds):
        part = weights[where] * p
        part *= (n / part.sum(axis=1))[:, None]
        new = np.full_like(weights, 1e-3)  # keeps every estimate possible
        np.add.at(new, where, part)
        new[0, 0] = 0
        seen = np.bincount(where, minlength=len(new)) > 0
        weights[seen] = (new / new.sum(axis=1, keepdims=True))[seen]
    # a bucket no training token fell into takes the weights of the next smaller one
    for b in range(2, len(weights)):
        if not (where == b).any() and (where == b - 1).any():
            weights[b] = weights[b - 1]
            where = np.append(where, b)
    return weights


def score(docs: DataFrame, held: object, text: str = "text", id_: str = "doc_id", group_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    found = terms(docs, held, text, id_, group_bytes)
    one = found.agg(F.sum(F.when(~F.col("held"), F.col("n_tokens"))).alias("n"), F.sum("v").alias("v")).first()
    n, v = int(one["n"] or 0), int(one["v"] or 0)
    columns = found.select("doc_id", "held", "bits", "word_n", "pair_n")
    cells = columns.mapInArrow(_histogram(n), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(sorted((r["cell"], r["n"]) for r in cells), v)
    id_field = T.StructField("doc_id", found.schema["doc_id"].dataType)
    schema = T.StructType([id_field] + [T.StructField(c, t) for c, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, known, base, full = [], [], [], []
            for _, w, p, c in _rows(b):
                lam = weights[bucket_of(c)]
                prob = lam[:, 0] * p / np.maximum(c, 1) + lam[:, 1] * w / max(1, n) + lam[:, 2] / (v + 1)
                size.append(len(w))
                known.append(int((w > 0).sum()))
                base.append(float(np.log10((w + 1) / (n + v + 1)).sum()))
                full.append(float(np.log10(prob).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array([n] * len(size), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=schema.names)

    return columns.mapInArrow(run, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score(table(spark, sf_dir, "documents"), held)
