"""Near-duplicate documents by order MinHash and banded alignment.

Shingles are five words in a row (the whole text where it has fewer), labelled
with their occurrence number.  For each of ``sketches`` hash functions the two
labelled shingles of least hash are kept in the order of the text; their ordered
pair is a bucket key.  Equal pairs are likely only where the edit similarity of
the shingle sequences is high.

One pass of linear cost comes first: every member of a bucket is held against the
bucket's leader, which is the member whose other buckets are largest (the text that
most near copies derive from).  Verified links are made into components.

What is left is settled exactly (``_rest``): all pairs of a bucket whose texts are
in different components are tested.  Buckets of up to ``FEW`` members give their
pairs as rows; the members of larger ones are dealt into blocks, and each pair of
blocks is one group, in which shared shingles are counted for all pairs at once and
only pairs with enough of them are aligned.  Members of a bucket's largest component
meet the others, not each other.  So no pair of a bucket stays untested unless its
texts are already in one class; a bucket with many components costs the square of
the members outside its largest one.  Links found here join components, so only the
components they touch are formed anew.

A candidate is verified by banded alignment: labelled shingles are unique in a
text, so the longest common subsequence inside the band that the threshold allows
is a longest increasing run of matched positions.  With S matched shingles of A
and B, similarity is S / (A + B - S); a link needs ``threshold`` (0.8) or more.

Defined results: equal texts (nulls are empty texts) are one class whatever their
ids; class_id is the least doc_id of the class (nulls last); every input row gives
one output row, repeated rows too; texts without words are linked to nothing but
equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, as_signed, batches_by_bytes, mix, scope, settle, string_buffer, table, word_shingles
from .graph import components, joined

WORDS = 5
#: Buckets of up to so many members give pairs as rows; a block of a larger one has about so many members, and shingles.
FEW, BLOCK_ROWS, BLOCK_SHINGLES = 8, 1000, 400_000


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingle hashes in text order, and the row bounds within them."""
    h, bounds, _ = word_shingles(raw, offsets, WORDS)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # occurrence labels: rank among equal shingles of the same row
    key = h ^ mix(owner.astype(np.uint64))
    by = np.argsort(key, kind="stable")
    k = key[by]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    if not head.all():
        begin = np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))
        label = np.zeros(len(k), np.uint64)
        label[by] = (np.arange(len(k)) - begin).astype(np.uint64)
        h = np.where(label > 0, mix(h ^ mix(label)), h)
    return h, bounds


def order_minhash(h: np.ndarray, bounds: np.ndarray, sketches: int) -> np.ndarray:
    """(rows with shingles, sketches) keys of the two least shingles in text order."""
    begin = bounds[:-1][np.diff(bounds) > 0]
    size = np.diff(np.append(begin, len(h)))
    # the place takes the low bits of the hash; more of them only for a text of over 2**26 shingles
    low = np.uint64((1 << max(26, int(size.max(initial=0)).bit_length())) - 1)
    place = (np.arange(len(h)) - np.repeat(begin, size)).astype(np.uint64)
    out = np.zeros((len(begin), sketches), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for j in range(sketches):
            odd = np.uint64(mix(np.array([j + 1], np.uint64))[0] | np.uint64(1))
            v = (h ^ (h >> np.uint64(31)) ^ odd) * odd
            v = (v & ~low) | place
            one = begin + (np.minimum.reduceat(v, begin) & low).astype(np.int64)
            v[one] = top
            second = np.minimum.reduceat(v, begin)
            two = np.where(second == top, one, begin + (second & low).astype(np.int64))
            a, b = np.minimum(one, two), np.maximum(one, two)
            out[:, j] = mix(h[a] * np.uint64(3) + mix(h[b]) + np.uint64(j))
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """S / (A + B - S) of the in-order matches inside the band, 0 as soon as threshold is out of reach."""
    total = len(a) + len(b)
    need = threshold / (1 + threshold) * total - 1e-9
    if min(len(a), len(b)) < need:
        return 0.0
    band = int(total - 2 * need) + 1
    by = np.argsort(b)
    i = np.minimum(np.searchsorted(b[by], a), len(b) - 1)
    match = b[by][i] == a
    x, y = np.flatnonzero(match), by[i[match]]
    y = y[np.abs(x - y) <= band]
    if len(y) < need:
        return 0.0
    if (np.diff(y) > 0).all():
        s = len(y)
    else:
        tails: list[int] = []
        for v in y.tolist():
            p = bisect_left(tails, v)
            if p == len(tails):
                tails.append(v)
            else:
                tails[p] = v
        s = len(tails)
    return s / (total - s)


def _key(text: str) -> list[Column]:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.struct(F.xxhash64(t).alias("k"), F.octet_length(t).alias("n")).alias("u"), t.alias("t")]


def sketch(docs: DataFrame, text: str = "text", sketches: int = 12) -> DataFrame:
    """u (text key), sk array<bigint> of order MinHash keys, n shingles, for the rows with words."""
    u = "struct<k: bigint, n: int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_by_bytes(batch, "t", 1 << 20):
                raw, off = string_buffer(b.column(1))
                h, bounds = shingles(raw, off)
                has = np.flatnonzero(np.diff(bounds) > 0)
                if len(has):
                    sk = as_signed(order_minhash(h, bounds, sketches))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.FixedSizeListArray.from_arrays(pa.array(sk.ravel()), sketches).cast(pa.list_(pa.int64())), pa.array(np.diff(bounds)[has])], names=["u", "sk", "n"])

    return docs.select(*_key(text)).mapInArrow(run, f"u {u}, sk array<bigint>, n bigint")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Rows u, v of pairs whose texts (u, t; one row a text) align to threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_by_bytes(batch, "t", 1 << 20):
                one, two = b.column(2).dictionary_encode(), b.column(3).dictionary_encode()
                ha, ba = shingles(*string_buffer(one.dictionary))
                hb, bb = shingles(*string_buffer(two.dictionary))
                keep = []
                for i, (p, q) in enumerate(zip(one.indices.to_pylist(), two.indices.to_pylist(), strict=True)):
                    if aligned(ha[ba[p] : ba[p + 1]], hb[bb[q] : bb[q + 1]], threshold) >= threshold:
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], names=["u", "v"])

    node = pairs.schema["u"].dataType.simpleString()
    near = pairs.join(texts.select("u", F.col("t").alias("t2")).hint("merge"), "u").join(texts.select(F.col("u").alias("v"), "t").hint("merge"), "v")
    return near.select("u", "v", "t2", "t").mapInArrow(run, f"u {node}, v {node}")


def _star(rows: DataFrame) -> DataFrame:
    """Candidates u, v: members u of bucket b against its leader v (rows: b, u; leaders have most bucket mates)."""
    sized = settle(rows.join(apart(rows.groupBy("b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "b"), "b"), "buckets", "deal")
    score = sized.groupBy("u").agg(F.sum("c").alias("s"))
    scored = sized.select("b", "u").join(score.hint("merge"), "u")
    leader = scored.groupBy("b").agg(F.max(F.struct("s", "u")).alias("v"))
    return scored.select("b", "u").join(apart(leader.select("b", F.col("v.u").alias("v")), "b"), "b").filter("u <> v").select("u", "v").distinct()


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(a, b) counts of the shingles that two texts share; a text has a shingle once."""
    _, col = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    left = row < len(a)
    ra, ca, rb, cb = row[left], col[left], row[~left] - len(a), col[~left]
    wide = int(col.max(initial=-1)) + 1
    na, nb = np.bincount(ca, minlength=wide), np.bincount(cb, minlength=wide)
    out = np.zeros((len(a), len(b)), np.float32)
    # columns of many texts are multiplied as matrices, the others give their pairs one by one
    often = na * nb * 256 > out.size
    place = np.cumsum(often) - 1
    for lo in range(0, int(often.sum()), 2048):
        part = often & (place >= lo) & (place < lo + 2048)
        x, y = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
        x[ra[part[ca]], place[ca[part[ca]]] - lo] = 1
        y[rb[part[cb]], place[cb[part[cb]]] - lo] = 1
        out += x @ y.T
    few = ~often & (na > 0) & (nb > 0)
    by = np.argsort(cb, kind="stable")
    first, rb = np.searchsorted(cb[by], np.arange(wide)), rb[by]
    at = np.flatnonzero(few[ca])
    ends = np.cumsum(nb[ca[at]])
    flat = out.ravel()
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), side="right")))
        c = ca[at[lo:hi]]
        size = nb[c]
        mate = rb[np.repeat(first[c] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        np.add.at(flat, np.repeat(ra[at[lo:hi]], size) * len(b) + mate, np.float32(1))
        lo = hi
    return out


def _block_links(threshold: float):
    """Of one pair of blocks: links between its components, enough of them to join all that a verified pair joins."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        k, x, y, own = rows["k"][0].as_py(), key[1].as_py(), key[2].as_py(), rows["own"].to_numpy()
        h, bounds = shingles(*string_buffer(rows["t"]))
        sh = [h[bounds[i] : bounds[i + 1]] for i in range(len(own))]
        size = np.diff(bounds)
        root: dict[tuple, int] = {}
        up = np.array([root.setdefault((c["k"], c["n"]), i) for i, c in enumerate(rows["c"].to_pylist())])
        sk = np.array(rows["sk"].to_pylist(), np.int64)
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        keep: list[tuple[int, int]] = []
        if len(a) and len(b):
            shared = overlaps([sh[i] for i in a], [sh[i] for i in b])
            enough = shared >= threshold / (1 + threshold) * (size[a][:, None] + size[b][None, :]) - 1e-3
            p, q = np.nonzero(enough & (up[a][:, None] != up[b][None, :]))
            p, q = a[p], b[q]
            if x == y:
                p, q = p[p < q], q[p < q]
            join = up.tolist()

            def find(i: int) -> int:
                while join[i] != i:
                    join[i] = i = join[join[i]]
                return i

            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                # the first bucket that two texts share tests them
                if (r := find(i)) != (s := find(j)) and not (sk[i, :k] == sk[j, :k]).any() and aligned(sh[i], sh[j], threshold) >= threshold:
                    join[r] = s
                    keep.append((i, j))
        return pa.table([rows["u"].take(pa.array([i for i, _ in keep], pa.int64())), rows["u"].take(pa.array([j for _, j in keep], pa.int64()))], names=["u", "v"])

    return run


def _rest(sk: DataFrame, classes: DataFrame, texts: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """Links u, v among all pairs of a bucket whose texts are in different components (sk: u, sk, n of the texts that share a bucket)."""
    node = sk.schema["u"].dataType.simpleString()
    rows = sk.join(classes.hint("merge"), "u", "left").select("u", F.coalesce("c", "u").alias("c"), "n", F.posexplode("sk").alias("k", "b"))
    mixed = rows.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("s")).filter("lo <> hi").select("b", "s")
    rows = settle(rows.join(apart(mixed, "b"), "b"), "mixed", "deal")
    members = rows.filter(F.col("s") <= FEW).groupBy("b").agg(F.collect_list(F.struct("u", "c", "n")).alias("m"))
    long_enough = lambda x, y: F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * (threshold - 1e-9)
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["u"] > x["u"]) & (y["c"] != x["c"]) & long_enough(x, y)), lambda y: F.struct(x["u"].alias("u"), y["u"].alias("v")))))
    pairs = members.select(F.explode(pairs).alias("p")).select("p.u", "p.v").distinct()
    pairs = pairs.join(tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().hint("merge"), ["u", "v"], "left_anti")
    links = verify(settle(pairs, "candidates", "deal"), texts, threshold)
    large = rows.filter(F.col("s") > FEW)
    foremost = large.groupBy("b", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).groupBy("b").agg(F.max(F.struct("m", "c", "w")).alias("x"), F.sum("m").alias("m"), F.sum("w").alias("w"))
    blocks = lambda m, w: F.ceil(F.greatest(m / BLOCK_ROWS, w / BLOCK_SHINGLES)).cast("int")
    plan = foremost.select("b", F.col("x.c").alias("most"), blocks(F.col("m") - F.col("x.m"), F.col("w") - F.col("x.w")).alias("rest"), blocks(F.col("x.m"), F.col("x.w")).alias("main"))
    at = F.when(F.col("c") == F.col("most"), F.col("rest") + F.pmod(F.xxhash64("u"), F.col("main"))).otherwise(F.pmod(F.xxhash64("u"), F.col("rest"))).cast("int")
    meets = F.when(F.col("own") >= F.col("rest"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("main") - 1))
    dealt = large.join(apart(plan, "b"), "b").withColumn("own", at).select("b", "k", "u", "c", "own", F.explode(meets).alias("o"))
    dealt = dealt.select("b", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"), "k", "u", "c", "own")
    dealt = dealt.join(sk.select("u", "sk").join(texts.hint("merge"), "u").hint("merge"), "u")
    return settle(links.unionByName(dealt.groupBy("b", "x", "y").applyInArrow(_block_links(threshold), f"u {node}, v {node}")), "links", "deal")


def text_classes(docs: DataFrame, text: str = "text", threshold: float = 0.8, sketches: int = 12) -> DataFrame:
    """u, c for each text that is linked to another one; c is the least u of its class."""
    with scope(docs.sparkSession) as keep:
        sk = settle(sketch(docs, text, sketches).groupBy("u").agg(F.first("sk").alias("sk"), F.first("n").alias("n")), "sketches")
        tested = settle(_star(sk.select("u", F.explode("sk").alias("b"))), "candidates", "merge")
        touched = settle(tested.select("u").union(tested.select("v")).distinct(), "touched", "merge")
        texts = settle(docs.select(*_key(text)).join(touched.hint("merge"), "u", "left_semi").dropDuplicates(["u"]), "texts")
        classes = components(settle(verify(tested, texts, threshold), "links", "deal"))
        new = _rest(sk.join(touched.hint("merge"), "u", "left_semi"), classes, texts, tested, threshold)
        return keep(classes if new.isEmpty() else joined(classes, new))


def near_classes(docs: DataFrame, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its class), u (text key), rep (text key of the row with class_id)."""
    classes = text_classes(docs, text, **options)
    rows = docs.select(F.col(f"`{id_}`").alias("doc_id"), _key(text)[0])
    own = rows.groupBy("u").agg(F.min("doc_id").alias("first"))
    own = own.join(classes.hint("merge"), "u", "left").select("u", "first", F.coalesce("c", "u").alias("c"))
    least = own.groupBy("c").agg(F.min(F.struct(F.col("first").isNull().alias("no"), F.col("first").alias("class_id"), F.col("u").alias("rep"))).alias("x"))
    named = own.select("u", "c").join(apart(least, "c"), "c").select("u", "x.class_id", "x.rep")
    return rows.join(named.hint("merge"), "u").select("doc_id", "class_id", "u", "rep")


def keep_first(docs: DataFrame, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """One row of each class of near duplicates, with the columns of docs: the one with the least id."""
    named = near_classes(docs, text, id_, **options).filter("u = rep").select(F.col("doc_id").alias("__id"), "class_id", F.col("u").alias("__u")).filter(F.col("__id").eqNullSafe(F.col("class_id"))).select("__id", "__u").distinct()
    rows = docs.select("*", _key(text)[0].alias("__u"))
    kept = rows.join(named.hint("merge"), (rows["__u"] == named["__u"]) & rows[f"`{id_}`"].eqNullSafe(named["__id"]), "left_semi")
    # rows of equal id and text: the one whose other columns have the least hash, so that which one stays is defined
    others = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in (id_, text))))) if len(docs.columns) > 2 else F.lit(0)
    one = kept.groupBy("__u").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), others).alias("__row"))
    return one.select("__row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
