"""Exact substring dedup by suffix arrays with bucket-pointer refinement.

A byte is removed when it lies in a WINDOW-byte string that also starts anywhere
else in the collection, same document included.

1. Anchors.  Every window of a document picks the leftmost minimum-hash Q-gram
   inside it; windows in a row with one anchor form a segment.  Equal windows have
   equal anchors at equal offsets, so a window's twin is found in the bucket of
   its anchor's Q-gram.  Segments are about one per 90 bytes; only their hashes
   are shuffled, and buckets met once end there.
2. A segment met again needs no text: all its windows repeat.
3. One copy of each distinct segment of a bucket that has several is brought
   together with the others, and their suffixes are sorted by bucket-pointer
   refinement: 8-gram buckets first, then every bucket of two or
   more is split by the bucket pointers of later offsets, and the new pointers are
   used by the next round, up to depth WINDOW.  Windows that still share a bucket
   are equal.
4. A bucket of more than ``hot`` distinct segments (one passage in very many
   documents) is too large for a task and is refined across tasks: the pointer of a
   window at depth 2h is made of the pointers at depth h of its start and of h bytes
   later, as in 3, but as a hash of the two in place of a rank, so that pointers of
   different tasks can be compared; pointers at depth WINDOW are counted by a
   distributed, pre-aggregated groupBy.

Segments are counted by (anchor, segment) before anything is joined, and the joins
on anchors and segments deal every key, hot or not, to SALTS parts.

Texts are keyed by (xxhash64, byte length), so exact copies share their spans and
the rows of the input need no unique id.  Anchors, segments and pointers of 4 are
64-bit hashes: two different segments under one anchor, or windows of one hot bucket,
that collide would be taken for equal (odds of 2^-64 for each such pair).

Defined results: a null text is empty; texts under WINDOW bytes lose nothing;
repeated rows of WINDOW bytes or more are copies and lose everything; columns of
the input are kept, and ``spans`` / ``kept`` replace input columns so named; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MULT, as_signed, batches_by_bytes, mix, powers, scope, settle, span_hash, string_buffer, table

WINDOW, Q = 200, 24
CHUNK = 1 << 20
SALTS = 16  # parts of a hot key; the other side of the join is repeated for each
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """first window, number of windows, anchor hash, segment hash of all rows' segments."""
    found: list[tuple[np.ndarray, ...]] = []
    for c in range(0, max(0, len(raw) - WINDOW + 1), CHUNK):
        part = raw[c : c + CHUNK + WINDOW - 1]
        up, down = powers(len(part) + 1)
        w = len(part) - WINDOW + 1
        with np.errstate(over="ignore"):
            prefix = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
            gram = (prefix[Q:] - prefix[:-Q]) * down[: len(part) - Q + 1]
            low = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(len(low), dtype=np.uint64)
        wide, k = WINDOW - Q + 1, 1
        while 2 * k <= wide:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        low = np.minimum(low[:w], low[wide - k : wide - k + w])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.clip(offsets[:-1] - c, 0, w)
        last = np.clip(offsets[1:] - c - WINDOW + 1, 0, w)
        real = last > first
        edge = np.zeros(w + 1, np.int32)
        np.add.at(edge, first[real], 1)
        np.add.at(edge, last[real], -1)
        cut = np.zeros(w + 1, bool)
        cut[1:w] = anchor[1:] != anchor[:-1]
        cut[first[real]] = cut[last[real]] = True
        cut[0] = cut[w] = True
        at = np.flatnonzero(cut)
        begin, end = at[:-1], at[1:]
        ok = np.cumsum(edge)[begin] > 0
        begin, end = begin[ok], end[ok]
        found.append((begin + c, end - begin, mix(gram[anchor[begin]]), span_hash(prefix, begin, end + WINDOW - 1)))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_windows(raw: np.ndarray, offsets: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Positions whose depth-byte string inside its row equals that of another position.

    Bucket-pointer refinement: pointer[i] is the first place of i's bucket in the
    order by the prefixes compared so far.
    """
    n = len(raw)
    if n < depth:
        return np.zeros(0, np.int64)
    place = np.int32 if n < 2**31 else np.int64
    room = (np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)).astype(place)  # bytes from here to the row's end
    key = raw.astype(np.uint64)
    done = 1
    while done < min(8, depth) and 2 * done <= depth:
        longer = np.zeros(n, np.uint64)
        longer[: n - done] = (key[: n - done] << np.uint64(8 * done)) | key[done:]
        key, done = longer, 2 * done
    live = np.flatnonzero(room >= done).astype(place)
    pointer = np.full(n, -1, place)
    first, order = np.zeros(len(live), place), key[live]
    del key
    while True:
        by = np.argsort(order, kind="stable").astype(place)
        rank = order[by]
        del order
        head = np.ones(len(by), bool)
        head[1:] = rank[1:] != rank[:-1]
        old = first[by]
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(by)))
        # place within the old bucket: where this sub-bucket starts, less where the old bucket starts
        old_head = np.ones(len(by), bool)
        old_head[1:] = old[1:] != old[:-1]
        old_start = np.maximum.accumulate(np.where(old_head, np.arange(len(by), dtype=place), 0))
        sub_start = np.repeat(start, size).astype(place)
        pointer[live[by]] = old + sub_start - old_start
        many = np.repeat(size > 1, size)
        live = np.sort(live[by[many]])
        if done >= depth or not len(live):
            return live
        step = min(done, depth - done)
        live = live[room[live] >= done + step]
        first = pointer[live]
        order = first.astype(np.int64) * (n + 1) + pointer[live + step]
        done += step


def hashed_pointers(raw: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Refinement with hashes for ranks: equal pointers at i and j where the depth bytes from there are equal."""
    pointer, done = raw.astype(np.uint64), 1
    while done < depth:
        step = min(done, depth - done)
        n = max(0, len(pointer) - step)
        with np.errstate(over="ignore"):
            if done < 8:
                pointer = (pointer[:n] << np.uint64(8 * done)) | pointer[step:]
            else:
                pointer = mix(pointer[:n] * np.uint64(MULT) + mix(pointer[step:] + np.uint64(done)))
        done += step
    return pointer


def keyed(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(t).alias("k"), F.octet_length(t).alias("n"), t.alias("t")).filter(F.col("n") >= WINDOW)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, s, k, n of segments, and z, which deals them in turn to SALTS parts."""
    seen = 0
    for batch in batches:
        for b in batches_by_bytes(batch, "t", 2 << 20):
            raw, off = string_buffer(b.column(2))
            at, _, a, s = segments(raw, off)
            row = np.searchsorted(off, at, side="right") - 1
            k, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            z = (np.arange(seen, seen + len(a)) % SALTS).astype(np.int8)
            seen += len(a)
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(a)), pa.array(as_signed(s)), pa.array(k[row]), pa.array(n[row]), pa.array(z)], names=["a", "s", "k", "n", "z"])


SAME, MIXED, HOT = 0, 1, 2
FOUND = "kind int, k bigint, n int, at int, size int, a bigint, seg binary, hashes array<bigint>"
FLAGS = 1, 2, 4  # bits: the segment repeats; send its text; its bucket is hot


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows k, n, t, known segments [(hash, flags)] -> spans known, segments to sort, hashes of hot windows."""
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = ["kind", "k", "n", "at", "size", "a", "seg", "hashes"]
    for batch in batches:
        for b in batches_by_bytes(batch, "t", 1 << 20):
            raw, off = string_buffer(b.column(2))
            at, size, a, s = segments(raw, off)
            row = np.searchsorted(off, at, side="right") - 1
            flags = b.column(3)
            known = flags.flatten().field("s").to_numpy(zero_copy_only=False)
            bits = flags.flatten().field("bits").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(flags.offsets)))
            # (row, segment hash) of the answers against those of the segments
            have = mix(known.view(np.uint64) ^ mix(owner.astype(np.uint64)))
            want = mix(s ^ mix(row.astype(np.uint64)))
            if not len(have) or not len(want):
                continue
            by = np.argsort(have)
            have, head = np.unique(have[by], return_index=True)
            bits = np.bitwise_or.reduceat(bits[by], head)
            i = np.minimum(np.searchsorted(have, want), len(have) - 1)
            bit = np.where(have[i] == want, bits[i], 0)
            _, first = np.unique(want, return_index=True)
            once = np.zeros(len(want), bool)
            once[first] = True
            send = once & (bit & FLAGS[1] > 0)
            if not bit.any():
                continue
            # neighbouring segments whose windows all repeat become one span
            same = np.flatnonzero(bit & FLAGS[0])
            joins = np.ones(len(same), bool)
            joins[1:] = (at[same][1:] != (at + size)[same][:-1]) | (row[same][1:] != row[same][:-1])
            start = np.flatnonzero(joins)
            stop = np.append(start[1:], len(same)) - 1 if len(same) else start
            rows = [(SAME, row[same[i]], at[same[i]], at[same[j]] + size[same[j]] - at[same[i]], 0, None, None) for i, j in zip(start, stop, strict=True)]
            for x in np.flatnonzero(send & (bit & FLAGS[2] == 0)):
                rows.append((MIXED, row[x], at[x], size[x], as_signed(a[x : x + 1])[0], raw[at[x] : at[x] + size[x] + WINDOW - 1].tobytes(), None))
            if len(hot := np.flatnonzero(send & (bit & FLAGS[2] > 0))):
                pointer = as_signed(hashed_pointers(raw))
                for x in hot:
                    rows.append((HOT, row[x], at[x], size[x], 0, None, pointer[at[x] : at[x] + size[x]].tolist()))
            if not rows:
                continue
            kd, rw, ps, sz, an, sg, hs = zip(*rows, strict=True)
            rw = np.array(rw)
            k, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((kd, k[rw], n[rw], np.array(ps) - off[rw], sz, an, sg, hs), types, strict=True)], names=names)


def _sorted_blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Blocks of whole anchors from rows sorted by anchor."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        held_bytes += b.nbytes
        a = b.column(0)
        if held_bytes >= limit and a[0] != a[b.num_rows - 1]:
            values = a.to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(values, values[-1]))
            held[-1] = b.slice(0, cut)
            yield pa.Table.from_batches(held)
            held, held_bytes = [b.slice(cut)], 0
    if held:
        yield pa.Table.from_batches(held)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, seg, k, n, at sorted by a -> the runs of repeated windows k, n, at, size."""
    for block in _sorted_blocks(batches, 2 << 20):
        seg = block.column("seg").combine_chunks().dictionary_encode()
        if isinstance(seg, pa.ChunkedArray):
            seg = seg.combine_chunks()
        which = seg.indices.to_numpy(zero_copy_only=False)
        raw, off = string_buffer(seg.dictionary)
        hits = repeated_windows(raw, off)
        again = np.bincount(which, minlength=len(seg.dictionary)) > 1
        flag = np.zeros(len(raw) + 1, bool)
        flag[hits] = True
        for i in np.flatnonzero(again):
            flag[off[i] : off[i + 1] - WINDOW + 1] = True
        step = np.diff(np.concatenate([[0], flag.astype(np.int8)]))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        owner = np.searchsorted(off, begin, side="right") - 1
        # windows end WINDOW - 1 before their segment does, so no run spans two segments
        lo, hi = np.searchsorted(owner, which, side="left"), np.searchsorted(owner, which, side="right")
        times = hi - lo
        src = np.repeat(np.arange(len(which)), times)
        run = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = block.column("at").to_numpy()[src] + begin[run] - off[owner[run]]
        yield pa.RecordBatch.from_arrays([pa.array(block.column("k").to_numpy()[src]), pa.array(block.column("n").to_numpy()[src]), pa.array(at.astype(np.int32)), pa.array((end - begin)[run].astype(np.int32))], names=["k", "n", "at", "size"])


def repeated_spans(docs: DataFrame, text: str = "text", hot: int = 24_000) -> DataFrame:
    """k, n, runs array<struct<at, size>> of repeated windows for each text that has any.

    hot bounds what a task sorts at once: that many segments of about 300 bytes.
    """
    texts = keyed(docs, text)
    req = texts.mapInArrow(_requests, "a bigint, s bigint, k bigint, n int, z tinyint")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<tinyint>")).alias("z")
    with scope(docs.sparkSession) as keep:
        each = settle(req.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "n")).alias("sender")), "segments")
        mixed = each.groupBy("a").agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select("a", "d", every_salt)
        again = req.join(each.filter("c > 1").select("a", "s", every_salt).hint("merge"), ["a", "s", "z"]).select("k", "n", "s", F.lit(FLAGS[0]).alias("bits"))
        sent = each.withColumn("z", F.pmod(F.col("s"), F.lit(SALTS)).cast("tinyint")).join(mixed.hint("merge"), ["a", "z"])
        sent = sent.select("sender.k", "sender.n", "s", (F.lit(FLAGS[1]) + F.when(F.col("d") > hot, FLAGS[2]).otherwise(0)).alias("bits"))
        flags = keep(settle(again.unionByName(sent).groupBy("k", "n").agg(F.collect_set(F.struct("s", "bits")).alias("flags")), "flags"))
    found = settle(texts.join(flags.hint("merge"), ["k", "n"]).select("k", "n", "t", "flags").mapInArrow(_answers, FOUND), "found")
    known = found.filter(F.col("kind") == SAME).select("k", "n", "at", "size")
    mixed = found.filter(F.col("kind") == MIXED).select("a", "seg", "k", "n", "at").repartition("a").sortWithinPartitions("a").mapInArrow(_refine, "k bigint, n int, at int, size int")
    windows = found.filter(F.col("kind") == HOT).select("k", "n", "at", F.posexplode("hashes").alias("i", "h")).select("k", "n", (F.col("at") + F.col("i")).alias("at"), "h")
    twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    crowd = windows.join(twice.hint("merge"), "h").select("k", "n", "at", F.lit(1).alias("size"))
    return known.unionByName(mixed).unionByName(crowd).groupBy("k", "n").agg(F.collect_set(F.struct("at", "size")).alias("runs"))


def merged(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans covered by the windows that start in the runs: disjoint, apart, ascending."""
    by = np.argsort(at, kind="stable")
    start, end = at[by].astype(np.int64), (at + size)[by].astype(np.int64) + WINDOW - 1
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def whole_characters(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each span that is whole UTF-8 characters; spans without any are left out."""
    lead = np.flatnonzero(np.append((doc & 0xC0) != 0x80, True))
    start, end = lead[np.searchsorted(lead, start)], lead[np.searchsorted(lead, end, side="right") - 1]
    return start[end > start], end[end > start]


def remove_repeats(docs: DataFrame, text: str = "text", hot: int = 24_000, columns: list[str] | None = None, whole: bool = False) -> DataFrame:
    """columns of docs (all by default) with spans (removed bytes) and kept (remaining bytes); whole: a character goes only with all its bytes."""
    runs = repeated_spans(docs, text, hot)
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("spans", "kept")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("spans", SPANS), T.StructField("kept", T.BinaryType())])
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("own"), t.alias("t"), F.xxhash64(t).alias("k"), F.octet_length(t).alias("n"))
    joined = rows.join(runs.hint("merge"), ["k", "n"], "left").select("own", "t", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for b in batches_by_bytes(batch, "t", 2 << 20):
                raw, off = string_buffer(b.column(1))
                runs_ = b.column(2)
                spans, kept = [], []
                for i in range(b.num_rows):
                    doc = raw[off[i] : off[i + 1]]
                    r = runs_[i]
                    if not r.is_valid:
                        spans.append([])
                        kept.append(doc.tobytes())
                        continue
                    v = r.values
                    s, e = merged(v.field("at").to_numpy(zero_copy_only=False), v.field("size").to_numpy(zero_copy_only=False))
                    if whole:
                        s, e = whole_characters(doc, s, e)
                    spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    edges = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(doc)]])
                    kept.append(b"".join(doc[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
                own = b.column(0)
                yield pa.RecordBatch.from_arrays([own.field(j) for j in range(len(names))] + [pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], names=[*names, "spans", "kept"])

    return joined.mapInArrow(run, schema)


#: The result of op1_suffix_dedup over all windows, for DuckDB.
ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT id, b, unnest(range(0, octet_length(b) - 199)) AS p FROM docs WHERE octet_length(b) >= 200),
windows AS (SELECT id, p, md5(hex(b[p + 1 : p + 200])) AS h FROM places),
hits AS (SELECT id, p FROM (SELECT id, p, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1),
runs AS (SELECT id, p, sum(fresh) OVER (PARTITION BY id ORDER BY p) AS g FROM (SELECT id, p, CASE WHEN p > lag(p) OVER (PARTITION BY id ORDER BY p) + 200 THEN 1 ELSE 0 END AS fresh FROM hits)),
spans AS (SELECT id, min(p) AS s, max(p) + 200 AS e FROM runs GROUP BY id, g),
pieces AS (SELECT id, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS x, s AS y FROM spans UNION ALL SELECT id, max(e), max(octet_length(b)) FROM spans JOIN docs USING (id) GROUP BY id),
kept AS (SELECT id, string_agg(hex(b[x + 1 : y]), '' ORDER BY x) AS k FROM pieces JOIN docs USING (id) WHERE y > x GROUP BY id),
total AS (SELECT id, sum(e - s) AS r, count(*) AS n FROM spans GROUP BY id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n IS NULL THEN b ELSE unhex(coalesce(k, '')) END) AS kept_sha256
FROM docs LEFT JOIN total USING (id) LEFT JOIN kept USING (id)
"""


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), "text", columns=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return out.select("doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
