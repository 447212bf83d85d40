"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Each task opens one in-process DuckDB with the merge table (left id, right id,
merged id = rank).  The distinct pre-token pieces of a slice of rows become
token-position rows; the recursive query joins neighbours to the merge table and
contracts every word's leftmost pair of minimum rank until no pair is left.
Decoding is an ordered aggregation of the vocabulary's bytes.

No token crosses a byte pair that occurs inside no token, so a piece is first cut
there.  Parts of over ``SEGMENT`` bytes are contracted by segments of that size, all in
one query, and joined: a sequence of tokens is the encoding of its text where each two
neighbours are that of theirs (contracting their bytes gives the two again).  Where the
tokens beside a border are not, the bytes of some tokens on both sides are contracted
anew, of more until both edges of the stretch fit.  So no query holds more than short
words, whatever the length of a part.  DuckDB works in memory (``memory_mb``) and writes
no files.

Defined results: a null or empty text has no ids and decodes to nothing; rows
are independent, so repeated rows get equal results; the output has the key
columns asked for, ``ids`` and ``decoded``; an empty table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_by_bytes, string_buffer, table

ENCODE = """
WITH RECURSIVE step(w, toks) AS (
    SELECT w, toks FROM start
  UNION ALL
    SELECT s.w, s.toks[1 : (b.best & 1048575) - 1] || [CAST(b.best >> 20 AS INTEGER)] || s.toks[(b.best & 1048575) + 2 :]
    FROM step s JOIN (
        SELECT p.w, min((CAST(g.merged AS BIGINT) << 20) | p.pos) AS best
        FROM (
            SELECT w, unnest(toks[1 : len(toks) - 1]) AS l, unnest(toks[2 :]) AS r, unnest(range(1, len(toks))) AS pos FROM step
        ) p JOIN merges g ON g.pair = (CAST(p.l AS BIGINT) << 32) | p.r
        GROUP BY p.w
    ) b ON b.w = s.w
)
SELECT w, arg_min(toks, len(toks)) AS ids FROM step GROUP BY w
"""
#: Bytes of a segment, and tokens taken from each side of a border at first.
SEGMENT = 128
BESIDE = 8
DECODE = "SELECT u.w, string_agg(v.hex, '' ORDER BY u.pos) AS hex FROM (SELECT w, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM coded) u JOIN vocab v ON v.id = u.tok GROUP BY u.w ORDER BY u.w"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class DuckBpe:
    """Piece coder of one task; the piece cache is bounded and only saves work."""

    def __init__(self, path: str, pattern: str, cache_pieces: int = 400_000, memory_mb: int = 600, cache_chars: int = 16_000_000, segment: int = SEGMENT, beside: int = BESIDE):
        self.segment, self.beside = segment, beside
        self.load(load_ranks(path), pattern, cache_pieces, memory_mb, cache_chars)

    def load(self, ranks: dict[bytes, int], pattern: str, cache_pieces: int, memory_mb: int, cache_chars: int) -> None:
        import duckdb
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.cache_pieces, self.cache_chars = cache_pieces, cache_chars
        self.token = {r: k for k, r in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stretches: dict[bytes, list[int]] = {}
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": ""})
        ids = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con.register("v0", pa.table({"id": ids, "hex": [k.hex() for k in self.ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v0")
        left, right, to = [], [], []
        self.inside = np.zeros((256, 256), bool)
        for tok, r in self.ranks.items():
            for i in range(1, len(tok)):
                self.inside[tok[i - 1], tok[i]] = True
                a, b = self.ranks.get(tok[:i]), self.ranks.get(tok[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(r)
        self.con.register("m0", pa.table({"pair": pa.array(np.array(left, np.int64) << 32 | np.array(right, np.int64)), "merged": pa.array(to, pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m0")
        self.con.unregister("m0"), self.con.unregister("v0")
        self.forget()

    def forget(self) -> None:
        """Known pieces: number by text, and per number the bounds of its ids and of its bytes."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.id_at, self.byte_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def cut(self, piece: bytes) -> list[bytes]:
        if len(piece) <= 24:
            return [piece]
        raw = np.frombuffer(piece, np.uint8)
        at = [0, *(np.flatnonzero(~self.inside[raw[:-1], raw[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(at, at[1:], strict=False)]

    def contract(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after the other, and the number of ids of each part."""
        long = [i for i, p in enumerate(parts) if len(p) > self.segment]
        if not long:
            return self.contract_short(parts)
        short = [i for i, p in enumerate(parts) if len(p) <= self.segment]
        ids, count = self.contract_short([parts[i] for i in short])
        each: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        for i, x in zip(short, np.split(ids, np.cumsum(count)[:-1]) if short else [], strict=True):
            each[i] = x
        for i in long:
            each[i] = self.contract_long(parts[i])
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def contract_short(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        start = np.cumsum(size) - size
        count, found = np.zeros(len(parts), np.int64), []
        work = np.cumsum(size**2)  # intermediate lists of a word fill at most half its squared length
        at = 0
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 20_000_000, side="right")))
            w = np.arange(at, to)
            tok = self.byte_id[raw[_ranges(start[w], size[w])]]
            bounds = np.concatenate([[0], np.cumsum(size[w])]).astype(np.int32)
            got = self.ask(ENCODE, "start", {"w": pa.array(w.astype(np.int32)), "toks": pa.ListArray.from_arrays(pa.array(bounds), pa.array(tok))})
            ids = got.column("ids").combine_chunks()
            who = got.column("w").to_numpy()
            count[who] = np.diff(ids.offsets.to_numpy())
            found.append((who, ids.flatten().to_numpy()))
            at = to
        out = np.zeros(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        for who, ids in found:
            out[_ranges(first[who], count[who])] = ids
        return out, count

    def contract_long(self, part: bytes) -> np.ndarray:
        """The ids of a part of any length, by segments."""
        if len(self.pairs) + len(self.stretches) > 300_000:
            self.pairs, self.stretches = {}, {}
        segments = [part[i : i + self.segment] for i in range(0, len(part), self.segment)]
        known = self.many(set(segments))
        blocks = [known[x] for x in segments]
        # what the borders need is asked for in three queries; the pass below finds it known, but where stretches grow
        self.fit({(a[-1], b[0]) for a, b in zip(blocks, blocks[1:])})
        bad = [(a, b) for a, b in zip(blocks, blocks[1:]) if not self.pairs[a[-1], b[0]]]
        self.stretches |= self.many({self.bytes_of([*a[-self.beside:], *b[:self.beside]]) for a, b in bad} - self.stretches.keys())
        edges = set()
        for a, b in bad:
            new = self.stretches[self.bytes_of([*a[-self.beside:], *b[:self.beside]])]
            if len(a) > self.beside:
                edges.add((a[-self.beside - 1], new[0]))
            if len(b) > self.beside:
                edges.add((new[-1], b[self.beside]))
        self.fit(edges)
        out = list(blocks[0])
        for b in blocks[1:]:
            left = right = self.beside
            if self.fits(out[-1], b[0]):
                out += b
                continue
            while True:
                text = self.bytes_of([*out[-left:], *b[:right]])
                new = self.stretches.get(text)
                if new is None:
                    new = self.stretches[text] = self.many({text})[text]
                grow_left = len(out) > left and not self.fits(out[-left - 1], new[0])
                grow_right = len(b) > right and not self.fits(new[-1], b[right])
                if not grow_left and not grow_right:
                    break
                left, right = left * (1 + grow_left), right * (1 + grow_right)
            out[-left:] = new
            out += b[right:]
        return np.array(out, np.int32)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def many(self, texts: set[bytes]) -> dict[bytes, list[int]]:
        names = sorted(texts)
        if not names:
            return {}
        ids, count = self.contract_short(names)
        return {n: x.tolist() for n, x in zip(names, np.split(ids, np.cumsum(count)[:-1]), strict=True)}

    def fit(self, pairs: set[tuple[int, int]]) -> None:
        """Finds out of pairs of ids whether contracting their bytes gives them again."""
        new = [p for p in pairs if p not in self.pairs]
        got = self.many({self.bytes_of(p) for p in new})
        self.pairs |= {p: got[self.bytes_of(p)] == list(p) for p in new}

    def fits(self, a: int, b: int) -> bool:
        if (a, b) not in self.pairs:
            self.fit({(a, b)})
        return self.pairs[a, b]

    def ask(self, query: str, name: str, columns: dict[str, pa.Array]) -> pa.Table:
        self.con.register(name, pa.table(columns))
        got = self.con.sql(query).to_arrow_table()
        self.con.unregister(name)
        return got

    def learn(self, pieces: set[str]) -> None:
        """Encode and decode pieces that are not known."""
        names = sorted(pieces)
        raws = [p.encode("utf-8", "surrogatepass") for p in names]
        whole = np.fromiter((self.ranks.get(r, -1) for r in raws), np.int64, len(raws))
        parts, owner = [], []
        for i in np.flatnonzero(whole < 0).tolist():
            cut = self.cut(raws[i])
            parts += cut
            owner += [i] * len(cut)
        flat, count = self.contract(parts)
        size = np.where(whole < 0, np.bincount(owner, weights=count, minlength=len(names)).astype(np.int64) if owner else 0, 1)
        ids = np.repeat(whole, size).astype(np.int32)
        ids[np.repeat(whole < 0, size)] = flat  # parts stand in the order of their pieces
        decoded, length = self.decode(ids, size)
        self.chars += sum(map(len, names))
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, decoded])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(size)])
        self.byte_at = np.concatenate([self.byte_at, self.byte_at[-1] + np.cumsum(length)])

    def decode(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of ids, one after the other, and the number of bytes of each run (size: its ids, one at least)."""
        pieces, most = size, 100_000
        if len(size) and int(size.max()) > most:  # the ids of a long run are decoded a stretch at a time
            size = np.concatenate([np.minimum(most, n - np.arange(0, n, most)) for n in size.tolist()])
        bounds = np.concatenate([[0], np.cumsum(size)])
        raw, length = [], []
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 400_000, side="right")) - 1)
            lists = pa.ListArray.from_arrays(pa.array((bounds[at : to + 1] - bounds[at]).astype(np.int32)), pa.array(ids[bounds[at] : bounds[to]]))
            text = self.ask(DECODE, "coded", {"w": pa.array(np.arange(at, to, dtype=np.int32)), "ids": lists}).column("hex")
            length.append(pc.binary_length(text).to_numpy().astype(np.int64) // 2)
            raw += [np.frombuffer(bytes.fromhex(string_buffer(c)[0].tobytes().decode()), np.uint8) for c in text.chunks]
            at = to
        flat = np.concatenate([np.zeros(0, np.int64), *length])
        if pieces is not size:
            flat = np.add.reduceat(flat, np.searchsorted(bounds, np.cumsum(pieces) - pieces))
        return np.concatenate([np.zeros(0, np.uint8), *raw]), flat

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, id bounds, decoded bytes and byte bounds of the texts."""
        split = [self.find(t) if t else [] for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        flat = list(chain.from_iterable(split))
        number = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            new = {flat[i] for i in missing}
            if len(self.known) + len(new) > self.cache_pieces or self.chars > self.cache_chars:
                self.forget()
                new, missing = set(flat), range(len(flat))
            self.learn(new)
            number[missing] = [self.known[flat[i]] for i in missing]
        return *_gather(self.ids, self.id_at, number, bounds), *_gather(self.bytes, self.byte_at, number, bounds)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + size[0] - 1, start[1], ..."""
    reach = np.cumsum(size)
    return np.repeat(start - reach + size, size) + np.arange(reach[-1] if len(reach) else 0)


def _gather(flat: np.ndarray, at: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[i]:at[i+1]] of each i in number, one after the other, and the rows' bounds in them."""
    size = at[number + 1] - at[number]
    return flat[_ranges(at[number], size)], np.concatenate([[0], np.cumsum(size)])[bounds]


_CODERS: dict[tuple, DuckBpe] = {}


def encode_decode(docs: DataFrame, text: str = "text", keys: list[str] | None = None, path: str | None = None, pattern: str | None = None, slice_bytes: int = 2 << 20) -> DataFrame:
    """keys, ids array<int>, decoded binary; narrow, so it shuffles nothing."""
    names = docs.columns if keys is None else keys
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        key = (path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        coder = _CODERS.get(key) or _CODERS.setdefault(key, DuckBpe(*key))
        for batch in batches:
            for b in batches_by_bytes(batch, "__text", slice_bytes):
                ids, at, raw, end = coder.rows(b.column(len(names)).to_pylist())
                coded = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                decoded = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(end.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [coded, decoded], names=[*names, "ids", "decoded"])

    return source.mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents"), "text", ["doc_id"]))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
