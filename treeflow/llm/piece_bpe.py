"""SentencePiece (BPE type) encoding and decoding by backtracking.

Merging by score, leftmost first among equals, gives the one sequence of tokens that
covers a text and whose neighbours are all compatible: merging the text of two
neighbours again gives these two.  So a text is encoded from the left: the longest
token at a position (Aho-Corasick over the reversed vocabulary, one pass a batch), or
the next shorter one, that is compatible with the token before; where none is left,
the position is marked in a bitfield as failed and the token before it is taken back.
The tokens up to a position are the encoding of that prefix, so a position is failed
whatever stands before it, and none is tried twice: time is linear in the text, and
memory a few integers a character of one part.

Texts are cut first where no token can cross: before a run of spaces, and inside long
stretches between characters that are neighbours in no token.  Distinct parts are
encoded once while a cache of bounded characters holds them.  Characters that are no
token become their bytes' tokens.

Defined results: a null or empty text has the end id alone and decodes to nothing;
rows are independent, so repeated rows get equal results; the output has the key
columns asked for, ``ids`` and ``decoded``; an empty table gives none.  U+2581 in a
text is a space to the model, and decodes to one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _gather
from .common import batches_by_bytes, table

SPACE = "▁"
#: Between the parts of a batch while they are searched together; no token holds it.
BORDER = "\n"


class PieceModel:
    """The vocabulary of a model file: pieces with scores, byte ids, the end id."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or any(t.type in (4, 5) for t in model.pieces):
            raise ValueError(f"{path}: not a BPE model with byte pieces, identity normalisation and no user-defined pieces")
        #: A space is put before every text that isn't empty, and taken off when decoding.
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.unknown = {p.unk_id(): train.unk_surface}
        self.end = p.eos_id()
        self.ids = {p.id_to_piece(i): i for i in range(n) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i))}
        self.score = {t: p.get_score(i) for t, i in self.ids.items()}
        byte = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        if len(byte) != 256:
            raise ValueError(f"{path}: the model has no byte pieces")
        self.byte_ids = [byte[b] for b in range(256)]
        self.value = {i: b for b, i in byte.items()}
        self.surface = {i: t.replace(SPACE, " ") for t, i in self.ids.items()}
        if any(BORDER in t for t in self.ids):
            raise ValueError(f"{path}: tokens with line feeds")
        #: What each id adds to a text whose runs of byte ids are whole characters.
        parts = [self.surface.get(i, "").encode("utf-8") if i not in self.value else bytes([self.value[i]]) for i in range(n)]
        self.raw, self.raw_at = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        self.neighbours = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        self.space_first = not any(b == SPACE != a for a, b in self.neighbours)

    def together(self, char: str) -> set[str]:
        """The characters that tokens link to char through neighbours, spaces apart: no token crosses the set's border."""
        found, left = {char}, [char]
        links: dict[str, set[str]] = {}
        for a, b in self.neighbours:
            if SPACE not in (a, b):
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
        while left:
            new = links.get(left.pop(), set()) - found
            found |= new
            left.extend(new)
        return found

    def remerge(self, text: str) -> list[str]:
        """The tokens of a short text: merges the best scored pair, leftmost first among equals, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def decode(self, ids: list[int]) -> str:
        """Surfaces of the ids without the prefix; runs of byte ids as UTF-8, U+FFFD for each byte of no character."""
        text = self.surfaces(ids)
        first = next((i for i in ids if i in self.surface or i in self.value or i in self.unknown), None)
        return text[1:] if self.prefix and self.surface.get(first, "").startswith(" ") else text

    def surfaces(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, -1]:
            b = self.value.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_characters(bytes(run)))
                run = bytearray()
            out.append(self.surface.get(i) or self.unknown.get(i, ""))
        return "".join(out)


def _characters(raw: bytes) -> str:
    out = []
    while raw:
        try:
            return "".join(out) + raw.decode()
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode())
            out.append("�")
            raw = raw[e.start + 1 :]
    return "".join(out)


class BacktrackingCoder:
    """Encoder of one task; both caches are bounded and only save work."""

    def __init__(self, path: str, cache_chars: int = 8_000_000, cache_pairs: int = 500_000):
        import ahocorasick

        self.model = PieceModel(path)
        self.cache_chars, self.cache_pairs = cache_chars, cache_pairs
        self.backwards = ahocorasick.Automaton()
        for t in self.model.ids:
            self.backwards.add_word(t[::-1], t)
        self.backwards.make_automaton()
        self.shorter: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        letters = "".join(map(re.escape, sorted(self.model.together("a"))))
        self.find = re.compile(f"{SPACE}*[{letters}]+|{SPACE}*[^{letters}{SPACE}\n]+|{SPACE}+|\n+" if self.model.space_first and SPACE not in self.model.together("a") else "(?s).+").findall
        self.forget()

    def forget(self) -> None:
        """Known parts: number by text, and per number the bounds of its ids and of its bytes."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.id_at, self.byte_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def next_shorter(self, token: str) -> str | None:
        """The longest token that is a proper prefix; a character always counts as one."""
        if len(token) == 1:
            return None
        if token not in self.shorter:
            ids = self.model.ids
            self.shorter[token] = next(token[:k] for k in range(len(token) - 1, 0, -1) if k == 1 or token[:k] in ids)
        return self.shorter[token]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the text of both again gives both ('' on the left: whether it gives the right one)."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.cache_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self.model.remerge(left + right) == ([left, right] if left else [right])
        return known

    def longest(self, text: str) -> list[str]:
        """The longest token at each position, or the character itself; at the end of a match the automaton gives the longest first."""
        out, n = list(text), len(text) - 1
        for end, token in dict(reversed(list(self.backwards.iter(text[::-1])))).items():
            out[n - end] = token
        return out

    def tokens(self, longest: list[str], at: int, stop: int) -> list[str]:
        """The tokens of the text from at to stop."""
        first, known = at, self.pairs.get
        failed = bytearray(((stop - at) >> 3) + 1)
        out: list[str] = []
        before, token = "", longest[at]
        while True:
            while token is not None:
                end = at + len(token)
                if not failed[(end - first) >> 3] & (1 << ((end - first) & 7)):
                    ok = known((before, token))
                    if ok or (ok is None and self.compatible(before, token)):
                        break
                token = self.next_shorter(token)
            if token is not None:
                out.append(token)
                if end == stop:
                    return out
                at, before, token = end, token, longest[end]
            else:  # every token here is at odds with the one before, which is taken back
                failed[(at - first) >> 3] |= 1 << ((at - first) & 7)
                token = out.pop()
                at -= len(token)
                before, token = out[-1] if out else "", self.next_shorter(token)

    def cut(self, part: str) -> list[str]:
        """The part, cut between characters that are neighbours in no token where it is long."""
        if len(part) <= 24:
            return [part]
        inside = self.model.neighbours
        at = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in inside), len(part)]
        return [part[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, parts: list[str]) -> None:
        """Encodes and decodes parts that are not known."""
        ids_of, byte_ids = self.model.ids, self.model.byte_ids
        flat, size, at = [], [], 0
        cuts = [self.cut(p) for p in parts]
        longest = self.longest(BORDER.join(chain.from_iterable(cuts)))
        for pieces in cuts:
            n = len(flat)
            for piece in pieces:
                end = at + len(piece)
                tokens = self.tokens(longest, at, end)
                ids = list(map(ids_of.get, tokens))
                if None in ids:
                    ids = list(chain.from_iterable([i] if i is not None else [byte_ids[b] for b in t.encode("utf-8", "surrogatepass")] for i, t in zip(ids, tokens, strict=True)))
                flat += ids
                at = end + 1
            size.append(len(flat) - n)
        count = np.array(size, np.int64)
        ids = np.array(flat, np.int32)
        raw, byte_at = _gather(self.model.raw, self.model.raw_at, ids, np.concatenate([[0], np.cumsum(count)]))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.chars += sum(map(len, parts))
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, raw])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(count)])
        self.byte_at = np.concatenate([self.byte_at, self.byte_at[-1] + byte_at[1:]])

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids (without an end), id bounds, decoded bytes and byte bounds of the texts."""
        prefix = self.model.prefix
        split = [self.find(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        flat = list(chain.from_iterable(split))
        if self.chars > self.cache_chars:
            self.forget()
        number = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(number < 0).tolist()
        if missing:
            self.learn(sorted({flat[i] for i in missing}))
            number[missing] = [self.known[flat[i]] for i in missing]
        raw, at = _gather(self.bytes, self.byte_at, number, bounds)
        if prefix:  # its space is the first byte of every text that isn't empty
            some = np.diff(at) > 0
            raw = np.delete(raw, at[:-1][some])
            at = at - np.concatenate([[0], np.cumsum(some)])
        return *_gather(self.ids, self.id_at, number, bounds), raw, at


_CODERS: dict[str, BacktrackingCoder] = {}


def encode_decode(docs: DataFrame, text: str = "text", keys: list[str] | None = None, path: str | None = None, end: bool = True, slice_bytes: int = 1 << 20) -> DataFrame:
    """keys, ids array<int> (with the end id, if so wanted), decoded binary; narrow, so it shuffles nothing."""
    names = docs.columns if keys is None else keys
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        key = path or public_tokenizers.path("piece_bpe_32k.model")
        coder = _CODERS.get(key) or _CODERS.setdefault(key, BacktrackingCoder(key))
        for batch in batches:
            for b in batches_by_bytes(batch, "__text", slice_bytes):
                ids, at, raw, byte_at = coder.rows(b.column(len(names)).to_pylist())
                if end:
                    ids = np.insert(ids, at[1:], coder.model.end)
                    at = at + np.arange(len(at))
                coded = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                decoded = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(byte_at.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [coded, decoded], names=[*names, "ids", "decoded"])

    return source.mapInArrow(run, schema)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
