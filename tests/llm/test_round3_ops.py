"""Fill-in-middle, SentencePiece by backtracking and importance resampling against brute force."""

import hashlib
import math
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from treeflow.llm import fim, piece_bpe, resample

SCHEMA = "doc_id bigint, text string, n bigint, form string, rank string, ids string, row bigint, unit int"
TEXTS = ["", None, "one", "Don't panic: 42 é漢🎉 tabs\tand\r\nlines", "a <M> b", "<S", "x" * 40_000, "ab " * 9_000, "é" * 100, " ", "same", "same"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, "f", "r", "z", 1, 2) for i, t in rows], SCHEMA)


def fim_brute(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 7, 16_384])
def test_fill_in_middle(spark, chunk):
    rng = random.Random(chunk)
    made = ["".join(rng.choice("ab1 é\n<P>M") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts = (TEXTS if chunk > 1 else [t for t in TEXTS if t is None or len(t) < 1000]) + made
    rows = [*enumerate(texts), (None, "no id here"), (None, "no id here"), (3, TEXTS[3])]
    out = fim.transform(table(spark, rows), plan=fim.Plan(chunk=chunk, partition_bytes=50_000))
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = [(i, *fim_brute(i, t), t or "") for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_an_empty_table(spark):
    assert fim.transform(table(spark, [])).collect() == []


@pytest.fixture(scope="module")
def library():
    public_tokenizers = pytest.importorskip("public_tokenizers", reason="needs the vocabulary files")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_the_library(spark, library):
    path, lib = library
    rng = random.Random(5)
    letters = "ab c▁\n\té漢🎉0123 eratin\0̀.,'"
    texts = [*TEXTS, "▁▁ ▁", "\n", " " * 33 + "x", "inging" * 30, "ﷺ﻿�", *("".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(400)), *("".join(rng.choice("etaoin") for _ in range(2000)) for _ in range(3))]
    rows = [*enumerate(texts), (None, "no id"), (3, TEXTS[3])]
    out = piece_bpe.encode_decode(table(spark, rows), keys=["doc_id"], path=path).collect()
    want = [(i, lib.encode(t or "", add_eos=True)) for i, t in rows]
    assert [(r["doc_id"], r["ids"]) for r in out] == want
    assert [bytes(r["decoded"]).decode() for r in out] == [lib.decode(w) for _, w in want]
    assert piece_bpe.encode_decode(table(spark, []), path=path, keys=["doc_id"]).collect() == []


def test_decoding_any_ids_and_small_caches(library):
    path, lib = library
    rng = random.Random(6)
    model = piece_bpe.PieceModel(path)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == lib.decode(ids), ids
    coder = piece_bpe.BacktrackingCoder(path, cache_chars=50, cache_pairs=10)
    for _ in range(50):
        t = "".join(rng.choice("the in at er\n1") for _ in range(80))
        ids, *_ = coder.rows([t])
        assert ids.tolist() == lib.encode(t)
    assert len(coder.pairs) <= 10


def test_backtracking_takes_back_tokens(library):
    """Longest matches alone are not the encoding; a failed position is not tried twice."""
    coder = piece_bpe.BacktrackingCoder(library[0])
    text = "▁" + "aaab" * 5000 + "a" * 4999
    longest = coder.longest(text)
    tokens = coder.tokens(longest, 0, len(text))
    assert "".join(tokens) == text and [coder.model.ids[t] for t in tokens] == library[1].encode(text[1:])
    assert tokens[1] != longest[1] or any(longest[sum(map(len, tokens[:k]))] != tokens[k] for k in range(len(tokens)))


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def grams(text, n):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resample_brute(rows, target, n, min_words, percent, buckets):
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for g in grams(x, n):
                side[g % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[g % buckets] for g in grams(x, n))
        out.append([i, len(words_of(x)), len(grams(x, n)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], sys.maxsize if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling(spark, n):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choice("abcé7Z") for _ in range(rng.choice([1, 4, 31, 32, 33, 65, 300]))) for _ in range(40)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(150)]
    rows = [*enumerate([*TEXTS, *made]), (None, made[0]), (None, made[0]), (20, made[8])]
    target = [None, "", *made[:20]]
    draw = resample.Draw(max_n=n, buckets=101, min_words=3, percent=30)
    out = resample.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), draw=draw)
    assert sorted(map(repr, map(tuple, out.collect()))) == resample_brute(rows, target, n, 3, 30, 101)


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(table(spark, []), none).collect() == []
    got = resample.resample(table(spark, [(1, "a b")]), none, draw=resample.Draw(min_words=1, percent=100)).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(2, 1)]


def test_a_draw_of_equal_scores(spark):
    """Rows that the order leaves equal still get ranks of their own, over several range partitions."""
    rows = [(5, "same words here")] * 300
    spark_rows = table(spark, rows).repartition(4)
    got = resample.resample(spark_rows, spark.createDataFrame([("x",)], "text string"), draw=resample.Draw(min_words=1, percent=50)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151))
