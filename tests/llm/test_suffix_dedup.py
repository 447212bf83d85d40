"""Exact substring dedup against brute force."""

import random

import numpy as np

from treeflow.llm import suffix_dedup as sd


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for i in range(len(r) - sd.WINDOW + 1):
            w = r[i : i + sd.WINDOW]
            count[w] = count.get(w, 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - sd.WINDOW + 1):
            if count[r[i : i + sd.WINDOW]] > 1:
                gone[i : i + sd.WINDOW] = True
        out.append(bytes(np.frombuffer(r, np.uint8)[~gone]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    syl = ["an", "th", "or", "é", "ti", "on ", "es", "wh", " ", "ou", "\n"]
    word = lambda n: "".join(rng.choice(syl) for _ in range(n))
    shared, base = word(300), word(500)
    texts = [None, "", "short", "x" * 1000, "ab" * 400, "x" * 199, "x" * 200]
    texts += [word(rng.randrange(10, 200)) + shared + word(rng.randrange(0, 200)) for _ in range(12)]
    texts += [word(50) + shared[rng.randrange(0, 150) : rng.randrange(200, 600)] + word(9) for _ in range(12)]
    texts += [base, base, base[:300] + "Q" + base[301:], base[100:] + base[:250], base + base]
    for _ in range(6):
        k = rng.randrange(len(base))
        texts.append(base[:k] + word(2) + base[k + 3 :])
    return texts


def test_windows_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        rows = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        depth = rng.choice([3, 8, 11, 16, 20])
        raw = np.frombuffer(b"".join(rows), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        grams = {}
        for r, o in zip(rows, off, strict=False):
            for i in range(len(r) - depth + 1):
                grams.setdefault(r[i : i + depth], []).append(int(o) + i)
        want = sorted(i for v in grams.values() if len(v) > 1 for i in v)
        assert sd.repeated_windows(raw, off, depth).tolist() == want


def test_hashed_pointers_are_equal_where_bytes_are():
    rng = random.Random(5)
    for depth in (3, 8, 11, 16, 24, 200):
        raw = bytes(rng.choice(b"ab") for _ in range(700)) + b"a" * 300
        p = sd.hashed_pointers(np.frombuffer(raw, np.uint8), depth)
        assert len(p) == len(raw) - depth + 1
        by = {}
        for i, x in enumerate(p.tolist()):
            assert by.setdefault(raw[i : i + depth], x) == x
        assert len(set(by.values())) == len(by)
    assert len(sd.hashed_pointers(np.zeros(5, np.uint8), 200)) == 0


def check(spark, texts, hot):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string").repartition(3)
    got = {r.doc_id: bytes(r.kept) for r in sd.remove_repeats(df, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_removal_brute_force(spark):
    check(spark, corpus(1), 24_000)


def test_hot_buckets(spark):
    check(spark, corpus(2), 3)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sd.remove_repeats(df).count() == 0
