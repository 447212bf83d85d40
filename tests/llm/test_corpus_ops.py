"""LM scoring and decontamination against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from treeflow.llm import decontaminate as dc
from treeflow.llm import lm
from treeflow.llm.common import F


def vocab(rng, n=400):
    return ["".join(rng.choice(["An", "th", "or", "é", "ti", "on", "es"]) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def test_lm_counts_and_scores(spark):
    rng = random.Random(6)
    words = vocab(rng, 60)
    texts = [None, "", "\x0b one\tTWO two"]
    for _ in range(60):
        k = [rng.randrange(60)]
        for _ in range(rng.randrange(1, 80)):
            k.append((7 * k[-1] + rng.randrange(3)) % 60)
        texts.append(" ".join(words[j] for j in k))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = sorted(lm.score(df, held, group_bytes=2000).collect(), key=lambda r: r.doc_id)
    toks = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    uni, bi = Counter(), Counter()
    for i, _ in rows:
        if not out[i]:
            uni.update(toks[i])
            bi.update(zip(["<s>", *toks[i]], toks[i], strict=False))
    n, v = sum(uni.values()), len(uni)
    for r in got:
        t = toks[r.doc_id]
        assert r.held_out == out[r.doc_id] and r.n_tokens == len(t) and r.train_tokens == n
        assert r.n_known == sum(uni[x] > 0 for x in t)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    # weights by EM over the exact deleted counts agree with the histogram's to its resolution
    lam = np.tile([1 / 3] * 3, (66, 1))
    lam[0] = [0, 0.5, 0.5]
    seen = []
    for i, _ in rows:
        if not out[i]:
            for a, b in zip(["<s>", *toks[i]], toks[i], strict=False):
                c = uni[a] if a != "<s>" else uni["</s>"]
                seen.append((int(lm.bucket_of(np.array([c - 1]))[0]), (bi[a, b] - 1) / (c - 1) if c > 1 else 0, (uni[b] - 1) / (n - 1), 1 / (v + 1)))
    k, p = np.array([s[0] for s in seen]), np.array([s[1:] for s in seen])
    for _ in range(40):
        part = lam[k] * p
        part /= part.sum(axis=1, keepdims=True)
        new = np.full_like(lam, 1e-3)
        np.add.at(new, k, part)
        new[0, 0] = 0
        have = np.bincount(k, minlength=66) > 0
        lam[have] = (new / new.sum(axis=1, keepdims=True))[have]
    for r in got:
        t, s = toks[r.doc_id], 0.0
        for a, b in zip(["<s>", *t], t, strict=False):
            c = uni[a] if a != "<s>" else uni["</s>"]
            w = lam[int(lm.bucket_of(np.array([c]))[0])]
            s += math.log10(w[0] * bi[a, b] / max(c, 1) + w[1] * uni[b] / n + w[2] / (v + 1))
        if r.doc_id > 2:
            assert abs(r.score - s) < 0.02 * abs(s) + 0.05
    better = sum(r.score > r.base_score for r in got if r.held_out)
    assert better >= sum(r.held_out for r in got) * 0.7


def test_words_that_collide_as_polynomials():
    """Thue-Morse words of opposite sign are equal for every polynomial modulo 2**64."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    u = t.translate(str.maketrans("ab", "ba"))
    w, _, _ = lm.tokens(lm.pa.array([f"{t} {u} {t}"]))
    assert w[0] == w[2] != w[1]


def test_lm_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(df, F.lit(False)).count() == 0
    one = lm.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), F.lit(True)).first()
    assert one.n_known == 0 and one.train_tokens == 0 and math.isfinite(one.score)


def brute(doc, item):
    """Greatest similarity of an item-sized window and its place, over the words themselves."""
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    w, m = lower(doc), lower(item)
    if not w or not m:
        return (0.0, -1)
    if len(m) < 5:
        at = next((i for i in range(len(w) - len(m) + 1) if w[i : i + len(m)] == m), None)
        return (0.0, -1) if at is None else (1.0, -at)
    if len(w) < 5:
        return (0.0, -1)
    sh = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    a, best = sh(m), (0.0, -1)
    for s in range(max(1, len(w) - len(m) + 1)):
        b = sh(w[s : s + len(m)])
        least = sum((a & b).values())
        best = max(best, (least / (a.total() + b.total() - least), -s))
    return best


def test_decontamination_brute_force(spark):
    rng = random.Random(8)
    words = vocab(rng)
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(0, None), (1, ""), (2, "two words"), (12, "Alone"), (13, "w w w w w w"), (14, " ".join(pick(5)))] + [(i, " ".join(pick(rng.randrange(12, 40)))) for i in range(3, 12)]
    docs = [(0, None), (1, ""), (2, "x two WORDS y two words"), (3, "w " * 30), (100, "alone"), (101, "two"), (102, "so ALONE here"), (103, items[5][1] + " end")]
    for i in range(4, 60):
        body = pick(rng.randrange(5, 120))
        if i % 2:
            p = dict(items)[rng.randrange(3, 12)].split()
            for _ in range(rng.randrange(0, 3)):
                p[rng.randrange(len(p))] = rng.choice(words)
            k = rng.randrange(len(body))
            body[k:k] = [p[0].upper(), *p[1:]]
        docs.append((i, " ".join(body)))
    docs += [(98, "Two\twords"), (99, dict(items)[5])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in dc.find(df, it, block_bytes=1500).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            sim, s = brute(t, x)
            if sim >= 0.8:
                want[d, i] = (sim, -s)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    assert {(2, 2), (98, 2), (100, 12), (102, 12), (3, 13)} <= set(want)
    kept = dc.clean(df, it)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert dc.find(none, items).count() == 0
    assert dc.find(spark.createDataFrame([(1, "a b c d e f")], none.schema), items.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius(monkeypatch):
    """Many items of one length, probed in chunks, against all distances."""
    monkeypatch.setattr(dc, "PAIRS", 1000)
    rng = np.random.default_rng(4)
    for radius in (0, 7, 15, 21):
        g = dc.Group(9, list(range(300)))
        g.prints = list(rng.integers(0, 256, (300, 8), dtype=np.uint8))
        g.index(radius)
        windows = rng.integers(0, 256, (120, 8), dtype=np.uint8)
        windows[:40] = g.prints[:40]
        for i in range(40):
            for b in rng.choice(64, i % 24, replace=False):
                windows[i, b // 8] ^= 1 << (b % 8)
        away = np.bitwise_count(windows[:, None, :] ^ g.prints[None, :, :]).sum(axis=2)
        want = {(w, k, int(away[w, k])) for w, k in zip(*np.nonzero(away <= radius), strict=True)}
        assert {(int(w), int(k), int(d)) for w, k, d in zip(*g.within(windows, radius), strict=True)} == want


def test_radius_covers_similar_windows():
    """Windows of similarity 0.8 and more lie within 21 bits."""
    rng = np.random.default_rng(6)
    lost = seen = 0
    for _ in range(3000):
        n = int(rng.integers(8, 80))
        item = rng.integers(0, 2**63, n, dtype=np.uint64)
        window = item.copy()
        k = int(n * rng.uniform(0, 0.12))
        window[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
        a, b = Counter(item.tolist()), Counter(window.tolist())
        least = (a & b).total()
        if least / (a.total() + b.total() - least) >= 0.8:
            seen += 1
            p = [dc.fingerprint(dc.signs(x).sum(axis=0, keepdims=True))[0] for x in (item, window)]
            lost += int(np.bitwise_count(p[0] ^ p[1]).sum()) > 21
    assert seen > 2000 and lost == 0
