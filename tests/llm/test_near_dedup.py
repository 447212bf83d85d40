"""Order MinHash near-dedup against exhaustive alignment."""

import random
from pathlib import Path

import numpy as np

from treeflow.llm import near_dedup as nd
from treeflow.llm.common import FILES_A_CORE, string_buffer
from treeflow.llm.graph import components, joined


def corpus(seed, families=12):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["an", "th", "or", "ti", "on", "es"]) for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    texts = [None, "", "", "one", "one", "one two", "a b c d", "a b c d"]
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 3 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts += [" ".join(rng.choice(vocab) for _ in range(80)) + " " + passage for _ in range(20)]
    rng.shuffle(texts)
    return texts


def brute(texts):
    h, b = nd.shingles(*string_buffer(nd.pa.array([t or "" for t in texts])))
    sh = [h[b[i] : b[i + 1]].tolist() for i in range(len(texts))]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, c in enumerate(y):
                new.append(row[j] + 1 if a == c else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if not same and sh[i] and sh[j] and len(set(sh[i]) & set(sh[j])) * 9 >= 4 * (len(sh[i]) + len(sh[j])):
                s = lcs(sh[i], sh[j])
                same = s / (len(sh[i]) + len(sh[j]) - s) >= 0.8
            if same:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_alignment_is_exact():
    rng = random.Random(9)
    for _ in range(300):
        a = rng.sample(range(60), rng.randrange(1, 50))
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            i, j = rng.randrange(len(b)), rng.randrange(len(b))
            b[i], b[j] = b[j], b[i]
        b = [x for x in b if rng.random() > 0.05] or [1]
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        got = nd.aligned(x, y, 0.8)
        row = [0] * (len(b) + 1)
        for p in a:
            new = [0]
            for j, q in enumerate(b):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[-1]))
            row = new
        want = row[-1] / (len(a) + len(b) - row[-1])
        assert (got >= 0.8) == (want >= 0.8) and (got < 0.8 or abs(got - want) < 1e-12)


def test_occurrence_labels():
    h, b = nd.shingles(*string_buffer(nd.pa.array(["a a a a a a a", "a a a a a", "", None, "x y"])))
    assert b.tolist() == [0, 3, 4, 4, 4, 5] and len(set(h[:3].tolist())) == 3 and h[0] == h[3]


def test_classes_brute_force(spark):
    for seed in (1,):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, class_id int").repartition(3)
        got = {r.doc_id: r.class_id for r in nd.near_classes(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)
        kept = nd.keep_first(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))


def families(seed, members=400):
    """A family whose origin is absent, and small families under a template of 85 %."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(members):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    template = [word() for _ in range(255)]
    for _ in range(members // 4):
        own = [word() for _ in range(45)]
        for _ in range(3):
            w = template + own
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def all_pairs(texts):
    """Least place of each class, by alignment of every pair that shares enough shingles."""
    h, b = nd.shingles(*string_buffer(nd.pa.array(texts)))
    sh = [h[b[i] : b[i + 1]] for i in range(len(texts))]
    sets = [set(x.tolist()) for x in sh]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and len(sets[i] & sets[j]) * 9 >= 4 * (len(sh[i]) + len(sh[j])) and nd.aligned(sh[i], sh[j], 0.8) >= 0.8:
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    return up


def test_overlaps_count_all_pairs():
    rng = random.Random(4)
    common = np.arange(1000, 1100, dtype=np.uint64)
    a, b = ([np.unique(np.append(common[: rng.randrange(100)], np.array(rng.sample(range(300), rng.randrange(40)), np.uint64))) for _ in range(n)] for n in (70, 90))
    assert nd.overlaps(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_no_leader_cap(spark, monkeypatch):
    texts = families(2)
    monkeypatch.setattr(nd, "BLOCK_ROWS", 150, raising=False)  # several blocks a bucket
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = all_pairs(texts)
    got = {r.doc_id: r.class_id for r in nd.near_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "same words in here now ok"), (5, "same words in here now ok"), (5, "same words in here now ok"), (None, "else")], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in nd.near_classes(df).collect()) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert nd.keep_first(df).count() == 2
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert nd.near_classes(none).count() == 0


def test_which_of_equal_rows_stays(spark):
    """Rows of equal id and text: the same one stays however the table is dealt."""
    rows = [(7, "same words in here now ok", f"s{i}", None) for i in range(20)] + [(3, None, "x", None), (3, "", "y", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, u string")
    got = {tuple(sorted((r.doc_id, r.source) for r in nd.keep_first(df.repartition(n)).collect())) for n in (1, 3, 5)}
    assert len(got) == 1 and len(next(iter(got))) == 2


def test_scope_deletes_what_it_does_not_keep(spark, tmp_path):
    from treeflow.llm.common import scope, settle

    with scope(spark):
        with scope(spark) as keep:
            gone, kept = settle(spark.range(3)), keep(settle(spark.range(4)))
        assert kept.count() == 4
        assert not spark._jvm.java.io.File(gone._settled.removeprefix("file://")).exists()
    assert not spark._jvm.java.io.File(kept._settled.removeprefix("file://")).exists()


def test_tables_of_keys_are_few_files(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 4000, 2)], "u bigint, v bigint")
    files = lambda df: len(list(Path(df._settled.removeprefix("file://")).glob("part-*")))
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        classes = components(links)
        more = joined(classes, spark.createDataFrame([(1, 3), (9001, 9002)], "u bigint, v bigint"))
        most = FILES_A_CORE * spark.sparkContext.defaultParallelism
        assert files(classes) <= most and files(more) <= most
        got = {r.u: r.c for r in more.collect()}
        assert len(got) == 4002 and got[9002] == 9001 and all(got[i] == (i - i % 2 if i > 3 else 0) for i in range(4000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "u bigint, v bigint")
    got = {r.u: r.c for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_more_links_join_components(spark):
    """joined() equals components() of all links: links between components, to nodes outside them, and among such nodes."""
    rng = random.Random(3)
    for _ in range(2):
        first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
        more = [(rng.randrange(80), rng.randrange(80)) for _ in range(15)]
        frame = lambda rows: spark.createDataFrame(rows, "u int, v int")
        got = joined(components(frame(first)), frame(more))
        whole = components(frame(first + more))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
