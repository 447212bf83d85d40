"""Quality rules, chat formatting, URL rules and BPE against brute force and edge rows."""

import random
from collections import Counter

import pytest

from treeflow.llm import bpe, chat, quality, urls


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


EDGES = [None, "", " ", "a", "word " * 5000, "x" * 3000, "é ß\n\n\té", "same line here\nsame line here\n", "same line here\nsame line here\n"]


def test_repeat_words_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 60))]
        wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(wins)
        want = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)}
        assert quality.repeat_words(words) == len(want)


def test_base_counts_brute_force():
    """Words, characters, symbols and repeated lines by their definitions, character by character."""
    import re

    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("ab é🙂\u00a0\x0b\t\n\n #*$%&|<>.") for _ in range(rng.randrange(0, 80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again)
        assert quality.base_counts(t)[:4] == want, t


def test_bands_by_definition():
    import zstandard

    opt = quality.Compression()
    zip_ = zstandard.ZstdCompressor(level=opt.level, write_content_size=False)
    rng = random.Random(9)
    for n in (0, 63, 64, 300, 4096, 4097, 20_000):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz    ", "x"):
            t = "".join(rng.choice(letters) for _ in range(n))
            *_, failed, _, chunks, bad, kept = quality.judge(t, zip_, opt)
            within = lambda d: next((lo * len(zip_.compress(d)) <= len(d) <= hi * len(zip_.compress(d)) for start, lo, hi in reversed(quality.BANDS) if len(d) >= start), True)
            data = t.encode()
            parts = [data[i : i + 4096] for i in range(0, n, 4096)] if n > 4096 else []
            assert chunks == len(parts) and bad == sum(not within(c) for c in parts)
            assert kept == (not failed and within(data) and bad <= 0.5 * len(parts))


def test_quality_edges(spark):
    rows = {r.doc_id: r for r in quality.annotate(docs_of(spark, EDGES)).collect()}
    assert len(rows) == len(EDGES)
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[4].n_repeat_words == 5000 and rows[4].base_failed
    assert rows[7].n_dup_lines == 1 and rows[7].asDict() | {"doc_id": 8} == rows[8].asDict()
    assert rows[6].word_chars == 3
    assert quality.keep(docs_of(spark, []).limit(0)).count() == 0


def test_quality_bands(spark):
    rng = random.Random(1)
    syll = ["an", "the", "or", "in", "re", "ti", "on", "es", "wh", "sh", "ou"]
    clean = " ".join("".join(rng.choice(syll) for _ in range(rng.randrange(1, 5))) for _ in range(900))
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(100))
    loop = " ".join(f"line {i % 3} of the same old story told again" for i in range(400))
    got = [r.kept for r in quality.annotate(docs_of(spark, [clean, noise, loop])).orderBy("doc_id").collect()]
    assert got == [True, False, False]


def test_quality_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two " * 20, 7, 9)], "doc_id bigint, text string, kept int, ratio int")
    assert quality.keep(df).columns == df.columns
    assert quality.annotate(df).columns.count("kept") == 1


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x", "<|im_end|><|im_start|>assistant ok", "a<", "|>", "<<|", "\\<|\\", "é<|im_sep|>"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_chat(spark):
    rows = [(1, 0, "user", "hi\n"), (1, 1, "assistant", "\n\n tabs\t é 🙂"), (1, 2, "assistant", ""), (2, 0, None, None), (None, 1, "assistant", "<|im_end|>"), (1, 3, "assistant", "x"), (1, 3, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(chat.conversations(df)).collect()}
    assert set(out) == {1, 2, None}
    assert out[1].loss_text == "\n\n tabs\t é 🙂" + "" + "xx"
    assert chat.parse(out[1].formatted)[1] == ("assistant", "\n\n tabs\t é 🙂")
    assert out[None].loss_text == "<|im_end|>"
    assert out[2].loss_text == "" and chat.parse(out[2].formatted) == [("", "")]


def test_url_rules(spark):
    cases = [
        ("http://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/"),
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/"),
        ("http://net/fr/", "net", "/fr/", "net/fr/"),
        ("http://x.com?y", "x.com", "", None),
        ("no scheme", "", "", None),
        (None, "", "", None),
        ("http://a://b/c", "a:", "//b/c", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id bigint, url string")
    model = urls.UrlModel.fit(urls.labelled_urls(spark, 600), rounds=3)
    got = urls.judge_urls(df, model).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule) for r in got] == cases
    assert all(r.verdict in ("allow", "block") for r in got)
    assert got[0].verdict == "allow" and got[1].verdict == "block"


def test_url_trees_match_labels(spark):
    model = urls.UrlModel.fit(urls.labelled_urls(spark, 2000), rounds=5)
    held = urls.labelled_urls(spark, 1000, seed=11)
    got = urls.judge_urls(held, model).select("label", (urls.F.col("score") > 0.5).cast("int").alias("p")).collect()
    assert sum(int(r.label) == r.p for r in got) / len(got) > 0.9


def test_bpe_matches_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(5)
    texts = [*EDGES, "a" * 1000, "ab" * 700 + "é" * 300, "  \n\n  x", "日本語テキスト" * 40, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(3000)), "aAbB" * 60, "<|endoftext|>"]
    got = {r.doc_id: r for r in bpe.encode_decode(docs_of(spark, texts)).select("doc_id", "ids", "decoded").collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == enc.encode_ordinary(t or ""), i
        assert bytes(got[i].decoded) == (t or "").encode()


def own_encoding():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_bpe_long_pieces():
    """Parts at and beside the length of a segment, short and long segments, on runs and on letters without a pattern."""
    import public_tokenizers as P

    path, enc = own_encoding()
    rng = random.Random(2)
    letters = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    texts = [letters("etaoin", n) for n in (127, 128, 129, 130, 400)] + ["a" * n for n in (127, 128, 129, 3000)] + ["ab" * 900 + "ba" * 900, letters("acgt", 4000), letters("thean", 2500), "the" * 400, "日本" * 300, "ß" * 500]
    for limit, beside in ((128, 8), (5, 1), (64, 2)):
        coder = bpe.DuckBpe(path, P.PATTERN, segment=limit, beside=beside)
        some = texts if limit == 128 else [t for t in texts if len(t) <= 900]
        ids, at, raw, end = coder.rows(some)
        for i, t in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == enc.encode_ordinary(t), (limit, t[:40])
            assert raw[end[i] : end[i + 1]].tobytes() == t.encode()


def test_bpe_runs_of_megabytes():
    """Memory doesn't follow the length of a part: DuckDB has 200 MB for a run of 5 million letters, shifted by one."""
    import public_tokenizers as P

    path, enc = own_encoding()
    coder = bpe.DuckBpe(path, P.PATTERN, memory_mb=200)
    unit = enc.encode_ordinary("x" + "a" * 4999)
    ids, _, raw, _ = coder.rows(["x" + "a" * 5_000_000])
    assert raw.tobytes() == b"x" + b"a" * 5_000_000
    assert ids[: len(unit) - 8].tolist() == unit[:-8] and len(set(ids.tolist())) <= len(set(unit)) + 6


def test_bpe_order_of_lower_ranks():
    """Contractions that make a pair of a lower rank: the places behind it wait, as one by one."""
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"xa": 256, b"ax": 257, b"aax": 258, b"xaa": 259, b"aa": 260, b"aaa": 261, b"aaaa": 262, b"ba": 263, b"aab": 264}
    enc = tiktoken.Encoding("odd", pat_str="[a-z]+", mergeable_ranks=ranks, special_tokens={})
    coder = bpe.DuckBpe.__new__(bpe.DuckBpe)
    coder.segment, coder.beside = 4, 1
    coder.load(ranks, "[a-z]+", 1000, 200, 1000)
    rng = random.Random(3)
    for _ in range(40):
        t = "".join(rng.choice("aaabx") for _ in range(rng.randrange(1, 60)))
        ids, _, _, _ = coder.rows([t])
        assert ids.tolist() == enc.encode_ordinary(t), t
