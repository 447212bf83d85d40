"""HTML extraction and toxicity: exactness of inference, held-out accuracy, edge rows."""

import itertools
import random
import time

import numpy as np

from treeflow.llm import html_crf as h
from treeflow.llm import toxicity as tx


def test_blocks():
    page = "<title>x</title><body><nav><a href='/a>b'>Home</a></nav><article><h1>A &amp;amp; B</h1><p>one\n two&nbsp;<b>three<br>four<p>five &lt;b&gt;<script>var t='</p>';</script></article><!-- <p>no</p> --><footer>&copy; me</footer>"
    assert [b.text for b in h.blocks(page)] == ["Home", "A &amp; B", "one two three four", "five <b>", "© me"]
    assert h.main_text(page, h.trained()) == "A &amp; B\n\none two three four\n\nfive <b>"


def test_markup_errors_and_edges(spark):
    odd = [None, "", "plain words only", "<p", "<<<>>><p>a</q></p></p>", "<a href=\"x>y", "<div>" * 3000 + "deep" + "</div>" * 10, "&#x41;&#0;&#xD800;<p>&bogus;"]
    df = spark.createDataFrame([(i, f"u{i}", x, "old") for i, x in enumerate(odd)], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert len(got) == len(odd) and got[0] == got[1] == ""
    assert h.extract(df.limit(0)).count() == 0


def test_viterbi_is_best_path():
    crf, rng = h.trained(), random.Random(1)
    for page in h.labelled_pages(40, 9):
        b = h.blocks(page, labels=True)[: rng.randrange(1, 9)]
        e = h.features(b) @ crf.w
        value = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(crf.t[a, c] for a, c in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(b)), key=value)
        assert abs(value(best) - value(crf.decode(b))) < 1e-6


def test_extraction_held_out():
    crf = h.trained()
    pages = [h.blocks(p, labels=True) for p in h.labelled_pages(120, 77)]
    right = sum(y == (b.label or 0) for p in pages for b, y in zip(p, crf.decode(p), strict=True))
    assert right / sum(map(len, pages)) > 0.97


#: Pages of shapes that the training pages do not have: (html, main text).
FOREIGN = [
    (
        "<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>Tides</title><style>p{color:red}</style><body class=home><div id=page><div id=masthead><a href=/>The Harbour</a></div>"
        "<ul id=navigation><li><a href=/a>Boats</a><li><a href=/b>Knots</a></ul><div id=primary class=hentry><h1 class=entry-title>Why tides turn</h1><div class=entry-content><p>The moon pulls the water toward it, and the water piles up on both sides of the globe.<p>Twice a day the shore feels it. Sailors plan around it, and so do the crabs.</div></div>"
        "<div id=secondary class=sidebar><h3>Recent</h3><ul><li><a href=/c>Ropes</a></ul></div><div id=colophon class=site-footer>&copy; The Harbour, all rights reserved</div></div>",
        "Why tides turn\n\nThe moon pulls the water toward it, and the water piles up on both sides of the globe.\n\nTwice a day the shore feels it. Sailors plan around it, and so do the crabs.",
    ),
    (
        "<HTML><BODY><NAV><A HREF=/>Home</A></NAV><MAIN><ARTICLE><H1>Как варят соль</H1><P>Соль варят долго, и вода уходит медленно.</P><UL><LI>Сначала греют воду.<LI>Потом ждут кристаллы.</UL></ARTICLE><SECTION CLASS=comments><P>Мне понравилось!</P></SECTION></MAIN><FOOTER>© Соль</FOOTER></BODY></HTML>",
        "Как варят соль\n\nСоль варят долго, и вода уходит медленно.\n\nСначала греют воду.\n\nПотом ждут кристаллы.",
    ),
    (
        "<body><header role=banner><h2>Daily Lamp</h2></header><script>if (a < b) document.write('<p>no</p>')</script><main role=main><h1>Lamps go out</h1><blockquote>It was dark, she said, and nobody moved for an hour.</blockquote><aside class=related><a href=/x>More lamps</a></aside><p>The town waited until morning, when the power came back.</p></main><form action=/s><label>Search</label><input></form>",
        "Lamps go out\n\nIt was dark, she said, and nobody moved for an hour.\n\nThe town waited until morning, when the power came back.",
    ),
]


def test_pages_of_other_shapes():
    for page, want in FOREIGN:
        assert h.main_text(page, h.trained()) == want


def test_names_of_the_whole_page_say_nothing_of_a_block():
    p = "<p>This is a long enough paragraph about rivers, hills and towns that people visit in summer. It has a second sentence, too.</p>"
    for head in ('<body class="has-sidebar"><article>', '<html class="nav-open"><body id="comments"><article>', '<body><article class="post tag-news">'):
        assert h.main_text(f"{head}{p}{p}</article></body>", h.trained()) == "\n\n".join([p[3:-4]] * 2)


def test_articles_that_nothing_names():
    """Text between menu and footer without an element or class for it; an aside in an article is none of its text."""
    p, q = "This is a long enough paragraph about rivers, hills and towns that people visit in summer. It has a second sentence, too.", "The council met on Tuesday and agreed to repair the old bridge before winter."
    menu, foot = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', "<footer>© 2020 Acme</footer>"
    for tag in ("p", "div"):
        for texts in ([p, q], [q, q]):
            inner = "".join(f"<{tag}>{t}</{tag}>" for t in texts)
            assert h.main_text(f"<html><body>{menu}{inner}{foot}</body></html>", h.trained()) == "\n\n".join(texts)
    assert h.main_text(f"<body>{menu}<h1>Bridge to be mended</h1><p>{q}</p>{foot}</body>", h.trained()) == f"Bridge to be mended\n\n{q}"
    assert h.main_text(f"<body><article><p>{p}</p><p>{q}</p><aside>Related: the other bridge</aside><p>{p}</p></article></body>", h.trained()) == f"{p}\n\n{q}\n\n{p}"
    assert h.main_text(f'<body>{menu}<div class="ad">{q}</div><div class="footer">{q}</div></body>', h.trained()) == ""


def test_markup_never_crashes_or_hides_the_page():
    texts = lambda p: [b.text for b in h.blocks(p)]
    assert texts('<div data-y="foo">x</div>') == ["x"]
    assert texts("<html><head><title>x</title><body><article><p>kept</article>") == ["kept"]
    assert texts("<head><meta a=b><p>kept") == ["kept"]
    for tag in ("button", "select", "svg", "canvas", "object", "script", "title", "textarea", "option"):
        assert texts(f"<{tag}><article><p>kept</p></article>")[-1] == "kept"
    assert texts("<button>no</button><select><option>no</select><svg><text>no</text></svg><p>yes") == ["yes"]
    assert texts('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert texts("<table><tr><td>a</div>b<td>c<tr><td>d</table>e") == ["a", "b", "c", "d", "e"]
    assert texts("<b><p>one</b> two</p>") == ["one two"]
    assert texts("a < b <3 <!-- x --> <? y ?> <!d> z <") == ["a < b <3 z <"]


def test_reading_is_linear():
    shapes = {"<div>x": 0.3, "<a ": 0.2, "<a \">\"": 0.5, "<script>": 0.2, "<button>x": 0.2, "<p><b><i>": 0.5, "<ul><li>x": 0.5, "<table><tr><td>x": 0.6, "<!-": 0.2, "<": 0.2, "&": 0.2}
    for shape, seconds in shapes.items():
        for page in (shape * (56_000 // len(shape)), shape * (56_000 // len(shape)) + ">"):
            began = time.perf_counter()
            h.blocks(page)
            assert time.perf_counter() - began < 3 * seconds, shape
    began = time.perf_counter()
    assert len(h.blocks("<div>x" * 170_000)) == 170_000
    assert time.perf_counter() - began < 15


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(80, rng.integers(0, 12), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = tx.Index(vectors, 80)
    dense = np.zeros((700, 80))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 7):
        docs, sims = index.nearest(*vectors[i], 10, skip=i)
        want = dense @ dense[i]
        want[i] = 0
        order = np.lexsort((np.arange(700), -np.round(want, 12)))[:10]
        order = order[want[order] > 1e-12]
        assert np.allclose(want[order], sims) and np.allclose(want[docs], sims)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "th", "or", "ti", "on"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        w = rng.choices(words, k=60) + (rng.choices(["zounds", "varlet", "knave"], k=3) if y else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_held_out_and_edges(spark):
    rows = corpus(600, 2)
    edges = [(1000, None, 0), (1001, "", 0), (1002, "x " * 20000, 0), (1003, "Knave! varlet", 1), (1003, "Knave! varlet", 1)]
    df = spark.createDataFrame([(i, t, "en") for i, t, _ in rows + edges], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = tx.fit(df, labels, tx.part_of("doc_id", 5) != 0)
    got = {r.doc_id: r for r in tx.score(df, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if tx.np.uint32(__import__("zlib").crc32(str(i).encode())) % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score < 0.5
    assert got[1003].predicted == 1 and got[1003].evidence[0].toxic == 1
    assert tx.score(df.limit(0), model).count() == 0
    none = tx.fit(df, labels.limit(0), tx.F.lit(True))
    assert tx.score(df, none).first().score == 0.0


def test_examples_find_themselves():
    """All features count: every example with a word is at cosine 1 to itself, and the k nearest are those of a full scan."""
    rng = random.Random(5)
    rows = corpus(400, 9) + [(9000, "solitary", 0), (9001, "Unheard-of, thing", 1)]
    model = tx.ToxicModel(rows, {0: sum(y == 0 for *_, y in rows), 1: sum(y == 1 for *_, y in rows)}, k=7)
    text = {i: t for i, t, _ in rows}
    vectors = [model.vector(tx.counts(text[i])) for i in model.ids]
    dense = np.zeros((len(rows), len(model.vocab)))
    for i, (t, w) in enumerate(vectors):
        assert len(t)
        dense[i, t] = w
    for i in [*rng.sample(range(len(rows)), 60), model.ids.index(9000), model.ids.index(9001)]:
        docs, sims = model.index.nearest(*vectors[i], 7)
        true = dense @ dense[i]
        assert abs(sims[0] - 1) < 1e-9 and true[docs[0]] > 1 - 1e-9
        assert np.allclose(sims, np.sort(true)[::-1][: len(sims)])
        assert len(sims) == min(7, (true > 1e-12).sum())


def test_toxicity_ids_of_text_and_bounded_examples(spark):
    rows = [(f"r{i}", t, y) for i, t, y in corpus(120, 4)]
    rows.append(("long", "knave " * 2000, 1))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id string, toxic int")
    model = tx.fit(df, labels, tx.F.lit(True), text_bytes=10_000)
    assert "long" not in model.ids and len(model.ids) == len(rows) - 1
    few = tx.fit(df, labels, tx.F.lit(True), class_bytes=3000)
    size = {i: (len(t.encode()), y) for i, t, y in rows}
    for label in (0, 1):
        assert sum(size[i][0] for i in few.ids if size[i][1] == label) <= 3000
    got = tx.score(df, model).collect()
    assert {r.doc_id for r in got} == {i for i, *_ in rows} and any(r.evidence for r in got)
