"""Main-text extraction: a linear-chain CRF over the DOM's leaf blocks.

A page becomes its leaf blocks in order: stretches of text between block-level
tags, with the tags, classes, ids and roles of their open ancestors.  A two-label
chain (main, other) over binary features of ancestors and text is trained on
labelled pages by gradient ascent on the conditional likelihood and decoded by
Viterbi.  The labelled pages are written by ``labelled_pages`` from page plans of
several styles with invented text; their elements carry ``data-y``, which is read
from training pages only.

Reading takes time linear in the page.  End tags that HTML lets authors leave out
are supplied (p, li, dt, dd, table parts, head); what is never closed hides nothing:
a raw element (script, style, title, ...) ends before the next tag, a silent one
(button, select, svg, ...) is ignored, or ends where a block begins if it is a
control.  A quote that is never closed is an ordinary character; if a tag is open to
the end of the page under its quotes, quotes count no more from there on.

Defined results: null or empty html has an empty text; markup errors never fail
(stray end tags are ignored, paragraphs close each other, a `<` that begins no tag
is text); pages are extracted one by one, so repeated rows give equal texts; other
columns are kept by ``extract``, whose text column replaces one of that name; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Elements whose content is never text, and elements that bound blocks.
SILENT = frozenset("script style template svg title noscript iframe object canvas select option button textarea math audio video".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Silent elements that hold no blocks, so a block's start ends them.
CONTROLS = ("button", "select", "option", "svg", "math")
#: What a start tag ends by itself, and the element that it looks no further than.
ROW, CELL = ("tr", "td", "th"), ("td", "th")
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (ROW, ("table",)), "td": (CELL, ("table", "tr")), "th": (CELL, ("table", "tr"))}
ENDS |= dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", *ROW), ("table",)))
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-y|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HINTS = {
    "ad": r"\b(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|adsense)\b",
    "menu": r"nav|menu|breadcrumb|pagination|pager|toc\b|tabs?\b",
    "comment": r"comment|repl(?:y|ies)|discuss|disqus|respon",
    "notice": r"cookie|consent|notice|gdpr|alert|popup|modal|newsletter|subscri|signup|banner",
    "side": r"side|related|widget|share|social|recommend|trending|tags?\b(?!-)",
    "foot": r"foot|copyright|legal|credits",
    "head": r"head|masthead|logo|topbar|brand|contentinfo",
    "form": r"search|login|form",
    "main": r"content|article|post|entry|story|\bmain\b|text|body",
}
HINTS = {k: re.compile(v, re.I) for k, v in HINTS.items()}
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "table", "li", "figure", "blockquote", "p", "heading", "pre", "dialog")
LENGTHS = (2, 5, 10, 20, 40)


@dataclass
class Block:
    text: str
    tags: frozenset
    hints: frozenset
    own: str
    linked: float
    label: int | None


SIMPLE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"<>]*\"|'[^'<>]*')*+)>")
TAG_NAME = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)")
QUOTE_OR_END = re.compile(r"[\"'>]")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


class Reader:
    """Tags and text of a page, left to right; the work is linear in the page whatever stands in it."""

    def __init__(self, page: str):
        self.page, self.low = page, page.translate(ASCII_LOWER)
        self.last_quote = {q: page.rfind(q) for q in "\"'"}
        self.quotes = True  # until a tag is found that its quotes leave open to the end of the page
        self.unclosed: set[str] = set()
        self.last_end: dict[str, int] = {}

    def tag(self, at: int) -> tuple[bool, str, str, int] | None:
        """Whether it is an end tag, name, attributes and end of the tag at a `<`; None where there is none."""
        if m := SIMPLE_TAG.match(self.page, at):
            return bool(m[1]), m[2].lower(), m[3], m.end()
        m = TAG_NAME.match(self.page, at)
        if m is None:
            return None
        end = self.quoted_end(m.end()) if self.quotes else -1
        if end < 0:
            self.quotes = False
            end = self.page.find(">", m.end())
        return None if end < 0 else (bool(m[1]), m[2].lower(), self.page[m.end() : end], end + 1)

    def quoted_end(self, at: int) -> int:
        while m := QUOTE_OR_END.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            if m.start() < self.last_quote[m[0]]:
                at = self.page.index(m[0], at) + 1
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of a raw element ends; one that is never closed ends before the next tag."""
        found = -1
        if tag not in self.unclosed:
            name = "</" + tag
            found = self.low.find(name, at)
            while found >= 0 and self.low[found + len(name) : found + len(name) + 1] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                found = self.low.find(name, found + 1)
            if found < 0:
                self.unclosed.add(tag)
        if found >= 0:
            end = self.page.find(">", found)
            return end + 1 if end >= 0 else len(self.page)
        found = self.page.find("<", at)
        return found if found >= 0 else len(self.page)

    def closes(self, tag: str, at: int) -> bool:
        """Whether an end tag of that name stands anywhere behind at."""
        return at <= self.last("</" + tag)

    def last(self, what: str) -> int:
        if what not in self.last_end:
            self.last_end[what] = self.low.rfind(what)
        return self.last_end[what]


class Open:
    """The open elements; every question is answered from the places of each tag, not by walking the stack."""

    def __init__(self):
        self.stack: list[list] = []  # tag, hints, label, alive
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.silent = self.links = 0

    def push(self, tag: str, hints: frozenset, label: int | None) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.stack.append([tag, hints, label, True])

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def shut(self, to: int) -> None:
        """Ends the elements from that place on."""
        while len(self.stack) > to:
            tag, _, _, alive = self.stack.pop()
            if alive:
                self.gone(tag)

    def gone(self, tag: str) -> None:
        place = self.at[tag].pop()
        if self.blocks and self.blocks[-1] == place:
            self.blocks.pop()
        self.silent -= tag in SILENT
        self.links -= tag == "a"

    def end(self, tag: str) -> None:
        place = self.last(tag)
        if place < 0:
            return
        if tag in BLOCK:
            inside = self.blocks[-1] > place
            if tag == "p" and inside or place < self.last("td", "th", "caption") and tag not in TABLE:
                return
            self.shut(place)
        elif self.blocks and self.blocks[-1] > place:
            # an inline element ends without the blocks that were opened inside it
            self.stack[place][3] = False
            self.gone(tag)
        else:
            self.shut(place)

    def begin_block(self, tag: str) -> None:
        """Ends what a block's start tag ends by itself: a paragraph, the item or cell before it, stray controls."""
        p = self.last("p")
        if p >= 0 and self.blocks[-1] == p:
            self.shut(p)
        control = [self.at[t][0] for t in CONTROLS if self.at.get(t)]
        if control:
            self.shut(min(control))
        if tag in ENDS:
            ended, within = ENDS[tag]
            floor = self.last(*within)
            places = [x for t in ended if self.at.get(t) for x in (self.at[t][bisect_right(self.at[t], floor) :][:1])]
            if places:
                self.shut(min(places))

    def inherited(self) -> tuple[frozenset, int | None]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (frozenset(), None)


def blocks(page: str | None, labels: bool = False) -> list[Block]:
    """The leaf blocks with text, in order; labels reads data-y (training pages only)."""
    page = page or ""
    out: list[Block] = []
    buffer: list[str] = []
    linked = 0
    read, open_ = Reader(page), Open()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tags = frozenset(t for t in TAGS if open_.at.get(t)) | (frozenset(["heading"]) if any(open_.at.get(t) for t in HEADINGS) else frozenset())
                own = open_.stack[open_.blocks[-1]][0] if open_.blocks else "body"
                hints, label = open_.inherited()
                out.append(Block(text, tags, hints, own, min(1.0, linked / len(text)), label))
            buffer.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not open_.silent:
            text = html_lib.unescape(text) if "&" in text else text
            buffer.append(text)
            if open_.links:
                linked += len(text.strip())

    pos, end = 0, len(page)
    while pos < end:
        if page[pos] != "<":
            stop = page.find("<", pos)
            stop = end if stop < 0 else stop
            say(page[pos:stop])
            pos = stop
            continue
        found = read.tag(pos)
        if found is None:
            if page.startswith("<!--", pos):
                stop = page.find("-->", pos)
                pos = end if stop < 0 else stop + 3
            elif page[pos + 1 : pos + 2] in ("!", "?", "/") and (stop := page.find(">", pos)) >= 0:
                pos = stop + 1
            else:
                # no tag begins here, nor further on if none ends
                stop = pos + 1 if pos < read.last(">") else end
                say(page[pos:stop])
                pos = stop
            continue
        closing, tag, inner, pos = found
        if closing:
            if tag in BLOCK:
                flush()
            open_.end(tag)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            open_.begin_block(tag)
        if tag in VOID or tag == "head" or inner.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            pos = read.raw_end(tag, pos)
            continue
        if tag in SILENT and not read.closes(tag, pos):
            continue
        hints, label = open_.inherited()
        for name, value in ATTRIBUTE.findall(inner) if inner else ():
            value = value.strip("\"'")
            if name.lower() == "data-y":
                label = (1 if value == "1" else 0) if labels else None
            elif tag not in ("html", "body"):  # what the whole page is called says nothing of a block
                hints = hints | {k for k, r in HINTS.items() if r.search(value)}
        open_.push(tag, hints, label)
    flush()
    return out


NAMES = ["bias", *(f"in_{t}" for t in TAGS), *(f"hint_{h}" for h in HINTS), *(f"own_{t}" for t in ("p", "heading", "li", "td", "div", "other")), *(f"words_over_{n}" for n in LENGTHS), "some_links", "mostly_links", "sentence_end", "has_comma", "copyright", "first", "last", "main_and_p", "inside_hinted_only", "short_link", "after_h1", "unmarked", "unmarked_prose"]
INDEX = {n: i for i, n in enumerate(NAMES)}


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), len(NAMES)), np.float32)
    headed = False
    for i, b in enumerate(page):
        on = ["bias"]
        on += [f"in_{t}" for t in TAGS if t in b.tags]
        on += [f"hint_{h}" for h in b.hints]
        own = "heading" if re.fullmatch("h[1-6]", b.own) else b.own
        on.append(f"own_{own}" if f"own_{own}" in INDEX else "own_other")
        words = b.text.count(" ") + 1
        on += [f"words_over_{n}" for n in LENGTHS if words > n]
        if b.linked > 0.05:
            on.append("some_links")
        if b.linked > 0.5:
            on.append("mostly_links")
            if words <= 6:
                on.append("short_link")
        if b.text[-1] in ".!?…\"”»":
            on.append("sentence_end")
        if "," in b.text:
            on.append("has_comma")
        if "©" in b.text or re.search(r"\b(?:copyright|all rights reserved)\b", b.text, re.I):
            on.append("copyright")
        if headed:
            on.append("after_h1")
        if i == 0:
            on.append("first")
        if i == len(page) - 1:
            on.append("last")
        if b.tags & {"article", "main"} and not b.hints - {"main"} and not b.tags & {"nav", "aside", "footer", "form"}:
            on.append("main_and_p")
        if b.hints and "main" not in b.hints:
            on.append("inside_hinted_only")
        if not b.hints - {"main"} and not b.tags & {"nav", "header", "aside", "footer", "form", "dialog"} and b.linked <= 0.5:
            on.append("unmarked")
            if words > 5 and "sentence_end" in on:
                on.append("unmarked_prose")
        headed = headed or b.own == "h1"
        x[i, [INDEX[n] for n in on]] = 1
    return x


class Crf:
    """Two labels; w: (features, 2) emissions, t: (2, 2) transitions."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @classmethod
    def train(cls, pages: list[list[Block]], rounds: int = 150, rate: float = 0.1, decay: float = 5e-4) -> Crf:
        """Gradient ascent (Adam) on the mean conditional log-likelihood of labelled pages."""
        xs = [features(p) for p in pages]
        longest = max(map(len, xs))
        x = np.zeros((len(xs), longest, len(NAMES)), np.float32)
        y = np.zeros((len(xs), longest), np.int64)
        mask = np.zeros((len(xs), longest), bool)
        for i, (p, f) in enumerate(zip(pages, xs, strict=True)):
            x[i, : len(f)] = f
            y[i, : len(f)] = [b.label or 0 for b in p]
            mask[i, : len(f)] = True
        w, t = np.zeros((len(NAMES), 2)), np.zeros((2, 2))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        gold = np.eye(2)[y] * mask[..., None]
        both = mask[:, 1:] & mask[:, :-1]
        gold_t = np.einsum("nia,nib,ni->ab", gold[:, :-1], gold[:, 1:], both)
        total = mask.sum()
        lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
        for step in range(1, rounds + 1):
            e = x @ w
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for i in range(1, longest):
                a = np.stack([lse(alpha[:, i - 1] + t[:, k]) for k in (0, 1)], axis=1) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
            for i in range(longest - 2, -1, -1):
                b = np.stack([lse(t[k] + e[:, i + 1] + beta[:, i + 1]) for k in (0, 1)], axis=1)
                beta[:, i] = np.where(mask[:, i + 1, None], b, 0)
            z = lse(alpha[:, -1])[:, None]
            p = np.exp(alpha + beta - z[..., None]) * mask[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[..., None, None]) * both[..., None, None]
            grads = [np.einsum("nif,nik->fk", x, gold - p) / total - decay * w, (gold_t - pair.sum(axis=(0, 1))) / total - decay * t]
            for k, (theta, g) in enumerate(zip((w, t), grads, strict=True)):
                m, v = moments[2 * k], moments[2 * k + 1]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(w, t)

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest label sequence."""
        if not page:
            return []
        e = features(page) @ self.w
        best, back = e[0].copy(), []
        for row in e[1:]:
            through = best[:, None] + self.t
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        k = int(best.argmax())
        out = [k]
        for b in reversed(back):
            k = int(b[k])
            out.append(k)
        return out[::-1]


ALPHABETS = ("lo ra mi ten sol ver qui dan é ßu kor pel in an".split(), "ка мо ст ен ри ла до ве ту на".split(), "ma κα λο τη σι ρα νε πο".split())


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    """Pages by plan, with invented text; data-y is 1 on main elements, 0 elsewhere.

    Styles differ in the elements that hold the article (article, main, div, layout
    table, bare body), in classes, ids and roles, in the end tags they leave out, in
    alphabet and in the case of tags.
    """
    rng = random.Random(seed)
    chance = lambda p: rng.random() < p
    syllables = ALPHABETS[0]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    def sentence(a: int = 4, b: int = 18) -> str:
        s = [word() + ("," if chance(0.08) else "") for _ in range(rng.randrange(a, b))]
        return s[0].capitalize() + " " + " ".join(s[1:]) + rng.choice([".", ".", ".", ".", "!", "?", "", ":"])

    para = lambda: " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
    prose = lambda: rng.choice([para, sentence])()
    label = lambda *names: f'{rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
    attr = lambda *names: " " + label(*names) if chance(0.85) else ""
    named = lambda *names: " " + label(*names)  # noqa: E731  what nothing else tells from an article's text
    loose = False  # end tags that may be left out are left out
    close = lambda t: "" if loose or chance(0.08) else f"</{t}>"
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    links = lambda k: "".join(f"<li>{link()}{close('li')}" for _ in range(k))

    def nav() -> str:
        return rng.choice(
            [
                f"<nav><ul>{links(rng.randrange(2, 8))}</ul></nav>",
                f'<div{attr("menu", "navbar", "breadcrumbs")}><ul>{links(5)}</ul></div>',
                f'<div role="navigation">{" | ".join(link() for _ in range(5))}</div>',
                f"<table{attr('menu', 'tabs')}><tr>{''.join(f'<td>{link()}{close("td")}' for _ in range(4))}</table>",
            ]
        )

    def header() -> str:
        return rng.choice([f"<header>{link()}<p>{sentence(2, 6)}{close('p')}</header>", f'<div{named("header", "masthead", "site-header")}><h2>{word()}</h2>{prose()}</div>', f'<div role="banner">{word()} <b>{sentence(1, 5)}</b></div>'])

    def footer() -> str:
        return rng.choice([f"<footer>&copy; {word()} &middot; {sentence()}</footer>", f"<footer><p>{prose()}{close('p')}{link()}</footer>", f'<div{named("footer", "page-foot", "legal")}>{prose()} All rights reserved</div>', f'<div role="contentinfo"><p>{prose()}{close("p")}</div>'])

    def ad() -> str:
        return rng.choice([f'<div{named("ad", "ads", "advert", "sponsored", "ad-banner", "promo")}>{prose()}</div>', f'<div {label("ad", "advertisement", "sponsor-box")}><p>{prose()}{close("p")}{link()}</div>', f"<ins class=adsense><p>{prose()}</p></ins>"])

    def notice() -> str:
        return rng.choice([f'<div{named("cookie-notice", "consent", "newsletter", "alert", "gdpr popup")}><p>{prose()}{close("p")}<button>OK</button></div>', f'<dialog open><p>{prose()}{close("p")}</dialog>', f'<div role="alert">{prose()}</div>'])

    def aside() -> str:
        return rng.choice([f"<aside><h3>{word()}</h3><p>{prose()}</p></aside>", f"<aside>{prose()}</aside>", f'<div{attr("sidebar", "related", "widget", "share-bar")}><h4>{word()}</h4><ul>{links(4)}</ul><p>{prose()}{close("p")}</div>', f'<div role="complementary"><h3>{word()}</h3><ul>{links(3)}</ul></div>'])

    def form() -> str:
        return f'<form><label>{word()} {word()}</label><p>{sentence()}{close("p")}<input name=q><select><option>{word()}<option>{word()}</select><button>{word()}</button></form>'

    def comments() -> str:
        body = "".join(f"<{t}{attr('comment', 'reply') if chance(0.5) else ''}><b>{word()}</b><p>{prose()}{close('p')}</{t}>" for t in [rng.choice(["div", "li", "article"])] for _ in range(rng.randrange(1, 6)))
        return f'<{(t := rng.choice(["section", "div", "div", "ol"]))} {label("comments", "comment-list", "discussion", "replies")}><h3>{word()}</h3>{body}</{t}>'

    def other(f) -> str:
        return re.sub(r"<(\w+)", r'<\1 data-y="0"', f(), count=1)

    def body_parts() -> str:
        title = f"<h1>{sentence(2, 9)}</h1>" if chance(0.8) else f"<h1>{word()} {word()}</h1>" if chance(0.7) else ""
        if title and chance(0.15):
            title = f"<header>{title}</header>"
        parts = [title]
        for _ in range(rng.randrange(1, 9)):
            r = rng.random()
            if r < 0.7:
                p = para()
                p = f"<b>{p}<br>" if chance(0.1) else p.replace(" ", f' <a href="/x">{word()}</a> ', 1) if chance(0.15) else p
                parts.append(f"<p>{p}{close('p')}")
            elif r < 0.78:
                parts.append(f"<{(t := rng.choice(['h2', 'h3']))}>{sentence(2, 6)[:-1]}</{t}>")
            elif r < 0.84:
                parts.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{sentence(3, 9)}{close('li')}" for _ in range(3)) + f"</{t}>")
            elif r < 0.87:
                parts.append("<dl>" + "".join(f"<dt>{word()}{close('dt')}<dd>{sentence(3, 9)}{close('dd')}" for _ in range(2)) + "</dl>")
            elif r < 0.9:
                parts.append(f"<blockquote>{para()}</blockquote>")
            elif r < 0.93:
                parts.append(f"<table><tr><td>{word()}{close('td')}<td>{sentence(2, 6)}{close('td')}{close('tr')}</table>")
            elif r < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{sentence(3, 9)}</figcaption></figure>" if chance(0.5) else f"<pre>{sentence()}</pre>")
            elif r < 0.97:
                parts.append(f"<p>{word().capitalize()}.{close('p')}")
            else:
                parts.append(other(rng.choice([ad, aside, lambda: f"<aside>{sentence(2, 6)}</aside>", notice])))
        if chance(0.12):
            parts.append(other(comments))
        return "".join(parts)

    def main() -> str:
        inner = body_parts()
        if chance(0.18):
            # nothing around the article says so: a bare body, or elements without classes
            return f'<div data-y="1">{inner}</div>'
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        if tag in ("article", "main"):
            return f'<{tag} data-y="1">{inner}</{tag}>'
        if chance(0.15):
            return f'<{tag} role="main" data-y="1">{inner}</{tag}>'
        return f'<{tag} data-y="1"{attr("content", "post", "entry-content", "story-body", "article-text")}>{inner}</{tag}>'

    out = []
    for i in range(n):
        syllables = ALPHABETS[i % 6 if i % 6 < 3 else 0]
        loose = chance(0.2)
        before = [f for f in (header, nav, notice, ad) if chance(0.5)]
        after = [f for f in (aside, comments, form, ad, nav, notice) if chance(0.3)]
        rng.shuffle(before)
        rng.shuffle(after)
        end = other(footer) if chance(0.8) else ""
        if chance(0.08):
            # a layout table: menu and boxes left, the article in the middle
            side = "".join(map(other, after))
            body = "".join(map(other, before)) + f'<table><tr><td data-y="0">{side}{close("td")}<td data-y="1">{body_parts()}{close("td")}{close("tr")}</table>' + end
        else:
            body = "".join(map(other, before)) + main() + "".join(map(other, after)) + end
        page = f"<title>{word()}</title>{body}" if loose else f"<html><head><title>{word()}</title></head><body>{body}</body></html>"
        out.append(re.sub(r"(?<=<)/?[a-z]+\d?(?=[\s>])", lambda m: m[0].upper(), page) if chance(0.05) else page)
    return out


@lru_cache(maxsize=4)
def trained(n: int = 400, seed: int = 5) -> Crf:
    return Crf.train([b for p in labelled_pages(n, seed) if (b := blocks(p, labels=True))])


def main_text(page: str | None, crf: Crf) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, crf.decode(found), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", crf: Crf | None = None, columns: list[str] | None = None) -> DataFrame:
    """columns of pages (all by default) and text; narrow, no shuffle."""
    model = crf or trained()
    names = [c for c in (pages.columns if columns is None else columns) if c != "text"]
    schema = T.StructType([pages.schema[c] for c in names] + [T.StructField("text", T.StringType())])
    source = pages.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{html}`").cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), model).encode("utf-8", "replace").decode() for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(texts, pa.string())], names=[*names, "text"])

    return source.mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
