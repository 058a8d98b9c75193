"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks in page order, each with the path
of open tags, classes and ids over it and its words. A bidirectional LSTM in numpy
reads hashed vectors of path and words, so that each block is classified with the
whole page as context; the blocks classified as main text are joined by two \\n.

The model is trained in numpy on pages written from random grammars of page parts
(menus, headers, footers, sidebars, notices, adverts, forms, comments, articles),
whose labels are known by construction: pages whose tags and classes say what
they are, pages of bare elements, pages laid out by a table, and text right in
the body. Seed and sizes
are parameters. Grammars of the test are not trained on.

A page is read once, so very long pages, attributes and nesting cost time in
proportion. Blocks that score alike are judged alike; their order is the page's.

Null and empty html, and pages without main text, give empty text. Unclosed and
truncated tags, stray ``<`` and unknown character references are read as browsers
do, near enough. Repeated rows are extracted one by one. Other columns pass
through ``extract``, which adds or replaces ``text``. Empty tables give empty results.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

PATH_SLOTS, WORD_SLOTS, NUMBERS, HIDDEN = 256, 64, 4, 16
INPUT = PATH_SLOTS + WORD_SLOTS + NUMBERS
#: Steps of the LSTM over one group of pages; longer groups hold fewer pages.
CELLS = 1 << 14

#: Elements by how they are read.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe svg".split())
#: Each alternative ends at the latest at the page's end and never goes back, so a page is read once. A quote opens a value after = only; one left open takes the rest of the page, as in browsers.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z](?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)|[^<]++|<", re.S)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\w+")
#: Inline elements that are followed at once, and characters of the classes and ids of one element that are looked at.
_MOST_INLINE, _MOST_NAMES = 64, 400


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


#: Open elements that a tag closes by itself.
_IMPLIED = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "option": {"option"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}}
#: Of a path deeper than both together, so many outer and inner elements are looked at.
OUTER, INNER = 6, 12


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, character references decoded, white space as one space. Time and memory are in proportion to the page, however its tags nest."""
    page = page or ""
    blocks: list[Block] = []
    # Open block elements with their words, open inline elements since the last of them, and how many of each name are open.
    stack: list[tuple[str, str]] = []
    inline: list[list[str]] = [[]]
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    linked = at = 0

    def close_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            shown = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            blocks.append(Block(tuple(x for _, x in shown), text, linked))
        parts.clear()
        linked = 0

    def pop() -> str:
        name, _ = stack.pop()
        n_open[name] -= 1
        n_open.subtract(inline.pop())
        return name

    while (m := _TOKEN.match(page, at)) is not None:
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            parts.append(token)
            if n_open["a"] > 0:
                linked += len(token)
            continue
        tag = _TAG.match(token)
        if tag is None:
            continue
        name = tag[1].lower()
        if token[1] == "/":
            if name in INLINE:
                if name in inline[-1]:
                    # The latest of its name.
                    k = len(inline[-1]) - 1 - inline[-1][::-1].index(name)
                    del inline[-1][k]
                    n_open[name] -= 1
                continue
            close_block()
            if n_open[name] > 0:
                while pop() != name:
                    pass
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name == "br":
            parts.append(" ")
        elif name in VOID:
            if name not in INLINE and name != "img":
                close_block()
        elif name in INLINE:
            if len(inline[-1]) < _MOST_INLINE:
                inline[-1].append(name)
                n_open[name] += 1
        else:
            close_block()
            n_open.subtract(inline[-1])
            inline[-1].clear()
            implied = _IMPLIED.get(name, {"p"})
            while stack and stack[-1][0] in implied:
                pop()
                n_open.subtract(inline[-1])
                inline[-1].clear()
            if name == "body" and stack and stack[-1][0] == "head":
                pop()
            words = " ".join("".join(x) for x in _NAMES.findall(token)).lower()[:_MOST_NAMES]
            stack.append((name, f"{name} {words}" if words else name))
            inline.append([])
            n_open[name] += 1
    close_block()
    return blocks


def _slot(text: str, slots: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % slots


_SLOTS: dict[tuple[str, ...], list[int]] = {}


def _path_slots(path: tuple[str, ...]) -> list[int]:
    known = _SLOTS.get(path)
    if known is None:
        names = set()
        for depth, x in enumerate(path):
            tag, *words = x.split(" ")
            names |= {tag, f"{depth}:{tag}"} | {f"{tag}/{path[depth - 1].split(' ')[0]}"} | {f".{w}" for long in words for w in [long, *re.split(r"[-_]", long)]}
        names.add("last " + path[-1].split(" ")[0] if path else "none")
        known = sorted({_slot(n, PATH_SLOTS) for n in names})
        if len(_SLOTS) > 50_000:
            _SLOTS.clear()
        _SLOTS[path] = known
    return known


def vectors(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), dtype=np.float32)
    for i, b in enumerate(blocks):
        x[i, _path_slots(b.path)] = 1.0
        words = _WORD.findall(b.text.lower())
        slots = np.bincount([hash_word(w) for w in words], minlength=WORD_SLOTS) if words else np.zeros(WORD_SLOTS)
        x[i, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = slots / max(1.0, float(np.sqrt((slots**2).sum())))
        x[i, -NUMBERS:] = (np.log1p(len(words)) / 4, b.linked / max(1, len(b.text)), float(b.text[-1] in ".!?"), i / max(1, len(blocks) - 1))
    return x


_WORD_CACHE: dict[str, int] = {}


def hash_word(word: str) -> int:
    k = _WORD_CACHE.get(word)
    if k is None:
        if len(_WORD_CACHE) > 200_000:
            _WORD_CACHE.clear()
        k = _WORD_CACHE[word] = _slot(word, WORD_SLOTS)
    return k


# ---- the model: two LSTMs, one in each direction, and a logistic layer


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p: dict[str, np.ndarray] = {}
    for d in "fb":
        p[f"w{d}"] = (rng.standard_normal((INPUT, 4 * HIDDEN)) * 0.1).astype(np.float32)
        p[f"u{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
        p[f"c{d}"] = np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)
    p["v"] = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
    p["o"] = np.zeros(1, dtype=np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(p: dict[str, np.ndarray], d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of one direction over (steps, pages, inputs); masked steps carry the state on."""
    steps, pages, _ = x.shape
    proj = (x.reshape(-1, INPUT) @ p[f"w{d}"] + p[f"c{d}"]).reshape(steps, pages, -1)
    h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
    out = np.zeros((steps, pages, HIDDEN), dtype=np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = proj[t] + h @ p[f"u{d}"]
        i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, new_c, c)
        out[t] = h
    return out


def scores(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.concatenate((_run(p, "f", x, mask), _run(p, "b", x, mask)), axis=2) @ p["v"] + p["o"]


def gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kept: dict[str, list] = {"f": [], "b": []}
    h = np.concatenate([_run(p, d, x, mask, kept[d]) for d in "fb"], axis=2)
    prob = _sigmoid(h @ p["v"] + p["o"])
    n = mask.sum()
    loss = float(-(np.log(np.where(y, prob, 1 - prob) + 1e-9) * mask).sum() / n)
    ds = ((prob - y) * mask / n).astype(np.float32)
    g = {k: np.zeros_like(a) for k, a in p.items()}
    g["v"], g["o"] = np.einsum("tp,tph->h", ds, h), np.array([ds.sum()], dtype=np.float32)
    for k, d in enumerate("fb"):
        into = ds[:, :, None] * p["v"][k * HIDDEN : (k + 1) * HIDDEN]
        dh_next = dc_next = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        for t, h0, c0, i, f, o, gg, tc, m in reversed(kept[d]):
            dh = into[t] + dh_next
            dc = np.where(m, dc_next + dh * o * (1 - tc**2), 0)
            dz = np.concatenate((dc * gg * i * (1 - i), dc * c0 * f * (1 - f), np.where(m, dh, 0) * tc * o * (1 - o), dc * i * (1 - gg**2)), axis=1)
            dz_all[t] = dz
            g[f"u{d}"] += h0.T @ dz
            dh_next = np.where(m, dz @ p[f"u{d}"].T, dh)
            dc_next = np.where(m, dc * f, dc_next)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        g[f"w{d}"], g[f"c{d}"] = x.reshape(-1, INPUT).T @ flat, flat.sum(axis=0)
    return loss, g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(len(v) for v in pages))
    x, mask = np.zeros((steps, len(pages), INPUT), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


# ---- pages for training, with labels


def _phrase(rng: np.random.Generator, low: int, high: int) -> str:
    syllables = ("ta", "ren", "mo", "li", "est", "an", "dor", "ing", "the", "of", "und", "que", "sa", "ber", "tion")
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(low, high))]
    return " ".join(words).capitalize()


class _Writer:
    """Writes one random page and keeps, for each leaf block in order, whether it is main text."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.out, self.labels = rng, [], []

    def put(self, markup: str, *is_main: bool) -> None:
        self.out.append(markup)
        self.labels.extend(is_main)

    def pick(self, *choices: str) -> str:
        return str(self.rng.choice(choices))

    def phrase(self, low: int, high: int) -> str:
        return _phrase(self.rng, low, high)

    def within(self, tag: str, body: Callable[[], None]) -> None:
        self.out.append(f"<{tag}>")
        body()
        self.out.append(f"</{tag.split()[0]}>")

    def links(self, n: int, shape: str) -> None:
        """n links as blocks of their own, or all in one block with separators."""
        words = [f'<a href="/{k}">{self.phrase(1, 4)}</a>' for k in range(n)]
        if shape == "line":
            self.put(f"<p>{self.pick(' | ', ' ', ' &middot; ', ' / ').join(words)}</p>", False)
        else:
            for w in words:
                self.put(f"<{shape}>{w}</{shape}>", False)

    def sentence(self) -> str:
        return self.phrase(1, int(self.rng.choice((4, 12, 60)))) + self.pick(".", ".", ".", "", "!")

    def long_sentence(self) -> str:
        return " ".join(self.phrase(5, 25) + self.pick(".", ".", "?", "!") for _ in range(self.rng.integers(1, 5)))


#: Names of neutral meaning, as layouts have them.
_NEUTRAL = ("", "", ' class="row"', ' class="col-8"', ' class="wrap"', ' id="x1"', ' class="c4 clearfix"', ' class="inner"')


def _named_parts(w: _Writer) -> dict[str, Callable[[], None]]:
    """Parts around an article whose tags, classes or ids say what they are."""

    def menu() -> None:
        w.within(w.pick("nav", 'div class="menu"', 'div id="nav"', "nav class=main-menu"), lambda: w.within("ul", lambda: w.links(int(w.rng.integers(2, 9)), "li")))

    def header() -> None:
        w.put(f'<header><h1 class="logo">{w.phrase(1, 4)}</h1><p>{w.phrase(3, 9)}</p></header>', False, False)

    def advert() -> None:
        tag = w.pick('div class="ad"', 'div class="advert"', 'div class="sponsored"', 'aside class="ads"', 'div class="promo"')
        w.put(f"<{tag}>{w.phrase(3, 14)}.</{tag.split()[0]}>", False)

    def notice() -> None:
        tag = w.pick('div class="cookie-notice"', 'div id="banner"', 'div class="notice"', 'div role="alert"', 'div class="newsletter"')
        w.put(f"<{tag}><p>{w.phrase(5, 20)}.</p></{tag.split()[0]}>", False)

    def side() -> None:
        def body() -> None:
            w.put(f"<h3>{w.phrase(1, 4)}</h3>", False)
            if w.rng.random() < 0.7:
                w.put(f"<p>{w.phrase(3, 15)}.</p>", False)
            w.within("ul", lambda: w.links(int(w.rng.integers(0, 6)), "li"))

        w.within(w.pick("aside", 'div class="sidebar"', 'div class="related"', 'div id="sidebar"', 'div class="recent-posts"', 'section class="widget"'), body)

    def form() -> None:
        w.put(f"<form><label>{w.phrase(1, 3)}</label><input name=q></form>", False)

    def comments() -> None:
        def body() -> None:
            for _ in range(w.rng.integers(1, 4)):
                w.put(f'<div class="comment"><p>{w.phrase(3, 25)}.</p></div>', False)

        w.within(w.pick('section class="comments"', 'div id="comments"', 'div class="reader-comments"'), body)

    def footer() -> None:
        tag = w.pick("footer", 'div class="footer"', 'footer id="foot"')
        w.put(f"<{tag}>&copy; {w.phrase(2, 14)}.</{tag.split()[0]}>", False)

    return {"menu": menu, "header": header, "advert": advert, "notice": notice, "side": side, "form": form, "comments": comments, "footer": footer}


def _table(w: _Writer, rows: int) -> None:
    """A table of values in an article."""

    def body() -> None:
        for r in range(rows):
            cell = "th" if r == 0 else "td"
            w.put("<tr>" + "".join(f"<{cell}>{w.phrase(1, 5)}</{cell}>" for _ in range(3)) + "</tr>", True, True, True)

    w.within("table", body)


def semantic_page(w: _Writer) -> None:
    """An article in a tag or class of that name, among parts that are named too."""
    part = _named_parts(w)

    def article() -> None:
        if w.rng.random() < 0.8:
            w.put(f"<{(t := w.pick('h1', 'h2'))}>{w.phrase(2, 9)}.</{t}>", True)
        for _ in range(w.rng.integers(1, 14)):
            kind, text = w.rng.random(), w.sentence()
            if kind < 0.58:
                w.put(f"<p>{text}</p>", True)
            elif kind < 0.73:
                w.put(f"<p><b>{text}<br>", True)
            elif kind < 0.80:
                w.put(f"<h2>{text}</h2>", True)
            elif kind < 0.86:
                w.put(f"<ul><li>{text}</li><li>{w.phrase(2, 12)}</li></ul>", True, True)
            elif kind < 0.90:
                w.put(f'<blockquote>{text} <a href="/x">{w.phrase(1, 3)}</a></blockquote>', True)
            elif kind < 0.94:
                part["advert"]()
            elif kind < 0.97:
                _table(w, int(w.rng.integers(2, 4)))
            else:
                w.put(f"<pre>{text}</pre>", True)
        if w.rng.random() < 0.15:
            part["comments"]()

    for name in ("notice", "header", "menu", "advert", "form"):
        if w.rng.random() < (0.8 if name == "menu" else 0.4):
            part[name]()
    if w.rng.random() < 0.3:
        part["side"]()
    w.within(w.pick("article", "article", 'article class="post"', "main", 'div class="content"', 'div class="article-body"', 'main id="content"'), article)
    for name in ("comments", "side", "advert", "form", "notice"):
        if w.rng.random() < 0.3:
            part[name]()
    if w.rng.random() < 0.9:
        part["footer"]()


def _plain_menu(w: _Writer) -> None:
    w.within(f"{w.pick('div', 'ul', 'td')}{w.pick(*_NEUTRAL)}", lambda: w.links(int(w.rng.integers(3, 9)), w.pick("li", "div", "line", "p")))


def _plain_footer(w: _Writer) -> None:
    text = w.pick(f"&copy; {w.phrase(2, 8)}", f"&copy; 2024 {w.phrase(1, 5)}. {w.phrase(2, 5)}.", f"Copyright {w.phrase(1, 5)}")
    before, after = w.pick("<p>|</p>", "<div>|</div>", "<p><small>|</small></p>").split("|")
    w.put(before + text + after, False)


def _plain_side(w: _Writer) -> None:
    def body() -> None:
        before, after = w.pick("<h3>|</h3>", "<h4>|</h4>", "<p><b>|</b></p>", "<div>|</div>").split("|")
        w.put(before + w.phrase(1, 3) + after, False)
        w.links(int(w.rng.integers(2, 7)), w.pick("li", "div", "p"))

    w.within(f"{w.pick('div', 'td', 'section')}{w.pick(*_NEUTRAL)}", body)


def bare_page(w: _Writer, tag: str | None = None) -> None:
    """An article in elements that say nothing, among blocks of links that say nothing either."""
    tag = tag or w.pick("div", "div", "section")
    # Text right in the element that holds all of it, cut by rules, is a block too.
    before, after = w.pick("<p>|</p>", "<p>|</p>", "<div>|</div>", "|<hr>").split("|")

    def article() -> None:
        if w.rng.random() < 0.8:
            w.put(f"<{(t := w.pick('h1', 'h2'))}>{w.phrase(2, 9)}</{t}>", True)
        for _ in range(w.rng.integers(2, 12)):
            kind = w.rng.random()
            if kind < 0.75:
                w.put(before + w.long_sentence() + after, True)
            elif kind < 0.82:
                w.put(f"{before}{w.phrase(4, 12)} <a href=/x>{w.phrase(1, 3)}</a> {w.phrase(3, 12)}.{after}", True)
            elif kind < 0.90:
                w.put(f"<h3>{w.phrase(1, 6)}</h3>", True)
            elif kind < 0.95:
                w.put(f"<ul><li>{w.phrase(3, 12)}.</li><li>{w.phrase(3, 12)}.</li></ul>", True, True)
            else:
                _table(w, 2)

    for f, p in ((_plain_menu, 0.9), (_plain_side, 0.2)):
        if w.rng.random() < p:
            f(w)
    if w.rng.random() < 0.3:
        _named_parts(w)[w.pick("advert", "notice", "form")]()
    outer = f"{w.pick('div', 'div', 'section')}{w.pick(*_NEUTRAL)}"
    if after == "<hr>" and w.rng.random() < 0.5:
        article()
    else:
        w.within(outer, lambda: w.within(f"{tag}{w.pick(*_NEUTRAL)}", article) if w.rng.random() < 0.5 else article())
    if w.rng.random() < 0.2:
        _named_parts(w)["comments"]()
    for f, p in ((_plain_side, 0.5), (_plain_menu, 0.3), (_plain_footer, 0.8)):
        if w.rng.random() < p:
            f(w)


def layout_page(w: _Writer) -> None:
    """A table lays the page out: a column of links, one of text."""

    def column() -> None:
        if w.rng.random() < 0.7:
            w.put(f"<h1>{w.phrase(2, 8)}</h1>", True)
        for _ in range(w.rng.integers(2, 9)):
            w.put(f"<p>{w.long_sentence()}</p>" if w.rng.random() < 0.8 else f"<div>{w.long_sentence()}</div>", True)

    def row() -> None:
        if w.rng.random() < 0.8:
            w.within("td" + w.pick(*_NEUTRAL), lambda: w.links(int(w.rng.integers(2, 8)), w.pick("div", "li", "p")))
        w.within("td" + w.pick(*_NEUTRAL), column)
        if w.rng.random() < 0.4:
            w.within("td" + w.pick(*_NEUTRAL), lambda: w.links(int(w.rng.integers(2, 6)), w.pick("div", "p")))

    w.within("table", lambda: w.within("tr", row))
    if w.rng.random() < 0.8:
        _plain_footer(w)


def body_page(w: _Writer) -> None:
    """Text right in the body, cut by headings and rules; links in lines. No part has an element of its own."""
    w.links(int(w.rng.integers(3, 8)), "line")
    w.put(f"<h1>{w.phrase(2, 8)}</h1>", True)
    for _ in range(w.rng.integers(2, 8)):
        if w.rng.random() < 0.5:
            w.put(f"{w.long_sentence()}<hr>", True)
        else:
            w.put(f"{w.long_sentence()}<p>{w.long_sentence()}</p>", True, True)
    if w.rng.random() < 0.8:
        w.links(int(w.rng.integers(3, 7)), "line")
    if w.rng.random() < 0.8:
        w.put(f"<p>&copy; {w.phrase(1, 6)}</p>", False)


def mixed_page(w: _Writer) -> None:
    """A named menu and footer around bare text in sections, with widgets that say nothing between."""
    part = _named_parts(w)
    part["menu"]()
    for _ in range(w.rng.integers(1, 4)):
        w.put(f"<section><h2>{w.phrase(2, 7)}</h2><div>{w.long_sentence()}</div><div>{w.long_sentence()}</div></section>", True, True, True)
    _plain_side(w)
    part["footer"]()


def steps_page(w: _Writer) -> None:
    """Instructions as a numbered list in bare elements, with links in lines above and a plain footer."""
    w.links(int(w.rng.integers(3, 8)), w.pick("line", "div"))

    def steps() -> None:
        for _ in range(w.rng.integers(2, 7)):
            w.put(f"<li>{w.long_sentence()}</li>", True)

    def body() -> None:
        w.put(f"<h1>{w.phrase(2, 7)}</h1><p>{w.long_sentence()}</p>", True, True)
        w.within("ol", steps)
        w.put(f"<p>{w.long_sentence()}</p>", True)

    w.within(f"{w.pick('div', 'section')}{w.pick(*_NEUTRAL)}", body)
    _plain_side(w)
    _plain_footer(w)


#: Page grammars that are trained on, with their shares, and those held out for the test.
GRAMMARS, HELD_OUT = ((semantic_page, 0.45), (bare_page, 0.3), (layout_page, 0.13), (body_page, 0.12)), (mixed_page, steps_page)


def written_page(rng: np.random.Generator, grammar: Callable[[_Writer], None] | None = None) -> tuple[str, list[bool]]:
    """A random page of a grammar, or of one drawn from GRAMMARS, and for each leaf block in order whether it is main text."""
    w = _Writer(rng)
    chosen = grammar or GRAMMARS[int(rng.choice(len(GRAMMARS), p=[share for _, share in GRAMMARS]))][0]
    w.put(f"<!DOCTYPE html><html><head><title>{w.phrase(2, 9)}</title><style>p{{}}</style></head><body>", False)
    chosen(w)
    if rng.random() < 0.9:
        w.out.append("</body></html>")
    return "".join(w.out), w.labels


def train(pages: int = 700, steps: int = 480, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < pages:
        page, labels = written_page(rng)
        blocks = leaf_blocks(page)
        assert len(blocks) == len(labels), (page, labels)
        xs.append(vectors(blocks))
        ys.append(np.array(labels))
    p = initial(rng)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for t in range(1, steps + 1):
        at = rng.integers(0, pages, 24)
        x, mask = padded([xs[i] for i in at])
        # Path and word slots drop out at random, so that no single name decides.
        x[:, :, : PATH_SLOTS + WORD_SLOTS] *= rng.random((1, len(at), PATH_SLOTS + WORD_SLOTS)) > 0.1
        y = np.zeros(mask.shape, dtype=bool)
        for k, i in enumerate(at):
            y[: len(ys[i]), k] = ys[i]
        _, g = gradients(p, x, mask, y)
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return p


def label(pages: list[list[Block]], p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Whether each block is main text; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * max(1, len(pages[order[j]])) <= CELLS:
            j += 1
        own = order[i:j]
        x, mask = padded([vectors(pages[k]) for k in own])
        s = scores(p, x, mask) > 0
        for c, k in enumerate(own):
            out[k] = s[: len(pages[k]), c]
        i = j
    return out


def main_text(pages: list[str | None], p: dict[str, np.ndarray]) -> list[str]:
    blocks = [leaf_blocks(page) for page in pages]
    return ["\n\n".join(b.text for b, main in zip(own, is_main) if main) for own, is_main in zip(blocks, label(blocks, p))]


def extract(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model if model is not None else train())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(main_text(rows.tolist(), shared.value), dtype=object)

    return pages.withColumn("text", run("html"))
