"""Main text of web pages: leaf blocks labelled by a bidirectional LSTM in numpy.

A page is cut into leaf blocks: runs of text between block-level tags, each with the path of open elements (tag,
class, id and role words). A block's vector joins the hashed path, the mean hashed-word vector of all its words, and
a few figures (length, share of link text, punctuation, place). The network reads the whole sequence of a page in
both directions, so every block is judged with the rest of the document in view.

The network is trained here, on `training_pages` pages that a seeded generator lays out in many ways (menus, headers,
footers, sidebars, notices, adverts, forms, comments around and inside articles) together with their labels.

Defined results: a null or empty page, and a page without article blocks, gives an empty text; unclosed and stray
tags are tolerated; markup, scripts, styles and HTML comments are never text; repeated rows give equal results; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ready_for_python

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("svg math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mspace mstyle mpadded mphantom menclose merror semantics".split())
SILENT = frozenset("script style template noscript svg iframe object canvas annotation annotation-xml textarea select".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDY = re.compile(r"[A-Za-z]+|\d+")
SPACE = re.compile(r"\s+")

PATH_DIMS, WORD_DIMS, FIGURES, HIDDEN, WORD_ROWS = 96, 16, 6, 20, 4096
CHUNK = 4096
#: An end tag closes no element further out than this; browsers bound their depth too.
DEEPEST = 256
_WORDS = np.random.default_rng(3).normal(0, 0.5, (WORD_ROWS, WORD_DIMS)).astype(np.float32)


class _Tags:
    """The tags of a page in order. Each character is looked at a bounded number of times, whatever is left open.

    A quote that is never closed is an ordinary character; where quotes hide the end of a tag up to the end of the
    page, they count for nothing from that tag on; a tag without any end is text.
    """

    def __init__(self, page: str):
        self.page, self.quotes, self.open = page, {"'": True, '"': True}, True

    def _end(self, at: int) -> int:
        i = at
        while self.open:
            m = STOP.search(self.page, i)
            if m is None:
                self.open = False
                break
            if m[0] == ">":
                return m.start()
            i = m.end()
            if self.quotes[m[0]]:
                shut = self.page.find(m[0], i)
                if shut < 0:
                    self.quotes[m[0]] = False
                else:
                    i = shut + 1
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """The next tag from here on: its start, its end, its name (None for comments and such), whether it closes, its attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), None, False, ""
            m = NAME.match(page, start + 1)
            if m or page[start + 1 : start + 2] in ("!", "?"):
                end = self._end(m.end()) if m else page.find(">", start)
                if end < 0:
                    break
                return start, end + 1, m[2].lower() if m else None, bool(m and m[1]), page[m.end() : end] if m else ""
            at = start + 1
        return len(page), len(page), None, False, ""


def _past(page: str, tag: str, at: int) -> int:
    """The end of a silent element that opened here; svg can hold others of its kind. Without an end tag: of the page."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b([^>]*)>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag == "svg" and not m[2].endswith("/"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def leaf_blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of link text) of every block in page order."""
    out: list = []
    stack: list[tuple[str, tuple]] = []
    held: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if not held:
            return
        raw = "".join(held)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append((tuple(n for _, names in stack[-DEEPEST:] for n in names), text, min(1.0, linked / len(text))))
        held.clear()
        linked = 0

    at, tags = 0, _Tags(page)
    while at < len(page):
        start, end, tag, closes, attributes = tags.after(at)
        if start > at:
            held.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if tag is None:
            continue
        if closes:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    links -= sum(t == "a" for t, _ in stack[i:]) if links else 0
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE or len(stack) - i > DEEPEST:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in SILENT:
            if not (tag == "svg" and attributes.endswith("/")):
                at = _past(page, tag, at)
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                if stack[i][0] == "p":
                    links -= sum(t == "a" for t, _ in stack[i:]) if links else 0
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        names = (tag, *("." + w for a in NAMES.findall(attributes) for w in WORDY.findall("".join(a).lower())))
        stack.append((tag, names))
        links += tag == "a"
    flush()
    return out


def _path_vector(path: tuple, known: dict) -> np.ndarray:
    if path not in known:
        if len(known) > 20_000:
            known.clear()
        v = np.zeros(PATH_DIMS, dtype=np.float32)
        for i, name in enumerate(reversed(path)):
            h = zlib.crc32(name.encode())
            v[h % PATH_DIMS] += (1 if h & 0x10000 else -1) * (1.0 if i < 4 else 0.7)
        known[path] = v
    return known[path]


class _Rows(dict):
    """Hashed row of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = row = zlib.crc32(word.lower().encode()) % WORD_ROWS
        return row


_ROW = _Rows().__getitem__


def block_vectors(blocks: list, first: int, total: int, known: dict) -> np.ndarray:
    """Feature rows of blocks first.. of a page of `total` blocks."""
    out = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + FIGURES), dtype=np.float32)
    rows: list[int] = []
    figures, many = [], []
    for i, (path, text, links) in enumerate(blocks):
        words = text.split(" ")
        rows.extend(map(_ROW, words))
        many.append(n := len(words))
        out[i, :PATH_DIMS] = _path_vector(path, known)
        stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
        figures.append((math.log1p(n) / 4, links, min(1.0, stops / n), (first + i) / total, float(first + i == 0), float(n < 4)))
    if blocks:
        counts = np.array(many)
        out[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.add.reduceat(_WORDS[rows], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        out[:, PATH_DIMS + WORD_DIMS :] = figures
    return out


class BiLSTM:
    def __init__(self, seed: int = 5):
        r, n = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + FIGURES
        self.weights = {}
        for side in "fb":
            self.weights["x" + side] = r.normal(0, 0.15, (n, 4 * HIDDEN)).astype(np.float32)
            self.weights["h" + side] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, dtype=np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.weights["b" + side] = bias
        self.weights["o"] = r.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32)
        self.weights["c"] = np.zeros(1, dtype=np.float32)

    def _run(self, gates: np.ndarray, mask: np.ndarray, side: str, h: np.ndarray, c: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """gates: (pages, steps, 4H) from the inputs, in reading order of this side; masked steps keep the state."""
        out = np.zeros((*gates.shape[:2], HIDDEN), dtype=np.float32)
        w = self.weights["h" + side]
        for t in range(gates.shape[1]):
            z = gates[:, t] + h @ w
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            th = np.tanh(c_new)
            h_new = m * (o * th) + (1 - m) * h
            if keep is not None:
                keep.append((i, f, o, g, c, h, th, m))
            h, c = h_new, c_new
            out[:, t] = h
        return out, h, c

    def _inputs(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.weights["x" + side] + self.weights["b" + side]

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability that each block is article text; x: (pages, steps, features)."""
        zero = np.zeros((len(x), HIDDEN), dtype=np.float32)
        ahead, _, _ = self._run(self._inputs(x, "f"), mask, "f", zero, zero)
        back, _, _ = self._run(self._inputs(x, "b")[:, ::-1], mask[:, ::-1], "b", zero, zero)
        return self._label(np.concatenate([ahead, back[:, ::-1]], axis=2))

    def _label(self, both: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(both @ self.weights["o"] + self.weights["c"])[..., 0]))

    def long_scores(self, blocks: list, known: dict) -> np.ndarray:
        """One page of any length, CHUNK blocks at a time, carrying the states across chunks."""
        n, sides = len(blocks), {}
        cuts = [(a, min(n, a + CHUNK)) for a in range(0, n, CHUNK)]
        for side, order in (("f", cuts), ("b", cuts[::-1])):
            h = c = np.zeros((1, HIDDEN), dtype=np.float32)
            hidden = np.zeros((n, HIDDEN), dtype=np.float32)
            for a, b in order:
                gates = self._inputs(block_vectors(blocks[a:b], a, n, known)[None], side)
                turn = slice(None) if side == "f" else slice(None, None, -1)
                got, h, c = self._run(gates[:, turn], np.ones((1, b - a), dtype=np.float32), side, h, c)
                hidden[a:b] = got[0, turn]
            sides[side] = hidden
        return self._label(np.concatenate([sides["f"], sides["b"]], axis=1))

    def _gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        zero = np.zeros((len(x), HIDDEN), dtype=np.float32)
        kept: dict = {"f": [], "b": []}
        ahead, _, _ = self._run(self._inputs(x, "f"), mask, "f", zero, zero, kept["f"])
        back, _, _ = self._run(self._inputs(x, "b")[:, ::-1], mask[:, ::-1], "b", zero, zero, kept["b"])
        both = np.concatenate([ahead, back[:, ::-1]], axis=2)
        err = ((self._label(both) - y) * mask / mask.sum())[..., None]
        grads["o"] = np.einsum("pth,pto->ho", both, err)
        grads["c"] = err.sum(axis=(0, 1))
        down = err @ self.weights["o"].T
        for side, part in (("f", down[..., :HIDDEN]), ("b", down[:, ::-1, HIDDEN:])):
            xs = x if side == "f" else x[:, ::-1]
            dh, dc = zero.copy(), zero.copy()
            w = self.weights["h" + side]
            for t in range(x.shape[1] - 1, -1, -1):
                i, f, o, g, c, h, th, m = kept[side][t]
                dh = dh + part[:, t]
                dcn = dc + m * dh * o * (1 - th**2)
                dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), dh * th * o * (1 - o), dcn * i * (1 - g**2)], axis=1) * m
                grads["x" + side] += xs[:, t].T @ dz
                grads["h" + side] += h.T @ dz
                grads["b" + side] += dz.sum(axis=0)
                dh, dc = dz @ w.T + (1 - m) * dh, m * dcn * f + (1 - m) * dc
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 24, rate: float = 0.015, seed: int = 5) -> None:
        r, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        by_length = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [by_length[a : a + batch] for a in range(0, len(pages), batch)]
        for epoch in range(epochs):
            for k in r.permutation(len(groups)):
                x, mask, y = padded([pages[i] for i in groups[k]])
                grads = self._gradients(x, mask, y)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                for name, g in grads.items():
                    g = g / max(1.0, norm)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g**2
                    move = rate * (1 - 0.9 * epoch / epochs) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                    self.weights[name] = (self.weights[name] - move).astype(np.float32)


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), steps, PATH_DIMS + WORD_DIMS + FIGURES), dtype=np.float32)
    mask, y = np.zeros((len(pages), steps), dtype=np.float32), np.zeros((len(pages), steps), dtype=np.float32)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], mask[i, : len(b)], y[i, : len(b)] = a, 1, b
    return x, mask, y


def make_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A laid-out page and the blocks of its article, for training."""
    pick = lambda *options: options[int(r.integers(len(options)))]
    word = lambda: "".join(pick(*"bcdfghklmnprstvwz", "", "st", "tr") + pick(*"aeiou", "\u00e9", "ou") + pick("", "", "n", "r", "s", "t") for _ in range(int(r.integers(1, 4))))
    mark: list[str] = []

    def text(low: int, high: int) -> str:
        ws = [word() for _ in range(int(r.integers(low, high)))]
        odd = r.random()
        if odd < 0.15:  # text that looks like junk is still text
            sign = pick(*"#*%$!~^+=@", "&amp;") * int(r.integers(1, 4))
            ws = [w + sign for w in ws]
        elif odd < 0.25:
            ws = [w.upper() for w in ws]
        elif odd < 0.33:
            sign = pick("|", "/", "-", "&gt;", "&middot;")
            ws = [x for w in ws for x in (w, sign)]
        stops = [w + ("." if r.random() < 0.1 else "," if r.random() < 0.08 else "") for w in ws]
        return " ".join(stops).capitalize() + pick(".", ".", "")

    def own(s: str) -> str:
        mark.append(SPACE.sub(" ", html.unescape(re.sub(r"<[^>]*>", "", s))).strip())
        return s

    menu = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{pick(word().capitalize(), text(1, 4))}</a></li>" for _ in range(int(r.integers(2, 9)))) + "</ul>"
    wrap = lambda tag, names, inside: f"<{tag}{pick(f' class=\"{pick(*names)}\"', f' id=\"{pick(*names)}\"')}>{inside}</{tag}>"

    def junk() -> str:
        kind = pick("nav", "ad", "aside", "notice", "form", "share", "related", "header", "footer", "comments")
        if kind == "nav":
            return pick(f"<nav>{menu()}</nav>", wrap("div", ("menu", "main-menu", "navbar", "breadcrumbs", "navigation", "topnav", "toc", "pagination"), menu()), wrap("ul", ("menu", "nav-list", "crumbs"), menu()[4:-5]), wrap("p", ("breadcrumb", "nav"), " &raquo; ".join(f"<a href='/{word()}'>{word()}</a>" for _ in range(3))))
        if kind == "ad":
            return wrap(pick("div", "aside", "section"), ("ad", "ads", "advert", "ad-box", "sponsored", "promo", "banner-ad", "advertisement"), pick(text(2, 30), f"<p>{text(2, 40)}</p>", f"<a href='/x'>{text(2, 10)}</a>"))
        if kind == "aside":
            return pick(f"<aside><h3>{text(1, 5)}</h3>{menu()}</aside>", f"<aside><p>{text(4, 40)}</p></aside>", wrap("div", ("sidebar", "side", "widget", "right-rail", "sidebar-box"), f"<h3>{text(1, 4)}</h3>" + pick(menu(), f"<p>{text(4, 40)}</p>")))
        if kind == "notice":
            return wrap(pick("div", "section", "p"), ("cookie", "cookie-notice", "notice", "consent", "newsletter", "popup", "alert", "banner", "gdpr", "subscribe", "paywall"), pick(text(4, 40), f"<p>{text(4, 30)}</p><button>{word()}</button>"))
        if kind == "form":
            return f"<form action='/s'><label>{text(1, 6)}</label><input name='q'><button>{word()}</button>{pick('', f'<p>{text(2, 15)}</p>')}</form>"
        if kind == "share":
            return wrap("div", ("share", "social", "tools", "tags", "meta-links"), pick(menu(), f"<span>{text(1, 4)}</span> <a href='/f'>{word()}</a>"))
        if kind == "related":
            return wrap(pick("div", "section"), ("related", "recommended", "more-stories", "trending", "popular"), f"<h3>{text(1, 5)}</h3>" + pick(menu(), "".join(f"<p><a href='/r'>{text(3, 12)}</a></p>" for _ in range(3))))
        if kind == "header":
            return pick(f"<header><h2>{text(1, 5)}</h2><p>{text(2, 12)}</p></header>", wrap("div", ("header", "masthead", "site-header", "topbar", "site-title"), text(1, 8)))
        if kind == "footer":
            return foot()
        each = "".join(f"<div class='comment'><b>{word()}</b><p>{text(3, 60)}</p></div>" for _ in range(int(r.integers(1, 5))))
        return pick(wrap("section", ("comments", "comment-list", "replies", "discussion", "respond"), f"<h3>{text(1, 3)}</h3>" + each), wrap("div", ("comments", "user-comments", "disqus", "reader-comments"), each), wrap("ol", ("comment-list", "commentlist"), f"<li class='comment'><p>{text(3, 60)}</p></li>" * int(r.integers(1, 3))))

    def foot() -> str:
        return pick(f"<footer>&copy; {word()}.example.com &middot; {text(2, 14)}</footer>", f"<footer><p>{text(2, 20)}</p>{menu()}</footer>", wrap("div", ("footer", "site-footer", "copyright", "legal", "bottom"), text(3, 25)))

    def body() -> str:
        out = [f"<{(h := pick('h1', 'h1', 'h2'))}>{own(text(1, 14))}</{h}>"] if r.random() < 0.85 else []
        for _ in range(int(pick(1, 2, 3, 5, 8, 14, 30))):
            long = pick((1, 3), (1, 12), (10, 60), (40, 160))
            form = r.random()
            if form < 0.6:
                out.append(f"<p>{own(text(*long))}</p>")
            elif form < 0.75:  # end tags left out
                out.append(f"<p>{pick('', '<b>', '<span>', '<em>')}{own(text(*long))}{pick('', '<br>', '<br/>')}")
            elif form < 0.8:
                out.append(f"<h2>{own(text(1, 8))}</h2>")
            elif form < 0.86:
                out.append("<ul>" + "".join(f"<li>{own(text(2, 20))}</li>" for _ in range(3)) + "</ul>")
            elif form < 0.9:
                out.append(f"<blockquote><p>{own(text(*long))}</p></blockquote>")
            elif form < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{own(text(1, 5))}</td><td>{own(text(1, 5))}</td></tr>" for _ in range(2)) + "</table>")
            else:
                a = text(3, 20)
                out.append(f"<p>{own(a + f' <a href={chr(34)}/l{chr(34)}>' + word() + '</a> ' + text(3, 20))}</p>")
            if r.random() < 0.06:
                out.append(junk())
        return "".join(out)

    main = pick(
        lambda: f"<article>{body()}</article>",
        lambda: f"<article>{body()}</article>",
        lambda: f"<main><article>{body()}</article></main>",
        lambda: f"<main>{body()}</main>",
        lambda: wrap("div", ("content", "article", "post", "entry-content", "story", "article-body", "main-content", "post-content"), body()),
        lambda: f"<section class='article-text'>{body()}</section>",
        lambda: f"<div class='page'><div class='wrapper'><article class='post'>{body()}</article></div></div>",
        lambda: f"<div id='{word()}'><div class='{word()}'>{body()}</div></div>",
        lambda: f"<table><tr><td>{menu()}</td><td>{body()}</td></tr></table>",
        lambda: f"<table class='layout'><tr><td{pick('', ' class=left', ' width=150')}>{pick(menu(), '<br>'.join(f'<a href=/{word()}>{word()}</a>' for _ in range(5)))}</td><td{pick('', ' class=main')}>{body()}</td>{pick('', f'<td>{junk()}</td>')}</tr></table>",
    )
    before = "".join(junk() for _ in range(int(r.integers(0, 4))))
    inside = main()
    after = "".join(junk() for _ in range(int(r.integers(0, 4))))
    page = f"<!DOCTYPE html><html><head><title>{text(1, 12)}</title>{pick('', '<script>if (a < b) { c = "</div>"; }</script>', '<style>p { margin: 0 }</style>')}</head><body>{pick('', f'<nav>{menu()}</nav>')}{before}{inside}{after}{pick(foot(), foot(), '')}" + pick("</body></html>", "")
    return page, mark


_TRAINED: dict = {}


def trained(training_pages: int = 500, seed: int = 5) -> BiLSTM:
    """The labeller, trained on generated pages; kept for the life of the process."""
    if (training_pages, seed) not in _TRAINED:
        r, known, rows = np.random.default_rng(seed), {}, []
        while len(rows) < training_pages:
            page, own = make_page(r)
            blocks, left = leaf_blocks(page), {}
            for t in own:
                left[t] = left.get(t, 0) + 1
            if not 0 < len(blocks) < 150:
                continue
            y = np.zeros(len(blocks), dtype=np.float32)
            for i, (_, text, _) in enumerate(blocks):
                if left.get(text):
                    left[text] -= 1
                    y[i] = 1
            rows.append((block_vectors(blocks, 0, len(blocks), known), y))
        model = BiLSTM(seed)
        model.fit(rows)
        _TRAINED[training_pages, seed] = model
    return _TRAINED[training_pages, seed]


def main_texts(model: BiLSTM, pages: list, most: int = 20_000) -> list[str]:
    """Main text of each page; pages of like length are labelled together, about `most` blocks at a time."""
    known: dict = {}
    cut = [leaf_blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(cut[order[end]]) * (end + 1 - at) <= most and len(cut[order[end]]) <= CHUNK:
            end += 1
        some = order[at:end]
        at = end
        if len(cut[some[0]]) > CHUNK:
            scores = [model.long_scores(cut[some[0]], known)]
        else:
            x, mask, _ = padded([(block_vectors(cut[i], 0, len(cut[i]), known), np.zeros(len(cut[i]))) for i in some])
            scores = list(model.scores(x, mask))
        for i, s in zip(some, scores):
            out[i] = " ".join(text for (_, text, _), p in zip(cut[i], s) if p > 0.5)
    return out


def extract(pages: DataFrame, model: BiLSTM | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    ready_for_python(pages.sparkSession)
    labeller = model or trained()

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series(main_texts(labeller, column.tolist()), dtype=object)

    found = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), text_of(F.col(f"`{html_col}`")).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
