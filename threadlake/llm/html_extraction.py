"""Main-text extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, scripts,
styles and comments left out. Each block becomes a vector: its hashed tag path
(names, classes and ids of the open elements), its hashed words, and a few
measures. A bidirectional LSTM in numpy reads a page's vectors in order, so each
block is judged with the whole page around it, and labels it as content or not.
The content blocks, in page order, are the text.

The labeller is trained where it is used, on pages that ``sample_page`` makes
up with known labels (``PAGES`` of them, a fixed seed): menus, headers, notices,
adverts, sidebars, forms, comments and footers around articles in many layouts.
Many of them have class names that say nothing, hardly any elements, or a script
without spaces, and some are learned from without their words, so that the labeller
leans on structure. Training takes half a minute at most and gives the same weights every time.

Defined cases: null or empty HTML has an empty text; text outside any element,
unclosed, unknown or crossing tags and cut-off pages are read as far as they go;
no block is capped; repeated rows each get their text; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.arrow_text import released

PATH_SIZE, WORD_SIZE, MEASURES = 128, 32, 10
WIDTH = PATH_SIZE + WORD_SIZE + MEASURES
HIDDEN = 20
#: Pages made up for training, and rounds over them.
PAGES, ROUNDS = 1800, 7
#: Odds that a page is learned from without its words, so that they only help.
WORDLESS = 0.3
#: Cells (pages x blocks) of one forward pass.
CELLS = 16_384

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
MARK = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")
#: Elements whose content is never text.
DARK = frozenset(("script", "style", "noscript", "template", "iframe", "head", "title", "desc", "metadata", "textarea", "select"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
#: Elements that a head may hold; any other start tag ends an open head, unless one of FOREIGN is open.
IN_HEAD = frozenset(("base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"))
FOREIGN = ("template", "svg", "math")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "math", "mi", "mn", "mo", "mtext", "mrow", "mfrac", "msqrt", "msub", "msup", "msubsup"))
#: Elements that a new one of their kind, or the end of an element around them, closes.
LOOSE = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
BREAKS_P = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))


class _Element:
    """An open element: what it closes with, and the hashed path down to it.

    Steps from a block to its path cost nothing: each element has the cells of the
    whole path above it, and the nearest one that isn't inline.
    """

    __slots__ = ("block", "cells", "depth", "name", "path")

    def __init__(self, name: str, tokens: list[str], above: _Element | None, depth: int) -> None:
        self.name, self.depth = name, depth
        if name in INLINE:
            self.block, self.path, self.cells = (above.block, above.path, above.cells) if above else (None, 0, (0, 0))
            return
        self.block = self
        whole, first, second = token_cells(tuple(tokens))
        self.path = whole | (above.path if above else 0)
        self.cells = (first, second)


@lru_cache(maxsize=50_000)
def token_cells(tokens: tuple[str, ...]) -> tuple[int, int, int]:
    """Bits of an element's tokens anywhere on a path, as its last element, and as its last but one."""
    out = []
    for depth in ("", "0", "1"):
        bits = 0
        for i, token in enumerate(tokens):
            bits |= 1 << (zlib.crc32(f"{'c' if i else 't'}{depth}{token}".encode()) % PATH_SIZE)
        out.append(bits)
    return out[0], out[1], out[2]


def blocks(page: str) -> list[tuple[str, int, int]]:
    """(text, path cells, characters within links) of the leaf blocks of a page.

    The time is linear in the page: every element is looked at when it opens and
    when it closes, however deep it stands.
    """
    out: list[tuple[str, int, int]] = []
    stack: list[_Element] = []
    parts: list[str] = []
    opened: Counter[str] = Counter()
    linked = dark = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                at = stack[-1].block if stack else None
                bits = 0
                if at is not None:
                    up = stack[at.depth - 1].block if at.depth else None
                    bits = at.path | at.cells[0] | (up.cells[1] if up is not None else 0)
                out.append((text, bits, linked))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal dark
        for e in stack[k:]:
            dark -= e.name in DARK
            opened[e.name] -= 1
        del stack[k:]

    def closed(name: str) -> None:
        """Closes the last open element of that name and all within it."""
        k = len(stack) - 1
        while stack[k].name != name:
            k -= 1
        close(k)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        found = m.start() if m else n
        if found > at and not dark:
            piece = page[at:found]
            parts.append(piece)
            if opened["a"]:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1] and opened["head"] and name not in IN_HEAD and not any(opened[x] for x in FOREIGN):
            closed("head")
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[1]:
            if opened[name]:
                closed(name)
            continue
        if (name in BREAKS_P or name in LOOSE) and stack and (near := stack[-1].block) is not None:
            if near.name in LOOSE.get(name, ()) or near.name == "p" and name in BREAKS_P:
                close(near.depth)
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        marks = " ".join(v for a in MARK.findall(m[3] or "") for v in a[1:] if v).lower()
        stack.append(_Element(name, NAME.findall(f"{name} {marks}"), stack[-1] if stack else None, len(stack)))
        opened[name] += 1
        dark += name in DARK
    flush()
    return out


class _Cells(dict):
    """Hashed cell by word, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        cell = self[word] = zlib.crc32(word.encode()) % WORD_SIZE
        return cell


WORD_CELLS = _Cells()
# Where scripts that may do without spaces begin, and marks that end or part sentences in any script.
SPACELESS, ENDS, PARTS = "\u0e00", ".!?…\"'”:。！？」』؟।", ".,。、，؛،।"


def words_of(text: str) -> list[str]:
    """Lower-cased words; a long run of a script without spaces counts as words of three characters."""
    words = text.lower().split()
    if not any(len(w) > 9 and max(w) >= SPACELESS for w in words):
        return words
    return [w[i : i + 3] for w in words for i in range(0, len(w), 3 if max(w) >= SPACELESS else len(w))]


def vectors(page: list[tuple[str, int, int]]) -> np.ndarray:
    """A row for each block of a page."""
    n = len(page)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    cells_ = np.frombuffer(b"".join(path.to_bytes(PATH_SIZE // 8, "little") for _, path, _ in page), np.uint8).reshape(n, PATH_SIZE // 8)
    out[:, :PATH_SIZE] = np.unpackbits(cells_, axis=1, bitorder="little")
    sizes, cells = [], []
    for text, _, _ in page:
        words = words_of(text)
        sizes.append(len(words))
        cells.extend(map(WORD_CELLS.__getitem__, words))
    size = np.array(sizes)
    counts = np.bincount(np.repeat(np.arange(n) * WORD_SIZE, size) + np.array(cells), minlength=n * WORD_SIZE)
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.sqrt(counts.reshape(n, WORD_SIZE) / size[:, None])
    m = out[:, PATH_SIZE + WORD_SIZE :]
    length = np.array([len(t) for t, _, _ in page])
    m[:, 0] = np.log1p(size) / 4
    m[:, 1] = np.minimum(1.0, np.array([k for _, _, k in page]) / length)
    m[:, 2] = [t[-1] in ENDS for t, _, _ in page]
    m[:, 3] = np.arange(n) / n
    m[:, 4] = np.minimum(1.0, np.array([sum(map(t.count, PARTS)) for t, _, _ in page]) / (size + 1))
    m[:, 5] = np.minimum(1.0, length / size / 10)
    m[:, 6] = ["©" in t or "»" in t or "|" in t for t, _, _ in page]
    m[:, 7] = 1.0
    # How much of the page's unlinked text stands at the same path, and how much in this block.
    free = length * (1 - m[:, 1])
    places: dict[int, int] = {}
    at = np.array([places.setdefault(path, len(places)) for _, path, _ in page])
    m[:, 8] = np.bincount(at, weights=free)[at] / max(1.0, free.sum())
    m[:, 9] = free / max(1.0, free.max())
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        scale = lambda a, b: (rng.standard_normal((a, b)) * np.sqrt(1.0 / a)).astype(np.float32)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"], self.w[f"h{d}"] = scale(WIDTH, 4 * HIDDEN), scale(HIDDEN, 4 * HIDDEN)
            self.w[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["o"], self.w["c"] = scale(2 * HIDDEN, 1)[:, 0], np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, HIDDEN) over x (time, page, WIDTH)."""
        steps, n = x.shape[:2]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        fed = x @ self.w[f"x{d}"] + self.w[f"b{d}"]
        out, trace = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            g = fed[t] + h @ self.w[f"h{d}"]
            gates = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            u = np.tanh(g[:, 3 * HIDDEN :])
            before, c0 = h, c
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                trace.append((i, f, o, u, c0, tc, before))
        return out, trace

    @staticmethod
    def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each page's steps in reverse, padding left behind."""
        t = np.arange(x.shape[0])[:, None]
        return x[np.where(t < sizes, sizes - 1 - t, t), np.arange(x.shape[1])]

    def forward(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        f, tf = self._run(x, "f", keep)
        b, tb = self._run(self._turned(x, sizes), "b", keep)
        h = np.concatenate([f, self._turned(b, sizes)], axis=2)
        return _sigmoid(h @ self.w["o"] + self.w["c"]), h, tf, tb

    def _back(self, d: str, x: np.ndarray, trace: list, dh: np.ndarray, grads: dict) -> None:
        wh = self.w[f"h{d}"]
        later, dc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        dg = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        gh = np.zeros_like(wh)
        for t in range(len(trace) - 1, -1, -1):
            i, f, o, u, c0, tc, before = trace[t]
            up = dh[t] + later
            dc = dc + up * o * (1 - tc * tc)
            g = dg[t]
            g[:, :HIDDEN] = dc * u * i * (1 - i)
            g[:, HIDDEN : 2 * HIDDEN] = dc * c0 * f * (1 - f)
            g[:, 2 * HIDDEN : 3 * HIDDEN] = up * tc * o * (1 - o)
            g[:, 3 * HIDDEN :] = dc * i * (1 - u * u)
            gh += before.T @ g
            later = g @ wh.T
            dc = dc * f
        grads[f"h{d}"] = gh
        grads[f"x{d}"] = x.reshape(-1, WIDTH).T @ dg.reshape(-1, 4 * HIDDEN)
        grads[f"b{d}"] = dg.sum(axis=(0, 1))

    def gradients(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the real steps, and its gradients."""
        p, h, tf, tb = self.forward(x, sizes, True)
        real = np.arange(len(x))[:, None] < sizes
        dz = ((p - y) * real / real.sum()).astype(np.float32)
        loss = -(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-7, 1)) * real).sum() / real.sum()
        grads = {"o": np.einsum("tnh,tn->h", h, dz), "c": np.array([dz.sum()], np.float32)}
        dh = dz[:, :, None] * self.w["o"]
        self._back("f", x, tf, dh[:, :, :HIDDEN], grads)
        self._back("b", self._turned(x, sizes), tb, self._turned(dh[:, :, HIDDEN:], sizes), grads)
        return float(loss), grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int, rate: float = 0.012, seed: int = 3) -> float:
        """Adam over batches of pages of like length, slower and slower; the weights are the mean of the last third's. The last round's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step, kept = 0, 0
        mean = {k: np.zeros_like(x) for k, x in self.w.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [order[i : i + 16] for i in range(0, len(order), 16)]
        for past in range(rounds):
            losses, pace = [], rate * (1 - past / rounds)
            for k in rng.permutation(len(batches)):
                x, sizes = stacked([pages[i][0] for i in batches[k]])
                y = np.zeros(x.shape[:2], np.float32)
                for j, i in enumerate(batches[k]):
                    y[: sizes[j], j] = pages[i][1]
                loss, grads = self.gradients(x, y, sizes)
                losses.append(loss)
                step += 1
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.w[name] -= pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
                if 3 * past >= 2 * rounds:
                    kept += 1
                    for name, x in self.w.items():
                        mean[name] += (x - mean[name]) / kept
        if kept:
            self.w = mean
        return float(np.mean(losses))

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is content, page by page."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            most = len(pages[order[-1]])
            take = max(1, CELLS // most)
            batch, order = order[-take:], order[:-take]
            x, sizes = stacked([pages[i] for i in batch])
            p = self.forward(x, sizes)[0]
            for j, i in enumerate(batch):
                out[i] = p[: sizes[j], j] >= 0.5
        return out


def stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((sizes.max(), len(pages), WIDTH), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
    return x, sizes


# Words that made-up pages use around their articles.
MENU = "home about contact news sports blog shop products services support login register account search help faq jobs press archive topics startseite kontakt accueil inicio nosotros".split()
LEGAL = "copyright © all rights reserved terms privacy policy imprint impressum datenschutz mentions légales aviso legal sitemap powered by".split()
NOTICE = "we use cookies to improve your experience accept decline settings by continuing you agree subscribe newsletter sign up free".split()
ADVERT = "advertisement sponsored buy now sale offer discount shop deal click here limited anzeige publicité anuncio".split()
SOCIAL = "share tweet like follow us comments reply replies report posted by user ago min read more related articles popular tags previous next older newer print rate see also archives most".split()
ALPHABETS = ("etaoinshrdlucmfwypvbgk", "enisratdhulcgmobwfkzäöüß", "esaitnrulodcpmévqfbghèàç", "eaosrnidlctumpbgvyqhfóíáñ", "оеаинтсрвлкмдпуяыьгзбч", "αοιετσνηυρπκμλωδ", "اليمنورتبةعدسفهكقحجشطص")
# Signs of scripts that do without spaces, each with the mark that ends a sentence, if any.
SIGNS = (("のにはをたがでてとしれさいあるなかもこれ日本人大年一国中会出学時行", "。"), ("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会", "。"), ("กขคงจชดตทนบปพมยรลวสหอาเแโไ", ""))
# How sites mark their content, and what stands around it.
CONTENT_AT = ("article", "main", "div class=content", "div id=content", "div class=article-body", "section class=post", "div class=entry-content", "div role=main", "div class=story", "div itemprop=articleBody", "div class=post-body", "div class=text", "article class=post")
PLACES = ("row", "container", "wrapper", "inner", "column", "left", "right", "wide", "col-md-4", "col-md-8", "grid", "box", "block", "clearfix")
PLAIN_AT = ("div", "div", "div", "section", "div class=row", "div class=col-md-8", "div class=col-lg-9", "div class=container", "div class=wrapper", "div class=inner", "div class=grid", "td", "div class=column")
AROUND = {
    "menu": (("nav", "nav class=menu", "nav class=breadcrumb", "nav role=navigation"), ("div class=nav", "div id=menu", "ul class=navigation", "div class=navbar", "div class=breadcrumbs", "ul class=menu", "div class=topbar")),
    "header": (("header", "header class=site-header", "header role=banner"), ("div class=header", "div id=header", "div class=masthead", "div class=branding")),
    "notice": (("div class=cookie", "div class=consent", "section class=gdpr"), ("div id=cookie-notice", "div class=banner", "div class=notice", "div class=newsletter", "div class=alert", "div class=popup")),
    "advert": (("div class=ad", "aside class=ad", "ins class=adsbygoogle"), ("div class=ads", "div class=advert", "div id=ad", "div class=sponsored", "div class=promo", "div class=advertisement", "div class=sponsor")),
    "sidebar": (("aside", "aside class=related", "aside role=complementary"), ("div class=sidebar", "div id=sidebar", "div class=widget", "section class=related", "div class=recommended", "div class=popular")),
    "form": (("form", "form class=search", "form id=login", "form class=subscribe"), ("div class=form", "div class=search", "div class=login", "div class=subscribe")),
    "comments": (("section id=comments", "section class=comments"), ("div class=comments", "div id=disqus", "ol class=comment-list", "div class=comment", "div class=responses", "div class=replies")),
    "share": (("div class=share", "div class=social", "ul class=share-buttons"), ("div class=tags", "div class=meta", "div class=sharing", "div class=follow")),
    "footer": (("footer", "footer class=site-footer", "footer role=contentinfo"), ("div class=footer", "div id=footer", "div class=copyright", "div class=colophon", "div class=bottom")),
}
EMPHASIS = ("b", "i", "em", "strong", "span", "code", "u", "mark", "small", "a href=/x")


class _Writer:
    """Makes up one page: its HTML and the texts of its content blocks."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.content = rng, [], []
        self.gap, stop = " ", "."
        letters = rng.choice(ALPHABETS)
        if rng.random() < 0.15:
            letters, stop = rng.choice(SIGNS)
            self.gap = ""
        self.stops = "...?!".replace(".", stop) if stop else (rng.choice(("", " ")),)
        #: What paragraphs are, whether classes say nothing, and how often a paragraph is full of links.
        self.para = rng.choice(("p", "p", "p", "p", "p", "div", "div class=para"))
        self.hashed: dict[str, str] | None = {} if rng.random() < 0.3 else None
        self.wrapped = rng.random() < 0.15
        self.linking = rng.choice((0.0, 0.0, 0.1, 0.6))
        self.words = ["".join(rng.choice(letters[: rng.choice((8, 14, 30))]) for _ in range(rng.choice((1, 2, 2, 3, 4, 5, 6, 8, 11)))) for _ in range(150)]
        #: How often an end tag is left out, a sentence ends with its mark, and boxes have telling names.
        self.loose = rng.choice((0.0, 0.0, 0.03, 0.3))
        self.marked = rng.choice((1.0, 0.9, 0.5))
        self.named = rng.choice((0.3, 0.8, 1.0))

    def word(self) -> str:
        return self.words[int(150 * self.rng.random() ** 2)]

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.gap.join(self.word() for _ in range(self.rng.randint(low, high))).capitalize() + (self.rng.choice(self.stops) if self.rng.random() < self.marked else "")

    def prose(self) -> str:
        return self.gap.join(self.sentence() for _ in range(self.rng.choice((1, 1, 1, 2, 3, 5, 9))))

    def some(self, words: list[str], low: int, high: int) -> str:
        return " ".join(self.rng.choice(words) if self.rng.random() < 0.6 else self.word() for _ in range(self.rng.randint(low, high)))

    def filler(self, words: list[str]) -> str:
        """Of the kind's words, or of any; of the kind's where nothing else tells it."""
        return self.some(words, 2, 14) if self.hashed is not None or self.rng.random() < 0.5 else self.sentence()

    def tag(self, spec: str, inner) -> None:
        name, *marks = spec.split(" ", 1)
        if marks and self.hashed is not None and not marks[0].startswith("href"):
            kind, value = marks[0].split("=")
            marks = [f"{kind}=" + self.hashed.setdefault(value, self.rng.choice(("sc-", "_", "css-")) + "".join(self.rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)))]
        mark = "" if not marks else " " + re.sub(r"=(.*)", r'="\1"', marks[0])
        self.out.append(f"<{name}{mark}>")
        inner()
        if name not in LOOSE and name != "b" or self.rng.random() >= self.loose:
            self.out.append(f"</{name}>")

    def text(self, spec: str, text: str) -> None:
        self.tag(spec, lambda: self.out.append(text))

    def good(self, spec: str, text: str) -> None:
        """A content block; some of its words may stand in inline elements."""
        r = self.rng
        self.content.append(" ".join(text.split()))
        words = text.split(" ")
        if len(words) > 5 and r.random() < self.linking:
            for k in range(r.randrange(3), len(words), r.choice((2, 3, 5))):
                words[k] = f'<a href="/x">{words[k]}</a>'
        elif r.random() < 0.3:
            a = r.randrange(len(words))
            b = r.choice((a + 1, a + 3, len(words))) if r.random() < 0.8 else len(words)
            name, *mark = r.choice(EMPHASIS).split(" ")
            words[a] = f"<{name}{' ' + mark[0] if mark else ''}>{words[a]}"
            words[min(b, len(words)) - 1] += f"</{name}>" if r.random() < 0.9 or name == "a" else ""
        if r.random() < 0.1:
            words[-1] += "<br>"
        elif r.random() < 0.1 and len(words) > 4 and not any("<" in w for w in words):
            words[len(words) // 2] = "<br>" + words[len(words) // 2]
        self.text(spec, " ".join(words))

    def spec(self, kind: str) -> str:
        plain, named = AROUND[kind]
        return self.placed(self.rng.choice(plain if self.rng.random() < 0.5 else named))

    def placed(self, spec: str) -> str:
        """Sometimes with a further class that only says where the element stands."""
        r = self.rng
        if r.random() < 0.25 and " class=" in spec:
            name, mark = spec.split(" class=")
            place = r.choice(PLACES)
            return f"{name} class={place} {mark}" if r.random() < 0.5 else f"{name} class={mark} {place}"
        return spec

    def links(self, spec: str, words: list[str], n: int) -> None:
        def items() -> None:
            for _ in range(n):
                label = self.rng.choice(words).capitalize() if self.rng.random() < 0.5 else " ".join(self.word() for _ in range(self.rng.choice((1, 1, 2, 5))))
                self.tag("li", lambda label=label: self.out.append(f'<a href="/x">{label}</a>'))

        self.tag(spec, lambda: self.tag("ul", items) if self.rng.random() < 0.8 else self.out.extend(f'<a href="/x">{self.word()}</a> ' for _ in range(n)))

    def noise(self, kind: str) -> None:
        r, spec = self.rng, self.spec(kind)
        if kind == "menu":
            self.links(spec if r.random() < 0.85 else "div", MENU, r.randint(2, 9))
        elif kind == "header":
            self.tag(spec, lambda: (self.text(r.choice(("h1", "h2")) if r.random() < 0.08 else r.choice(("div class=logo", "div class=logo", "p", "div", "span", "a href=/", "a href=/")), self.filler(MENU)), r.random() < 0.4 and self.text("p", self.filler(MENU))))
        elif kind == "notice":
            self.tag(spec, lambda: (self.text("p", self.filler(NOTICE)), r.random() < 0.5 and self.text("button", "OK")))
        elif kind == "advert":
            self.tag(spec, lambda: self.text("p", self.filler(ADVERT)) if r.random() < 0.3 else self.out.append(self.filler(ADVERT)))
        elif kind == "sidebar":
            self.tag(spec, lambda: (self.text(r.choice(("h2", "h3", "h4")), self.some(SOCIAL, 1, 4)), self.links("div", SOCIAL, r.randint(2, 5)) if self.hashed is not None or r.random() < 0.6 else self.text("p", self.prose())))
        elif kind == "form":
            self.tag(spec, lambda: (self.text("label", self.some(NOTICE, 1, 4)), self.out.append("<input name=q>"), self.text("button", self.word()), r.random() < 0.3 and self.text("p", self.filler(NOTICE))))
        elif kind == "comments":
            one = lambda: self.tag(r.choice(("div class=comment", "li class=comment", "article class=comment", "div", "li")), lambda: (self.text(r.choice(("span class=author", "p class=meta", "div class=user", "b")), self.some(SOCIAL, 1, 4)), self.text("p", self.prose())))
            self.tag(spec, lambda: [self.text("h3", self.some(SOCIAL, 1, 3)), *[one() for _ in range(r.randint(1, 5))]])
        elif kind == "share":
            self.links(spec, SOCIAL, r.randint(2, 5))
        else:
            self.tag(spec, lambda: (self.out.append("&copy; " * (r.random() < 0.6) + self.filler(LEGAL)) if r.random() < 0.5 else self.text("p", self.filler(LEGAL)), r.random() < 0.3 and self.links("div", LEGAL, r.randint(2, 4)), r.random() < 0.15 and self.tag("ul", lambda: [self.text("li", self.filler(LEGAL)) for _ in range(r.randint(1, 3))])))

    def part(self, odds: float) -> None:
        """A piece of an article; with these odds, something that stands between its pieces."""
        r, x = self.rng, self.rng.random()
        if r.random() < odds:
            self.noise(r.choice(("advert", "share", "sidebar", "notice", "form")))
        elif x < 0.60:
            if self.wrapped:
                self.tag("div class=para", lambda: self.good("p", self.prose()))
            else:
                self.good(self.para, self.prose())
        elif x < 0.72:
            self.good(r.choice(("h2", "h2", "h3", "h4")), self.sentence(1, 7))
        elif x < 0.84:
            short = r.random() < 0.3
            item = (lambda: " ".join(([str(r.randint(1, 900))] if r.random() < 0.3 else []) + [self.word() for _ in range(r.randint(1, 4))])) if short else (lambda: self.sentence(1, 5)) if r.random() < 0.5 else self.prose
            if short and r.random() < 0.6:
                self.good(r.choice(("h2", "h3", "h4")), self.sentence(1, 2))
            self.tag(r.choice(("ul", "ol", "ul class=list", "ul class=items", "ol class=steps")), lambda: [self.good("li", item()) for _ in range(r.randint(2, 6))])
        elif x < 0.88:
            cells, rows = r.randint(2, 4), r.randint(2, 4)
            row = lambda cell: self.tag("tr", lambda: [self.good(cell, self.sentence(1, 4)) for _ in range(cells)])
            self.tag("table", lambda: [row("th"), *[row("td") for _ in range(rows)]])
        elif x < 0.91:
            self.tag("blockquote", lambda: self.good("p", self.prose())) if r.random() < 0.5 else self.good("blockquote", self.prose())
        elif x < 0.94:
            self.good("pre", self.sentence(2, 20))
        elif x < 0.97:
            self.tag("figure", lambda: (self.out.append('<img src="/i.png" alt="">'), self.good("figcaption", self.sentence(2, 12))))
        else:
            self.tag("dl", lambda: [(self.good("dt", self.sentence(1, 3)), self.good("dd", self.sentence(2, 12))) for _ in range(r.randint(1, 4))])

    def article(self) -> None:
        r = self.rng
        title = self.sentence(2, 14)
        within = r.random() < 0.7

        def head() -> None:
            if r.random() < 0.1:
                self.good("p", self.sentence(2, 5))
            if self.wrapped and r.random() < 0.5:
                self.tag("div class=head", lambda: self.good("h1", title))
            elif r.random() < 0.95:
                self.good(r.choice(("h1", "h1", "h1", "h1 class=title", "h2", "h2", "div class=title", "div")), title)
            if r.random() < 0.1:
                row = lambda: self.tag("tr", lambda: (self.good("th", self.sentence(1, 2)), self.good("td", self.sentence(1, 3))))
                self.tag(r.choice(("table", "table class=infobox", "table class=facts")), lambda: [row() for _ in range(r.randint(1, 5))])
            if r.random() < 0.12:
                self.tag("div class=intro" if r.random() < 0.3 else "div", lambda: self.good("p", self.prose()))

        def body() -> None:
            if within:
                self.tag("header", head) if r.random() < 0.1 else head()
            odds = r.choice((0.0, 0.0, 0.06, 0.15))
            pieces = lambda n: [self.part(odds if k else 0.0) for k in range(n)]
            if r.random() < 0.25:
                for _ in range(r.randint(1, 3)):
                    self.tag(r.choice(("section", "div", "div class=section")), lambda: pieces(r.randint(1, 5)))
            else:
                pieces(r.choice((1, 2, 4, 7, 10, 16)))

        if not within:
            head()
        self.tag(self.placed(r.choice(CONTENT_AT if r.random() < self.named else PLAIN_AT)), body)

    def line_of_links(self, words: list[str], n: int) -> None:
        """Links side by side, with bars between them or each on a line of its own."""
        gap = self.rng.choice((" | ", " ", "<br>", " &gt; "))
        self.out.append(gap.join(f'<a href="/x">{self.rng.choice(words).capitalize() if self.rng.random() < 0.5 else self.word()}</a>' for _ in range(n)))

    def bare(self) -> tuple[str, list[str]]:
        """A page with hardly any elements: lines, rules, open paragraphs, or one table around all."""
        r, tables = self.rng, self.rng.random() < 0.4
        open_, shut = ("<td>", "</td>") if tables else ("", "<hr>")
        self.out.append("<html><body" + r.choice((">", " bgcolor=white>")) + ("<table><tr>" if tables else ""))
        if r.random() < 0.7:
            self.out.append(open_)
            self.line_of_links(MENU, r.randint(1, 5))
            self.out.append(shut if r.random() < 0.8 or tables else "<p>")
        self.out.append("</tr></table><table><tr><td>" if tables and r.random() < 0.5 else open_)
        if r.random() < 0.6:
            title = self.sentence(2, 8)
            self.content.append(" ".join(title.split()))
            self.out.append(r.choice(("<center><font size=5>{}</font></center>", "<h2>{}</h2>", "<p><b>{}</b></p>", "<h1>{}</h1>", "<div><b>{}</b></div>")).format(title))
        rules = not tables and r.random() < 0.4
        for _ in range(r.randint(1, 7)):
            text = self.prose()
            lines = text.split(" ")
            if r.random() < 0.4 and len(lines) > 3:
                lines[len(lines) // 2] = "<br><br>" + lines[len(lines) // 2]
            self.content.append(" ".join(text.split()))
            self.out.append((f"{' '.join(lines)}<hr>") if rules else f"<p>{' '.join(lines)}" + ("</p>" if r.random() < 0.5 else ""))
        self.out.append("</td></tr></table><table><tr><td>" if tables else "" if rules else "<hr>")
        if r.random() < 0.5:
            self.out.append(r.choice(("<small>{}</small>", "<i>{}</i>", "{}")).format(self.some(LEGAL, 1, 8)))
        else:
            self.line_of_links(LEGAL, r.randint(1, 4))
        self.out.append("</td></tr></table></body></html>" if tables else "</body>")
        return "".join(self.out), self.content

    def page(self) -> tuple[str, list[str]]:
        r = self.rng
        if r.random() < 0.12:
            return self.bare()
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>")
        for kind, odds in (("notice", 0.35), ("header", 0.4), ("menu", 0.75), ("form", 0.2), ("advert", 0.4)):
            if r.random() < odds:
                self.noise(kind)
        around = [r.choice(PLAIN_AT) for _ in range(r.choice((0, 0, 1, 1, 2, 3)))]
        for spec in around:
            name, *mark = spec.split(" class=")
            self.out.append(f'<{name} class="{mark[0]}">' if mark else f"<{name}>")
        if around and r.random() < 0.2:
            self.noise("sidebar")
        self.article()
        for kind, odds in (("share", 0.25), ("advert", 0.25), ("comments", 0.35), ("sidebar", 0.35), ("form", 0.15)):
            if r.random() < odds:
                self.noise(kind)
        self.out.extend(f"</{spec.split(' ')[0]}>" for spec in reversed(around))
        if r.random() < 0.85:
            self.noise("footer")
        if r.random() < 0.15:
            self.noise("notice")
        self.out.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.out), self.content


def sample_page(seed: int) -> tuple[str, list[str]]:
    """A made-up page and the texts of its content blocks."""
    return _Writer(random.Random(seed)).page()


def labelled(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a made-up page; a block is content if its text is."""
    writer = _Writer(random.Random(seed))
    page, content = writer.page()
    found, want = blocks(page), set(content)
    x = vectors(found)
    if writer.hashed is None and random.Random(seed).random() < WORDLESS:
        x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = 0
    return x, np.array([text in want for text, _, _ in found], np.float32)


@lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The labeller's weights; the same in every process."""
    model = Labeller()
    model.fit([labelled(seed) for seed in range(PAGES)], ROUNDS)
    return model.w


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    keep = model.label([vectors(c) for c in cut])
    return ["\n\n".join(b[0] for b, k in zip(c, ks, strict=True) if k) for c, ks in zip(cut, keep, strict=True)]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every row of pages."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.w = weights
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts([h.as_py() or "" for h in part.column(2)], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kind, link = (pages.schema[c].dataType.simpleString() for c in (key, url))
    found = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(released(run), f"key {kind}, url {link}, text string, n_chars bigint")
    return found.withColumnRenamed("key", key).withColumnRenamed("url", url)
