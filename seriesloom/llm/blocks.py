"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks, the stretches of text between block-level tags. A bidirectional LSTM in numpy reads
their sequence, and so labels every block with the whole page as context. A block's input is the hashed set of
its tag path (tags, classes and ids of all ancestors), the hashed vector of all its words, and a few
figures (length, share of linked text, marks, place, depth). Blocks it labels as article are joined in page order.

No table labels blocks, so the training pages are made: paragraphs of a bounded sample of the pages given
(``SAMPLE`` pages, smallest hashes first) are set into random layouts of articles, menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, whose labels are known. Training is seeded and runs on
that sample only; every page is then labelled whole.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
two line ends; nothing else is dropped or capped. Scripts, styles, templates, comments and titles hold no text. Only scripts,
styles, titles and text areas run to the page's end where their end tag is missing.
Null and empty pages give an empty text. Repeated pages are labelled one by one. Unclosed and stray tags are
read as browsers read them where that matters to blocks (an open paragraph ends at the next block). Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
PATHS, WORDS, FIGURES, HIDDEN = 512, 64, 6, 20
LAYOUTS = 700

# Elements that do not end a block, elements without content, and those whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Raw text runs to its end tag or the page's end. The other elements hold no text up to their own end tag; one without an
# end tag holds nothing. The head is no element here: what may stand in it has no text, and all else is the body.
RAW = "script|style|title|textarea"
HOLDERS = "noscript|template|svg|math|iframe|object|canvas|select"
# What ends drawings and formulas (the HTML standard's list), and the parts of them that may hold pages.
BREAKS = ("b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|"
          "strong|strike|sub|sup|table|tt|u|ul|var")
INSETS = "foreignobject|desc|annotation-xml|mi|mo|mn|ms|mtext"

ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*"
UNREAD = rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
TOKEN = re.compile(rf"{UNREAD}|<(/?)([a-zA-Z][^\s/<>]*)({ATTRIBUTES})>", re.S | re.I)
HELD = re.compile(rf"{UNREAD}|<(/?)({HOLDERS})(?=[\s/>])({ATTRIBUTES})>", re.S | re.I)
FOREIGN = re.compile(rf"{UNREAD}|<(/?)({INSETS}|{BREAKS})(?=[\s/>])({ATTRIBUTES})>", re.S | re.I)
HOLDS, INSET = frozenset(HOLDERS.split("|")), frozenset(INSETS.split("|"))
NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: float


def _name(tag: str, attributes: str) -> str:
    """A path step: the tag and the parts of its class, id and role names."""
    if "=" not in attributes:
        return tag
    names = [p.lower() for m in NAMED.finditer(attributes) for p in PART.findall(m[2] or m[3] or m[4] or "")]
    return ".".join([tag, *names])


CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}


def _held(page: str, start: int) -> dict[int, int]:
    """Where the elements that hold no text begin and end, from ``start`` on; those without an end tag are left out."""
    open_at: dict[str, list[int]] = {}
    ends = {}
    for tag in HELD.finditer(page, start):
        if tag[3] and tag[2]:
            if open_at.get(tag[3].lower()):
                ends[open_at[tag[3].lower()].pop()] = tag.end()
        elif tag[3] and not tag[4].endswith("/"):
            open_at.setdefault(tag[3].lower(), []).append(tag.start())
    return ends


def _outside(page: str, start: int, end: int) -> int:
    """Where a drawing or formula ends: at its end tag, or at the first tag that cannot be in it."""
    depth = 0
    for tag in FOREIGN.finditer(page, start, end):
        name = (tag[3] or "").lower()
        if name in INSET:
            depth = max(0, depth - 1) if tag[2] else depth + (not tag[4].endswith("/"))
        elif name and not tag[2] and not depth:
            return tag.start()
    return end


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    found: list[Block] = []
    if not page:
        return found
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0
    ends: dict[int, int] | None = None

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(tuple(step for _, step in path), text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    last = page.rfind(">")
    while at <= last:
        token = TOKEN.search(page, at, last + 1)
        if not token:
            break
        text(page[at : token.start()])
        at = token.end()
        closing, tag, attributes = token[2], token[3], token[4]
        if not tag:
            continue  # a comment, a declaration or an element without text
        tag = tag.lower()
        if tag in HOLDS:
            if not closing and not attributes.endswith("/"):
                ends = _held(page, token.start()) if ends is None else ends
                at = max(at, ends.get(token.start(), 0))
                if tag in ("svg", "math"):
                    at = _outside(page, token.end(), at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        end()
        links = 0
        if closing:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == tag:
                    del path[k:]
                    break
            continue
        if path and path[-1][0] == "p":
            path.pop()
        if path and path[-1][0] in CLOSES.get(tag, ()):
            path.pop()
        if tag not in VOID and tag != "head" and not attributes.endswith("/"):
            path.append((tag, _name(tag, attributes)))
    text(page[at:])
    end()
    return found


def path_slots(path: tuple[str, ...]) -> list[int]:
    """Hashed names of a path: tags, class parts, the leaf and its parent."""
    names = {f"t:{step.partition('.')[0]}" for step in path}
    names |= {f"c:{part}" for step in path for part in step.split(".")[1:]}
    names |= {f"{k}:{step.partition('.')[0]}" for k, step in enumerate(reversed(path[-2:]))}
    return sorted({zlib.crc32(n.encode()) % PATHS for n in names})


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORDS
        return value


_SLOTS = _Slots()


def figures(page: list[Block]) -> np.ndarray:
    """Hashed words (length one) and figures of a page's blocks."""
    out = np.zeros((len(page), WORDS + FIGURES), np.float32)
    for k, block in enumerate(page):
        own = block.text.lower().split()
        counts = np.bincount(np.fromiter(map(_SLOTS.__getitem__, own), np.int64, len(own)), minlength=WORDS)
        out[k, :WORDS] = counts / np.sqrt((counts**2).sum())
        marks = sum(map(block.text.count, ".,;:!?"))
        out[k, WORDS:] = (np.log1p(len(own)) / 4, block.linked, min(1.0, marks / len(own)), k / len(page),
                          1 - k / len(page), len(block.path) / 10)
    return out


class Labeller:
    """A bidirectional LSTM over block vectors. ``weights`` holds all parameters by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    @classmethod
    def fresh(cls, random: np.random.Generator) -> Labeller:
        h, inputs = HIDDEN, PATHS + WORDS + FIGURES
        weights = {"x": random.normal(0, 0.1, (inputs, 8 * h)), "b": np.zeros(8 * h), "v": random.normal(0, 0.2, 2 * h), "c": np.zeros(1)}
        for d in (0, 1):
            weights[f"u{d}"] = random.normal(0, 0.15, (h, 4 * h))
            weights["b"][d * 4 * h + h : d * 4 * h + 2 * h] = 1.0  # remember at first
        return cls({k: v.astype(np.float32) for k, v in weights.items()})

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) >= 20_000:
                self.paths.clear()
            known = self.paths[path] = self.w["x"][path_slots(path)].sum(axis=0) + self.w["b"]
        return known

    def inputs(self, page: list[Block]) -> np.ndarray:
        """Input parts of all gates of both directions: blocks x 8 hidden."""
        return np.stack([self._path(b.path) for b in page]) + figures(page) @ self.w["x"][PATHS:]

    def run(self, z: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States of both directions for padded pages: z is steps x pages x 8 hidden, mask steps x pages."""
        steps, pages, h = z.shape[0], z.shape[1], HIDDEN
        states = np.zeros((steps, pages, 2 * h), np.float32)
        tape: list = [[], []]
        for d in (0, 1):
            hidden, cell = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a = z[t, :, d * 4 * h : (d + 1) * 4 * h] + hidden @ self.w[f"u{d}"]
                gates = 1 / (1 + np.exp(-np.clip(a[:, : 3 * h], -30, 30)))
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                g = np.tanh(a[:, 3 * h :])
                m = mask[t][:, None]
                new_cell = f * cell + i * g
                squashed = np.tanh(new_cell)
                if keep:
                    tape[d].append((t, hidden, cell, i, f, o, g, squashed, m))
                hidden = m * (o * squashed) + (1 - m) * hidden
                cell = m * new_cell + (1 - m) * cell
                states[t, :, d * h : (d + 1) * h] = hidden
        return states, tape

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is article text, page by page. Long pages are run in smaller groups."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and (len(group) + 1) * len(pages[order[at + len(group)]]) <= 8192:
                group.append(order[at + len(group)])
            at += len(group)
            steps = max(len(pages[k]) for k in group)
            z = np.zeros((steps, len(group), 8 * HIDDEN), np.float32)
            mask = np.zeros((steps, len(group)), np.float32)
            for j, k in enumerate(group):
                z[: len(pages[k]), j] = self.inputs(pages[k])
                mask[: len(pages[k]), j] = 1
            states, _ = self.run(z, mask)
            scores = states @ self.w["v"] + self.w["c"]
            for j, k in enumerate(group):
                out[k] = scores[: len(pages[k]), j] >= 0
        return out


def learn(pages: list[tuple[list[Block], list[int]]], epochs: int = 10, group: int = 32, seed: int = 3) -> Labeller:
    """Train on labelled pages with Adam and backpropagation through time."""
    random = np.random.default_rng(seed)
    net = Labeller.fresh(random)
    dense = []
    for page, _ in pages:
        x = np.zeros((len(page), PATHS + WORDS + FIGURES), np.float32)
        for k, block in enumerate(page):
            x[k, path_slots(block.path)] = 1
        x[:, PATHS:] = figures(page)
        dense.append(x)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    turn, h = 0, HIDDEN
    for epoch in range(epochs):
        order = random.permutation(len(pages))
        for at in range(0, len(order), group):
            chosen = order[at : at + group]
            steps = max(len(pages[k][0]) for k in chosen)
            x = np.zeros((steps, len(chosen), dense[0].shape[1]), np.float32)
            y, mask = np.zeros((steps, len(chosen)), np.float32), np.zeros((steps, len(chosen)), np.float32)
            for j, k in enumerate(chosen):
                x[: len(dense[k]), j], y[: len(dense[k]), j], mask[: len(dense[k]), j] = dense[k], pages[k][1], 1
            states, tape = net.run(x @ net.w["x"] + net.w["b"], mask, keep=True)
            p = 1 / (1 + np.exp(-np.clip(states @ net.w["v"] + net.w["c"], -30, 30)))
            error = (p - y) * mask / mask.sum()
            grads = {"v": np.einsum("tp,tph->h", error, states), "c": np.array([error.sum()], np.float32)}
            down = error[:, :, None] * net.w["v"]
            dz = np.zeros((steps, len(chosen), 8 * h), np.float32)
            for d in (0, 1):
                u = net.w[f"u{d}"]
                du = np.zeros_like(u)
                dh, dc = np.zeros((len(chosen), h), np.float32), np.zeros((len(chosen), h), np.float32)
                for t, hidden, cell, i, f, o, g, squashed, m in reversed(tape[d]):
                    dh = dh + down[t, :, d * h : (d + 1) * h]
                    through = m * dh
                    dcell = m * dc + through * o * (1 - squashed**2)
                    da = np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f), through * squashed * o * (1 - o),
                                         dcell * i * (1 - g**2)], axis=1)
                    dz[t, :, d * 4 * h : (d + 1) * 4 * h] = da
                    du += hidden.T @ da
                    dh = da @ u.T + (1 - m) * dh
                    dc = dcell * f + (1 - m) * dc
                grads[f"u{d}"] = du
            grads["x"] = np.tensordot(x, dz, ((0, 1), (0, 1)))
            grads["b"] = dz.sum(axis=(0, 1))
            turn += 1
            rate = 0.02 * (0.75**epoch)
            for name, grad in grads.items():
                first[name] += 0.1 * (grad - first[name])
                second[name] += 0.001 * (grad**2 - second[name])
                step = first[name] / (1 - 0.9**turn) / (np.sqrt(second[name] / (1 - 0.999**turn)) + 1e-8)
                net.w[name] = (net.w[name] - rate * step).astype(np.float32)
    net.paths.clear()
    return net


# How pages mark their regions, for the training layouts.
REGIONS = {
    "menu": ("<nav>", '<ul class="menu">', '<div id="navigation">', '<div class="nav navbar">', '<div class="breadcrumbs">', '<div role="navigation">'),
    "header": ("<header>", '<div id="header">', '<div class="site-header masthead">', '<div class="topbar">'),
    "footer": ("<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright legal">', '<footer class="footer">'),
    "sidebar": ("<aside>", '<div class="sidebar">', '<div id="sidebar" class="widget">', '<section class="related">', '<div class="recommended">', '<aside class="promo">'),
    "notice": ('<div class="notice">', '<div class="cookie-banner">', '<div id="consent">', '<div class="alert">', '<div class="newsletter subscribe">', '<div role="alert">', '<section class="notice">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="banner">', '<aside class="ad">'),
    "form": ("<form>", '<form class="search">', '<div class="login form">', '<form action="/s">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="comment">', '<section id="discussion">', '<div class="replies">'),
}
ARTICLES = ("<article>", "<main>", '<main><article>', '<div class="content"><article>', '<div id="content">', '<div class="post">',
            '<div class="article-body">', '<div class="entry-content">', '<section class="story">', "<article class=\"post\">", '<div id="main" class="text">')


def _closing(opening: str) -> str:
    return "".join(f"</{tag}>" for tag in reversed(re.findall(r"<([a-z]+\d?)", opening)))


def layout(random: np.random.Generator, texts: list[str]) -> tuple[list[Block], list[int]]:
    """One made page with its labels. Article text is marked with a sign no page has and found again by it."""
    sign = "\ue000"

    def some(low: int, high: int) -> str:
        own = texts[random.integers(len(texts))].split()
        count = int(random.integers(low, high + 1))
        start = int(random.integers(0, max(1, len(own) - count)))
        return html.escape(" ".join(own[start : start + count])) or "text"

    def region(kind: str) -> str:
        opening = REGIONS[kind][random.integers(len(REGIONS[kind]))]
        if kind in ("menu", "header"):
            items = [f'<a href="/x">{some(1, 3)}</a>' for _ in range(random.integers(2, 9))]
            inner = "".join(f"<li>{x}</li>" for x in items) if random.random() < 0.7 else " ".join(items)
            inner = f"<ul>{inner}</ul>" if random.random() < 0.6 else inner
        elif kind == "form":
            inner = f"<label>{some(1, 3)}</label><input><button>{some(1, 2)}</button>" + (f"<p>{some(3, 12)}</p>" if random.random() < 0.4 else "")
        elif kind == "comments":
            inner = "".join(f'<div class="comment"><p>{some(2, 60)}</p></div>' if random.random() < 0.5 else f"<p>{some(2, 60)}</p>" for _ in range(random.integers(1, 5)))
            inner = f"<h3>{some(1, 3)}</h3>{inner}" if random.random() < 0.5 else inner
        elif kind == "sidebar":
            inner = "".join(f"<p>{some(3, 30)}</p>" if random.random() < 0.5 else f'<li><a href="/y">{some(2, 8)}</a></li>' for _ in range(random.integers(1, 6)))
        else:
            inner = some(2, 40) if random.random() < 0.7 else f"<p>{some(2, 40)}</p>"
        return opening + inner + _closing(opening)

    def article() -> str:
        opening = ARTICLES[random.integers(len(ARTICLES))]
        parts = [f"<h1>{sign}{some(1, 12)}</h1>"] if random.random() < 0.85 else []
        for _ in range(random.integers(1, 14)):
            kind = random.random()
            if kind < 0.72:
                lead = "<b>" if random.random() < 0.15 else ""
                parts.append(f"<p>{lead}{sign}{some(1, 150)}" + ("<br>" if lead else "" if random.random() < 0.1 else "</p>"))
            elif kind < 0.8:
                parts.append(f"<h2>{sign}{some(1, 8)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{sign}{some(1, 25)}</li>" for _ in range(random.integers(1, 5))) + "</ul>")
            elif kind < 0.91:
                parts.append(f"<blockquote>{sign}{some(3, 40)}</blockquote>")
            elif kind < 0.95:
                parts.append(f"<div>{sign}{some(5, 90)}</div>")
            else:
                parts.append(region("advert" if random.random() < 0.6 else "sidebar"))
        if random.random() < 0.12:
            parts.append(region("comments"))
        return opening + "".join(parts) + _closing(opening)

    before = [region(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if random.random() < 0.45]
    after = [region(k) for k in ("comments", "sidebar", "advert", "form", "notice", "footer") if random.random() < 0.45]
    random.shuffle(before)
    inside = f'<html><head><title>x</title></head><body>{"".join(before)}{article()}{"".join(after)}'
    page = blocks(inside + ("</body></html>" if random.random() < 0.9 else ""))
    labels = [int(sign in b.text) for b in page]
    return [b._replace(text=b.text.replace(sign, "") or "text") for b in page], labels


def train(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS, seed: int = 11) -> Labeller:
    """Train on layouts made of the paragraphs of at most ``sample`` pages."""
    chosen = pages.select(F.col("page_id").cast("string").alias("id"), F.col("html").cast("string")).where("html is not null").orderBy(
        F.xxhash64("id"), "id", "html").limit(sample)

    # One task fits on the bounded sample; tasks have one thread for matrix products, so the result is the same everywhere.
    def fit(batches):
        texts = sorted(b.text for batch in batches for page in batch.column("html") for b in blocks(page.as_py())
                       if b.text.count(" ") >= 4)
        texts = texts or ["the few words of a page where a table of pages has none " * 5]
        random = np.random.default_rng(seed)
        net = learn([layout(random, texts) for _ in range(layouts)])
        names = sorted(net.w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([net.w[n].astype("<f4").tobytes() for n in names], pa.binary()),
             pa.array([list(net.w[n].shape) for n in names], pa.list_(pa.int32()))], ["name", "data", "shape"])

    rows = chosen.select("html").coalesce(1).mapInArrow(fit, "name string, data binary, shape array<int>").collect()
    return Labeller({r["name"]: np.frombuffer(r["data"], "<f4").reshape(r["shape"]).copy() for r in rows})


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of all pages."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller.w)

    def extract(batches):
        net = Labeller(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(p.as_py()) for p in part.column("html")]
                texts = ["\n\n".join(b.text for b, main in zip(page, labels, strict=True) if main)
                         for page, labels in zip(found, net.label(found), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
