"""Main-text extraction: a recurrent labeller of the blocks of a page.

A page is cut into leaf blocks (runs of text between block-level tags).  Every
block is a vector of learned embeddings of its tag path (tags, classes, ids and
roles of its ancestors), learned embeddings of its hashed words, and a few
numbers.  A bidirectional LSTM in numpy reads the blocks of a whole page in
order and labels each as main text or not, so that a block is seen in the
context of all others.  The labelled blocks are joined in page order.

The model is trained in numpy.  Its examples are the blocks of a bounded sample
of the pages, labelled by what their nearest telling ancestor says, and pages
composed of the sample's words in other frames (``FRAMES_MAIN``, ``FRAMES_REST``),
a third of them with opaque class names or without telling elements, so
that it does not depend on one site's markup.

Defined results: text in elements that are hidden is none; an unclosed quote or
tag ends at the next tag; null, empty and tag-free pages are handled (plain text is one
block of main text); repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_VALUE, mix, modest_batches, prefix_hash, range_hash, words_of
from .labelled import stored_sample

#: Pages that are learned from, at most; buckets of path tokens and of words.
TRAIN_PAGES, PATHS, WORDS = 400, 4096, 8192
DIM_PATH, DIM_WORD, NUMBERS, HIDDEN = 24, 4, 6, 16

#: Every alternative takes what it has looked at, and a tag ends at the next ``<`` at the latest, so the scan is linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^<>]*+>?.*?(?:</\1\s*>|\Z)|<(template|noscript|svg|iframe)\b[^<>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"<]*\"|'[^'<]*'|[^<>])*+)>?|<[!?/][^<>]*+>?",
    re.S | re.I,
)
#: Elements that are skipped up to their closing tag; without one, or as ``<svg/>``, only the tag is.
_CLOSING = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("template", "noscript", "svg", "iframe")}
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_UNSEEN = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*?)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
#: Words of a class name: parts of camel case, runs of letters, numbers.
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Innermost path tokens that a block keeps.
DEEPEST = 60
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Words of tags, classes, ids and roles that tell main text from the rest of a page.
MAIN = frozenset("article main content post entry story body articlebody text blog".split())
REST = frozenset(
    "nav navigation navbar menu header masthead footer aside sidebar side ad ads advert advertisement adverts banner sponsor sponsored promo cookie cookies consent notice"
    " alert popup modal form newsletter subscribe signup login search comment comments reply discussion respond related recommended share social breadcrumb breadcrumbs"
    " pagination pager tags widget toolbar copyright legal disclaimer select button label option complementary contentinfo".split()
)


@dataclass(order=True)
class Block:
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links
    turn: int = 0  # whether it stands in another element than the block before it


def with_turns(blocks: list[Block]) -> list[Block]:
    """Sets ``turn`` of the blocks of one page: another path, its last element left out."""
    before = None
    for b in blocks:
        i = next((i for i in range(len(b.path) - 1, -1, -1) if b.path[i][0] not in ".!"), 0)
        b.turn = int(before is not None and b.path[:i] != before)
        before = b.path[:i]
    return blocks


_tags: dict[tuple[str, str], tuple[str, ...]] = {}
#: A path token of elements that a reader does not see.
HIDES = "!hidden"


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """Path tokens of one element; few different ones occur, so they are kept."""
    got = _tags.get((tag, attrs))
    if got is None:
        words = [w.lower() for m in _ATTR.finditer(attrs) for w in _PARTS.findall(m[2] or m[3] or m[4] or "")]
        got = (tag, *["." + w for w in words])
        if tag not in ("html", "body", "main", "article") and (_HIDDEN.search(_QUOTED.sub('""', attrs)) or _UNSEEN.search(attrs)):
            got = (*got, HIDES)
        if len(_tags) < 50_000:
            _tags[tag, attrs] = got
    return got


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order, character references decoded, white space made single; text that is not shown has none."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] | None = None
    linked = unseen = 0
    open_: Counter[str] = Counter()

    def flush() -> None:
        nonlocal path, linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path or (), linked))
            parts.clear()
        path, linked = None, 0

    def add(text: str) -> None:
        nonlocal path, linked
        if unseen:
            return
        if path is None and not text.isspace():
            path = tuple(n for tag, names in stack[-DEEPEST:] if tag not in ("html", "body") for n in names)[-DEEPEST:]
        parts.append(text)
        if open_["a"]:
            linked += len(text)

    def pop(i: int) -> None:
        nonlocal unseen
        for tag, names in stack[i:]:
            open_[tag] -= 1
            unseen -= names[-1] == HIDES
        del stack[i:]

    def innermost(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if open_[tag] else -1

    at = 0
    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        skipped = (m[2] or "").lower()
        if skipped and skipped not in unclosed and not (skipped == "svg" and m[0].endswith("/>")):
            end = _CLOSING[skipped].search(page, at)
            if end:
                at = end.end()
            else:
                unclosed.add(skipped)
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[3]:
            i = innermost(tag)
            if i >= 0:
                pop(i)
            continue
        if tag in _ENDS_P:
            i = innermost("p")
            if i >= 0:
                pop(i)
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEPEST), -1):
                if stack[i][0] in _SIBLINGS[tag]:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag in VOID:  # a slash at the end of any other tag means nothing
            continue
        names = _names(tag, m[5])
        stack.append((tag, names))
        open_[tag] += 1
        unseen += names[-1] == HIDES
    if at < len(page):
        add(page[at:])
    flush()
    return with_turns(out)


def silver(block: Block) -> int:
    """What the nearest telling ancestor says; without one, a long unlinked block is main text."""
    inside = any(n in ("article", "main") for n in block.path)
    element: list[str] = []
    for name in reversed(block.path):
        element.append(name)
        if name[0] == ".":
            continue
        bare = [n.lstrip(".") for n in element]
        element = []
        if any(n in REST for n in bare) and not (inside and bare[-1] == "header"):
            return 0
        if any(n in MAIN for n in bare):
            return 1
    return int(len(block.text) >= 60 and block.linked * 2 < len(block.text))


#: Frames of composed pages: around main text, and around the rest.
FRAMES_MAIN = ["article", "main", "div .content", "div .post", "div .entry .content", "section .article .body", "div .main .content", "div .story", "article .post main"]
FRAMES_REST = [
    "nav", "header", "footer", "aside", "form", "div .ad", "div .ads", "div .advert", "div .advertisement", "div .sidebar", "div .menu", "ul .menu", "div .header", "div .footer",
    "div .cookie .notice", "div .cookie .banner", "div .consent", "div .notice", "div .alert", "div .popup", "div .promo", "div .sponsored", "section .comments", "div .comment",
    "ol .comments", "div .reply", "div .related", "div .share", "div .social", "div .newsletter", "div .subscribe", "div .breadcrumb", "div .pagination", "div .widget", "div .tags",
    "aside .sidebar", "div .nav", "nav .navbar", "div .login", "form .search", "div .banner", "div .copyright", "header .masthead", "div .modal", "article .comment", "li .comment",
]


#: What often stands around main text, whatever the language of the page.
AROUND = [
    "Home", "Contact", "About us", "Log in", "Sign in", "Sign up", "Search", "Menu", "Share", "Tweet", "Share on Facebook", "Reply", "Like", "Report", "Read more", "Next", "Previous", "Back to top",
    "Related articles", "You may also like", "Popular posts", "Leave a comment", "3 comments", "Posted by anna on 3 May 2021 at 10:14", "Great post, thanks for sharing!", "I do not agree with this at all.",
    "We use cookies to improve your experience. By using this site you accept them.", "Accept all cookies", "Subscribe to our newsletter", "Enter your email address", "Advertisement", "Sponsored", "Buy now",
    "Terms of service", "Privacy policy", "Copyright 2024 Example Ltd. All rights reserved.", "\u00a9 2023 example.com", "All rights reserved", "Follow us", "Tags: news, life", "Skip to content",
]


def composed(words: list[str], rng: np.random.Generator, around: list[str] | None = None) -> tuple[list[Block], list[int]]:
    """A page of the sample's main words in one of FRAMES_MAIN, and of what stands around it in some of FRAMES_REST.

    Many pages lose their names: classes become opaque ones, or all elements
    plain ones, so that order, lengths, links and words have to tell."""
    around = around or AROUND
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    out: list[Block] = []
    y: list[int] = []
    names = rng.random()  # under 0.35 opaque classes, in most of these no telling elements either
    opaque: dict[str, str] = {}

    def path(tokens: tuple[str, ...]) -> tuple[str, ...]:
        if names >= 0.35:
            return tokens
        got = []
        for t in tokens:
            if t[0] == ".":
                if t not in opaque:
                    opaque[t] = ".x" + str(rng.integers(1000))
                got.append(opaque[t])
            else:
                got.append("div" if names >= 0.12 and t in ("article", "main", "nav", "header", "footer", "aside", "section", "form") else t)
        return tuple(got)

    def rest(inside: tuple[str, ...] = ()) -> None:
        frame = (*inside, *FRAMES_REST[rng.integers(len(FRAMES_REST))].split())
        leaf = [("ul", "li", "a"), ("p",), (), ("div",), ("span",), ("h3",)][rng.integers(6)]
        for _ in range(rng.integers(1, 7)):
            t = around[rng.integers(len(around))] if rng.random() < 0.7 else text(int(rng.integers(1, 12)))
            out.append(Block(t, path((*frame, *leaf)), len(t) if "a" in leaf else 0))
            y.append(0)

    for _ in range(rng.integers(0, 4)):
        rest()
    wrap = ("div", ".wrapper") if rng.random() < 0.3 else ()
    frame = (*wrap, *FRAMES_MAIN[rng.integers(len(FRAMES_MAIN))].split())
    for leaf in [("h1",)] * int(rng.random() < 0.8) + [[("p",), ("p",), ("p",), ("div",), ("ul", "li"), ("h2",), ("blockquote", "p"), ("p", "b"), ()][rng.integers(9)] for _ in range(rng.integers(1, 12))]:
        out.append(Block(text(int(rng.integers(1, 60))), path((*frame, *leaf)), 0))
        y.append(1)
        if rng.random() < 0.08 and names >= 0.35:
            rest(frame)
    for _ in range(rng.integers(0, 4)):
        rest()
    return with_turns(out), y


def _hash(token: str, size: int) -> int:
    h = 2166136261
    for c in token.encode():
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % size


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_ids(path: tuple[str, ...]) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        got = np.unique(np.array([_hash(n, PATHS) for n in (*path, "^" + (path[-1] if path else ""))], np.int64))
        if len(_paths) < 100_000:
            _paths[path] = got
    return got


@dataclass
class Inputs:
    """Sparse inputs of the blocks of several pages, one after another."""

    path: np.ndarray
    path_at: np.ndarray
    word: np.ndarray
    word_at: np.ndarray
    number: np.ndarray


def inputs(blocks: list[Block]) -> Inputs:
    ids = [_path_ids(b.path) for b in blocks]
    raw = [b.text.encode() for b in blocks]
    off = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts, ends, first = words_of(data, off)
    w = (mix(range_hash(prefix_hash(LOWER_VALUE[data]), starts, ends)) % np.uint64(WORDS)).astype(np.int64)
    size = np.diff(off) - 1.0
    words = np.diff(first)
    stops = np.concatenate([[0], np.cumsum(np.isin(data, (33, 44, 46, 63)))])
    number = np.column_stack([np.log1p(size) / 5, np.log1p(words) / 4, [b.linked / max(1, len(b.text)) for b in blocks], np.minimum(1, (stops[off[1:]] - stops[off[:-1]]) / np.maximum(1, words)), [b.turn for b in blocks], np.ones(len(blocks))])
    return Inputs(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])]), w, first, number)


def _bag(table: np.ndarray, ids: np.ndarray, at: np.ndarray, mean: bool) -> np.ndarray:
    c = np.zeros((len(ids) + 1, table.shape[1]))
    np.cumsum(table[ids], axis=0, out=c[1:])
    out = c[at[1:]] - c[at[:-1]]
    return out / np.maximum(1, np.diff(at))[:, None] if mean else out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors, logistic output; trained with Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = DIM_PATH + DIM_WORD + NUMBERS, HIDDEN
        self.p = {"path": rng.normal(0, 0.05, (PATHS, DIM_PATH)), "word": rng.normal(0, 0.02, (WORDS, DIM_WORD)), "out": rng.normal(0, 0.3, 2 * h + d), "bias": np.zeros(1)}
        for k in ("f", "b"):
            self.p["x" + k], self.p["h" + k] = rng.normal(0, d**-0.5, (d, 4 * h)), rng.normal(0, h**-0.5, (h, 4 * h))
            self.p["c" + k] = np.concatenate([np.ones(h), np.zeros(3 * h)])  # forget gates start open

    def vectors(self, x: Inputs) -> np.ndarray:
        return np.concatenate([_bag(self.p["path"], x.path, x.path_at, False), _bag(self.p["word"], x.word, x.word_at, True), x.number], axis=1)

    def _pass(self, v: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """One direction over (steps, pages, inputs); the state stays as it is where a page has no block."""
        steps, pages, _ = v.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, tape = np.zeros((steps, pages, HIDDEN)), []
        zx = v @ self.p["x" + way] + self.p["c" + way]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = zx[t] + h @ self.p["h" + way]
            f, i, o, g = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c1 = f * c + i * g
            tc = np.tanh(c1)
            if keep:
                tape.append((t, h, c, f, i, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c1 + (1 - m) * c
            out[t] = h
        return out, tape

    def _padded(self, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(at)
        page = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(v)) - np.repeat(at[:-1], size)
        x, mask = np.zeros((int(size.max()), len(size), v.shape[1])), np.zeros((int(size.max()), len(size)))
        x[step, page], mask[step, page] = v, 1
        return x, mask, step, page

    def probabilities(self, x: Inputs, at: np.ndarray) -> np.ndarray:
        """For blocks of pages that begin at ``at`` (pages of like length go together)."""
        v = self.vectors(x)
        out = np.zeros(len(v))
        size = np.diff(at)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and (hi - lo + 1) * size[order[hi]] <= 60_000:
                hi += 1
            some = order[lo:hi]
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
            cut = np.concatenate([[0], np.cumsum(size[some])])
            xs, mask, step, page = self._padded(v[rows], cut)
            hf, hb = self._pass(xs, mask, "f", False)[0], self._pass(xs, mask, "b", False)[0]
            a = np.concatenate([hf[step, page], hb[step, page], v[rows]], axis=1)
            out[rows] = _sigmoid(a @ self.p["out"] + self.p["bias"][0])
            lo = hi
        return out

    def gradients(self, x: Inputs, at: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        v = self.vectors(x)
        xs, mask, step, page = self._padded(v, at)
        runs = {w: self._pass(xs, mask, w, True) for w in ("f", "b")}
        a = np.concatenate([runs["f"][0][step, page], runs["b"][0][step, page], v], axis=1)
        p = _sigmoid(a @ self.p["out"] + self.p["bias"][0])
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        d = (p - y) / len(y)
        g = {"out": a.T @ d, "bias": np.array([d.sum()])}
        da = d[:, None] * self.p["out"]
        dv = da[:, 2 * HIDDEN :].copy()
        for k, way in enumerate(("f", "b")):
            dout = np.zeros_like(runs[way][0])
            dout[step, page] = da[:, k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*xs.shape[:2], 4 * HIDDEN))
            dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
            gh = np.zeros_like(self.p["h" + way])
            for t, h, c, f, i, o, gg, tc, m in reversed(runs[way][1]):
                dh = dh + dout[t]
                live = dh * m
                dc1 = dc * m + live * o * (1 - tc**2)
                dz = np.concatenate([dc1 * c * f * (1 - f), dc1 * gg * i * (1 - i), live * tc * o * (1 - o), dc1 * i * (1 - gg**2)], axis=1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dh * (1 - m) + dz @ self.p["h" + way].T
                dc = dc * (1 - m) + dc1 * f
            g["h" + way], g["c" + way] = gh, dz_all.sum(axis=(0, 1))
            g["x" + way] = np.tensordot(xs, dz_all, ((0, 1), (0, 1)))
            dv += (dz_all @ self.p["x" + way].T)[step, page]
        g["path"], g["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        np.add.at(g["path"], x.path, np.repeat(dv[:, :DIM_PATH], np.diff(x.path_at), axis=0))
        n = np.diff(x.word_at)
        np.add.at(g["word"], x.word, np.repeat(dv[:, DIM_PATH : DIM_PATH + DIM_WORD] / np.maximum(1, n)[:, None], n, axis=0))
        return float(loss), g

    def train(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.02, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), 16):
                some = [pages[i] for i in order[lo : lo + 16]]
                at = np.concatenate([[0], np.cumsum([len(b) for b, _ in some])])
                _, g = self.gradients(inputs([b for bs, _ in some for b in bs]), at, np.array([y for _, ys in some for y in ys], float))
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        for k in ("path", "word"):  # what was never learned from says nothing
            self.p[k][(s[k] == 0).all(axis=1)] = 0


def fit(pages: DataFrame, limit: int = TRAIN_PAGES, composed_pages: int = 2500, stretch: int = 300) -> Labeller:
    """Trained on about ``limit`` pages, chosen by hash, and ``composed_pages`` composed ones.

    Only the sampled pages' blocks come to the driver; a long page is learned from whole, in stretches of blocks."""
    modest_batches(pages.sparkSession)
    rows = pages.filter("html is not null").select(F.col("page_id").alias("doc_id"), "html")

    def run(batches):
        for batch in batches:
            out = []
            for page in batch.column(0).to_pylist():
                b = [{"text": x.text, "path": list(x.path), "linked": x.linked} for x in blocks_of(page)]
                out += [b[i : i + stretch] for i in range(0, len(b), stretch)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("path", pa.list_(pa.string())), ("linked", pa.int32())])))], names=["b"])

    got = stored_sample(rows, limit, "sample-pages", "html").select("html").mapInArrow(run, "b array<struct<text:string,path:array<string>,linked:int>>").toArrow().column(0).to_pylist()
    real = sorted(with_turns([Block(x["text"], tuple(x["path"]), x["linked"]) for x in b]) for b in got)
    marked = [(b, [silver(x) for x in b]) for b in real]
    words = [w for bs, ys in marked for x, y in zip(bs, ys, strict=True) if y for w in x.text.split()] or ["word"]
    around = AROUND + [x.text for bs, ys in marked for x, y in zip(bs, ys, strict=True) if not y and len(x.text) < 80][: 4 * len(AROUND)]
    rng = np.random.default_rng(9)
    model = Labeller()
    model.train(2 * marked + [composed(words, rng, around) for _ in range(composed_pages)])
    return model


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every row of ``pages``, from the whole html."""
    modest_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            n, step = batch.num_rows, 200
            for lo in range(0, n, step):
                part = batch.slice(lo, step)
                found = [blocks_of(p) if p else [] for p in part.column(2).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(b) for b in found])])
                flat = [b for bs in found for b in bs]
                main = m.probabilities(inputs(flat), at) >= 0.5 if flat else np.zeros(0, bool)
                text = [" ".join(b.text for b, ok in zip(bs, main[a : a + len(bs)], strict=True) if ok) for bs, a in zip(found, at, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()),
                        pa.array([len(b) for b in found], pa.int32()), pa.array([int(main[a:b].sum()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int32()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int, n_main int")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
