"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: runs of text between block-level tags, with
inline markup joined. Each block is read as a tag path (tags, class and id names
of the elements around it, hashed), a hashed bag of its words, and a few lengths
and ratios. A bidirectional LSTM in numpy runs over the page's whole block
sequence, so the class of every block is decided in the light of all others.

The network is trained here, at first use, on pages that ``htmlpages`` makes up
with known classes; the same seeds give the same weights. No page of the input is
used for that.

Defined cases: null, empty and textless html give an empty text; markup that is
not closed ends where HTML ends it, or with the page; scripts, styles, templates,
frames and form controls are never text; blocks that repeat are kept each; a page
of one block or of a million is labelled whole, in memory that grows with its bytes; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import small_batches, string_buffers, word_bounds, word_hashes
from .htmlpages import Maker

TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?P<end>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S
)
NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("script style template noscript textarea select button iframe object svg math head title datalist audio video canvas".split())
RAW = frozenset("script style textarea title iframe".split())  # their content is not markup
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes these if they stand open above the last element that bounds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUND = frozenset("ul ol dl table tbody thead tfoot td th div article section main aside body".split())

PATH, WORDS, EXTRA = 256, 64, 12
INPUT, HIDDEN = PATH + WORDS + EXTRA, 24
#: Blocks of a page, or of pages of like length, that are labelled at a time.
LONG_PAGE = 4096
PAGES, EPOCHS, RATE, DECAY = 2400, 7, 0.01, 0.1


class Element:
    """An open element; its path is the chain of parents, which the blocks of a page share."""

    __slots__ = ("depth", "name", "parent", "vector")

    def __init__(self, parent: Element | None, name: str):
        self.parent, self.name = parent, name
        self.depth = 1 + (parent.depth if parent else 0)
        self.vector: np.ndarray | None = None

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at:
            out.append(at.name)
            at = at.parent
        return tuple(reversed(out))


class OpenElements:
    """The stack of open elements, with the places of every tag, so that no tag is searched for through the stack."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.elements: list[Element] = []
        self.bounds: list[int] = []  # places of elements in BOUND
        self.at: dict[str, list[int]] = {}
        self.anchors = self.hidden = 0

    def push(self, tag: str, name: str) -> None:
        place = len(self.tags)
        self.elements.append(Element(self.elements[-1] if self.elements else None, name))
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(place)
        if tag in BOUND:
            self.bounds.append(place)
        self.anchors += tag == "a"
        self.hidden += tag in SKIP

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all in it; nothing for -1."""
        while 0 <= place < len(self.tags):
            tag = self.tags.pop()
            self.elements.pop()
            self.at[tag].pop()
            if tag in BOUND:
                self.bounds.pop()
            self.anchors -= tag == "a"
            self.hidden -= tag in SKIP


def blocks(page: str) -> list[tuple[str, Element | None, int, int]]:
    """(text, inmost open element, characters in links, characters) of each leaf block, in page order."""
    out: list[tuple[str, Element | None, int, int]] = []
    open_ = OpenElements()
    parts: list[str] = []
    linked, at = 0, 0
    inside: Element | None = None

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, inside, linked, len(raw)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, inside
        if not open_.hidden and text:
            if not parts:
                if text.isspace():
                    return
                inside = open_.elements[-1] if open_.elements else None
            parts.append(text)
            if open_.anchors > 0:
                linked += len(text)

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            open_.cut(open_.last(tag))
            continue
        if tag in BLOCK:
            flush()
            if open_.hidden == 1:  # an open head ends at the body or its first block, unless that stands in a hidden element of the head
                open_.cut(open_.last("head"))
            closed = max(open_.last("p"), *(open_.last(x) for x in CLOSES.get(tag, ())), -1)
            if closed >= (open_.bounds[-1] if open_.bounds else 0):
                open_.cut(closed)
        elif tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        names = " ".join(next(filter(None, x), "") for x in NAME.findall(m["attrs"])).lower() if m["attrs"] else ""
        open_.push(tag, f"{tag} {names}" if names else tag)
    flush()
    return out


def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def _own(name: str) -> np.ndarray:
    """Hashed counts of one element's tag and names."""
    got = np.zeros(PATH, np.uint8)
    tag, _, names = name.partition(" ")
    for word in (tag, *("." + x for x in SPLIT.split(names) if x)):
        slot = _slot(word, PATH)
        got[slot] = min(2, got[slot] + 1)
    return got


def path_vector(element: Element | None) -> np.ndarray:
    """Hashed counts, up to two, of the tags and names on a path, the inmost tag once more by itself."""
    if element is None:
        return np.zeros(PATH, np.uint8)
    new, at = [], element
    while at is not None and at.vector is None:
        new.append(at)
        at = at.parent
    got = at.vector if at is not None else np.zeros(PATH, np.uint8)
    for e in reversed(new):  # from the outermost on, each once for all blocks in it
        got = e.vector = np.minimum(got + _own(e.name), 2)
    out = got.copy()
    last = _slot("last " + element.name.split(" ")[0], PATH)
    out[last] = min(2, out[last] + 1)
    return out


def features(pages: list[list[tuple[str, Element | None, int, int]]], before: int = 0, after: int = 0) -> np.ndarray:
    """A row for each block of all pages; before, after: how many blocks of a single page go before and come after these."""
    every = [b for page in pages for b in page]
    n = len(every)
    x = np.zeros((n, INPUT), np.float32)
    if not n:
        return x
    for i, b in enumerate(every):
        x[i, :PATH] = path_vector(b[1])
    data, offsets = string_buffers(pa.array([b[0] for b in every], pa.large_string()))
    starts, ends, first = word_bounds(data, offsets)
    count = np.diff(first)
    slot = (word_hashes(data, starts, ends, lower=True) % np.uint64(WORDS)).astype(np.int64)
    bag = np.bincount(np.repeat(np.arange(n), count) * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS)
    x[:, PATH : PATH + WORDS] = bag / np.sqrt(np.maximum((bag * bag).sum(axis=1), 1))[:, None]
    raw = np.array([(len(b[0]), b[2] / max(1, b[3]), b[1].depth if b[1] else 0) for b in every], np.float32)
    sizes = np.array([len(p) for p in pages])
    place = np.concatenate([np.arange(s) for s in sizes]) + before
    total = np.repeat(sizes, sizes) + before + after
    last = data[np.maximum(offsets[1:] - 1, 0)]
    e = PATH + WORDS
    x[:, e] = np.log1p(raw[:, 0]) / 5
    x[:, e + 1] = np.log1p(count) / 4
    x[:, e + 2] = raw[:, 1]
    x[:, e + 3] = raw[:, 2] / 10
    x[:, e + 4] = place / np.maximum(total, 1)
    x[:, e + 5] = np.log1p(place) / 4
    x[:, e + 6] = np.log1p(total - place) / 4
    x[:, e + 7] = last == ord(".")
    x[:, e + 8] = np.add.reduceat(data == ord(","), offsets[:-1]) / np.maximum(count, 1)
    x[:, e + 9] = raw[:, 0] < 25
    x[:, e + 10] = raw[:, 1] > 0.8
    x[:, e + 11] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"{d}x"] = rng.normal(0, 0.08, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.p[f"{d}h"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"{d}b"] = bias
        self.p["direct"] = np.zeros(INPUT, np.float32)
        self.p["out"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, z: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states for pre-computed inputs z (time, pages, 4 * HIDDEN), from a state on; later steps of short pages are padding at the end."""
        steps, n, _ = z.shape
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out, trace = np.empty((steps, n, HIDDEN), np.float32), []
        w = self.p[f"{d}h"]
        for t in range(steps):
            a = z[t] + h @ w
            gates = _sigmoid(a[:, : 3 * HIDDEN])
            g = np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, h_before = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                trace.append((i, f, o, g, before, tc, h_before))
        return (out, trace, (h, c)) if state else (out, trace)

    def _pack(self, x: np.ndarray, sizes: np.ndarray):
        """Row of x at each (time, page), forward and backward, with -1 for padding."""
        steps = int(sizes.max())
        t = np.arange(steps)[:, None]
        first = np.cumsum(sizes) - sizes
        inside = t < sizes
        return np.where(inside, first + t, -1), np.where(inside, first + sizes - 1 - t, -1)

    def logits(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False):
        both, traces = [], []
        for d, at in zip("fb", self._pack(x, sizes), strict=True):
            z = (x @ self.p[f"{d}x"] + self.p[f"{d}b"])[np.maximum(at, 0)]
            out, trace = self._run(z, d, keep)
            h = np.empty((len(x), HIDDEN), np.float32)
            h[at[at >= 0]] = out[at >= 0]
            both.append(h)
            traces.append((at, trace))
        h = np.concatenate(both, axis=1)
        return h @ self.p["out"] + x @ self.p["direct"] + self.p["bias"], h, traces

    def long_logits(self, page: list) -> np.ndarray:
        """logits of one page's blocks, for LONG_PAGE of them at a time; only the states go from part to part."""
        n = len(page)
        z = np.zeros(n)
        for k, d in enumerate("fb"):
            state = (np.zeros((1, HIDDEN), np.float32),) * 2
            cuts = range(0, n, LONG_PAGE)
            for i in cuts if d == "f" else reversed(cuts):
                part = page[i : i + LONG_PAGE]
                x = features([part], i, n - i - len(part))
                turn = 1 if d == "f" else -1
                out, _, state = self._run((x @ self.p[f"{d}x"] + self.p[f"{d}b"])[::turn, None, :], d, False, state)
                z[i : i + len(part)] += out[::turn, 0] @ self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
                if d == "f":
                    z[i : i + len(part)] += x @ self.p["direct"] + self.p["bias"]
        return z

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, h, traces = self.logits(x, sizes, keep=True)
        dz = ((_sigmoid(z) - y) / len(y)).astype(np.float32)
        g = {"out": h.T @ dz, "direct": x.T @ dz, "bias": dz.sum(keepdims=True)}
        dh_all = dz[:, None] * self.p["out"]
        for k, (d, (at, trace)) in enumerate(zip("fb", traces, strict=True)):
            w = self.p[f"{d}h"]
            n = at.shape[1]
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            da_rows, dw = np.zeros((len(x), 4 * HIDDEN), np.float32), np.zeros_like(w)
            own = dh_all[:, k * HIDDEN : (k + 1) * HIDDEN]
            for t in range(len(trace) - 1, -1, -1):
                i, f, o, gg, before, tc, h_before = trace[t]
                real = (at[t] >= 0)[:, None]
                dh = dh + np.where(real, own[np.maximum(at[t], 0)], 0)
                dc = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                da_rows[at[t][real[:, 0]]] = da[real[:, 0]]
                dw += h_before.T @ da
                dh, dc = da @ w.T, dc * f
            g[f"{d}h"], g[f"{d}x"], g[f"{d}b"] = dw, x.T @ da_rows, da_rows.sum(axis=0)
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        batch, turn = 24, 0
        total = epochs * -(-len(pages) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for i in range(0, len(order), batch):
                some = [pages[k] for k in order[i : i + batch]]
                x, y = (np.concatenate(part) for part in zip(*some, strict=True))
                sizes = np.array([len(p[1]) for p in some])
                turn += 1
                rate = RATE * (1 - turn / (total + 1)) * (1 - 0.999**turn) ** 0.5 / (1 - 0.9**turn)
                for k, g in self.gradients(x, sizes, y).items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (np.sqrt(v[k]) + 1e-8) + DECAY * self.p[k])).astype(np.float32)
        return self

    def keep(self, pages: list[list]) -> list[np.ndarray]:
        """Which blocks of each page are main text."""
        out = [self.long_logits(p) > 0 if len(p) > LONG_PAGE else np.zeros(len(p), bool) for p in pages]
        # The others in groups, whose rows of features are held at a time.
        group: list[int] = []
        total = 0
        for i, p in enumerate(pages):
            if 0 < len(p) <= LONG_PAGE:
                if total + len(p) > 4 * LONG_PAGE:
                    self._keep_short(pages, group, out)
                    group, total = [], 0
                group.append(i)
                total += len(p)
        self._keep_short(pages, group, out)
        return out

    def _keep_short(self, every: list[list], chosen: list[int], result: list[np.ndarray]) -> None:
        pages = [every[i] for i in chosen]
        x = features(pages)
        sizes = np.array([len(p) for p in pages], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        i = 0
        while i < len(order):  # pages of like length together, about 4096 blocks at a time
            j = i + 1
            while j < len(order) and (j - i + 1) * sizes[order[j]] <= LONG_PAGE:
                j += 1
            some = order[i:j]
            rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in some])
            z = self.logits(x[rows], sizes[some])[0] > 0
            for k, part in zip(some, np.split(z, np.cumsum(sizes[some])[:-1]), strict=True):
                result[chosen[k]] = part
            i = j


def made_pages(count: int, seed: int = 0) -> list[tuple[list, np.ndarray]]:
    """Blocks and classes of made-up pages."""
    out = []
    for i in range(count):
        maker = Maker(seed + i)
        found = blocks(maker.page())
        known = [(b, maker.labels[b[0]]) for b in found if b[0] in maker.labels]
        if known:
            out.append(([b for b, _ in known], np.array([y for _, y in known], np.float32)))
    return out


_trained: dict[tuple[int, int], Labeller] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS) -> Labeller:
    key = (pages, epochs)
    if key not in _trained:
        _trained[key] = Labeller().fit([(features([b]), y) for b, y in made_pages(pages)], epochs)
    return _trained[key]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_blocks, n_kept for every row of pages(page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 4 << 20):
            found = [blocks(x) if x else [] for x in batch.column(2).to_pylist()]
            kept = shared.value.keep(found)
            texts = ["\n\n".join(b[0] for b, k in zip(page, use, strict=True) if k) for page, use in zip(found, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(p) for p in found], pa.int32()), pa.array([int(k.sum()) for k in kept], pa.int32())],
                ["page_id", "url", "text", "n_blocks", "n_kept"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_blocks int, n_kept int")
