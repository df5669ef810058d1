"""Main-text extraction from HTML by a bidirectional LSTM over a page's blocks.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, with the path of open
elements (names, class, id and role words). Each block is a vector of hashed path words, hashed words of its
text and a few proportions. Two numpy LSTMs read the sequence from both ends, so that every block is judged
with the whole page around it, and a logistic layer says whether it belongs to the main text. The model is
trained here, once per driver process, on pages made by html_pages.py; pages of similar length are
scored together, as many as a bound on their blocks allows, and a page beyond it in windows that hand on their
states: the backward states of all windows first (HIDDEN numbers a block), then the forward ones.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import no_cycles, text_slices

PATH, LEAF, WORDS, SHARES = 128, 32, 32, 6
INPUT = PATH + LEAF + WORDS + SHARES
HIDDEN = 16
#: Pages scored together, and blocks (padding included) in one array; some 2 KB each.
BATCH, STEPS = 128, 1 << 15

# fixed values: HTML's block-level, void and raw-text elements
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset(["hr"])
RAW = frozenset("script style iframe noembed noframes template svg".split())
PARSED = frozenset(["template", "svg"])  # of these, the two that run to the page's end only if they are closed there

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?)""", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
ENDS = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    """An open element: its name and its path's vector, made from its parent's when a block needs it."""

    __slots__ = ("name", "marks", "above", "made")

    def __init__(self, name: str, marks: str, above: Element | None):
        self.name, self.marks, self.above, self.made = name, marks, above, None

    def vector(self) -> np.ndarray:
        """Counts of the path's words up to two, then the last element's own; one byte each."""
        chain, at = [], self
        while at is not None and at.made is None:
            chain.append(at)
            at = at.above
        for own in reversed(chain):
            out = np.zeros(PATH + LEAF, np.uint8) if own.above is None else own.above.made.copy()
            out[PATH:] = 0
            for word in own.marks.split():
                path, leaf = _places(word)
                out[path] = min(2, out[path] + 1)
                out[leaf] = 1
            own.made = out
        return self.made


@lru_cache(50_000)
def _places(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode()) % PATH, PATH + zlib.crc32(b"leaf" + word.encode()) % LEAF


NO_PATH = np.zeros(PATH + LEAF, np.uint8)


@dataclass(slots=True)
class Block:
    path: Element | None
    text: str
    linked: int  # characters of raw text inside links


@lru_cache(50_000)
def _marks(name: str, attrs: str) -> str:
    """An element's name and the words of its class, id and role, as one string."""
    out = [name]
    for m in NAMED.finditer(attrs):
        out += [p.lower() for p in PIECES.findall(m[2] or m[3] or m[4] or m[1])]
    return " ".join(out)


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks with text in page order, character references decoded and white space made single blanks."""
    found: list[Block] = []
    stack: list[Element] = []
    names: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    links = linked = 0
    unclosed: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                found.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
        linked = 0

    def close(name):
        while True:
            last = stack.pop().name
            names[last] -= 1
            if last == name:
                return

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        closing, name, attrs = m[1], m[2], m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
            if closing:
                if names.get(name):
                    close(name)
                links = 0
            else:
                if names.get("p"):  # a block ends an open paragraph
                    close("p")
                if name in ("li", "option") and stack and stack[-1].name == name:
                    close(name)
                if name not in VOID:
                    stack.append(Element(name, _marks(name, attrs or ""), stack[-1] if stack else None))
                    names[name] = names.get(name, 0) + 1
        elif name in RAW:
            if not closing and not (attrs or "").endswith("/"):
                end = None if name in unclosed else ENDS[name].search(page, at)
                last = page.find(">", end.start()) if end else -1
                if last >= 0:
                    at = last + 1
                elif name in PARSED:
                    unclosed.add(name)
                else:
                    at = n
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name in ("br", "img", "wbr", "input"):
            parts.append(" ")
    flush()
    return found


def features(found: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """Vectors of a page's blocks from start up to stop."""
    stop = len(found) if stop is None else stop
    out = np.zeros((stop - start, INPUT), np.float32)
    for k in range(start, stop):
        b, row = found[k], out[k - start]
        row[: PATH + LEAF] = NO_PATH if b.path is None else b.path.vector()
        words = b.text.lower().split()
        row[PATH + LEAF : PATH + LEAF + WORDS] = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS) / len(words)
        size = len(b.text)
        row[-SHARES:] = np.log1p(size) / 8, b.linked / size, b.text[-1] in ".!?;:\"'", k / len(found), min(len(words), 40) / 40, sum(map(b.text.count, "|©»")) / size
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction, with what its backward pass needs."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((INPUT + HIDDEN, 4 * HIDDEN)) * 0.1).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None, state: list | None = None) -> np.ndarray:
        """x (steps, pages, INPUT), mask (steps, pages, 1): states after each step; masked steps leave them as they are.
        With state, begins from the two arrays there, if any, and leaves the last ones."""
        steps, pages, _ = x.shape
        h, c = state or [np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)]
        read = (x.reshape(-1, INPUT) @ self.w[:INPUT] + self.b).reshape(steps, pages, -1)
        out = np.empty((steps, pages, HIDDEN), np.float32)
        for t in range(steps):
            g = read[t] + h @ self.w[INPUT:]
            gates = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = np.split(gates, 3, axis=1)
            a = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * a
            s = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, a, s))
            h = mask[t] * (o * s) + (1 - mask[t]) * h
            c = mask[t] * new + (1 - mask[t]) * c
            out[t] = h
        if state is not None:
            state[:] = [h, c]
        return out

    def backward(self, x, mask, kept, grad) -> tuple[np.ndarray, np.ndarray]:
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in reversed(range(len(x))):
            h, c, i, f, o, a, s = kept[t]
            dh = dh + grad[t]
            own, own_c = mask[t] * dh, mask[t] * dc
            dnew = own_c + own * o * (1 - s * s)
            dg = np.concatenate((dnew * a * i * (1 - i), dnew * c * f * (1 - f), own * s * o * (1 - o), dnew * i * (1 - a * a)), 1)
            dw[:INPUT] += x[t].T @ dg
            dw[INPUT:] += h.T @ dg
            db += dg.sum(0)
            dh = dg @ self.w[INPUT:].T + (1 - mask[t]) * dh
            dc = dnew * f + (1 - mask[t]) * dc
        return dw, db


class Labeller:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.out = (rng.standard_normal(2 * HIDDEN + INPUT) * 0.05).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def _states(self, x, mask, kept=None):
        kept = kept or (None, None)
        return np.concatenate((self.ahead.forward(x, mask, kept[0]), self.back.forward(x[::-1], mask[::-1], kept[1])[::-1], x), 2)

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Per page the log odds of each block, pages of similar length together."""
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        out: list = [np.zeros(0, np.float32)] * len(pages)
        while order:
            if len(pages[order[-1]]) > STEPS:
                k = order.pop()
                out[k] = self._in_windows(pages[k])
                continue
            # all of a batch are padded to its longest, the last in order
            own = order[-max(1, min(BATCH, STEPS // len(pages[order[-1]]))) :]
            order = order[: -len(own)]
            x, mask = _pad([features(pages[k]) for k in own])
            z = self._states(x, mask) @ self.out + self.bias
            for j, k in enumerate(own):
                out[k] = z[: len(pages[k]), j]
        return out

    def _in_windows(self, page: list[Block], size: int = STEPS // 8) -> np.ndarray:
        mask, back, state = np.ones((size, 1, 1), np.float32), np.zeros((len(page), HIDDEN), np.float32), []
        starts = range(0, len(page), size)
        for at in reversed(starts):
            x = features(page, at, min(at + size, len(page)))[:, None]
            back[at : at + size] = self.back.forward(x[::-1], mask, None, state)[::-1, 0]
        z, state = np.zeros(len(page), np.float32), []
        for at in starts:
            x = features(page, at, min(at + size, len(page)))[:, None]
            ahead = self.ahead.forward(x, mask, None, state)
            z[at : at + size] = np.concatenate((ahead[:, 0], back[at : at + size], x[:, 0]), 1) @ self.out + self.bias
        return z

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, rate: float = 0.01) -> float:
        """Adam on the blocks' logistic loss; returns the last epoch's share of right labels."""
        rng = np.random.default_rng(11)
        weights = [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.out, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        right = 0.0
        for epoch in range(epochs):
            hits = total = 0
            for at in range(0, len(pages), 32):
                own = rng.permutation(len(pages))[:32] if at == 0 else rng.integers(0, len(pages), 32)
                x, mask = _pad([pages[k] for k in own])
                y = _pad([labels[k][:, None] for k in own])[0][:, :, 0]
                kept = ([], [])
                states = self._states(x, mask, kept)
                z = states @ self.out + self.bias
                m = mask[:, :, 0]
                dz = ((_sigmoid(z) - y) * m / m.sum()).astype(np.float32)
                hits, total = hits + int((((z > 0) == (y > 0)) * m).sum()), total + int(m.sum())
                dstates = dz[:, :, None] * self.out
                gw, gb = self.ahead.backward(x, mask, kept[0], dstates[:, :, :HIDDEN])
                hw, hb = self.back.backward(x[::-1], mask[::-1], kept[1], dstates[::-1, :, HIDDEN : 2 * HIDDEN])
                step += 1
                speed = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
                for k, g in enumerate((gw, gb, hw, hb, np.tensordot(dz, states, ([0, 1], [0, 1])), dz.sum(keepdims=True).reshape(1))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    weights[k] -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            right = hits / total
        return right


def _pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32), np.zeros((longest, len(rows), 1), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j], mask[: len(r), j] = r, 1
    return x, mask


@lru_cache(1)
def trained(pages: int = 1500, epochs: int = 14) -> Labeller:
    """The model, trained on `pages` made pages with a fixed seed."""
    from .html_pages import made_pages

    model, x, y = Labeller(), [], []
    for page, main in made_pages(pages):
        found = blocks(page)
        if found:
            x.append(features(found))
            y.append(np.array([float(b.text in main) for b in found], np.float32))
    model.train(x, y, epochs)
    return model


def extract_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p or "") for p in pages]
    return ["\n".join(b.text for b, s in zip(f, z, strict=True) if s > 0) for f, z in zip(found, model.scores(found), strict=True)]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row, the main text's blocks joined by line breaks.

    A null or empty page, or one without a main text, gives an empty text; null ids and urls stay, repeated
    rows are each extracted, an empty table gives none, other columns are not read. Whole pages, no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())  # some 100 KB

    def run(batches):
        with no_cycles():
            for batch in text_slices(batches, "html", 1 << 20):
                texts = extract_texts(batch.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
