"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, verified edit similarity, components.

Equal normalised lines, of any length, are one class from the start. Classes of enough words are sent once per
pair of radius + 2 blocks of their SimHash, and with `wide` once per min-hash band of their words; a bucket
proposes a spanning forest of real candidate pairs, whose texts are fetched by a second scan behind a fixed-size
filter and verified. Buckets in which a proposal failed are looked at again for every candidate pair between
different groups, so that the groups are those of all verified pairs. One occurrence per connected group stays:
the first by document and line.

One changed word of ten flips some nine of 64 bits, more than blocks can bear. The bands are for those lines: half
draw two words, each letter more doubling a word's chance (long words are rare ones, which unrelated lines do not
share), and half draw five words, all alike (so that one changed long word does not hide a pair).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, bit_filter, mix64, rewrite, text_slices
from .verified import BAND_COLUMNS, band_columns, verified_parts

#: Words from which on lines are compared for similarity; shorter ones have to be equal.
MIN_WORDS = 5
RADIUS = 3
#: Bits by which lines that share a min-hash band of their words may differ, and how many less from each of these
#: sizes on (code points): in a longer line the same share of changed characters spoils a smaller share of the bits.
WIDE, FEWER, FEWER_FROM = 20, 2, (110, 220)
#: Words that each band draws; the first WEIGHTED bands prefer long ones.
BAND_ROWS, WEIGHTED = (2, 2, 2, 2, 5, 5, 5, 5), 4
SIMILARITY = 0.8
LARGE = 4096
BASE = np.uint64(0x9E3779B97F4A7C55)
#: By byte: white space, whether it makes its word one with a letter or digit, and what it adds to a hash (A-Z as a-z).
WHITE = np.array([b in b" \t\n\v\f\r" for b in range(256)])
WORDLIKE = np.array([chr(b).isalnum() and b < 128 or b > 127 for b in range(256)])
LETTERS = mix64(np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint64) + np.uint64(0x5851F42D))
ONES = np.uint64(0x0101010101010101)
#: Bits of the filter that says which lines' texts to fetch: 2 MB, whatever the corpus.
FILTER_BITS = 1 << 24
#: Bytes of text read at once; a worker holds some eighty times as much.
SLICE = 1 << 19


def normal_lines(text: str) -> list[tuple[int, list[bytes]]]:
    """(line number, words with A-Z lowered) of the lines with a word."""
    lines = ((k, x.split()) for k, x in enumerate(text.encode().lower().split(b"\n")))
    return [(k, w) for k, w in lines if w]


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(1 << 20)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64 to the powers below n."""
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))


def run_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each run, by differences of one running sum of powers."""
    up, down = _powers() if len(values) < 1 << 20 else powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


@dataclass
class Lines:
    """The lines with a word of some texts: which text, which line of it, hash, SimHash, code points with single blanks
    between words, number of words, the words' places, and on request the min-hash bands of the words."""

    text: np.ndarray
    line: np.ndarray
    h: np.ndarray
    fp: np.ndarray
    size: np.ndarray
    n_words: np.ndarray
    raw: bytes
    first: np.ndarray
    last: np.ndarray
    bands: list[np.ndarray]

    def words(self, k: int) -> str:
        return b" ".join(self.raw[self.first[k] : self.last[k]].lower().split()).decode()


def read_lines(texts: list[str], prints: bool = True, banded: bool = False, chosen: Callable[[np.ndarray], np.ndarray] | None = None) -> Lines:
    """All texts at once as one array of bytes: no step per word or line. Without prints, these are zero; with chosen, so
    are prints and bands of the lines for whose hashes it is false."""
    parts = [t.encode() for t in texts]
    raw = b"\n".join(parts) + b"\n"
    b = np.frombuffer(raw, np.uint8)
    white = WHITE[b]
    edge = np.flatnonzero(np.diff(white, prepend=True))
    start, end = edge[::2], edge[1::2]  # of words: the array ends in white space
    breaks = np.flatnonzero(b == 10)
    count = np.diff(np.searchsorted(start, breaks), prepend=0)
    own = np.flatnonzero(count)
    size = count[own]
    stop = np.cumsum(size)
    begin = stop - size
    word = run_sums(LETTERS[b], start, end) if len(start) else np.zeros(0, np.uint64)
    more = np.flatnonzero((b & 0xC0) == 0x80)  # bytes that begin no code point
    chars = np.add.reduceat(end - start, begin) + size - 1 - np.searchsorted(more, end[stop - 1]) + np.searchsorted(more, start[begin]) if len(own) else size
    h = run_sums(word, begin, stop) if len(own) else np.zeros(0, np.uint64)
    fp, bands = np.zeros(len(own), np.uint64), [np.zeros(len(own), np.int64) for _ in BAND_COLUMNS] if banded else []
    n_words = size
    if (prints or banded) and len(own):
        some, first, last = np.arange(len(own)), start, end
        if chosen is not None:
            mask = chosen(h)
            some, of = np.flatnonzero(mask), np.repeat(mask, size)
            first, last, word, size = start[of], end[of], word[of], size[mask]
        spoken = WORDLIKE[b[first]]
        odd = np.flatnonzero(~spoken)  # words that begin with a sign: the rest of them tells
        if len(odd):
            spoken[odd] = np.logical_or.reduceat(WORDLIKE[b], np.stack([first[odd], last[odd]], 1).reshape(-1))[::2]
        if not spoken.all():
            which = np.repeat(np.arange(len(some)), size)
            spoken |= ~(np.bincount(which, spoken, len(some)) > 0)[which]
            size = np.bincount(which[spoken], minlength=len(some))
            first, last, word = first[spoken], last[spoken], word[spoken]
        if prints:
            fp[some] = majorities(word, size)
        if banded:
            for out, keys in zip(bands, band_columns(word, size, BAND_ROWS, np.minimum(last - first, 16).astype(np.uint64) - np.uint64(1), WEIGHTED), strict=True):
                out[some] = keys
    ends = np.cumsum([p.count(b"\n") + 1 for p in parts])
    text = np.searchsorted(ends, own, "right")
    return Lines(text, own - np.concatenate(([0], ends))[text], h, fp, chars, n_words, raw, start[begin], end[stop - 1] if len(own) else end[:0], bands)


def majorities(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For consecutive runs of hashes the bits that are set in over half of each. Runs of up to 255 are counted in the
    bytes of a word, eight bits at a time: differences of a running sum, which may well overflow."""
    ends = np.cumsum(size)
    out = np.zeros(len(size), np.uint64)
    half = np.minimum(size // 2, 255).astype(np.uint8)[:, None]
    total = np.zeros(len(hashes) + 1, np.uint64)
    for k in range(8):
        np.cumsum(hashes >> np.uint64(k) & ONES, out=total[1:])
        counts = (total[ends] - total[ends - size]).astype("<u8", copy=False)
        out |= (counts.view(np.uint8).reshape(-1, 8) > half).view("<u8").reshape(-1) << np.uint64(k)
    for k in np.flatnonzero(size > 255).tolist():
        sums = np.zeros(64, np.int64)
        for at in range(int(ends[k] - size[k]), int(ends[k]), 200_000):
            some = hashes[at : min(at + 200_000, int(ends[k]))]
            sums += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * sums > size[k], bitorder="little").view("<u8")[0]
    return out


def edit_distance(a: str | list[str], b: str | list[str], most: float = float("inf")) -> float:
    """Levenshtein distance of texts or lists, a column at a time as bit vectors (Myers) after common ends are cut;
    infinite as soon as it is sure to exceed `most`."""
    head = 0
    low = min(len(a), len(b))
    while head < low and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < low - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    full = (1 << len(a)) - 1
    where = defaultdict(int)
    for k, c in enumerate(a):
        where[c] |= 1 << k
    up, down, distance, top, limit = full, 0, len(a), 1 << (len(a) - 1), most + len(b)
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        distance += bool(right & top) - bool(left & top)
        limit -= 1
        if distance > limit:  # each column to come takes off one at most
            return float("inf")
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return distance


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - edit distance / longer length is at least `least`. The distance is worked out only if no bound decides:
    the lengths' difference from below; from above, words put in each other's place one by one, all between the
    words alike at both ends, and the words' edit distance times what the longest words can cost."""
    longest = max(len(a), len(b))
    most = (1 - least) * longest + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    x, y, close = _between(a, b, most)
    if close:
        return True
    cost = sorted([len(w) + 1 for w in x + y], reverse=True)
    if sum(cost[: edit_distance(x, y)]) <= most:
        return True
    return edit_distance(a, b, most) <= most


def unlike(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Which pairs cannot be similar by their characters alone, whatever their order: the edit distance is at least the
    number of characters that one has too many, counted in 64 kinds."""

    def counts(texts, size):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4") & 63
        return np.bincount(np.repeat(np.arange(len(texts)) << 6, size) + points, minlength=len(texts) << 6).reshape(-1, 64)

    out = np.empty(len(a), bool)
    for k in range(0, len(a), 2048):
        x, y = a[k : k + 2048], b[k : k + 2048]
        n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (x, y))
        over = np.abs(counts(x, n) - counts(y, m)).sum(1)  # too many of one and of the other
        longest = np.maximum(n, m)
        out[k : k + 2048] = (over + np.abs(n - m)) / 2 > (1 - least) * longest + 1e-9
    return out


#: Pairs of texts whose edit distances are worked out side by side: table entries and characters at most, and pairs
#: from which on that is faster than one by one.
ENTRIES, TEXT, FEW = 1 << 17, 1 << 21, 12
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def all_similar(a: list[str], b: list[str], least: float) -> np.ndarray:
    """similar(x, y, least) of each pair of texts, many at a time: the bounds of `similar` that cost little, and then
    distances between the words alike at both ends, pairs of about the same size side by side."""
    out = np.zeros(len(a), bool)
    rest, left, right, most = [], [], [], []
    for k in np.flatnonzero(~unlike(a, b, least)).tolist():
        allowed = (1 - least) * max(len(a[k]), len(b[k])) + 1e-9
        x, y, close = _between(a[k], b[k], allowed)
        if close:
            out[k] = True
        else:
            rest.append(k)
            left.append(" ".join(x))
            right.append(" ".join(y))
            most.append(int(allowed))
    size = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        least_size = int(size[order[at]])
        stop = at + int(np.searchsorted(size[order[at:]], least_size + max(16, least_size // 4), "right"))
        longest = int(size[order[stop - 1]])
        own = order[at : min(stop, at + max(FEW, min(ENTRIES // 64, TEXT // longest)))].tolist()
        at += len(own)
        x, y, n = [left[k] for k in own], [right[k] for k in own], [most[k] for k in own]
        same = [edit_distance(*t) <= t[2] for t in zip(x, y, n, strict=True)] if len(own) < FEW else _within(x, y, np.array(n))
        out[[rest[k] for k in own]] = same
    return out


def _between(a: str, b: str, most: float) -> tuple[list[str], list[str], bool]:
    """The words of both between those alike at both ends, and whether putting words in each other's place one by one or
    these all at once takes at most `most` edits."""
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum([max(len(p), len(q)) for p, q in zip(x, y, strict=True) if p != q]) <= most:
        return x, y, True
    low, k, j = min(len(x), len(y)), 0, 0
    while k < low and x[k] == y[k]:
        k += 1
    while j < low - k and x[-1 - j] == y[-1 - j]:
        j += 1
    x, y = x[k : len(x) - j], y[k : len(y) - j]
    return x, y, max(sum(map(len, x)) + len(x), sum(map(len, y)) + len(y)) <= most


def _within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's Levenshtein distance is at most `most`: Myers' bit vectors for all pairs side by side, in blocks
    of 64 rows, each block a column behind the one above it, so that all are worked out at once. Only blocks that a path
    of so few edits can pass take part; above these a row costs one more each column, which no such path uses. A common
    opening, which changes no distance, makes the first texts equally long. Pairs leave once no path is left."""
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
    x, y = (np.frombuffer("".join(t).encode("utf-32-le"), "<u4") for t in (a, b))
    code = np.zeros(max(x.max(initial=0), y.max(initial=0)) + 1, np.int64)
    code[x] = code[y] = 1
    kinds = np.flatnonzero(code)
    many = min(len(kinds), 255) + 1  # of more kinds some count as one: distances are bounds from below then
    code[kinds] = np.arange(len(kinds)) % 255 + 1
    pairs, blocks = len(a), max(1, -(-int(n.max()) // 64))
    lead = 64 * blocks - n
    ends = m + lead
    columns, width = int(ends.max()), pairs * many

    def places(size):  # of the characters of all texts: which text, where in it
        return np.repeat(np.arange(pairs), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)

    table = np.zeros((blocks, width), np.uint64)
    for size, kind, start in ((n, code[x], lead), (lead, 0, 0 * lead)):
        of, at = places(size)
        at += start[of]
        np.add.at(table.reshape(-1), (at >> 6) * width + of * many + kind, np.uint64(1) << (at & 63).astype(np.uint64))
    entry = np.zeros((columns, pairs), np.int64) + np.arange(pairs) * many
    of, at = places(m)
    entry[at + lead[of], of] += code[y]
    below, above = int(((most + n - m) // 2).max()), int(((most - n + m) // 2).max())
    out = np.maximum(n, m) <= most
    live = np.flatnonzero((np.abs(n - m) <= most) & ~out)
    if len(live) < pairs:
        entry = entry.take(live, 1)
    allowed, ends = most[live], ends[live]
    up, down = np.full((blocks, len(live)), ALL), np.zeros((blocks, len(live)), np.uint64)
    more, less = np.zeros((2, blocks + 1, len(live)), np.uint64)  # what the row above each block costs more or less than a column before
    score = np.full((blocks, len(live)), 64, np.uint64)  # at each block's last row
    offset = np.arange(blocks)[:, None] * width
    one, last, flat = np.uint64(1), np.uint64(63), table.reshape(-1)
    low = high = 0
    for t in range(columns + blocks - 1):
        first = min(blocks - 1, max(0, -((64 + above - t) // 65), t - columns + 1))
        if first == low:
            more[first], less[first] = one, np.uint64(0)
        low = first
        if (new := min(blocks - 1, (t + below) // 65, t)) > high:
            high = new
            score[high] = score[high - 1] - more[high] + less[high] + np.uint64(64)
        own = slice(low, high + 1)
        match = flat.take(entry[t - high : t - low + 1][::-1] + offset[own])
        p, q = up[own], down[own]
        across = match | q
        match |= less[own]
        diagonal = match & p
        diagonal += p
        diagonal ^= p
        diagonal |= match
        right = diagonal | p
        np.invert(right, out=right)
        right |= q
        left = diagonal & p
        plus, minus = right >> last, left >> last
        right <<= one
        right |= more[own]
        left <<= one
        left |= less[own]
        np.bitwise_and(right, across, out=q)
        across |= right
        np.invert(across, out=across)
        np.bitwise_or(left, across, out=p)
        more[low + 1 : high + 2], less[low + 1 : high + 2] = plus, minus
        score[own] += plus
        score[own] -= minus
        column = t - blocks + 2  # of the last block
        if high == blocks - 1 and (done := ends == column).any():
            out[live[done]] = score[-1][done].view(np.int64) <= allowed[done]
        if t % 32 == 31:
            # costs at every eighth row of the blocks' columns, which every path passes; others are at most four rows from one
            steps = [np.bitwise_count(v.view(np.uint8).reshape(*v.shape, 8)).astype(np.int64) for v in (p, q)]
            ahead = np.cumsum((steps[0] - steps[1])[:, :, ::-1], axis=2)[:, :, ::-1]  # from such a row to the block's last
            cost = score[own].view(np.int64)[:, :, None] - ahead
            k = np.arange(low, high + 1)[:, None, None]
            bound = np.abs((64 * (blocks - k) - 8 * np.arange(8)) - (ends[None, :, None] - (t - k + 1))) + cost
            bound = np.minimum(bound.min((0, 2)), np.abs(64 * (blocks - 1 - high) - ends + (t - high + 1)) + score[high].view(np.int64)) - 8
            stay = np.flatnonzero((ends > column) & (bound <= allowed))
            if not len(stay):
                break
            if len(stay) < 0.8 * len(live):
                live, ends, allowed, entry = live[stay], ends[stay], allowed[stay], entry.take(stay, 1)
                up, down, score, more, less = (v.take(stay, 1) for v in (up, down, score, more, less))
    if len(kinds) >= many:
        for k in np.flatnonzero(out).tolist():
            out[k] = edit_distance(a[k], b[k], most[k]) <= most[k]
    return out


def bits_for(size: np.ndarray, wide: int) -> np.ndarray:
    """Bits by which the larger of two lines in a band may differ from the other, by its size."""
    return wide - FEWER * sum((size >= s).astype(np.int64) for s in FEWER_FROM)


def lines_of(df: DataFrame, id_col: str, text_col: str, bands: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, line, h, fp, size, bands) of every line with a word of rows whose id is not null; size is 0 for lines of under MIN_WORDS words."""

    def run(batches):
        for batch in text_slices(batches, "text", SLICE):
            found = read_lines(batch.column("text").to_pylist(), banded=bool(bands))
            docs = batch.column("doc_id").take(pa.array(found.text))
            size = np.where(found.n_words >= MIN_WORDS, found.size, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([docs, pa.array(found.line.astype(np.int32)), pa.array(found.h.view(np.int64)), pa.array(found.fp.view(np.int64)), pa.array(size), *map(pa.array, found.bands)], ["doc_id", "line", "h", "fp", "size", *bands])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, ", ".join(["doc_id long, line int, h long, fp long, size int", *(f"{c} long" for c in bands)]))


def _texts(pairs: DataFrame, df: DataFrame, tables: Tables, text_col: str, bands: tuple[str, ...] = ()) -> DataFrame:
    """(h, line, bands): the normalised texts of the lines in pairs (a, b), by a scan behind a filter of fixed size."""
    bits = bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("key")), FILTER_BITS)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def fetch(batches):
        wanted, done = shared.value, set()

        def chosen(h):
            at = (h % np.uint64(FILTER_BITS)).astype(np.int64)
            return (wanted[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)

        for batch in text_slices(batches, "text", SLICE):
            found = read_lines(batch.column("text").to_pylist(), False, bool(bands), chosen)
            own, texts = [], []
            for k in np.flatnonzero(chosen(found.h)).tolist():
                if (h := int(found.h[k])) not in done:
                    if len(done) > 100_000:
                        done.clear()
                    done.add(h)
                    own.append(k)
                    texts.append(found.words(k))
            at = np.array(own, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.h[at].view(np.int64)), pa.array(texts, pa.string()), *(pa.array(x[at]) for x in found.bands)], ["h", "line", *bands])

    found = df.select(df[text_col].alias("text")).where("text is not null").mapInArrow(fetch, ", ".join(["h long, line string", *(f"{c} long" for c in bands)]))
    return tables.keep(found.groupBy("h").agg(*(F.first(c).alias(c) for c in ("line", *bands))), "texts")


def line_groups(df: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, wide: int | None = None) -> DataFrame:
    """(doc_id, line, first_doc_id, first_line, kept): the lines that occur again, exactly or nearly.

    Lines (numbered from 0, split at \\n) are compared without regard to A-Z case and white space; those without a
    word are left alone. Equal ones are linked, and of those of MIN_WORDS words and more two whose SimHashes differ in at
    most `radius` bits and whose edit similarity (1 - Levenshtein / longer length, in characters) is at least `least`.
    With `wide`, lines that share a min-hash band of their words may differ in that many bits (bits_for). A group's first
    occurrence is the one with the smallest (doc_id, line), and it alone is kept. Null texts have no lines; rows
    with a null id are left out; rows that share a doc_id count as one document. An empty table gives no rows.
    """
    tables = Tables(df.sparkSession, "lines")
    bands = BAND_COLUMNS if wide else ()
    lines = tables.keep(lines_of(df, id_col, text_col, bands), "lines")
    classes = tables.keep(lines.groupBy("h").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("fp", "size", *bands))), "classes")
    parts = verified_parts(classes.where("size > 0"), df, tables, lambda pairs: _texts(pairs, df, tables, text_col, bands), lambda x, y: similar(x, y, least), radius, least, large, partial(bits_for, wide=wide) if wide else None, partial(all_similar, least=least))
    # a part has two classes at least; of the other classes those count that occur twice
    alone = classes.where("n > 1").select("h").join(parts, F.col("h") == F.col("node"), "left_anti")
    of = parts.select(F.col("node").alias("h"), F.col("component").alias("part")).unionByName(alone.select("h", F.col("h").alias("part")))
    again = tables.keep(lines.select("doc_id", "line", "h").join(of, "h").select("doc_id", "line", "part"), "again")
    named = tables.keep(again.groupBy("part").agg(F.min(F.struct("doc_id", "line")).alias("of")).select("part", F.col("of.doc_id").alias("first_doc_id"), F.col("of.line").alias("first_line")), "named")
    tables.drop_but("again", "named")
    kept = (F.col("doc_id") == F.col("first_doc_id")) & (F.col("line") == F.col("first_line"))
    return again.join(named, "part").select("doc_id", "line", "first_doc_id", "first_line", kept.alias("kept"))


def remove_lines(df: DataFrame, radius: int = RADIUS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None, least_words: int = 1) -> DataFrame:
    """The input's rows and columns, texts without the lines that are kept elsewhere. A document that loses lines
    and keeps none of `least_words` words goes; all others, null texts and ids too, stay."""
    gone = line_groups(df, radius, least, id_col, text_col, wide=wide).where("not kept").groupBy("doc_id").agg(F.collect_set("line").alias("what"))
    return rewrite(df, gone, partial(_left_over, least_words=least_words), id_col, text_col)


def _left_over(text: str, gone: list[int], least_words: int) -> str | None:
    out = set(gone)
    left = [x for k, x in enumerate(text.split("\n")) if k not in out]
    return "\n".join(left) if any(len(x.encode().split()) >= least_words for x in left) else None
