"""Packs documents into windows by non-negative least squares over the histogram of piece lengths.

Documents are cut at whole windows only; what remains of each is one piece. The lengths' histogram, one
count per length however large the corpus, goes to the driver. There, combinations of two and three
lengths that fill a window exactly are enumerated, their repeat counts solved by accelerated projected
gradient, rounded down to what the histogram holds, and the rest packed greedily, again whole counts at
a time. The plan is a table of rank ranges per length, so every piece finds its sequence from its rank
among the pieces of its length, and no group of pieces is ever brought together.
"""

from __future__ import annotations

import contextlib
import math
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Tables, give_back, keep_between_tasks, no_cycles, text_slices

WINDOW = 2048
END_ID = 1
#: Words a worker remembers, at about 150 bytes each.
CACHED = 1_500_000
PUNCTUATION = b".,;:!?*#$%&"


class WordTokenizer:
    """Ids as the tokenizers library gives them, each distinct word encoded once.

    Tokens of this vocabulary never span white space, nor the border between an ASCII letter or digit and
    the punctuation that ends a word, and its normalisation is local to such parts: a text's ids are its
    parts' ids in a row. Parts not met before are encoded a thousand at a time with blanks between them and
    told apart by their offsets; words with other than Latin letters or the start of a special token go alone.
    What is met again while it is remembered stays; what is not is forgotten with the task that met it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lasting: dict[bytes, bytes] = {}
        self.recent: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _recall(self, parts: set[bytes], found: dict[bytes, bytes]) -> set[bytes]:
        """Puts what is remembered of the parts into found; returns the others."""
        lasting, recent, new = self.lasting, self.recent, set()
        for w in parts:
            if (ids := lasting.get(w)) is None:
                if (ids := recent.pop(w, None)) is None:
                    new.add(w)
                    continue
                lasting[w] = ids
            found[w] = ids
        return new

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not lasting."""
        found: dict[bytes, bytes] = {}
        words = self._recall(words, found)
        ends, parts = {}, set()
        for w in words:
            stem = w.rstrip(PUNCTUATION)
            if len(stem) < len(w) and stem and stem[-1:].isalnum() and b"<|" not in w:
                ends[w] = stem, w[len(stem) :]
                parts.update(ends[w])
            else:
                parts.add(w)
        plain, fresh = [], {}
        for w in self._recall(parts, found):
            text = w.decode()
            if b"<|" in w or not (text.isascii() or max(text) < "\u0180" and not any(c.isspace() for c in text)):
                fresh[w] = self._ids(text)
            else:
                plain.append((w, text))
        for k in range(0, len(plain), 1000):
            part = plain[k : k + 1000]
            starts = np.cumsum([0, *(len(t) + 1 for _, t in part)])
            encoded = self.library.encode(" ".join([t for _, t in part]), add_special_tokens=False)
            raw = np.array(encoded.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array([a for a, _ in encoded.offsets], np.int64), starts)).tolist()
            fresh.update((w, raw[a:b]) for (w, _), a, b in zip(part, cuts, cuts[1:], strict=False))
        found.update(fresh)
        for w, (stem, end) in ends.items():
            found[w] = fresh[w] = found[stem] + found[end]
        self.recent.update(fresh)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for held in (self.lasting, self.recent):
            if len(held) > CACHED:
                held.clear()
        get, rows, fresh = self.lasting.get, [], set()
        for t in texts:
            raw = (t or "").encode()
            words = (raw if b"<|" in raw else raw.lower()).split()
            ids = list(map(get, words))
            gaps, at = [], -1
            with contextlib.suppress(ValueError):  # the places of None, found without a step per word
                while True:
                    at = ids.index(None, at + 1)
                    gaps.append((at, words[at]))
            fresh.update(w for _, w in gaps)
            rows.append((ids, gaps))
        found = self._learn(fresh) if fresh else {}
        for ids, gaps in rows:
            for at, w in gaps:
                ids[at] = found[w]
        return [b"".join(ids) for ids, _ in rows]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    work = WordTokenizer(path)
    keep_between_tasks("packing", work.lasting)
    return work


def combinations_of(window: int) -> np.ndarray:
    """(n, 3): pairs, and triples with a middle length from a ladder of shares of the window, that fill it; 0 pads a pair."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack((window - a, a, np.zeros_like(a)), 1)
    ladder = np.unique(np.maximum(1, window * np.array([1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32]) // 64))
    lengths = np.arange(1, window)
    x, y = (v.ravel() for v in np.meshgrid(lengths, ladder, indexing="ij"))
    z = window - x - y
    triples = np.sort(np.stack((x, y, z), 1)[z >= 1], 1)[:, ::-1]
    return np.concatenate((pairs, np.unique(triples, axis=0)))


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x with least |A x - histogram|, A having a combination's lengths as a column (FISTA)."""
    n = len(histogram)
    used = combos > 0

    def forward(x):
        out = np.zeros(n)
        for k in range(combos.shape[1]):
            out += np.bincount(combos[:, k], x * used[:, k], n)
        return out

    def backward(r):
        return sum(r[combos[:, k]] * used[:, k] for k in range(combos.shape[1]))

    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A
        v = backward(forward(v))
        size = np.linalg.norm(v)
        v /= size
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - backward(forward(y) - histogram) / size)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / nt * (new - x), new, nt
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): uses every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    out = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    if left.sum():
        combos = combinations_of(window)
        combos = combos[(left[combos] > 0).all(1, where=combos > 0)]
        if len(combos):
            x = solve_counts(combos, left.astype(float))
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                lengths = [int(v) for v in combos[k] if v]
                times = min(int(x[k]), *(int(left[v]) // lengths.count(v) for v in lengths))
                if times > 0:
                    for v in lengths:
                        left[v] -= times
                    out.append((tuple(lengths), times))
    while left.any():  # each round uses up a length: the largest, and what fills its window best
        lengths, gap, free = [], window, left.copy()
        while gap > 0 and (fits := np.flatnonzero(free[: gap + 1])).size:
            lengths.append(int(fits[-1]))
            free[fits[-1]] -= 1
            gap -= int(fits[-1])
        times = min(int(left[v]) // lengths.count(v) for v in lengths)
        for v in lengths:
            left[v] -= times
        out.append((tuple(lengths), times))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """By length and first rank: the ranks from `rank` on go to sequences from `sequence` on, at `offset`."""
    rows, sequence, next_rank = [], 0, {}
    for lengths, times in patterns:
        offset = 0
        for v in lengths:
            rank = next_rank.get(v, 0)
            rows.append((v, rank, sequence, offset))
            next_rank[v] = rank + times
            offset += v
        sequence += times
    cells = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": cells[:, 0], "rank": cells[:, 1], "sequence": cells[:, 2], "offset": cells[:, 3]}


def pieces(df: DataFrame, tokenizer_file: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(part, doc_id, start, length, ids_crc32, doc_tokens, k[, ids]): each text's ids and END_ID, cut at whole windows.

    k numbers the pieces of a length within a partition."""

    def run(batches):
        try:
            with no_cycles():
                yield from cut_up(batches)
        finally:
            tokenizer(tokenizer_file).recent.clear()
            give_back()

    def cut_up(batches):
        work, counts, part = tokenizer(tokenizer_file), {}, 0
        for batch in text_slices(batches, "text", 1 << 20, "packing"):
            part = batch.column("part")[0].as_py()
            rows = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), work.encode(batch.column("text").to_pylist()), strict=True):
                raw += END_ID.to_bytes(4, "little")
                n = len(raw) // 4
                for start in range(0, n, window):
                    own = raw[4 * start : 4 * (start + window)]
                    size = len(own) // 4
                    k = counts.get(size, 0)
                    counts[size] = k + 1
                    rows.append((part, doc, start, size, zlib.crc32(own), n, k, own))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).withColumn("part", F.spark_partition_id().cast("long"))
    return rows.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_file: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece.

    A null or empty text is its end id alone. Repeated rows, null ids included, are packed each; an empty
    table gives none; other columns are not read. Ties are broken by partition and place within it.
    """
    tables = Tables(df.sparkSession, "packing")
    cut = tables.keep(pieces(df, tokenizer_file, window, id_col, text_col, with_ids), "pieces")
    counts = tables.keep(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length: window rows at most
        histogram[r["length"]] = r["n"]
    found = df.sparkSession.sparkContext.broadcast(slots(plan(histogram, window)))

    def place(batches):
        cells = found.value
        first = np.searchsorted(cells["length"], np.arange(window + 2))
        span = int(cells["rank"].max(initial=0)) + 1
        key = cells["length"] * span + cells["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(key, length * span + np.minimum(rank, span - 1), "right") - 1
            assert (at >= first[length]).all()
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(cells["sequence"][at] + rank - cells["rank"][at])
            columns["offset"] = pa.array(cells["offset"][at])
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    # a merge join: the bases are a row for each partition and length, which is too many to broadcast
    ranked = cut.join(before.hint("merge"), ["part", "length"]).select(*[n for n in names if n not in ("sequence_id", "offset")], (F.col("base") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(place, schema)


def padding(sequence_lengths: list[int], window: int = WINDOW) -> int:
    """Ids of padding: to the window, none at a power of two."""
    return sum(n * (0 if k & (k - 1) == 0 else window - k) for k, n in ((k, len(list(g))) for k, g in groupby(sorted(sequence_lengths))))
