"""Byte-level BPE without regex: transition-function scans cut the text, cached merges encode the slices.

Each code point becomes a symbol (its class, with one look ahead where the pattern needs it). An
eight-state automaton tells where a slice begins; its transition functions form a small monoid, so
blocks of text are composed side by side, the block functions by a log-step scan, and a second pass
marks the boundaries from each block's entry state. Slices not met before are merged together in
one padded matrix; every later occurrence is a dictionary lookup.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import keep_between_tasks, no_cycles, text_slices

# Symbols: letter, number, other, apostrophe + one letter, apostrophe + two letters, last blank before
# something, last other white space before something, any other white space, end of a text.
L, N, O, A1, A2, SP, WL, WS, END = range(9)
SYMBOLS = 9
# States: fresh, in letters, in numbers, in others, in white space, after a blank that may lead a
# slice, one contraction letter to come, two to come.
FRESH, IN_L, IN_N, IN_O, IN_W, LEAD, ONE, TWO = range(8)
BLOCK = 64
CACHED = 400_000


def _step(state: int, sym: int) -> tuple[int, bool]:
    """Next state, and whether a slice begins at this symbol."""
    if sym == END:
        return FRESH, True
    if state in (ONE, TWO):
        return (FRESH if state == ONE else ONE), False
    if sym in (A1, A2):
        return (IN_O, False) if state in (IN_O, LEAD) else (ONE if sym == A1 else TWO, True)
    if sym in (L, N, O):
        own = (IN_L, IN_N, IN_O)[sym]
        return own, state not in (own, LEAD)
    if sym == SP:
        return LEAD, True
    if sym == WL:
        return IN_W, True
    return IN_W, state != IN_W


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, ...]:
    """next[state, sym], begins[state, sym], compose[f, sym], compose2[f, g] (f first), apply[f, state]."""
    nxt = np.array([[_step(s, y)[0] for y in range(SYMBOLS)] for s in range(8)], np.uint8)
    begins = np.array([[_step(s, y)[1] for y in range(SYMBOLS)] for s in range(8)], bool)
    one = tuple(range(8))
    ids, todo = {one: 0}, [one]
    for f in todo:
        for y in range(SYMBOLS):
            g = tuple(int(nxt[s, y]) for s in f)
            if g not in ids:
                ids[g] = len(ids)
                todo.append(g)
    apply = np.array(todo, np.uint8)
    compose = np.array([[ids[tuple(int(nxt[s, y]) for s in f)] for y in range(SYMBOLS)] for f in todo], np.uint16)
    compose2 = np.array([[ids[tuple(g[s] for s in f)] for g in todo] for f in todo], np.uint16)
    return nxt, begins, compose, compose2, apply


@lru_cache(1)
def _classes() -> np.ndarray:
    """Symbol class by code point: L, N, O, or WS for any white space."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(0x110001, O, np.uint8)
    for sym, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (WS, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = sym
    out[0x110000] = END
    return out


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined with a filler after each, the starts of all slices (fillers' too) and the fillers' places."""
    joined = "\0".join(texts) + "\0"
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    cps[ends] = 0x110000
    sym = _classes()[cps]
    white = sym == WS
    alone = white.copy()
    alone[:-1] &= ~(white[1:] | (sym[1:] == END))
    alone[-1] = False
    sym[alone] = WL
    sym[alone & (cps == 0x20)] = SP
    tick = np.flatnonzero(cps == 0x27)
    if len(tick):
        padded = np.append(cps, [0x110000] * 2).astype(np.uint32)
        a, b = padded[tick + 1], padded[tick + 2]
        # fixed values: the contractions of the public split pattern
        sym[tick[np.isin(a, [ord(c) for c in "stmd"])]] = A1
        for pair in ("re", "ve", "ll"):
            sym[tick[(a == ord(pair[0])) & (b == ord(pair[1]))]] = A2
    nxt, begins, compose, compose2, apply = _automaton()
    n = len(sym)
    lanes = -(-n // BLOCK)
    grid = np.full(lanes * BLOCK, END, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    flat, f = compose.ravel(), np.zeros(lanes, np.uint16)
    for row in grid:
        f = flat[f * np.uint16(SYMBOLS) + row]
    step = 1
    while step < lanes:  # inclusive scan of the blocks' functions
        f = np.concatenate((f[:step], compose2[f[:-step], f[step:]]))
        step *= 2
    state = np.full(lanes, FRESH, np.uint8)
    state[1:] = apply[f[:-1], FRESH]
    marks, fn, fb = np.empty((BLOCK, lanes), bool), nxt.ravel(), begins.ravel()
    for k, row in enumerate(grid):
        at = state * np.uint8(SYMBOLS) + row
        marks[k], state = fb[at], fn[at]
    return joined, np.flatnonzero(marks.T.ravel()[:n]), ends


class BytePairCodec:
    """Encodes and decodes by a rank file; special tokens are ordinary text."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.none = np.int64(1 << 40)
        self.cache: dict[str, tuple[str, tuple[int, ...]]] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], self.none)

    def _merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Merges pieces of similar length at once, the lowest rank (leftmost on ties) of each in every round."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(width)[None, :] < size[:, None]
        ids[:, :-1][inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._ranks_of(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        out: list = [None] * len(pieces)
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == self.none
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    row = ids[k]
                    out[rows[k]] = tuple(row[row >= 0].tolist())
                live = ~done
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return out
            me, cols = np.arange(len(rows)), np.arange(ids.shape[1])
            take = cols[None, :] + (cols[None, :] > at[:, None])  # drops the column after the merged one
            ids[me, at] = best
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), take, 1)
            take = take[:, :-1]
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=self.none), take, 1)
            ranks[me, at] = self._ranks_of(ids[me, at], ids[me, at + 1])
            back = at > 0
            ranks[me[back], at[back] - 1] = self._ranks_of(ids[me[back], at[back] - 1], ids[me[back], at[back]])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """One long piece by a heap over linked neighbours: n log n."""
        import heapq

        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        prev, nxt, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        pair = self._pair_dict()
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (q := pair.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return tuple(ids[i] for i in range(n) if alive[i])

    @lru_cache(1)  # noqa: B019
    def _pair_dict(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))

    def learn(self, pieces: list[str]) -> None:
        """Fills the cache for these distinct pieces."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[piece] = (str(rank), (rank,))
            elif len(raw) > 64:
                ids = self._merge_long(raw)
                self.cache[piece] = (",".join(map(str, ids)), ids)
            else:
                groups.setdefault(-(-len(raw) // 4), []).append((piece, raw))
        for group in groups.values():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                for (piece, _), ids in zip(part, self._merge_many([raw for _, raw in part]), strict=True):
                    self.cache[piece] = (",".join(map(str, ids)), ids)

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """For each text its ids as decimals joined by commas, and as a list."""
        if not texts:
            return
        joined, starts, ends = boundaries(texts)
        first = np.searchsorted(starts, ends)  # the fillers' own slices
        bounds = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(bounds, chain(bounds[1:], (len(joined),)))]
        if len(self.cache) > CACHED:
            self.cache.clear()
        fresh = set(pieces).difference(self.cache)
        self.learn(list(fresh))
        got = list(map(self.cache.__getitem__, pieces))
        at = 0
        for k in first.tolist():
            own = got[at:k]
            yield ",".join([x[0] for x in own]), list(chain.from_iterable([x[1] for x in own]))
            at = k + 1

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte offset at which each id's bytes begin, and the total last."""
        return np.concatenate(([0], np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)))


@lru_cache(2)
def codec(rank_file: str) -> BytePairCodec:
    work = BytePairCodec(rank_file)
    keep_between_tasks("bpe", work.cache)
    return work


ENCODED = "doc_id long, ids array<int>, offsets array<long>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(df: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", output: str = "ids") -> DataFrame:
    """One row per input row: with output="ids" the ids and each id's byte offset (total last), with "digest"
    the number of ids and SHA-256 digests of the ids and of the bytes decoded from them.

    A null text is an empty one: no ids. Null ids stay null, repeated rows are encoded each, an empty table
    gives no rows, other columns are not read. Texts of any length are encoded whole. No shuffle.
    """

    def run(batches):
        with no_cycles():
            yield from encoded(codec(rank_file), batches)

    def encoded(work, batches):
        for batch in text_slices(batches, "text", 1 << 20, "bpe"):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            if output == "ids":
                rows = [ids for _, ids in work.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), pa.array([work.offsets(r) for r in rows], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])
            else:
                size, own, back = [], [], []
                for said, ids in work.encode_batch(texts):
                    size.append(len(ids))
                    own.append(hashlib.sha256(said.encode()).hexdigest())
                    back.append(hashlib.sha256(work.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, T._parse_datatype_string(ENCODED if output == "ids" else DIGEST))


def decode_documents(df: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary) from arrays of ids; a null array gives empty bytes."""

    def run(batches):
        work = codec(rank_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([work.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].alias("ids")).mapInArrow(run, "doc_id long, data binary")
