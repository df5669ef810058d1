"""Blocks of tokenised documents, and an exchange of their distinct keys that answers in the blocks' own order.

A block holds some hundred thousand words as local numbers with one 64-bit hash per distinct word. To learn
something about keys (n-grams, windows) over all blocks, each block sends its sorted distinct keys, cut by
their high bits into cells; a cell combines the blocks' values per key and returns to every block just the
values, in the order of the block's keys, which the block can make again. So what moves is one compressed
array per block and cell, pre-aggregated, whatever the skew of the keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cells_for, mix64, text_slices

#: Words of a block, as far as whole documents allow.
WORDS = 500_000
CODEC = "zstd"
BLOCK_SCHEMA = "chunk long, kind int, n_docs long, n_words long, data binary"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each array's bytes grouped by significance, compressed together."""
    parts = [b"%d;" % len(arrays)]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(b"%s;%d;" % (a.dtype.str.encode(), len(a)))
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec(CODEC, 1).compress(raw, asbytes=True)


def expand(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec(CODEC).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    at = raw.index(b";")
    n, at, out = int(raw[:at]), at + 1, []
    for _ in range(n):
        a = raw.index(b";", at)
        b = raw.index(b";", a + 1)
        kind, size = np.dtype(raw[at:a].decode()), int(raw[a + 1 : b])
        at = b + 1 + size * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * kind.itemsize, b + 1).reshape(kind.itemsize, size).T).reshape(-1).view(kind))
    return out


@dataclass
class Block:
    """Documents in a row: ids (with which are null), flags, words per document, and every word's hash."""

    doc_id: np.ndarray
    null_id: np.ndarray
    flag: np.ndarray
    size: np.ndarray
    word: np.ndarray

    @property
    def start(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.size)))


def read_block(data: bytes) -> Block:
    doc_id, null_id, flag, size, vocab, word = expand(data)
    return Block(doc_id, null_id.astype(bool), flag, size.astype(np.int64), vocab[word])


class _Builder:
    def __init__(self):
        self.vocab = defaultdict(count().__next__)
        self.docs, self.words, self.total = [], [], 0

    def add(self, doc, flag, words: list[bytes]) -> None:
        number = self.vocab
        self.words.append(np.array([number[w] for w in words], np.uint32))
        self.docs.append((doc, flag, len(words)))
        self.total += len(words)

    def data(self) -> bytes:
        ids, flags, sizes = zip(*self.docs, strict=True)
        vocab = np.array([xxhash.xxh64_intdigest(w) for w in self.vocab], np.uint64)
        return squeeze(np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), np.array(flags, np.uint8), np.array(sizes, np.uint32), vocab, np.concatenate(self.words))


def blocks(df: DataFrame, kind: Column, flag: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """BLOCK_SCHEMA: whole texts' words (A-Z lowered), documents of a kind together, in the input's order."""

    def run(batches):
        open_blocks: dict[int, _Builder] = {}
        made, part = 0, 0

        def close(kind):
            nonlocal made
            b = open_blocks.pop(kind)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([part << 24 | made - 1], pa.int64()), pa.array([kind], pa.int32()), pa.array([len(b.docs)], pa.int64()), pa.array([b.total], pa.int64()), pa.array([b.data()], pa.binary())], ["chunk", "kind", "n_docs", "n_words", "data"])

        for batch in text_slices(batches, "text", 1 << 20):
            part = batch.column("part")[0].as_py()
            for doc, text, kind, flag in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "kind", "flag")), strict=True):
                b = open_blocks.setdefault(kind, _Builder()) if kind not in open_blocks else open_blocks[kind]
                b.add(doc, flag, (text or "").encode().lower().split())
                if b.total >= words or len(b.docs) >= words:
                    yield close(kind)
        for kind in sorted(open_blocks):
            yield close(kind)

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), kind.cast("int").alias("kind"), flag.cast("int").alias("flag"), F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def cell_bits(df: DataFrame) -> int:
    return max(3, (cells_for(df) - 1).bit_length())


def send(chunk: int, keys: np.ndarray, values: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(cell, chunk, data) rows for sorted distinct keys and their values."""
    if not len(keys):
        return
    cell = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
        own = keys[a:b]
        yield int(cell[a]), chunk, squeeze(np.diff(own, prepend=np.uint64(0)), *(v[a:b] for v in values))


def answer(rows: DataFrame, combine: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]], n_values: int, n_answers: int, extra: Callable | None = None) -> DataFrame:
    """(chunk, cell, data): for each block and cell the answers in the order of the block's keys.

    combine(slot, values) gets the concatenated values with each entry's key number, and returns an array of
    answers by key number. extra(keys, answers) may add a row with chunk -1 whose data are its arrays.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [expand(x) for x in pdf["data"]]
        keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        order = np.concatenate(keys)
        del keys
        distinct, slot = np.unique(order, return_inverse=True)
        del order
        found = combine(slot, len(distinct), [np.concatenate([p[1 + k] for p in parts]) for k in range(n_values)])
        ends = np.cumsum(sizes)
        out = [squeeze(*(f[slot[e - n : e]] for f in found)) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        frame = pd.DataFrame({"chunk": pdf["chunk"], "cell": pdf["cell"], "data": out})
        if extra is not None:
            more = pd.DataFrame({"chunk": [-1], "cell": [int(pdf["cell"].iloc[0])], "data": [squeeze(*extra(distinct, found))]})
            frame = pd.concat([frame, more])
        return frame

    return rows.groupBy("cell").applyInPandas(run, "chunk long, cell long, data binary")


def gather(pdf: pd.DataFrame) -> list[np.ndarray]:
    """One block's answers from its rows of answer(), in the order of its sorted distinct keys."""
    parts = [expand(x) for _, x in sorted(zip(pdf["cell"], pdf["data"], strict=True), key=lambda r: r[0])]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def chain(context: np.ndarray, word: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams from their contexts' keys and last words; the two low bits tell the order."""
    h = mix64(context * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(order))
    return (h & ~np.uint64(3)) | np.uint64(order)
