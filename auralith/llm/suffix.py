"""Repeated passages by a sparse suffix array: retained suffixes, sorted, neighbours compared, matches extended.

In every window of the least passage length, the place of its smallest 10-word hash (its minimiser, the leftmost of
equal ones) is retained, so two copies of a passage retain the same places. Suffixes whose opening occurs once (nearly
all) are dropped by a key exchange. The others, with the words before them that their windows reach, are sorted by
their words over range partitions. Neighbours are compared word by word to the right, and to the left in the order of
the words read backwards; the lengths of these common parts tell for every extension to the left which suffixes hold
the same window. Each match is extended over its windows both ways, and extensions that meet are one passage. Classes
that reach the edge of a sorted piece, where neighbours lie in other tasks, are joined by their windows' hashes.
Words are 64-bit hashes (XXH64).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import answer, blocks, cell_bits, expand, gather, read_block, send, squeeze
from .common import Tables, cells_for, mix64, rewrite

MIN_WORDS = 50
OPENING = 10
BASE = np.uint64(0xD6E8FEB86659FD93)
NOWHERE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Sorted suffixes that are compared at a time.
PIECE = 32_768
ROWS = "cell long, chunk long, data binary"
#: Input bytes that a range of sorted suffixes should stand for: pieces bound the memory, so ranges may be wide and few.
SORTED_BYTES = 32 << 20
#: A retained suffix's words, those before it (nearest first), its earliest place and how often its block holds it;
#: or a block's own places (data).
SUFFIXES = "chunk long, item long, right binary, left binary, doc_id long, place long, n int, data binary"


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def run_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` words from every place on (fewer places than words by size - 1)."""
    n = len(word)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, BASE))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - size, np.uint64(_inverse(int(BASE)))))), dtype=np.uint64)
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(word) * power, dtype=np.uint64)))
    return mix64((total[size:] - total[:-size]) * back)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` values, by doubling."""
    done, out = 1, values
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(values) - width + 1], out[width - done :]) if done < width else out


class Places:
    """A block's retained places: of each, how many words after a window's start it lies at least and at most."""

    def __init__(self, block, least: int, opening: int = OPENING):
        self.doc = np.repeat(np.arange(len(block.size)), block.size)
        n = len(self.doc)
        count = max(0, n - least + 1)
        left = block.start[1:][self.doc] - np.arange(n)  # words from here to the document's end
        windows = np.flatnonzero(left[:count] >= least)
        if not len(windows):
            self.at = self.near = self.far = np.zeros(0, np.int64)
            self.opening = np.zeros(0, np.uint64)
            return
        openings = run_hashes(block.word, opening)
        order = np.argsort(openings, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = order[sliding(rank, least - opening + 1, np.minimum)[windows]]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        self.at = at[new]
        self.far = self.at - windows[new]
        self.near = self.at - windows[np.concatenate((new[1:], [len(at)])) - 1]
        self.opening = openings[self.at]


def common_parts(rows: np.ndarray) -> np.ndarray:
    """Of each row but the first: how many leading columns equal those of the row before."""
    if rows.shape[1] == 0:
        return np.zeros(max(0, len(rows) - 1), np.int64)
    other = rows[1:] != rows[:-1]
    return np.where(other.any(1), other.argmax(1), rows.shape[1])


def symbols(data: list[bytes], width: int) -> np.ndarray:
    """Rows of `width` word hashes, zero where a row ends sooner."""
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in data), ">u8").reshape(len(data), width)


def window_hashes(words: np.ndarray) -> np.ndarray:
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(words.shape[1] - 1, BASE))), dtype=np.uint64)
    return mix64((mix64(words) * power).sum(1, dtype=np.uint64))


def earliest(slot: np.ndarray, n: int, values: list[np.ndarray]) -> list[np.ndarray]:
    """Of each class: the smallest (doc_id, place), and how many places it has."""
    doc, place, times = values
    order = np.lexsort((place, doc, slot))
    first = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]
    return [doc[first], place[first], np.bincount(slot, times, n).astype(np.int64)]


def extensions(chunk, item, ahead, doc, place) -> pd.DataFrame:
    """ROWS (cell -1) for the blocks: each suffix's windows in a row with one first holder, as one extension."""
    order = np.lexsort((ahead, item, chunk))
    chunk, item, ahead, doc, place = (x[order] for x in (chunk, item, ahead, doc, place))
    same = [x[1:] == x[:-1] for x in (chunk, item, doc, place)]
    new = np.flatnonzero(np.concatenate(([True], ~(np.logical_and.reduce(same) & (ahead[1:] == ahead[:-1] + 1)))))
    last = np.concatenate((new[1:], [len(chunk)])) - 1
    of = chunk[new]
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    found = [item[new].astype(np.uint32), ahead[new].astype(np.uint32), ahead[last].astype(np.uint32), doc[new], place[new]]
    data = [squeeze(*(x[a:b] for x in found)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True)]
    return pd.DataFrame({"cell": np.full(len(cuts), -1), "chunk": of[cuts], "data": data})


def compare(pdf: pd.DataFrame, piece: int, least: int, bits: int, opening: int = OPENING):
    """ROWS of a piece of sorted suffixes: extensions (cell -1), and of classes that may go on in another piece the
    windows for the exchange (cell 0 and more) and the places they answer (cell -2)."""
    reach = least - opening
    right, left = symbols(pdf["right"].tolist(), least), symbols(pdf["left"].tolist(), reach)
    far = pdf["left"].str.len().to_numpy() // 8
    near = least - pdf["right"].str.len().to_numpy() // 8
    chunk, item, doc, place, times = (pdf[c].to_numpy() for c in ("chunk", "item", "doc_id", "place", "n"))
    n = len(pdf)
    after = common_parts(right)
    raw = left.tobytes()
    back = np.array(sorted(range(n), key=lambda k: raw[8 * reach * k : 8 * reach * (k + 1)]))
    before = common_parts(left[back])
    closed, opened = [], []
    for ahead in range(reach + 1):  # the window starts this many words before the suffix
        rows = np.flatnonzero((near <= ahead) & (ahead <= far))
        if not len(rows):
            continue
        follow = np.concatenate(([0], np.cumsum(after < least - ahead)))
        lead = np.empty(n, np.int64)
        lead[back] = np.concatenate(([0], np.cumsum(before < ahead)))
        _, some, slot = np.unique(follow[rows] * n + lead[rows], return_index=True, return_inverse=True)
        holder, where, count = earliest(slot, len(some), [doc[rows], place[rows], times[rows]])
        edge = (follow[rows[some]] == 0) | (follow[rows[some]] == follow[-1])
        keep = (~edge & (count > 1))[slot]
        closed.append((rows[keep], np.full(keep.sum(), ahead), holder[slot][keep], where[slot][keep]))
        if edge.any():
            some = rows[some[edge]]
            key = window_hashes(np.hstack((left[some, :ahead][:, ::-1], right[some, : least - ahead])).astype(np.uint64))
            number = np.cumsum(edge) - 1
            at = edge[slot]
            opened.append((key, holder[edge], where[edge], np.minimum(count[edge], 2), rows[at], np.full(at.sum(), ahead), number[slot][at]))
    if closed:
        rows, ahead, holder, where = (np.concatenate(x) for x in zip(*closed, strict=True))
        if len(rows):
            yield extensions(chunk[rows], item[rows], ahead, holder, where)
    if opened:
        base = np.cumsum([0] + [len(x[0]) for x in opened])
        key, holder, where, count = (np.concatenate([x[k] for x in opened]) for k in range(4))
        rows, ahead = (np.concatenate([x[k] for x in opened]) for k in (4, 5))
        slot = np.concatenate([x[6] + b for x, b in zip(opened, base, strict=False)])
        keys, number = np.unique(key, return_inverse=True)
        holder, where, count = earliest(number, len(keys), [holder, where, count])
        own = squeeze(chunk[rows], item[rows].astype(np.uint32), ahead.astype(np.uint32), number[slot].astype(np.uint32))
        yield pd.DataFrame({"cell": [-2], "chunk": [piece], "data": [own]})
        yield pd.DataFrame(send(piece, keys, [holder, where, np.minimum(count, 2).astype(np.uint8)], bits), columns=["cell", "chunk", "data"])


def passages(df: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, first): the runs of words that occur more than once, a row per
    document, run and first holder.

    A run is a longest sequence of windows of `least` words (A-Z lowered, split at ASCII white space) that each
    occur at least twice in the corpus and share the smallest doc_id among their holders; first tells the place
    to keep: that document's, at its first occurrence there. start and n_words count words of the text.
    Runs may overlap if their first holders differ. Null and short texts have none; rows that share a doc_id
    are one document's (each is listed); rows with a null id are compared by no one. An empty table gives none.
    """
    tables = Tables(df.sparkSession, "suffix")
    bits, parts = cell_bits(df), cells_for(df, SORTED_BYTES)
    made = tables.keep(blocks(df.where(F.col(id_col).isNotNull()), F.lit(0), F.lit(0), id_col, text_col), "blocks")

    def openings(batches):
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"], pdf["data"], strict=True):
                keys, n = np.unique(Places(read_block(data), least).opening, return_counts=True)
                yield pd.DataFrame(send(chunk, keys, [n.astype(np.uint32)], bits), columns=["cell", "chunk", "data"])

    often = answer(made.mapInPandas(openings, ROWS), lambda slot, n, v: [(np.bincount(slot, v[0], n) > 1).astype(np.uint8)], 1, 1)

    def retain(key, left, right):
        out = [pd.DataFrame({c: [] for c in ("chunk", "item", "right", "left", "doc_id", "place", "n", "data")})]
        for data in left["data"]:
            if not len(right):
                continue
            block = read_block(data)
            places = Places(block, least)
            keys, slot = np.unique(places.opening, return_inverse=True)
            live = np.flatnonzero(gather(right)[0][slot] > 0)
            if not len(live):
                continue
            at, near, far = places.at[live], places.near[live], places.far[live]
            number: dict[tuple[bytes, bytes], int] = {}
            item = np.empty(len(at), np.int64)
            for a in range(0, len(at), 4096):
                own = slice(a, a + 4096)
                after = block.word.take(at[own, None] + np.arange(least), mode="clip").astype(">u8").tobytes()
                before = block.word.take(at[own, None] - np.arange(1, least - OPENING + 1), mode="clip").astype(">u8").tobytes()
                for k, (x, y) in enumerate(zip(near[own].tolist(), far[own].tolist(), strict=True)):
                    r, b = 8 * least * k, 8 * (least - OPENING) * k
                    item[a + k] = number.setdefault((after[r : r + 8 * (least - x)], before[b : b + 8 * y]), len(number))
            doc = places.doc[at]
            place = at - block.start[doc]
            ids, first, n = earliest(item, len(number), [block.doc_id[doc], place, np.ones(len(at))])
            holders, rank = np.unique(doc, return_inverse=True)
            own = squeeze(block.doc_id[holders], rank.astype(np.uint32), np.diff(place, prepend=0), item.astype(np.uint32))
            words = list(number)
            out.append(pd.DataFrame({"chunk": key[0], "item": np.arange(len(words)), "right": [w[0] for w in words], "left": [w[1] for w in words], "doc_id": ids, "place": first, "n": np.minimum(n, 2), "data": None}))
            out.append(pd.DataFrame({"chunk": [key[0]], "item": [0], "right": [None], "left": [None], "doc_id": [0], "place": [0], "n": [0], "data": [own]}))
        return pd.concat(out)

    retained = tables.keep(made.select("chunk", "data").groupBy("chunk").cogroup(often.groupBy("chunk")).applyInPandas(retain, SUFFIXES), "retained")
    tables.drop_but("retained")
    # A passage of many copies has equal words after a place and others before it: their hash parts it among ranges.
    by = ("right", F.xxhash64("left"))
    suffixes = retained.where("data is null").drop("data").repartitionByRange(parts, *by).sortWithinPartitions(*by)

    def neighbours(batches):
        part, k, waiting, rows = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            waiting.append(pdf)
            rows += len(pdf)
            if rows >= PIECE:
                yield from compare(pd.concat(waiting), part << 24 | k, least, bits)
                k, waiting, rows = k + 1, [], 0
        if rows:
            yield from compare(pd.concat(waiting), part << 24 | k, least, bits)

    found = tables.keep(suffixes.mapInPandas(neighbours, ROWS), "found")
    edges = answer(found.where("cell >= 0"), lambda slot, n, v: [*(x := earliest(slot, n, v))[:2], (x[2] > 1).astype(np.uint8)], 3, 3)

    def across(_, left, right):
        out = [pd.DataFrame({"cell": pd.Series(dtype="int64"), "chunk": pd.Series(dtype="int64"), "data": pd.Series(dtype=object)})]
        for data in left["data"]:
            chunk, item, ahead, slot = expand(data)
            holder, where, more = (x[slot] for x in gather(right))
            keep = more > 0
            if keep.any():
                out.append(extensions(chunk[keep], item[keep].astype(np.int64), ahead[keep].astype(np.int64), holder[keep], where[keep]))
        return pd.concat(out)

    met = found.where("cell = -2").select("chunk", "data").groupBy("chunk").cogroup(edges.groupBy("chunk")).applyInPandas(across, ROWS)
    matches = found.where("cell = -1").unionByName(met).select("chunk", "data")

    def runs(_, left, right):
        out = [pd.DataFrame({c: [] for c in ("doc_id", "start", "n_words", "first_doc_id", "first")})]
        for data in left["data"]:
            if not len(right):
                continue
            ids, rank, step, item = expand(data)
            of, near, far, holder, where = (np.concatenate(x) for x in zip(*map(expand, right["data"]), strict=True))
            order = np.argsort(of, kind="stable")
            low, high = np.searchsorted(of[order], item), np.searchsorted(of[order], item, "right")
            place = np.repeat(np.arange(len(item)), high - low)
            match = order[_ranges(low, high - low)]
            size = (far[match] - near[match] + np.uint32(1)).astype(np.int64)
            ahead = _ranges(near[match].astype(np.int64), size)
            place, match = np.repeat(place, size), np.repeat(match, size)
            position = np.cumsum(step)[place]
            start = position - ahead
            rank, owner = rank[place], holder[match]
            own = (owner == ids[rank]) & (where[match] == position)
            order = np.lexsort((start, rank))
            start, rank, owner, own = start[order], rank[order], owner[order], own[order]
            new = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (start[1:] != start[:-1] + 1) | (owner[1:] != owner[:-1]) | (own[1:] != own[:-1]))))
            last = np.concatenate((new[1:], [len(start)])) - 1
            out.append(pd.DataFrame({"doc_id": ids[rank[new]], "start": start[new], "n_words": start[last] - start[new] + least, "first_doc_id": owner[new], "first": own[new]}))
        return pd.concat(out)

    schema = "doc_id long, start long, n_words long, first_doc_id long, first boolean"
    return retained.where("data is not null").select("chunk", "data").groupBy("chunk").cogroup(matches.groupBy("chunk")).applyInPandas(runs, schema)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... `size` numbers of each, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the (start, n_words) spans; white space next to a cut goes with it, but one line break or blank."""
    import re

    words = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    gone = np.zeros(len(words) + 1, bool)
    for start, n in spans:
        gone[start : start + n] = True
    out, at, k = [], 0, 0
    while k < len(words):
        if not gone[k]:
            k += 1
            continue
        end = k + int(np.argmin(gone[k:]))
        before = text[at : words[k][0]]
        kept = before.rstrip(" \t\n\v\f\r")
        out.append(kept)
        at = words[end - 1][1]
        after = len(text[at:]) - len(text[at:].lstrip(" \t\n\v\f\r"))
        if (kept or any(out)) and end < len(words):
            out.append("\n" if "\n" in before[len(kept) :] + text[at : at + after] else " ")
        at += after
        k = end
    out.append(text[at:])
    return "".join(out)


def remove_repeats(df: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, their texts without the passages that are kept in another place.

    Documents of which nothing is left go; texts without such passages (null ones too) stay as they are.
    """
    found = passages(df, least, id_col, text_col).where("not first")
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n_words")).alias("what"))
    return rewrite(df, spans, lambda text, found: cut(text, [(x["start"], x["n_words"]) for x in found]) or None, id_col, text_col)
