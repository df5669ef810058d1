"""Groups of things that are near by fingerprint and similar on a closer look, without all pairs.

Classes (h, fp, size) that share a bucket of the pigeonhole blocks of their fingerprints propose a spanning
forest of real candidate pairs; what is needed to judge them is fetched once, and each is judged. Buckets in
which a proposal failed are looked at again for every candidate pair between different groups, so that the
groups are exactly the components of all pairs that are both near and similar.

Where near prints alone would miss similar pairs, classes also carry band keys (min-hashes of the parts of each,
some to a band): those that share a band meet as well, and are near up to a wider radius.

A bucket's members are sorted by class, so that its forest hangs on its smallest members: the same group proposes
the same pairs in every bucket that it shares.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralith.operators.blocks import join_sets

from .chunks import answer, cell_bits, expand, gather, send, squeeze
from .common import Tables, connected_components, mix64
from .simhash import FEW, finer_masks, key_masks, near_pairs, pair_hits

BUCKETS = "c long, key long, fp long, h long, size int"
#: Min-hash bands as 32-bit keys, two to a long column.
BANDS = 8
BAND_COLUMNS = ("m0", "m1", "m2", "m3")
#: Min-hashes in each band. Two sets of Jaccard similarity s share one of eight bands of three with 1 - (1 - s^3)^8.
BAND_ROWS = (3,) * BANDS
#: The number of the first band's buckets; those of masks and of their finer masks are below, those of blocks of a
#: crowded band BANDS further on.
FIRST_BAND = 1 << 32
#: Sizes in an exchange of buckets: steps to the double (of one byte, the last for all beyond), and several sizes at once.
SIZE_STEPS, SEVERAL = 15, 255
#: Bits of a fingerprint that are sent with the size, and the bits of a key that both leave.
SENT, KEY = 16, ~np.uint64((1 << 24) - 1)
STEPS = mix64(np.arange(1, 8 * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def band_columns(hashes: np.ndarray, size: np.ndarray, rows: tuple[int, ...] = BAND_ROWS, rarer: np.ndarray | None = None, weighted: int = 0) -> list[np.ndarray]:
    """BAND_COLUMNS of consecutive runs of hashes, bands of `rows` min-hashes; zero for empty runs.

    In the first `weighted` bands a hash is the smallest half as often for each step that its `rarer` (0 to 15) is below 15."""
    some = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[some]
    keys = np.zeros((BANDS, len(size)), np.uint64)
    lift = np.uint64(15) - rarer if weighted else None
    for k in range(BANDS if len(some) else 0):
        own = np.zeros(len(some), np.uint64)
        for step in STEPS[8 * k : 8 * k + rows[k]]:
            drawn = hashes * step
            if k < weighted:
                drawn = (drawn >> np.uint64(16)) << lift
            own = mix64(own + np.minimum.reduceat(drawn, begin))
        keys[k, some] = own >> np.uint64(32)
    return [(keys[k] << np.uint64(32) | keys[k + 1]).view(np.int64) for k in range(0, BANDS, 2)]


def _band_keys(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The 32-bit keys of BAND_COLUMNS, one array a band."""
    return [part for c in columns for part in (c.view(np.uint64) >> np.uint64(32), c.view(np.uint64) & np.uint64(0xFFFFFFFF))]


def _bucket_keys(fp: np.ndarray, masks: list[int], bands: list[np.ndarray]) -> np.ndarray:
    """One key of the bits of KEY for each mask and band (rows) and fingerprint."""
    own = [fp.view(np.uint64) & np.uint64(m) for m in masks] + _band_keys(bands)
    return np.stack([mix64(x + mix64(np.array([k + 1], np.uint64))) for k, x in enumerate(own)]) & KEY


def _turned(fp: np.ndarray, mask: int) -> np.ndarray:
    """SENT neighbouring bits of the fingerprints (the last follows the first), as few of the mask's as can be."""
    low = (1 << SENT) - 1
    turn = min(range(64), key=lambda k: ((mask >> k | mask << 64 - k) & low).bit_count())
    return (fp.view(np.uint64) >> np.uint64(turn) | fp.view(np.uint64) << np.uint64((64 - turn) % 64)) & np.uint64(low)


def _sized(keys: np.ndarray, fp: np.ndarray, size: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of members (one a column; masks first, then bands), sorted, with the steps of their sizes, SEVERAL
    for two and more, and for a mask's key some bits that its members may differ in."""
    code = np.minimum(SIZE_STEPS * np.log2(np.maximum(size, 1)), SEVERAL - 1).astype(np.uint64) << np.uint64(SENT)
    both = keys | code
    for k, mask in enumerate(masks):
        both[k] |= _turned(fp, mask)
    both = np.sort(both.reshape(-1))
    at = np.flatnonzero(np.diff(both >> np.uint64(24), prepend=~np.uint64(0)))
    many = np.diff(at, append=len(both)) > 1
    return both[at] & KEY, np.where(many, SEVERAL, both[at] >> np.uint64(SENT) & np.uint64(255)).astype(np.uint8), both[at].astype(np.uint16)


def _matched(slot: np.ndarray, n: int, codes: np.ndarray, bits: np.ndarray, radius: int, least: float) -> np.ndarray:
    """Of n keys those that have two members, in two blocks or one, whose sizes may allow the similarity and whose bits
    (zero for bands) the radius; of many members the sizes alone decide."""
    apart = int(SIZE_STEPS * np.log2(1 / least) + 1e-9) + 1 if least > 0 else SEVERAL
    out = np.zeros(n, np.uint8)
    out[slot[codes == SEVERAL]] = 1
    count = np.bincount(slot, minlength=n)
    count[out > 0] = 0
    some = np.flatnonzero(count[slot] > 1)
    both = np.sort(slot[some].astype(np.int64) << 24 | codes[some].astype(np.int64) << SENT | bits[some])
    for step in range(1, FEW):  # neighbours, those next but one, ...
        many = count[both >> 24]
        both = both[(many > step) & (out[both >> 24] == 0)]
        x, y = both[:-step], both[step:]
        near = (x >> 24 == y >> 24) & ((y >> SENT) - (x >> SENT) <= apart)
        near &= (np.bitwise_count((x ^ y) & 0xFFFF) <= radius) | (count[x >> 24] > FEW)
        out[x[near] >> 24] = 1
        if not len(x):
            break
    return out


def _shared_buckets(classes: DataFrame, df: DataFrame, masks: list[int], bands: tuple[str, ...], tables: Tables, radius: int, least: float) -> DataFrame:
    """BUCKETS rows of the classes (h, fp, size, bands) for those buckets that have two members, one not too small for the
    other and, as far as a few bits tell, not too far from it.

    Which have is learned by the exchange of chunks.py, so that the many buckets of one are never shuffled as rows."""
    bits = cell_bits(df)

    def store(batches):
        for n, batch in enumerate(batches):
            part = batch.column("part")[0].as_py() if batch.num_rows else 0
            data = [squeeze(*(np.asarray(batch.column(c)) for c in ("h", "fp", "size", *bands)))]
            yield pa.RecordBatch.from_arrays([pa.array([part << 24 | n], pa.int64()), pa.array(data, pa.binary())], ["chunk", "data"])

    rows = classes.select("h", "fp", "size", *bands, F.spark_partition_id().cast("long").alias("part"))
    stored = tables.keep(rows.mapInArrow(store, "chunk long, data binary"), "class-blocks")

    def ask(batches):
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"], pdf["data"], strict=True):
                _, fp, size, *own = expand(data)
                keys, *told = _sized(_bucket_keys(fp, masks, own), fp, size, masks)
                yield pd.DataFrame(send(chunk, keys, told, bits), columns=["cell", "chunk", "data"])

    def matched(slot, n, values):
        return [_matched(slot, n, *values, radius, least)]

    told = answer(stored.mapInPandas(ask, "cell long, chunk long, data binary"), matched, 2, 1)

    def pick(_, left, right):
        out = []
        for data in left["data"]:
            h, fp, size, *more = expand(data)
            if len(h):
                own = _bucket_keys(fp, masks, more)
                shared = np.append(np.unique(own)[gather(right)[0] > 0], ~np.uint64(0))
                c, at = np.nonzero(shared[np.searchsorted(shared, own)] == own)
                key = np.stack([fp & np.int64(m - (1 << 64) if m >> 63 else m) for m in masks] + [x.view(np.int64) for x in _band_keys(more)])[c, at]
                out.append(pd.DataFrame({"c": np.where(c < len(masks), c, c - len(masks) + FIRST_BAND), "key": key, "fp": fp[at], "h": h[at], "size": size[at]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("c", "key", "fp", "h", "size")})

    return stored.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(pick, BUCKETS)


def _finer(masks: list[int], radius: int, large: int):
    """Members (c, key, fp, h, size, n) of crowded buckets of n, as BUCKETS rows of the smaller buckets that replace them:
    those of a mask by finer masks; those of a band by pairs of blocks of at most some large / 2, so that any two meet."""

    def run(batches):
        for batch in batches:
            c, bucket, fp, h, size, n = (np.asarray(batch.column(k)) for k in ("c", "key", "fp", "h", "size", "n"))
            for k in np.unique(c).tolist():
                at = np.flatnonzero(c == k)
                if k >= FIRST_BAND:
                    blocks = -(-2 * n[at] // large)
                    block = (mix64(h[at].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                    for start, stop in portions(blocks, 1 << 18):
                        many = blocks[start:stop]
                        own = np.repeat(np.arange(start, stop), many)
                        other = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
                        low, high = np.minimum(block[own], other), np.maximum(block[own], other)
                        own = at[own]
                        key = bucket[own] << 32 | low << 16 | high
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k + BANDS)), pa.array(key), pa.array(fp[own]), pa.array(h[own]), pa.array(size[own])], ["c", "key", "fp", "h", "size"])
                    continue
                finer = np.array(finer_masks(masks[k], radius), np.uint64)
                for start in range(0, len(at), 4096):
                    own = np.repeat(at[start : start + 4096], len(finer))
                    number = np.tile(np.arange(len(finer)), len(own) // len(finer))
                    key = (fp[own].view(np.uint64) & finer[number]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((k + 1) * len(finer) + number), pa.array(key), pa.array(fp[own]), pa.array(h[own]), pa.array(size[own])], ["c", "key", "fp", "h", "size"])

    return run


def portions(sizes: np.ndarray, most: int):
    """(start, stop) of runs of sizes that add up to at most `most`, or hold one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield at, stop
        at = stop


CANDIDATES = "c long, key long, a long, b long, overflow boolean"
#: Pairs that are judged at once, and characters of theirs: together they take fewer steps.
JUDGED, CHARS = 16384, 1 << 24


def _dealt(buckets: DataFrame) -> DataFrame:
    """The rows with each bucket (c, key) in one task, sorted. Dealt by a hash of c and key and not by these: Spark leaves
    out an exchange by the columns that a join has dealt rows by, and if it then broadcasts that join after all, a
    bucket's rows stay scattered."""
    return buckets.repartition(F.xxhash64("c", "key")).sortWithinPartitions("c", "key", "h")


def _near(cols: list, sizes: np.ndarray, use: np.ndarray, radius: int, wide: Callable | None, least: float, banded: bool):
    """The prints of the buckets in use, the bits that two of them may differ by, fits(a, b) for what else near ones must
    have, and where they are in cols (c, key, fp, h, size, ...)."""
    at = np.flatnonzero(np.repeat(use, sizes))
    prints, h, size = cols[2][at].view(np.uint64), cols[3][at], cols[4][at]

    def fits(a, b):
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fit = (low >= least * high) & (h[a] != h[b])
        return fit & (np.bitwise_count(prints[a] ^ prints[b]) <= wide(high)) if banded else fit

    return prints, int(wide(np.zeros(1, np.int64))[0]) if banded else radius, fits, at


def _candidates(buckets: DataFrame, radius: int, wide: Callable, least: float, large: int) -> DataFrame:
    """CANDIDATES from rows (c, key, fp, h, size): a forest of the pairs of a bucket that differ in at most radius bits (in
    a band's bucket, wide(larger size)) and whose sizes allow the similarity. Buckets over `large` are not solved but
    returned member by member as (c, key, h, fp, overflow)."""

    def run(batches):
        held, spilled = None, None
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in ("c", "key", "fp", "h", "size")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            c, key = cols[0], cols[1]
            new = _starts(c, key)
            last = int(new[-1])
            held = [x[last:] for x in cols]
            if last:
                yield from solve([x[:last] for x in cols], np.diff(new), spilled)
                spilled = None
            if len(held[0]) > large or spilled == (c[last], key[last]):  # too large to wait for its end
                spilled = (c[last], key[last])
                yield from solve(held, np.array([len(held[0])]), spilled)
                held = [x[:0] for x in held]
        if held is not None and len(held[0]):
            yield from solve(held, np.array([len(held[0])]), spilled)

    def solve(cols, sizes, spilled):
        c, key, fp, h, size = cols
        beyond = sizes > large
        if spilled is not None and (c[0], key[0]) == spilled:
            beyond[0] = True
        far = np.repeat(beyond, sizes)
        if far.any():
            yield out(c[far], key[far], h[far], fp[far], True)
        banded = c[np.cumsum(sizes) - sizes] >= FIRST_BAND
        for own in (~banded, banded):
            if (use := own & (sizes > 1) & ~beyond).any():
                prints, bits, fits, at = _near(cols, sizes, use, radius, wide, least, own is banded)
                a, b = (at[x] for x in near_pairs(prints, sizes[use], bits, fits, False))
                yield out(c[a], key[a], h[a], h[b], False)

    def out(c, key, a, b, overflow):
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(key), pa.array(a), pa.array(b), pa.array(np.full(len(a), overflow))], ["c", "key", "a", "b", "overflow"])

    return _dealt(buckets).mapInArrow(run, CANDIDATES)


def _starts(c: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the buckets of sorted rows begin."""
    return np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (key[1:] != key[:-1]))))


def _links(buckets: DataFrame, radius: int, wide: Callable, least: float, judge: Callable) -> DataFrame:
    """(src, dst) from rows (c, key, fp, h, size, part, line) and, if there, BAND_COLUMNS: links between parts, enough that
    these join as they do by all near pairs of a bucket that are similar. The pairs are judged where their bucket lies and
    never become rows; those whose parts are joined by then need no verdict. With BAND_COLUMNS, of the bands that two
    share the first alone has them judged: they meet in its bucket too, and that is looked at again unless it joined them."""
    names = ("c", "key", "fp", "h", "size", "part", *(k for k in BAND_COLUMNS if k in buckets.columns))

    def run(batches):
        held, lines = None, []
        waiting = _Waiting(judge)
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            lines += batch.column("line").to_pylist()
            new = _starts(cols[0], cols[1])
            last = int(new[-1])
            held = [x[last:] for x in cols]
            if last:
                yield from solve([x[:last] for x in cols], np.diff(new), lines, waiting)
                lines = lines[last:]
        if held is not None and len(held[0]):
            yield from solve(held, np.array([len(held[0])]), lines, waiting)
        yield from waiting.links()

    def solve(cols, sizes, lines, waiting):
        part = cols[5]
        begin = np.cumsum(sizes) - sizes
        mixed = np.minimum.reduceat(part, begin) != np.maximum.reduceat(part, begin)
        banded = cols[0][begin] >= FIRST_BAND
        for own in (~banded, banded):
            if not (use := own & mixed).any():
                continue
            prints, bits, fits, at = _near(cols, sizes, use, radius, wide, least, own is banded)
            group = part[at]
            keys = np.stack(_band_keys([x[at] for x in cols[6:]]), 1) if own is banded and len(cols) > 6 else None
            number = (cols[0][at] - FIRST_BAND) % BANDS
            for a, b in pair_hits(prints, sizes[use], bits):
                for k in range(0, len(a), 1 << 17):
                    x, y = a[k : k + (1 << 17)], b[k : k + (1 << 17)]
                    x, y = (v[(group[x] != group[y]) & fits(x, y)] for v in (x, y))
                    if keys is not None:
                        first = (keys[x] == keys[y]).argmax(1) == number[x]
                        x, y = x[first], y[first]
                    for start in range(0, len(x), JUDGED):
                        p, q = x[start : start + JUDGED], y[start : start + JUDGED]
                        yield from waiting.add(group[p], group[q], lines, at[p], at[q])

    return _dealt(buckets).mapInArrow(run, "src long, dst long")


class _Waiting:
    """Pairs of lines of different parts, from bucket after bucket, until there are enough to judge at once."""

    def __init__(self, judge: Callable):
        self.judge, self.pairs, self.n, self.chars = judge, [], 0, 0
        self.parts, self.parent = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, src: np.ndarray, dst: np.ndarray, lines: list[str], p: np.ndarray, q: np.ndarray):
        """Takes pairs of the parts src and dst, whose lines are numbers p and q; (src, dst) rows if they are enough."""
        if not len(src):
            return
        parts = np.union1d(self.parts, np.concatenate([src, dst]))
        if len(parts) > len(self.parts):
            at, parent = np.searchsorted(parts, self.parts), np.arange(len(parts))
            parent[at] = at[self.parent]
            self.parts, self.parent = parts, parent
        ends = [self.parent[np.searchsorted(parts, v)] for v in (src, dst)]
        apart = np.flatnonzero(ends[0] != ends[1])
        self.pairs.append((src[apart], dst[apart], [lines[i] for i in p[apart].tolist()], [lines[i] for i in q[apart].tolist()]))
        self.n += len(apart)
        self.chars += sum(map(len, self.pairs[-1][2]))
        if self.n >= JUDGED or self.chars >= CHARS:
            yield from self.links()

    def links(self):
        """(src, dst) rows that join parts as those pairs do that wait and are similar."""
        pairs, self.pairs, self.n, self.chars = self.pairs, [], 0, 0
        if not pairs:
            return
        src, dst = (np.concatenate([v[k] for v in pairs]) for k in (0, 1))
        same = np.asarray(self.judge(*([t for v in pairs for t in v[k]] for k in (2, 3))), bool)
        used: list = []
        self.parent = join_sets(self.parent, *(np.searchsorted(self.parts, v[same]) for v in (src, dst)), used)
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(self.parts[np.concatenate(v)]) for v in zip(*used, strict=True)], ["src", "dst"])
        if len(self.parts) > 1 << 18:
            self.parts, self.parent = self.parts[:0], self.parent[:0]


def _judged(pairs: DataFrame, evidence: DataFrame, tables: Tables, judge: Callable) -> DataFrame:
    """(a, b, same): pairs of classes with the verdict on their evidence."""
    left = pairs.join(evidence.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
    both = left.join(evidence.select(F.col("h").alias("b"), F.col("line").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= JUDGED or size >= CHARS:
                yield verdicts(held)
                held, rows, size = [], 0, 0
        if held:
            yield verdicts(held)

    def verdicts(held):
        a, b, x, y = (pa.concat_arrays([batch.column(k) for batch in held]) for k in ("a", "b", "x", "y"))
        return pa.RecordBatch.from_arrays([a, b, pa.array(judge(x.to_pylist(), y.to_pylist()))], ["a", "b", "same"])

    return tables.keep(both.mapInArrow(verify, "a long, b long, same boolean"), "verdicts")


def verified_parts(classes: DataFrame, source: DataFrame, tables: Tables, fetch: Callable, similar: Callable, radius: int, least: float, large: int, wide: Callable[[np.ndarray], np.ndarray] | None = None, judge: Callable | None = None) -> DataFrame:
    """(node, component) of the classes in groups: two are linked if their fingerprints differ in at most radius bits, the
    smaller size is at least `least` of the larger, and similar(x, y) holds for what fetch(pairs (a, b)) gives for them as
    rows (h, line), or (h, line, BAND_COLUMNS), which spares repeated verdicts. source is the table that the classes come from (for its size). Each h is a class of its own.
    With wide, classes also have BAND_COLUMNS, and those that share a band are near up to wide(larger size) bits, most of
    all for size 0. judge(xs, ys), if there, is similar(x, y) for many pairs at once, as an array."""
    judge = judge or (lambda xs, ys: np.array([similar(x, y) for x, y in zip(xs, ys, strict=True)], bool))
    masks, bands = list(key_masks(radius)), BAND_COLUMNS if wide else ()
    one = classes.select("h", "fp", "size")
    rows = tables.keep(_shared_buckets(classes, source, masks, bands, tables, radius, least), "buckets")
    first = tables.keep(_candidates(rows, radius, wide, least, large), "first")
    over = first.where("overflow").select("c", "key", F.col("a").alias("h"), F.col("b").alias("fp"))
    crowded = over.join(over.groupBy("c", "key").agg(F.count("*").alias("n")), ["c", "key"]).join(one, ["h", "fp"])
    second_rows = crowded.select("c", "key", "fp", "h", "size", "n").mapInArrow(_finer(masks, radius, large), BUCKETS)
    second = tables.keep(_candidates(second_rows, radius, wide, least, 1 << 62), "second")
    proposed = first.where("not overflow").unionByName(second)
    pairs = tables.keep(proposed.select("a", "b").distinct(), "pairs")
    evidence = fetch(pairs)
    verdicts = _judged(pairs, evidence, tables, judge)
    parts = tables.keep(connected_components(verdicts.where("same").select(F.col("a").alias("src"), F.col("b").alias("dst")), tables, "part"), "parts")
    # buckets with a failed proposal: all candidate pairs between different parts. A class with a candidate in a bucket
    # is in the bucket's forest, so its evidence has been fetched.
    failed = verdicts.where("not same").select("a", "b")
    again = proposed.join(failed, ["a", "b"]).select("c", "key").distinct()
    everything = rows.unionByName(second_rows).join(again, ["c", "key"], "left_semi").join(evidence, "h")
    labelled = everything.join(parts, everything["h"] == parts["node"], "left").select("c", "key", "fp", "h", "size", F.coalesce("component", "h").alias("part"), "line", *(c for c in BAND_COLUMNS if c in evidence.columns))
    links = tables.keep(_links(labelled, radius, wide, least, judge), "links")
    if not links.head(1):
        return parts
    joined = tables.keep(connected_components(links, tables, "whole"), "joined")  # parts to larger ones
    renamed = parts.join(joined.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    return renamed.unionByName(joined.join(parts.select("node"), "node", "left_anti").select("node", "component"))
