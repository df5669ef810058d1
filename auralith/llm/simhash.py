"""SimHash near-duplicates by bit-sliced comparison of fingerprints that agree on enough blocks.

Two fingerprints at most r bits apart agree on at least two of r + 2 blocks, so each is sent once per
pair of blocks. A bucket's fingerprints are stored as bit planes, 64 a word; for every fingerprint and
word the differing bits are added up by carry-save counters, and words in which every lane exceeds
the radius are abandoned every few planes. A bucket sends a spanning forest of its links, never all
of them. Buckets beyond a size go on by more and smaller blocks, which bounds them at 65,536 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralith.operators.blocks import join_sets

from .common import Tables, connected_components, text_slices

#: A bucket of more fingerprints is divided further.
LARGE = 4096
#: Members up to which a group's pairs are compared one by one: its words of 64 lanes would be nearly empty.
FEW = 48


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `words` words (of all, if there are fewer) of the text with A-Z lowered."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the fingerprint of each row's whole text, as a signed 64-bit integer."""

    def run(batches):
        for batch in text_slices(batches, "text", 1 << 20):
            fps = np.array([fingerprint(shingle_hashes(t or "", words)) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(low: int, high: int, n: int) -> list[int]:
    """Masks of n blocks over the bits from low up to high."""
    cuts = [low + (high - low) * k // n for k in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(8)
def key_masks(radius: int) -> tuple[int, ...]:
    """Every pair of radius + 2 blocks of the 64 bits: one pair agrees wherever at most radius bits differ."""
    return tuple(a | b for a, b in combinations(_blocks(0, 64, radius + 2), 2))


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks that hold `mask` and two of radius + 2 equal shares of the other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    shares = [sum(1 << b for b in rest[len(rest) * k // (radius + 2) : len(rest) * (k + 1) // (radius + 2)]) for k in range(radius + 2)]
    return [mask | a | b for a, b in combinations(shares, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(fp: Column, masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).cast("long").alias("c"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for k, m in enumerate(masks)])


def near_hits(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints (in consecutive groups of the sizes) within the radius, each once, in portions."""
    n, words = len(fps), -(-sizes // 64)
    first_word = np.concatenate(([0], np.cumsum(words)))
    start = np.concatenate(([0], np.cumsum(sizes)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(n) - start[group] + first_word[group] * 64
    padded = np.zeros(int(first_word[-1]) * 64, np.uint64)
    padded[lane] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")
    member = np.full(len(padded), -1, np.int64)
    member[lane] = np.arange(n)
    valid = np.packbits(member >= 0, bitorder="little").view("<u8")
    own = bits[lane]  # (n, 64)
    tasks = words[group]
    edges = np.concatenate(([0], np.cumsum(tasks)))
    at = 0
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + 65_536, "right")) - 1)
        q = np.repeat(np.arange(at, stop), tasks[at:stop])
        w = np.arange(len(q)) - (edges[q] - edges[at]) + first_word[group[q]]
        ahead = w >= lane[q] // 64  # links to earlier members were met from there
        q, w = q[ahead], w[ahead]
        counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius).bit_length())]
        over = ~valid[w]
        for b in range(64):
            carry = planes[b][w] ^ np.where(own[q, b], full, np.uint64(0))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
            if b % 8 == 7 or b == 63:
                live = np.flatnonzero(~_beyond(counters, over, radius))
                if len(live) < 0.8 * len(q):
                    q, w, over, counters = q[live], w[live], over[live], [c[live] for c in counters]
                if not len(q):
                    break
        near = ~_beyond(counters, over, radius)
        some = np.flatnonzero(near)
        q, w, near = q[some], w[some], near[some]
        for k in range(0, len(q), 8192):
            hit, bit = np.nonzero(np.unpackbits(near[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = q[k : k + 8192][hit], member[w[k : k + 8192][hit] * 64 + bit]
            yield a[a < b], b[a < b]
        at = stop


def near_sets(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """For fingerprints in consecutive groups of the sizes: the first index of each one's linked set within its group."""
    parent = np.arange(len(fps))
    for a, b in near_hits(fps, sizes, radius):
        parent = join_sets(parent, a, b)
    return parent


def pair_hits(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """near_hits, but small groups, of which there may be very many, without bit planes."""
    small, own = sizes <= FEW, np.arange(len(fps))
    if not small.all():
        large = np.flatnonzero(np.repeat(~small, sizes))
        for a, b in near_hits(fps[large], sizes[~small], radius):
            yield large[a], large[b]
        own = np.flatnonzero(np.repeat(small, sizes))
    sizes = sizes[small]
    later = np.repeat(np.cumsum(sizes), sizes) - np.arange(1, len(own) + 1)  # members behind each one in its group
    edges = np.concatenate(([0], np.cumsum(later)))
    at = 0
    while at < len(own):
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + 262_144, "right")) - 1)
        a = np.repeat(np.arange(at, stop), later[at:stop])
        b = np.arange(edges[at], edges[stop]) - edges[a] + a + 1
        near = np.flatnonzero(np.bitwise_count(fps[own[a]] ^ fps[own[b]]) <= radius)
        yield own[a[near]], own[b[near]]
        at = stop


def near_pairs(fps: np.ndarray, sizes: np.ndarray, radius: int, fits, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius for which fits(a, b) holds: all, or a spanning forest of them."""
    parent, used = np.arange(len(fps)), [(np.zeros(0, np.int64),) * 2]
    for a, b in pair_hits(fps, sizes, radius):
        fit = fits(a, b)
        a, b = a[fit], b[fit]
        if every:
            used.append((a, b))
        else:
            parent = join_sets(parent, a, b, used)
    return tuple(np.concatenate(x) for x in zip(*used, strict=True))


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius, comparing from the highest counter bit down."""
    above, same = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            above |= same & counters[k]
            same = same & ~counters[k]
    return above


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """(src, dst): a spanning forest of each bucket's links, from rows (c, key, fp) without repeats."""

    def run(batches):
        held = None
        for batch in batches:
            c, key, fp = (np.asarray(batch.column(k)) for k in ("c", "key", "fp"))
            if held is not None:
                c, key, fp = (np.concatenate(x) for x in zip(held, (c, key, fp), strict=True))
            if not len(c):
                continue
            new = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (key[1:] != key[:-1]))))
            last = new[-1]
            held = c[last:], key[last:], fp[last:]
            yield from solve(fp[:last], np.diff(new))
        if held is not None:
            yield from solve(held[2], np.array([len(held[2])]))

    def solve(fp, sizes):
        some = np.repeat(sizes > 1, sizes)
        fp, sizes = fp[some], sizes[sizes > 1]
        if len(fp):
            parent = near_sets(fp.view(np.uint64), sizes, radius)
            linked = np.flatnonzero(parent != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[parent[linked]])], ["src", "dst"])

    return buckets.repartition("c", "key").sortWithinPartitions("c", "key").mapInArrow(run, "src long, dst long")


def near_links(classes: DataFrame, radius: int, tables: Tables, large: int = LARGE) -> DataFrame:
    """(src, dst) among the distinct fingerprints (fp long): enough links that components are those of all links."""
    masks = list(key_masks(radius))
    rows = classes.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("k")).select("k.c", "k.key", "fp")
    sizes = rows.groupBy("c", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = tables.keep(rows.join(sizes, ["c", "key"]), "buckets")
    whole = rows.where(F.col("n") <= large).select("c", "key", "fp")
    finer = [F.when(F.col("c") == k, _keys(F.col("fp"), finer_masks(m, radius))) for k, m in enumerate(masks)]
    width = len(finer_masks(masks[0], radius))
    divided = rows.where(F.col("n") > large).select("fp", ((F.col("c") + 1) * width).alias("base"), F.explode(F.coalesce(*finer)).alias("k"))
    return _links(whole.unionByName(divided.select((F.col("base") + F.col("k.c")).alias("c"), "k.key", "fp")), radius)


def near_duplicates(df: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row: texts whose fingerprints differ in at most
    `radius` bits are linked, and component_id is the smallest doc_id reachable, its own included.

    Null, empty and blank texts have fingerprint zero and link like any others. Rows with a null id are members
    of their fingerprint's component but never name it; a component of null ids alone has a null component_id.
    Repeated rows are each returned; an empty table gives none; other columns are not read.
    """
    tables = Tables(df.sparkSession, "simhash")
    prints = tables.keep(fingerprints(df, words, id_col, text_col), "prints")
    classes = tables.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = near_links(classes.select("fp"), radius, tables)
    found = connected_components(links, tables)
    of = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = of.groupBy("component").agg(F.min("first").alias("component_id"))
    by_print = tables.keep(of.join(named, "component").select("fp", "component_id"), "named")
    tables.drop_but("prints", "named")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
