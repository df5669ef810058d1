"""What the search of op7 leaves out as it can change no result: pairs judged twice, buckets whose members' sizes differ."""

import numpy as np
import pyarrow as pa

from auralith.llm import fuzzy_lines as L
from auralith.llm import verified as V
from auralith.llm.common import Tables
from auralith.llm.simhash import key_masks, pair_hits


class Rows:
    columns = ["c", "key", "fp", "h", "size", "part", "line", *V.BAND_COLUMNS]

    def mapInArrow(self, run, schema):
        return run


def test_pairs_of_two_bands_are_judged_once(monkeypatch):
    """Four lines that share two bands, of four parts: six pairs, in the bucket of the first band."""
    monkeypatch.setattr(V, "_dealt", lambda rows: rows)
    judged = []

    def judge(xs, ys):
        judged.extend(zip(xs, ys, strict=True))
        return np.array([{x, y} == {"a", "d"} for x, y in zip(xs, ys, strict=True)], bool)

    rows = [(V.FIRST_BAND + band, 7 + band, 0, h, 10, h, "abcd"[h], *(key << 32 | 300 + h for key in (100 + h, 9, 11, 200 + h))) for band in (2, 4) for h in range(4)]
    run = V._links(Rows(), 3, lambda size: np.full(len(size), 20), 0.8, judge)
    data = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], Rows.columns)
    assert [set(x.values()) for batch in run(iter([data])) for x in batch.to_pylist()] == [{0, 3}]
    assert len(judged) == 6


def test_buckets_of_sizes_that_cannot_be_similar_are_left_out(spark, make):
    """Pairs that share a band: 40 with sizes 10 and 30, and 40 with 24 and 30, just at the similarity."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(160):  # the second members come behind all first ones, in other blocks
        pair, size = k % 80, 30 if k >= 80 else 10 if k < 40 else 24
        rows.append((k, int(rng.integers(1 << 62)), size, 7 << 32 | 1000 + pair, *(((10 * c + 1) << 40) + (k << 33) + k for c in (1, 2, 3))))
    classes = spark.createDataFrame(rows, "h long, fp long, size int, m0 long, m1 long, m2 long, m3 long").repartitionByRange(2, "h")
    found = V._shared_buckets(classes, make([(1, "a")]), list(key_masks(3)), V.BAND_COLUMNS, Tables(spark, "sized"), 3, 0.8)
    held = {r["h"] for r in found.where(f"c = {V.FIRST_BAND + 1}").collect()}
    assert held == {k for k in range(160) if k % 80 >= 40}


def test_sizes_that_may_be_similar_match():
    rng = np.random.default_rng(5)
    for least in (0.5, 0.8, 0.9, 1.0):
        low = np.concatenate([rng.integers(0, 2000, 3000), rng.integers(10**5, 10**7, 200)])
        high = np.maximum(low, np.floor(low / least).astype(np.int64) - rng.integers(0, 3, len(low)))
        fit = low >= least * high
        number = np.arange(len(low))
        keys = number.astype(np.uint64)[None] << np.uint64(24)
        codes = np.concatenate([V._sized(keys, keys[0], s, [])[1] for s in (low, high)])
        assert V._matched(np.tile(number, 2), len(low), codes, np.zeros(len(codes), np.uint16), 3, least)[fit].all()
    assert not V._matched(np.zeros(2, np.int64), 1, np.array([30, 36], np.uint8), np.zeros(2, np.uint16), 3, 0.8)[0]


def test_near_prints_match_in_every_bucket_that_they_share():
    """Groups of 2 to 60 members, of which two are near: their bits never tell them apart; those of two far ones do."""
    rng = np.random.default_rng(8)
    for radius in (1, 3, 8):
        for mask in key_masks(radius):
            group = np.repeat(np.arange(20), [2] * 10 + [3, 4, 5, 8, 20, 47, 48, 49, 50, 60])
            fps = rng.integers(0, 1 << 63, len(group), dtype=np.uint64)
            first = np.searchsorted(group, np.arange(20))
            fps[first + 1] = fps[first]
            for _ in range(radius):
                fps[first + 1] ^= np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)
            bits = V._turned(fps, mask).astype(np.uint16)
            assert V._matched(group, 20, np.full(len(group), 40, np.uint8), bits, radius, 0.8).all()
            if radius < 8:
                assert V._matched(group[:20], 10, np.full(20, 40, np.uint8), V._turned(rng.integers(0, 1 << 63, 20, dtype=np.uint64), mask).astype(np.uint16), radius, 0.8).sum() < 5


def test_small_and_large_groups_by_all_pairs():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 2, 3, 48, 49, 70, 1, 130, 2])
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = base[rng.integers(0, 6, sizes.sum())] ^ (np.uint64(1) << rng.integers(0, 64, sizes.sum()).astype(np.uint64))
    group = np.repeat(np.arange(len(sizes)), sizes)
    for radius in (0, 2, 20):
        got = sorted((int(x), int(y)) for a, b in pair_hits(fps, sizes, radius) for x, y in zip(a, b, strict=True))
        want = [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if group[a] == group[b] and int(fps[a] ^ fps[b]).bit_count() <= radius]
        assert got == want


def test_majorities_of_long_runs():
    rng = np.random.default_rng(7)
    size = np.array([1, 2, 254, 255, 256, 257, 1000, 3])
    hashes = rng.integers(0, 1 << 63, size.sum(), dtype=np.uint64) & rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    runs = np.split(hashes, np.cumsum(size)[:-1])
    want = [sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in r) > len(r)) for r in runs]
    assert L.majorities(hashes, size).tolist() == want
