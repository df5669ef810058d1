import numpy as np
import pytest
import xxhash

from auralith.llm import near_texts, simhash
from auralith.llm.common import Tables, connected_components
from tests.llm.conftest import ODD


def brute(rows, words, radius):
    prints = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        runs = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    ids = {p: [rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None] for p in part}
    return sorted((str(i), f"{prints[k]:016x}", min(ids[part[k]], default=None)) for k, (i, _) in enumerate(rows))


def got(df, **options):
    return sorted((str(r[0]), r[1], r[2]) for r in simhash.near_duplicates(df, **options).collect())


def test_against_brute_force(make, texts):
    assert got(make(texts), words=3, radius=2) == brute(texts, 3, 2)
    assert got(make(ODD), words=3, radius=2) == brute(ODD, 3, 2)
    only = [(None, "nameless and alone"), (1, "another text of words")]
    assert got(make(only), words=5, radius=3) == brute(only, 5, 3)


def test_empty(make):
    assert simhash.near_duplicates(make([(1, "a")]).limit(0)).count() == 0


def test_large_buckets(spark, make):
    """Fingerprints in one crowded bucket go on by smaller blocks, with the same components."""
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 14, 400, dtype=np.uint64) * np.uint64(1 << 50)).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in prints], "fp long")

    def components(large):
        tables = Tables(spark, "test")
        found = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df, 2, tables, large), tables).collect()}
        return {p: found.get(p, p) for p in prints}

    whole = components(1 << 20)
    assert components(8) == whole and len(set(whole.values())) < len(prints)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    sizes = np.array([1, 2, 63, 64, 65, 130])
    base = rng.integers(0, 1 << 63, len(sizes), dtype=np.uint64)
    prints = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) for b, n in zip(base, sizes)])
    hits = {(a, b) for x, y in simhash.near_hits(prints, sizes, radius) for a, b in zip(x.tolist(), y.tolist())}
    start = np.concatenate(([0], np.cumsum(sizes)))
    want = {(a, b) for s, e in zip(start, start[1:]) for a in range(s, e) for b in range(a + 1, e) if int(prints[a] ^ prints[b]).bit_count() <= radius}
    assert hits == want


def brute_near(rows, words=5, radius=8, least=0.8):
    """(id, smallest id reachable) of rows with different ids."""
    prints, sets = [], []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        runs = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        sets.append(set(runs))
    part = {i: i for i, _ in rows}
    for n, (i, _) in enumerate(rows):
        for m in range(n):
            whole = len(sets[n] | sets[m])
            near = sets[n] == sets[m] or (prints[n] ^ prints[m]).bit_count() <= radius
            if near and (not whole or len(sets[n] & sets[m]) >= least * whole) and part[i] != part[rows[m][0]]:
                old, new = max(part[i], part[rows[m][0]]), min(part[i], part[rows[m][0]])
                part = {k: new if p == old else p for k, p in part.items()}
    return part


def families(seed):
    """Texts with some words changed, unrelated ones, and short ones that share most words but few shingles."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(12):
        base = [f"w{x}" for x in rng.integers(0, 2000, 120)]
        for _ in range(8):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 7)):
                own[at] = f"c{rng.integers(0, 99)}"
            rows.append(" ".join(own))
    rows += [" ".join(rng.permutation(["a", "b", "c", "d", "e", "f"])) for _ in range(30)]
    return [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("large", [4096, 5])
def test_verified_links(make, large):
    rows = families(large)
    found = {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(make(rows), large=large).collect()}
    want = brute_near(rows)
    assert found == want and 12 < len(set(want.values())) < len(rows)


def test_near_texts_of_odd_rows(make, texts):
    single = [r for r in ODD if r[0] not in (5, None)]
    assert {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(make(single)).collect()} == brute_near(single)
    assert {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(make(texts)).collect()} == brute_near(texts)
    assert near_texts.near_texts(make(ODD).limit(0)).count() == 0


def test_equal_fingerprints_are_verified(make):
    """One repeated sentence outweighs all else in both fingerprints; the texts share hardly a shingle besides."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(2):
        own = " ".join(f"own{k}x{x}" for x in rng.integers(0, 9999, 60))
        rows.append((k, own + " " + " ".join(["over and over again this"] * 80)))
    found = {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(make(rows), wide=near_texts.WIDE).collect()}
    assert found == {0: 0, 1: 1} == brute_near(rows)


@pytest.mark.parametrize("cut", [0.02, 0.05, 0.1])
def test_recall_by_similarity(make, cut):
    """Pairs of texts of which a share of the shingles differs, around 0.96, 0.9 and 0.82 in Jaccard similarity."""
    rng = np.random.default_rng(int(cut * 100))
    rows = []
    for k in range(120):
        base = [f"w{x}" for x in rng.integers(0, 9000, 400)]
        own = list(base)
        for at in range(5, 5 + int(400 * cut), 5):
            own[at * 9 % 400] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    want = brute_near([r for r in rows if r[0] < 20], radius=64)
    found = {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(make(rows), wide=near_texts.WIDE).collect()}
    assert all(want[i] == i - i % 2 for i in want)
    assert sum(found[i] == i - 1 for i in found if i % 2) >= 0.99 * 120


def test_one_of_each(make):
    rows = [(3, "a b c d e f g"), (1, "A B c d e f g"), (2, "quite another text is here"), (None, "a b c d e f g"), (2, "quite another text is here")]
    kept = near_texts.one_of_each(make(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "2", "None"]
    assert kept.columns == make(rows).columns
