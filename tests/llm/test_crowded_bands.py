"""Classes that meet in one bucket of one band only: every pair of them counts, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralith.llm import fuzzy_lines as L
from auralith.llm.common import Tables
from auralith.llm.verified import verified_parts


def next_to(x, y):
    return abs(int(x) - int(y)) == 1


def halves(x, y):
    """All of a half, and of the two halves the first and the last alone."""
    return (int(x) < 30) == (int(y) < 30) or {int(x), int(y)} == {0, 59}


@pytest.mark.parametrize(("large", "similar"), [(4096, halves), (6, next_to)])
def test_links_between_any_two_members(spark, make, large, similar):
    """The similar ones are seldom the nearest fingerprints."""
    rng = np.random.default_rng(4)
    n = 60
    fps = [sum(1 << int(k) for k in rng.choice(62, 8, replace=False)) for _ in range(n)]
    rows = [(k, fps[k], 10, 7 << 32 | 1000 + k, *(((10 * c + 1) << 40) + (k << 33) + k for c in (1, 2, 3))) for k in range(n)]
    classes = spark.createDataFrame(rows, "h long, fp long, size int, m0 long, m1 long, m2 long, m3 long")

    def fetch(pairs):
        return pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().withColumn("line", F.col("h").cast("string"))

    parts = verified_parts(classes, make([(1, "a")]), Tables(spark, "crowded"), fetch, similar, 3, 0.8, large, lambda size: np.full(len(size), 20))
    assert {r["node"]: r["component"] for r in parts.collect()} == dict.fromkeys(range(n), 0)


def test_refused_lines_are_not_similar():
    rng = np.random.default_rng(8)
    words = ["alpha", "beta", "gämma", "delta", "語", "x", "yy", "zebra"]
    a = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(5000)]
    b = [" ".join(rng.choice(words, rng.integers(1, 12))) if k % 2 else x[: len(x) - 2] + "qé" for k, x in enumerate(a)]
    refused = L.unlike(a, b, 0.8)
    same = np.array([L.similar(x, y, 0.8) for x, y in zip(a, b, strict=True)])
    assert not (refused & same).any() and refused.sum() > 0.5 * (~same).sum() and same.sum() > 1000
