"""Neighbours and pairs among many that are equally near: the smallest ids win, however many there are."""

import pytest

from auralith.operators import similarity, tagging
from tests.test_units import vectors


def pool(spark, n=300):
    """A few rows of their own, and n equal ones with the largest ids first."""
    return vectors(spark, [(k, (1, 2, 0.5)) for k in range(n, 0, -1)] + [(1000 + k, (k + 1, 0.1, 9)) for k in range(20)])


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_neighbours(spark, metric):
    every = pool(spark)
    near = similarity.nearest(every.where("sample_id in (3, 250)"), every, 5, metric).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["sample_id"]) for r in near] == [(3, k) for k in (1, 2, 4, 5, 6)] + [(250, k) for k in (1, 2, 3, 4, 5)]


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_pairs(spark, metric):
    found = similarity.pairwise_top(pool(spark), 25, metric).collect()
    assert [(r["left_id"], r["right_id"]) for r in found] == [(1, k) for k in range(2, 27)]


def test_equal_scores_of_unequal_vectors(spark):
    every = vectors(spark, [(0, (0, 0))] + [(k, (3, 4) if k % 2 else (4, 3)) for k in range(200, 0, -1)])
    near = similarity.nearest(every.where("sample_id = 0"), every, 5, "euclidean").orderBy("rank").collect()
    assert [r["sample_id"] for r in near] == [1, 2, 3, 4, 5]


def test_knn_tags(spark):
    examples = spark.createDataFrame([(k, [1.0, 2.0], ["first" if k <= 3 else "later"]) for k in range(300, 0, -1)], "sample_id long, values array<double>, tags array<string>")
    got = tagging.knn_tags(vectors(spark, [(999, (1, 2.1))]), examples, k=3).collect()
    assert [(r["tag"], r["score"]) for r in got] == [("first", 1.0)]
