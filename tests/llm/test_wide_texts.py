"""The search of the pipeline's near-duplicate stage against Jaccard similarity alone."""

import numpy as np
import pytest

import corpus_pipeline
from auralith.llm import near_texts
from tests.llm.test_simhash import brute_near


def edited_texts(seed):
    """Pairs of texts of 300 words at a Jaccard similarity of 0.8 to 0.9 of their five-word shingles."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(40):
        base = [f"w{x}" for x in rng.integers(0, 9000, 300)]
        own = list(base)
        for at in rng.choice(np.arange(5, 295, 6), rng.integers(3, 7), replace=False):
            own[at] = "changed"
        rows += [" ".join(base), " ".join(own)]
    return list(enumerate(rows))


@pytest.mark.parametrize("large", [4096, 2])
def test_texts_at_the_verified_similarity_meet(make, large):
    rows = edited_texts(3)
    found = {r["doc_id"]: r["component_id"] for r in near_texts.near_texts(make(rows), large=large, wide=near_texts.WIDE).collect()}
    want, narrow = brute_near(rows, radius=64), brute_near(rows)
    assert len(set(narrow.values())) > len(set(want.values()))
    assert sum(found[i] != want[i] for i in want) <= 1


def test_stage(spark, make, sf):
    rows = edited_texts(3)
    want = brute_near(rows, radius=64)
    kept = corpus_pipeline.simhash_dedup(spark, make(rows), sf).count()
    assert len(set(want.values())) <= kept <= len(set(want.values())) + 1 < len(set(brute_near(rows).values()))
