"""The search of op7 and of the pipeline's line stage against edit similarity alone."""

import random

import pytest

from auralith.llm import fuzzy_lines as L
from tests.llm.test_lines import brute


def changed_lines(seed):
    """Families of lines of 8 to 40 words, each member with up to a tenth of its words changed."""
    rng = random.Random(seed)
    rows = []
    for f in range(24):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(8, 40))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 10))):
                own[rng.randrange(len(own))] = f"c{rng.randint(0, 9)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(k, "\n".join(rows[k : k + 3])) for k in range(0, len(rows), 3)]


@pytest.mark.parametrize("large", [4096, 3])
def test_lines_at_the_verified_similarity_meet(make, large):
    rows = changed_lines(2)
    found = sorted(map(tuple, L.line_groups(make(rows), large=large, wide=L.WIDE).collect()))
    want = brute(rows, radius=64)
    assert len(set(found) & set(want)) >= 0.97 * len(want) and len(brute(rows)) < 0.9 * len(want)


def test_wide_search_of_documents(make, texts):
    found = sorted(map(tuple, L.line_groups(make(texts), wide=L.WIDE).collect()))
    want = brute(texts, radius=64)
    assert len(set(found) & set(want)) >= 0.97 * len(want) and set(brute(texts)) != set(want)
