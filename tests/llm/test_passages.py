from collections import defaultdict

import numpy as np
import pytest

from auralith.llm import suffix
from tests.llm.conftest import ODD


def brute(rows, least):
    held = defaultdict(list)
    for i, text in rows:
        if i is not None:
            words = (text or "").encode().lower().split()
            for s in range(len(words) - least + 1):
                held[tuple(words[s : s + least])].append((i, s))
    marks = defaultdict(dict)
    for places in held.values():
        if len(places) > 1:
            first = min(places)
            for i, s in places:
                marks[i][s] = first[0], (i, s) == first
    out = []
    for i, own in marks.items():
        run = None
        for s in sorted(own):
            if run and run[1] == s - 1 and run[2] == own[s]:
                run[1] = s
            else:
                run = [s, s, own[s]]
                out.append((i, run))
    return sorted((i, r[0], r[1] - r[0] + least, *r[2]) for i, r in out)


def got(df, least):
    return sorted(map(tuple, suffix.passages(df, least).collect()))


def test_against_brute_force(make, texts):
    assert got(make(texts), 50) == brute(texts, 50)


@pytest.mark.parametrize("least", [12, 20])
def test_crossing_passages(make, least):
    """Passages that overlap, nest, repeat within a document and end where a third text goes on."""
    rng = np.random.default_rng(least)
    pool = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(30):
        words = [f"u{i}x{k}" for k in range(10)]
        for _ in range(3):
            s = int(rng.integers(0, 360))
            words += pool[s : s + int(rng.integers(3, 60))] + [f"v{i}"]
        rows.append((i, " ".join(words)))
    rows.append((99, " ".join(pool[:40] + ["x"] + pool[:40])))
    assert got(make(rows), least) == brute(rows, least)


def test_matches_across_pieces(make, monkeypatch):
    """One passage in every document, between words of their own, and its parts alone: sorted in pieces of three."""
    monkeypatch.setattr(suffix, "PIECE", 3)
    rng = np.random.default_rng(5)
    pool = [f"w{k}" for k in range(70)]
    rows = []
    for i in range(40):
        a, b = (0, 70) if i % 3 else sorted(rng.choice(71, 2, replace=False).tolist())
        rows.append((100 - i, " ".join([f"u{i}x{k}" for k in range(i % 5)] + pool[a:b] + [f"v{i % 7}"] * 3)))
    assert got(make(rows), 20) == brute(rows, 20)


def test_common_parts():
    rows = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 4], [5, 2, 4]])
    assert suffix.common_parts(rows).tolist() == [2, 3, 0]
    assert suffix.common_parts(rows[:1]).tolist() == [] and suffix.common_parts(rows[:, :0]).tolist() == [0, 0, 0]


def test_odd_rows(make):
    unique = [r for r in ODD if r[0] != 5]
    assert got(make(unique), 50) == brute(unique, 50)
    text = " ".join(f"w{k}" for k in range(60))
    twice = got(make([(5, text), (5, text), (6, "short")]), 50)  # rows of one id are one document: each is its first
    assert twice == [(5, 0, 60, 5, True)] * 2
    assert suffix.passages(make([(1, "a")]).limit(0)).count() == 0


def test_cut():
    assert suffix.cut("a b c d e", [(1, 2)]) == "a d e"
    assert suffix.cut("a\nb c\nd", [(1, 2)]) == "a\nd"
    assert suffix.cut("a b c", [(0, 1)]) == "b c"
    assert suffix.cut("a b c", [(2, 1)]) == "a b"[:3]
    assert suffix.cut("a b c", [(0, 3)]) == ""
    assert suffix.cut(" a  b ", []) == " a  b "


def test_remove_repeats(make):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"start {passage} end"), (2, f"other {passage}\nrest of it"), (3, passage), (4, None), (5, "plain"), (None, passage)]
    df = make(rows)
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"start {passage} end", 2: "other\nrest of it", 4: None, 5: "plain", None: passage}
