import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from auralith.llm import fuzzy_lines as L
from tests.llm.conftest import ODD


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert L.edit_distance(a, b) == levenshtein(a, b)
        assert L.edit_distance(a.split(), b.split()) == levenshtein(a.split(), b.split())
        for least in (0.5, 0.8):
            assert L.similar(a, b, least) == (levenshtein(a, b) <= (1 - least) * max(len(a), len(b)) + 1e-9)


def test_lines_as_arrays():
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "B", "é", "|", " ", " ", "\n", "\t", "漢"]) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    found = L.read_lines(made)
    want = [(i, k, b" ".join(w).decode()) for i, t in enumerate(made) for k, w in L.normal_lines(t)]
    assert found.n_words.tolist() == [len(w) for t in made for _, w in L.normal_lines(t)]
    assert [(i, k, found.words(n)) for n, (i, k) in enumerate(zip(found.text.tolist(), found.line.tolist()))] == want
    assert found.size.tolist() == [len(t) for _, _, t in want]
    by = defaultdict(set)
    for h, (_, _, t) in zip(found.h.tolist(), want):
        by[t].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)
    assert len(L.read_lines([]).h) == 0


def distance(a, b, most):
    """Levenshtein distance, a row at a time; some larger number than `most` if it is larger."""
    x, y = np.array([ord(c) for c in a]), np.array([ord(c) for c in b])
    steps = np.arange(len(y) + 1)
    row = steps
    for i, c in enumerate(x, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (y != c))))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return int(row.min())
    return int(row[-1])


@lru_cache(8)
def similar_pairs(lines, least):
    """All pairs of lines whose edit similarity is at least `least`. An edit spoils three runs of three letters at most, so
    lines that share too few are not compared."""
    grams = np.zeros((len(lines), 4096), np.int16)
    for k, t in enumerate(lines):
        for p in zip(t, t[1:], t[2:]):
            grams[k, hash(p) % 4096] += 1
    size, out = np.array([len(t) for t in lines]), []
    for a in range(len(lines)):
        longer = np.maximum(size[a], size[:a])
        most = np.floor((1 - least) * longer + 1e-9)
        shared = np.minimum(grams[a], grams[:a]).sum(1)
        for b in np.flatnonzero((np.abs(size[a] - size[:a]) <= most) & (shared >= longer - 2 - 3 * most)).tolist():
            if distance(lines[a], lines[b], most[b]) <= most[b]:
                out.append((a, b))
    return out


def brute(rows, radius=3, least=0.8):
    """Groups of equal lines and, from five words on, of all pairs at the similarity (and, below 64, at the radius)."""
    held = defaultdict(list)
    for i, text in rows:
        if i is not None and text is not None:
            for k, line in enumerate(text.split("\n")):
                if words := line.encode().lower().split():
                    held[b" ".join(words).decode()].append((i, k))
    lines = sorted(held, key=lambda t: len(t.split(" ")) >= 5)
    short = sum(len(t.split(" ")) < 5 for t in lines)
    long = lines[short:]
    prints = L.read_lines(long).fp if long else np.zeros(0, np.uint64)
    part = list(range(len(lines)))
    for a, b in similar_pairs(tuple(long), least):
        if int(prints[a] ^ prints[b]).bit_count() <= radius:
            old, new = part[short + a], part[short + b]
            part = [new if p == old else p for p in part]
    groups = defaultdict(list)
    for k, t in enumerate(lines):
        groups[part[k]] += held[t]
    return sorted((*o, *min(g), o == min(g)) for g in groups.values() if len(g) > 1 for o in g)


def got(df, **options):
    return sorted(map(tuple, L.line_groups(df, **options).collect()))


def near_lines(seed, n):
    """Families of long lines with a few words changed, and lines of one word repeated, whose SimHashes are equal."""
    rng = random.Random(seed)
    rows = []
    for f in range(4):
        base = [f"w{rng.randint(0, 900)}" for _ in range(60)]
        for k in range(n):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(60)] = f"c{rng.randint(0, 9)}"
            rows.append(" ".join(own))
    rows += [" ".join(["er"] * k) for k in range(5, 40)]
    rng.shuffle(rows)
    return [(k, "\n".join(rows[k : k + 3])) for k in range(0, len(rows), 3)]


@pytest.mark.parametrize("large", [4096, 6])
def test_against_brute_force(make, large):
    rows = near_lines(5, 14)
    assert got(make(rows), large=large) == brute(rows)


def test_documents(make, texts):
    assert got(make(texts)) == brute(texts)


def test_odd_rows(make):
    single = [r for r in ODD if r[0] != 5]
    assert got(make(single)) == brute(single)
    assert L.line_groups(make([(1, "a")]).limit(0)).count() == 0


def test_remove_lines(make):
    line = "this very line is here again and again"
    rows = [(1, f"first of all\n{line}\nown words that nobody else has today"), (2, f"Short.\n{line.upper()}"), (3, f"{line}\nsome other line with its own words\n short. "), (4, None), (5, ""), (6, f" {line}\n"), (None, line)]
    df = make(rows)
    out = L.remove_lines(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "Short.", 3: "some other line with its own words", 4: None, 5: "", None: line}


def test_only_repeated_lines_go(make):
    """A document of many short lines of its own outlives the line that it shares."""
    footer = "all rights reserved by the owner of this page"
    own = [f"line {k} is mine" for k in range(200)]
    rows = [(1, footer), (2, "\n".join([*own, footer])), (3, "menu\nhome\nfirst words of the third document here"), (4, "Menu\nhome \nquite another text of the fourth one")]
    out = {r["doc_id"]: r["text"] for r in L.remove_lines(make(rows), wide=L.WIDE).collect()}
    assert out == {1: footer, 2: "\n".join(own), 3: rows[2][1], 4: "quite another text of the fourth one"}


@pytest.mark.parametrize("words,least", [(8, 0.9), (12, 0.9), (20, 0.95), (40, 0.95)])
def test_recall_by_length(make, words, least):
    """Pairs of lines of random words, one character in ten words changed: how many are found."""
    rng = random.Random(words)
    rows = []
    for k in range(150):
        own = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.choice([2, 3, 3, 4, 5, 6, 7, 9]))) for _ in range(words)]
        rows.append((2 * k, " ".join(own)))
        for at in rng.sample(range(words), max(1, words // 10)):
            own[at] = own[at][:-1] + "z"
        rows.append((2 * k + 1, " ".join(own)))
    found = {r["doc_id"] for r in L.line_groups(make(rows), wide=L.WIDE).where("not kept").collect()}
    assert len(found) >= least * 150 and all(i % 2 for i in found)
