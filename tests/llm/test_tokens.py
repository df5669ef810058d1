import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auralith.llm import bpe, packing
from tests.llm.conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(library):
    rng = random.Random(1)
    letters = "ab'stdmrevlL 1²\n\t 　é漢'' .,!<|>\x00\U0001f600\x85\x1c"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["'ll've're", "x" * 900, " " * 300, "don't 's"]
    codec = bpe.codec(RANKS)
    for text, (said, ids) in zip(made, codec.encode_batch(made)):
        assert ids == library.encode_ordinary(text)
        assert said == ",".join(map(str, ids)) and codec.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=5))
def test_any_text(library, made):
    codec = bpe.codec(RANKS)
    assert [ids for _, ids in codec.encode_batch(made)] == [library.encode_ordinary(t) for t in made]


def test_documents(make, texts, library):
    found = {r["doc_id"]: r for r in bpe.encode_documents(make(texts), RANKS, output="digest").collect()}
    for i, text in texts:
        ids = library.encode_ordinary(text or "")
        assert (found[i]["n_tokens"], found[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_of_odd_rows(make):
    encoded = bpe.encode_documents(make(ODD), RANKS)
    back = bpe.decode_documents(encoded, RANKS).collect()
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in ODD)
    row = encoded.where("doc_id = 5").first()
    assert row["offsets"][0] == 0 and row["offsets"][-1] == len("same words here now") and len(row["offsets"]) == len(row["ids"]) + 1
    assert bpe.encode_documents(make(ODD).limit(0), RANKS).count() == 0


def check_packing(rows, found, window):
    own = Tokenizer.from_file(WORDS)
    ids = [(i, own.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    want = sorted((str(i), s, len(x[s : s + window]), zlib.crc32(np.array(x[s : s + window], "<u4").tobytes()), len(x)) for i, x in ids for s in range(0, len(x), window))
    assert sorted((str(r[0]), *r[1:5]) for r in found) == want
    fill: dict[int, int] = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill) == list(range(len(fill))) and max(fill.values(), default=0) <= window
    return list(fill.values())


def test_packing(make, texts):
    found = packing.pack(make(texts), WORDS).collect()
    lengths = check_packing(texts, found, 2048)
    assert packing.padding(lengths) < 0.03 * sum(lengths)
    check_packing(ODD, packing.pack(make(ODD), WORDS).collect(), 2048)
    check_packing(texts, packing.pack(make(texts), WORDS, window=64).collect(), 64)
    assert packing.pack(make(ODD).limit(0), WORDS).count() == 0
    row = packing.pack(make([(1, "a b")]), WORDS, with_ids=True).first()
    assert row["ids"][-1] == 1 and len(row["ids"]) == row["length"]


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    for window, n in ((64, 5000), (2048, 20_000), (2048, 30), (7, 100)):
        histogram = np.bincount(rng.integers(1, window + 1, n), minlength=window + 1)
        plan = packing.plan(histogram, window)
        used = np.zeros(window + 1, int)
        for lengths, times in plan:
            assert sum(lengths) <= window and times > 0
            for v in lengths:
                used[v] += times
        assert (used == histogram).all()
        if n > 1000:
            assert packing.padding([sum(x) for x, t in plan for _ in range(t)], window) < 0.03 * (histogram * np.arange(window + 1)).sum()
    assert packing.plan(np.zeros(9, int), 8) == []


def test_counts_are_least_squares():
    combos = packing.combinations_of(16)
    assert (combos.sum(1) == 16).all() and len({tuple(c) for c in combos.tolist()}) == len(combos)
    histogram = np.zeros(17)
    histogram[[10, 6]] = 40
    x = packing.solve_counts(combos, histogram)
    assert (x >= 0).all() and x[[tuple(c) for c in combos.tolist()].index((10, 6, 0))] > 30


def test_word_cache_is_exact():
    own, work = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    rng = random.Random(2)
    letters = "ab'STdmre 1²\n é漢 .,!*#<|>\x00\U0001f600ÅΣİßﬁ́"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|>x <|ENDOFTEXT|>. a<|startoftext|>,"]
    assert [np.frombuffer(x, "<u4").tolist() for x in work.encode(made)] == [own.encode(t, add_special_tokens=False).ids for t in made]
