import corpus_pipeline
from auralith.llm import langid, near_texts
from tests.llm.conftest import ODD
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_passages import brute as brute_passages
from tests.llm.test_simhash import brute_near
from tests.llm.test_tokens import check_packing


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, sf):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = docs.columns, dict(rows_of(docs))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language_id", "line_dedup", "simhash_dedup", "suffix_dedup", "packing"]

    one = stage["language_id"](spark, docs, sf).cache()
    after = dict(rows_of(one))
    assert one.columns == columns and after == {i: t for i, t in before.items() if any(c.isalpha() for c in t or "")}

    two = stage["line_dedup"](spark, one, sf).cache()
    got, gone = dict(rows_of(two)), {}
    groups = brute_lines(list(after.items()), radius=64)
    for i, k, _, _, kept in groups:
        if not kept:
            gone.setdefault(i, set()).add(k)
    wrong = 0
    for i, t in after.items():
        own = [(k, x) for k, x in enumerate(t.split("\n"))]
        left = "\n".join(x for k, x in own if k not in gone.get(i, ()))
        wrong += got.get(i) != (left if i not in gone or left.split() else None)
        assert i in gone or got[i] == t  # nothing that no other line resembles is touched
    assert two.columns == columns and set(got) <= set(after) and wrong <= 0.01 * len(after)

    three = stage["simhash_dedup"](spark, two, sf).cache()
    parts = brute_near(list(got.items()), radius=64)
    kept = dict(rows_of(three))
    assert three.columns == columns and all(got[i] == t for i, t in kept.items()) and {i for i in got if parts[i] == i} <= set(kept)
    assert len(kept) <= 1.01 * len(set(parts.values()))
    want = kept

    four = stage["suffix_dedup"](spark, three, sf).cache()
    cuts: dict[int, set] = {}
    for i, s, n, _, first in brute_passages(list(want.items()), 50):
        if not first:
            cuts.setdefault(i, set()).update(range(s, s + n))
    left = {i: [w for k, w in enumerate(t.encode().split()) if k not in cuts.get(i, ())] for i, t in want.items()}
    got = dict(rows_of(four))
    assert four.columns == columns and {i: t.encode().split() for i, t in got.items()} == {i: w for i, w in left.items() if w or i not in cuts}
    assert all(got[i] == want[i] for i in got if i not in cuts)

    check_packing(list(got.items()), stage["packing"](spark, four, sf).collect(), 2048)


def test_odd_documents(spark, make, sf):
    for rows in (ODD, ODD[:0]):
        docs = make(rows) if rows else make(ODD).limit(0)
        for name, run in corpus_pipeline.STAGES:
            out = run(spark, docs, sf)
            assert name == "packing" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == bool(rows)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_thresholds():
    """Stages on word shingles take five words."""
    assert near_texts.one_of_each.__defaults__[:3] == (5, 8, 0.8) and langid.UNKNOWN == "und"
