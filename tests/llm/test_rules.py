import random
from collections import Counter

import duckdb
import pytest

from auralith.llm import rule_ledger as R
from tests.compare import differences
from tests.llm.conftest import ODD


def plain(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, again = set(), 0
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    for x in lines:
        again += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_measures():
    rng = random.Random(2)
    made = ["".join(rng.choice("ab# \n\t| \x1c!") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for text in [t for _, t in ODD] + made:
        assert R.measure_text(text)[:5] == plain(text)


def test_ledger(make):
    found = {(r["doc_id"], r["n_words"]): r for r in R.ledger(make(ODD)).collect()}
    assert found[(1, 0)]["failures"] == found[(2, 0)]["failures"] == 1
    assert R.ledger(make(ODD)).count() == len(ODD) and R.ledger(make(ODD).limit(0)).count() == 0


def test_labels(spark, sf):
    """The verdict agrees with the quality labels of texts that are long enough."""
    labels = {i: q for i, q in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()}
    rows = R.ledger(spark.read.parquet(f"{sf}/documents.parquet")).withColumn("kept", R.passes("v1")).collect()
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and r["n_words"] >= 50]
    assert len(judged) > 20 and all(bool(q) == kept for q, kept in judged)


def test_ablations(make):
    ledger = R.ledger(make([(k, t) for k, t in enumerate(["w " * 3, "### " * 60, " ".join(f"x{k}" for k in range(80)), " ".join(f"x{k}!" for k in range(80)), None])]))
    rows = [r["failures"] for r in ledger.collect()]
    own = R.mask("v1")
    for r in R.ablations(ledger, "v1").collect():
        one = 1 << r["bit"]
        assert r["failing"] == sum(bool(f & one) for f in rows)
        assert r["failing_alone"] == sum(f & own == one for f in rows)
        assert r["kept_without"] == sum(f & own & ~one == 0 for f in rows)


@pytest.mark.parametrize("name", ["op3_metric_join", "op4_quality_rules", "op6_repeated_passages"])
def test_matches_sql(spark, sf, name):
    from auralith.llm import queries

    assert differences(queries.queries()[name](spark, sf), sf, queries.oracle_sql()[name]) == []
