import pytest
from pyspark.sql import functions as F

from auralith.llm import langid
from auralith.llm.queries import op5_language_id
from tests.llm.conftest import ODD


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = op5_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and len(truth[r["doc_id"]]["text"]) > 40]
    assert len(rows) == len(truth) and len(held) > 20
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts(make):
    df = make(ODD)
    model = langid.train(df.withColumn("lang", F.when(F.col("doc_id") == 6, "xx").otherwise(F.col("lang"))))
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()]
    assert len(found) == len(ODD) and {x for x in found if x[0] in (1, 2, 3)} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert dict((i, p) for i, p, _ in found)[6] == "xx"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.count() == len(ODD) - 3


def test_nothing_learned(make):
    df = make([(1, "some text")])
    model = langid.train(df.limit(0))
    assert langid.predict(df, model).first()["lang_pred"] == "und"
    assert langid.predict(df.limit(0), model).count() == 0


def test_counts_are_those_of_all_partitions(make):
    df = make([(k, f"aaa bbb {k}") for k in range(40)])
    one, many = langid.train(df.coalesce(1)), langid.train(df.repartition(7))
    assert all((a == b).all() for a, b in zip(one.rows[0][:2], many.rows[0][:2])) and one.rows[0][2] == many.rows[0][2] and one.langs == many.langs == ["en"]


def test_many_languages(spark):
    """A dirty column of hundreds of values teaches them all."""
    rows = [(k, f"{chr(97 + k % 26) * 3} {chr(97 + k // 26 % 26) * 4} common words", f"l{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.coalesce(1))
    assert len(model.langs) == 300
    found = langid.predict(df, model).collect()
    assert sum(r["lang_pred"] == f"l{r['doc_id']}" for r in found) > 250


def brute(rows, test):
    """Multinomial naive Bayes text by text: two- and three-letter strings, a blank for what is no letter."""
    import math
    from collections import Counter, defaultdict

    import regex

    def strings(text):
        runs = regex.sub(r"\P{L}+$", "", regex.sub(r"\P{L}+", " ", " " + text.lower()))
        return [runs[k : k + n] for n in (2, 3) for k in range(len(runs) - n + 1)]

    def bucket(s):
        x = ord(s[0]) * 0x9E3779B1 + ord(s[1]) * 0x85EBCA77
        if len(s) == 3:
            x += (ord(s[2]) + 0x100) * 0xC2B2AE3D
        x &= 0xFFFFFFFF
        return ((x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in rows:
        if text is not None and lang is not None:
            docs[lang] += 1
            counts[lang].update(map(bucket, strings(text)))
    out = []
    for text in test:
        if not text or not regex.search(r"\p{L}", text):
            out.append(("und", 0.0))
            continue
        like = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536)) for b in map(bucket, strings(text))) for x in docs}
        best = max(sorted(like), key=like.get)
        out.append((best, 1 / sum(math.exp(v - like[best]) for v in like.values())))
    return out


def test_against_brute_force(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect() if len(r["text"]) < 4000]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    rows = [r for r in op5_rows(df, spark).collect()]
    by = {r["doc_id"]: r for r in docs}
    learned = [(by[r["doc_id"]]["text"], by[r["doc_id"]]["lang"]) for r in rows if not r["held_out"]]
    want = brute(learned, [by[r["doc_id"]]["text"] for r in rows[:60]])
    for r, (lang, score) in zip(rows, want):
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)


def op5_rows(df, spark):
    fold = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(df.where(~fold))
    return langid.predict(df, model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
