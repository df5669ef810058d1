"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one scan that counts n-grams per language and partition in numpy and adds the dense count
vectors in two steps; scoring is one scan with the log-probability matrix broadcast, each row as the buckets its language has
(any number of languages: one of a few texts costs a few kilobytes). Texts are handled in slices as one code
point array, so no text costs a Python call per character.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import L as LETTER
from .bpe import _classes
from .common import text_slices

BUCKETS = 1 << 16
#: Languages that a training task holds counts of at once.
HELD = 64
ALPHA = 0.5
UNKNOWN = "und"


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per n-gram (two and three characters, words led by a blank) its text and bucket; per text its letters."""
    texts = [" " + t.lower() for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    letter = _classes()[cps] == LETTER
    text = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    letters = np.bincount(text, letter, len(texts))
    c, text = np.where(letter, cps, np.uint32(32))[keep], text[keep]
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + (c[2:] + np.uint32(0x100)) * np.uint32(0xC2B2AE3D)
    in2, in3 = text[:-1] == text[1:], text[:-2] == text[2:]
    bucket = np.concatenate((two[in2], three[in3]))
    bucket = (bucket ^ (bucket >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.concatenate((text[:-1][in2], text[:-2][in3])), (bucket >> np.uint32(16)).astype(np.int64), letters


@dataclass
class Model:
    langs: list[str]
    rows: list[tuple[np.ndarray, np.ndarray, float]]  # of each: buckets met, their log-probabilities, that of any other
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        text, bucket, letters = grams([t or "" for t in texts])
        best, top, total = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf), np.zeros(len(texts))
        for k, (met, log_p, other) in enumerate(self.rows):
            row = np.full(BUCKETS, other)
            row[met] = log_p
            like = np.bincount(text, row[bucket], len(texts)) + self.prior[k]
            higher = np.maximum(top, like)
            total = total * np.exp(top - higher) + np.exp(like - higher)  # the odds, relative to the best so far
            best[like > top] = k
            top = higher
        known = letters > 0
        score = np.where(known, 1 / total, 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], score.tolist()


def _add(frames_key: list[str]):
    def add(pdf):
        total = np.zeros(BUCKETS, np.int64)
        for blob in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(blob), np.int64)
        out = pdf.iloc[:1][frames_key].copy()
        out["docs"], out["counts"] = int(pdf["docs"].sum()), [zlib.compress(total.tobytes(), 1)]
        return out

    return add


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts every labelled row; null texts or languages teach nothing. Equal scores go to the smaller name.

    Partitions send count vectors by language, HELD at a time; these are added in groups of partitions first, so no
    task adds more than about the square root of them. Any number of languages: the driver gets a row for each.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        part = 0

        def flush():
            names = list(sums)
            blobs = [zlib.compress(sums[x].astype(np.int64).tobytes(), 1) for x in names]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([part] * len(names), pa.int64()), pa.array([docs[x] for x in names], pa.int64()), pa.array(blobs, pa.binary())], ["lang", "part", "docs", "counts"])
            sums.clear()
            docs.clear()
            return out

        for batch in text_slices(batches, "text", 1 << 20):
            part = batch.column("part")[0].as_py()
            langs = batch.column("lang").to_pylist()
            text, bucket, _ = grams(batch.column("text").to_pylist())
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            index = np.array([number[x] for x in langs], np.int64)
            of = index[text]
            per = np.bincount(index, minlength=len(names))
            for start in range(0, len(names), HELD):
                own = names[start : start + HELD]
                here = (of >= start) & (of < start + HELD) if len(names) > HELD else slice(None)
                table = np.bincount((of[here] - start) * BUCKETS + bucket[here], minlength=len(own) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(own):
                    sums[name] = sums[name] + table[k] if name in sums else table[k].copy()
                    docs[name] = docs.get(name, 0) + int(per[start + k])
                if len(sums) > HELD:
                    yield flush()
        if sums:
            yield flush()

    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).where("lang is not null and text is not null")
    parts = rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(count, "lang string, part long, docs long, counts binary")
    salted = parts.withColumn("salt", F.col("part") % 64).drop("part")
    some = salted.groupBy("lang", "salt").applyInPandas(_add(["lang", "salt"]), "lang string, salt long, docs long, counts binary")
    whole = some.groupBy("lang").applyInPandas(_add(["lang"]), "lang string, docs long, counts binary")
    found = sorted(whole.collect(), key=lambda r: r["lang"])
    model = Model([r["lang"] for r in found], [], np.zeros(len(found)))
    for r in found:
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        total = counts.sum() + ALPHA * BUCKETS
        met = np.flatnonzero(counts)
        model.rows.append((met.astype(np.int32), np.log((counts[met] + ALPHA) / total), float(np.log(ALPHA / total))))
    if found:
        docs = np.array([r["docs"] for r in found], np.float64)
        model.prior = np.log(docs / docs.sum())
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per input row, from the whole text alone; score is the posterior.

    A null text, or one without a letter, is "und" with score 0, as is every text if nothing was learned.
    Null ids stay, repeated rows are each scored, an empty table gives none, other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in text_slices(batches, "text", 1 << 20):
            langs, scores = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, whose text gets a language; "und" rows (null texts too) go."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        out: list[bool] = []
        for batch in text_slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], "text", 1 << 20):
            out += [x != UNKNOWN for x in shared.value.predict(batch.column("text").to_pylist())[0]]
        return pd.Series(out, dtype=bool)

    return df.where(known(df[text_col]))
