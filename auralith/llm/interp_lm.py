"""A deleted-interpolation language model over a whole corpus.

Maximum-likelihood n-gram estimates are mixed with weights that depend on how often the context was
seen (buckets by powers of two, per highest order whose context was seen at all). A fixed part of the
training documents is left out of the counts to learn the weights by expectation-maximisation; the final
counts are those of all training documents. Counts come from the key exchange in chunks.py; the weights from
one histogram of the left-out tokens' component probabilities, in steps of an eighth of a factor of two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import answer, blocks, cell_bits, chain, gather, read_block, send
from .common import Tables
from .langid import held_out

COUNTED, TUNING, SCORED = 0, 1, 2
BEGIN = np.uint64(xxhash.xxh64_intdigest(b" begin"))
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
FREQUENCIES = 24
ABSENT = -1000


@dataclass
class Grams:
    """Of a block: per token its n-gram's slot by order, and the slot of that n-gram's context (-1: none)."""

    keys: np.ndarray
    slots: list[np.ndarray]
    contexts: list[np.ndarray]
    doc: np.ndarray
    size: np.ndarray


def grams(block, order: int) -> Grams:
    """Tokens are a text's words and one end; contexts reach back to one begin mark, which is counted but no token."""
    n, start = len(block.size), block.start
    size = block.size + 2
    first = np.concatenate(([0], np.cumsum(size)))
    word = np.empty(int(first[-1]), np.uint64)
    doc = np.repeat(np.arange(n), size)
    pos = np.arange(len(word)) - first[doc]
    word[first[:-1]] = BEGIN
    word[first[1:] - 1] = END
    inner = (pos > 0) & (pos < size[doc] - 1)
    word[inner] = block.word[: int(start[-1])]
    by_order = [chain(np.zeros(len(word), np.uint64), word, 1)]
    for k in range(2, order + 1):
        longer = np.zeros(len(word), np.uint64)
        longer[1:] = chain(by_order[-1][:-1], word[1:], k)
        by_order.append(longer)
    valid = [pos >= k for k in range(order)]
    every = np.concatenate([g[v] for g, v in zip(by_order, valid, strict=True)])
    keys, slot = np.unique(every, return_inverse=True)
    slots, at = [], 0
    for v in valid:
        s = np.full(len(word), -1, np.int64)
        m = int(v.sum())
        s[v] = slot[at : at + m]
        slots.append(s)
        at += m
    token = pos > 0
    contexts = [np.concatenate(([-1], s[:-1]))[token] for s in slots[:-1]]
    for k, c in enumerate(contexts):
        c[~valid[k + 1][token]] = -1
    return Grams(keys, [s[token] for s in slots], contexts, doc[token], size - 1)


def counts_of(block, g: Grams, order: int) -> np.ndarray:
    """By key: occurrences in the block, the begin marks included."""
    total = np.zeros(len(g.keys), np.int64)
    for s in g.slots:
        total += np.bincount(s[s >= 0], minlength=len(total))
    begin = np.searchsorted(g.keys, begin_key())
    total[begin] += len(block.size)
    return total


def begin_key() -> np.uint64:
    return chain(np.zeros(1, np.uint64), np.array([BEGIN]), 1)[0]


def components(g: Grams, count: np.ndarray, n: int, v: int, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per token the bucket of its context, and its probability by order, shortest first (0: no such context)."""
    base = (count[g.slots[0]] + 0.5) / (n + 0.5 * (v + 1))
    out, bucket = [base], np.zeros(len(base), np.int64)
    for k in range(1, order):
        c = np.where(g.contexts[k - 1] >= 0, count[g.contexts[k - 1]], 0)
        own = np.where(g.slots[k] >= 0, count[g.slots[k]], 0)
        out.append(np.where(c > 0, own / np.maximum(c, 1), 0.0))
        frequency = np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), FREQUENCIES - 1)
        bucket = np.where(c > 0, 1 + (k - 1) * FREQUENCIES + frequency, bucket)
    return bucket, out


def learn_weights(bucket: np.ndarray, parts: np.ndarray, n: np.ndarray, order: int, steps: int = 60) -> np.ndarray:
    """(buckets, order) mixture weights that raise the likelihood of the counted tokens (n of each row)."""
    buckets = 1 + (order - 1) * FREQUENCIES
    usable = np.ones((buckets, order))
    for b in range(buckets):
        usable[b, 1 + (b - 1) // FREQUENCIES + 1 if b else 1 :] = 0
    w = usable / usable.sum(1, keepdims=True)
    prior = usable * 0.01  # a bucket that was never met keeps equal weights
    for _ in range(steps):
        share = w[bucket] * parts
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        total = prior.copy()
        for k in range(order):
            total[:, k] += np.bincount(bucket, share[:, k], buckets)
        w = total / total.sum(1, keepdims=True)
        w[:, 0] = np.maximum(w[:, 0], 1e-4)  # a word never seen in a context keeps a chance
        w /= w.sum(1, keepdims=True)
    return w


def score(df: DataFrame, order: int = 2, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Learns from documents whose crc32(id as text) mod folds is not fold; an eighth of those, by the quotient,
    tunes the weights. Null texts are empty: one end. Rows with a null id are scored, never learned from and
    not held_out; repeated rows count each. An empty table gives no rows; other columns are not read.
    Words are told apart by 64-bit hashes.
    """
    tables = Tables(df.sparkSession, "lm")
    bits = cell_bits(df)
    out_of = held_out(F.col(id_col), folds, fold)
    tune = F.floor(F.crc32(F.col(id_col).cast("string").cast("binary")) / folds) % 8 == 3
    kind = F.when(out_of | F.col(id_col).isNull(), SCORED).when(tune, TUNING).otherwise(COUNTED)
    made = tables.keep(blocks(df, kind, out_of, id_col, text_col), "blocks")

    def counted(batches):
        for pdf in batches:
            for chunk, kind, data in zip(pdf["chunk"], pdf["kind"], pdf["data"], strict=True):
                block = read_block(data)
                g = grams(block, order)
                none = np.zeros(len(g.keys), np.uint32)
                own = none if kind == SCORED else counts_of(block, g, order).astype(np.uint32)
                rows = send(chunk, g.keys, [own if kind == COUNTED else none, own if kind == TUNING else none], bits)
                yield pd.DataFrame(rows, columns=["cell", "chunk", "data"])

    def combine(slot, n, values):
        return [np.bincount(slot, v, n).astype(np.uint32) for v in values]

    def vocabulary(keys, found):
        words = (keys & np.uint64(3) == 1) & (keys != begin_key())
        return [np.array([np.count_nonzero(words & (found[0] > 0)), np.count_nonzero(words & (found[0] + found[1] > 0))], np.int64)]

    sent = made.mapInPandas(counted, "cell long, chunk long, data binary")
    answers = tables.keep(answer(sent, combine, 2, 2, vocabulary), "answers")
    distinct = answers.where("chunk = -1").mapInPandas(lambda it: (pd.DataFrame([x[0] for x in map(_expand_all, p["data"])], columns=["a", "b"]) for p in it if len(p)), "a long, b long").agg(F.sum("a"), F.sum("b")).first()
    tokens = {r["kind"]: r["n"] for r in made.groupBy("kind").agg(F.sum(F.col("n_words") + F.col("n_docs")).alias("n")).collect()}
    n_a, v_a, v = tokens.get(COUNTED, 0), distinct[0] or 0, distinct[1] or 0
    n = n_a + tokens.get(TUNING, 0)
    names = [f"q{k}" for k in range(order)]

    def tuning(_, left, right):
        seen = []
        for data in left["data"]:
            block = read_block(data)
            g = grams(block, order)
            bucket, parts = components(g, gather(right)[0].astype(np.float64), n_a, v_a, order)
            steps = [np.where(p > 0, np.round(8 * np.log2(np.maximum(p, 1e-30))), ABSENT).astype(np.int64) for p in parts]
            seen.append(np.stack([bucket, *steps], 1))
        rows, times = np.unique(np.concatenate(seen), axis=0, return_counts=True)
        return pd.DataFrame(rows, columns=["bucket", *names]).assign(n=times)

    by_chunk = answers.where("chunk >= 0")
    tuned = made.where(F.col("kind") == TUNING).select("chunk", "data")
    seen = tuned.groupBy("chunk").cogroup(by_chunk.join(tuned.select("chunk"), "chunk", "left_semi").groupBy("chunk")).applyInPandas(tuning, f"bucket long, {', '.join(f'{x} long' for x in names)}, n long")
    table = seen.groupBy("bucket", *names).agg(F.sum("n").alias("n")).toPandas()  # bounded by the buckets and steps
    q = table[names].to_numpy(np.float64)
    weights = learn_weights(table["bucket"].to_numpy(np.int64), np.where(q > ABSENT, 2.0 ** (q / 8), 0.0), table["n"].to_numpy(np.float64), order)

    def scored(_, left, right):
        out = []
        for data in left["data"]:
            block = read_block(data)
            g = grams(block, order)
            a, b = gather(right)
            count = (a + b).astype(np.float64)
            bucket, parts = components(g, count, n, v, order)
            mixed = sum(weights[bucket, k] * parts[k] for k in range(order))
            docs = len(block.size)
            out.append(pd.DataFrame({
                "doc_id": pd.array(block.doc_id, "Int64"), "held_out": block.flag.astype(bool), "n_tokens": g.size,
                "n_known": np.bincount(g.doc, count[g.slots[0]] > 0, docs).astype(np.int64), "train_tokens": n,
                "base_score": np.bincount(g.doc, np.log10(parts[0]), docs), "score": np.bincount(g.doc, np.log10(mixed), docs),
            }))
            out[-1].loc[block.null_id, "doc_id"] = pd.NA
        return pd.concat(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return made.select("chunk", "data").groupBy("chunk").cogroup(by_chunk.groupBy("chunk")).applyInPandas(scored, schema)


def _expand_all(data: bytes) -> list[np.ndarray]:
    from .chunks import expand

    return expand(data)
