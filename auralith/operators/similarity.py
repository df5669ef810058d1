"""Similarity queries over feature vectors (sample_id, values array<double>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auralith.functions.exprs import cosine, euclidean
from auralith.operators.blocks import block_join, matrix

METRICS = ("cosine", "euclidean")
#: References are the query's arguments; more than this are joined in blocks instead of being part of the plan.
LITERAL_REFERENCES = 64


def compare(a: Column, b: Column, metric: str) -> tuple[Column, Column]:
    """(similarity, distance): cosine with 1 - cosine, or 1 / (1 + d) with the Euclidean d."""
    if metric == "cosine":
        s = cosine(a, b)
        return s, 1 - s
    if metric == "euclidean":
        d = euclidean(a, b)
        return 1 / (1 + d), d
    raise ValueError(f"unsupported metric {metric!r}")


def _refine(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Row against row, from the differences themselves."""
    if metric == "cosine":
        s = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
        return s, 1 - s
    d = np.sqrt(((x - y) ** 2).sum(1))
    return 1 / (1 + d), d


def first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the k + 1 smallest ids of the rows equal to it: by ties no other is among the best k."""
    _, group = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.reshape(-1)))
    own = group.reshape(-1)[order]
    start = np.searchsorted(own, own)
    out = np.empty(len(x), bool)
    out[order] = np.arange(len(x)) - start <= k
    return out


def bounds(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of all rows from below and above, by more than block arithmetic can be off."""
    if metric not in METRICS:
        raise ValueError(f"unsupported metric {metric!r}")
    if x.shape[1] != y.shape[1]:
        raise ValueError("vector dimensions differ")
    if metric == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        if not (nx.all() and ny.all()):
            raise ValueError("cosine of a zero vector")
        s = (x @ y.T) / np.outer(nx, ny)
        return s - 1e-12, s + 1e-12
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)
    d, slack = xx + yy - 2 * (x @ y.T), 1e-12 * (xx + yy)
    low, high = (1 / (1 + np.sqrt(np.maximum(0, v))) for v in (d + slack, d - slack))
    return low - 1e-15, high + 1e-15


def refined(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and distance of the pairs (x[i], y[j]), some at a time."""
    out = [_refine(x[i[k : k + 65_536]], y[j[k : k + 65_536]], metric) for k in range(0, max(1, len(i)), 65_536)]
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def best_rows(x: np.ndarray, y: np.ndarray, usable: np.ndarray, others: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(i, j, similarity, distance): for each row of x its best k rows of y among the usable, ties by others[j]."""
    low, high = bounds(x, y, metric)
    low[~usable] = high[~usable] = -np.inf
    least = np.partition(low, -k, axis=1)[:, -k][:, None] if k < low.shape[1] else -np.inf
    i, j = np.nonzero(usable & (high >= least))  # all that may be among the best k, however many are as good
    s, d = refined(x, y, i, j, metric)
    order = np.lexsort((others[j], -s, i))
    i, j, s, d = i[order], j[order], s[order], d[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top], s[top], d[top]


def pairwise_top(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k most similar pairs (left_id < right_id) with similarity and distance; ties by ids.

    Every pair is compared, in blocks; each pair of blocks returns its own best k."""

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(x["values"]), matrix(y["values"])
        left, right = x["sample_id"].to_numpy(), y["sample_id"].to_numpy()
        own = x["lb"].iloc[0] == y["rb"].iloc[0]
        low, high = bounds(a, b, metric)
        usable = first_copies(a, left, k)[:, None] & first_copies(b, right, k) & ((left[:, None] < right) if own else True)
        low = low[usable]
        least = np.partition(low, -k)[-k] if k < len(low) else -np.inf
        i, j = np.nonzero(usable & (high >= least))  # all that may be among the best k, however many are as good
        s, d = refined(a, b, i, j, metric)
        out = pd.DataFrame({"left_id": np.minimum(left[i], right[j]), "right_id": np.maximum(left[i], right[j]), "similarity": s, "distance": d})
        return out.sort_values(["similarity", "left_id", "right_id"], ascending=[False, True, True]).head(k)

    found = block_join(vectors, vectors, "sample_id", solve, "left_id long, right_id long, similarity double, distance double", symmetric=True)
    return found.orderBy(F.desc("similarity"), "left_id", "right_id").limit(k)


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, sample_id, similarity, distance, rank): the k nearest other samples of each query; ties by id."""
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id long, sample_id long, similarity double, distance double, rank int")

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = matrix(x["values"]), matrix(y["values"])
        ids, others = x["sample_id"].to_numpy(), y["sample_id"].to_numpy()
        usable = (ids[:, None] != others) & first_copies(b, others, k)
        i, j, sim, d = best_rows(a, b, usable, others, k, metric)
        return pd.DataFrame({"query_id": ids[i], "sample_id": others[j], "similarity": sim, "distance": d})

    found = block_join(queries, candidates, "sample_id", solve, "query_id long, sample_id long, similarity double, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "sample_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def similar_to(vectors: DataFrame, references: list[int], limit: int = 25, threshold: float = 0.0, order: str = "desc") -> DataFrame:
    """(sample_id, ref_id, similarity): for each other sample its best reference by cosine, at least the threshold.

    The earlier reference wins a tie; rows are in order of similarity, then sample, then reference. limit 0 is
    no limit. A few references' vectors become constants of the plan, so the candidates are scanned once and
    nothing is joined or shuffled but the last order; more than LITERAL_REFERENCES are compared in blocks.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if not -1 <= threshold <= 1:
        raise ValueError("threshold must lie between -1 and 1")
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    references = list(dict.fromkeys(references))
    if not references:
        raise ValueError("at least one reference")
    if len(references) > LITERAL_REFERENCES:
        scored = _best_of_many(vectors, references)
    else:
        scored = _best_of_few(vectors, references)
    kept = scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity") if order == "desc" else F.asc("similarity"), "sample_id", "ref_id")
    return kept.limit(limit) if limit else kept


def _best_of_few(vectors: DataFrame, references: list[int]) -> DataFrame:
    found = {r["sample_id"]: r["values"] for r in vectors.where(F.col("sample_id").isin(references)).select("sample_id", "values").collect()}
    if missing := [r for r in references if r not in found]:
        raise LookupError(f"no feature vector for {missing}")
    scores = [F.struct(cosine(F.col("values"), F.array(*[F.lit(float(v)) for v in found[r]])).alias("s"), F.lit(-k).alias("turn"), F.lit(r).cast("long").alias("ref")) for k, r in enumerate(references)]
    best = F.array_max(F.array(*scores))
    return vectors.where(~F.col("sample_id").isin(references)).select("sample_id", best.alias("best")).select("sample_id", F.col("best.ref").alias("ref_id"), F.col("best.s").alias("similarity"))


def _best_of_many(vectors: DataFrame, references: list[int]) -> DataFrame:
    """The same by blocks of candidates and references; each block sends its candidates' best."""
    asked = vectors.sparkSession.createDataFrame([(r,) for r in references], "sample_id long")
    own = vectors.join(asked, "sample_id").select("sample_id", "values")
    if (known := {r["sample_id"] for r in own.select("sample_id").collect()}) != set(references):  # as many as the arguments
        raise LookupError(f"no feature vector for {[r for r in references if r not in known]}")
    turn = {r: k for k, r in enumerate(references)}

    def solve(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        refs = y["sample_id"].to_numpy()
        turns = np.array([turn[r] for r in refs.tolist()])
        i, j, s, _ = best_rows(matrix(x["values"]), matrix(y["values"]), np.ones((len(x), len(y)), bool), turns, 1, "cosine")
        return pd.DataFrame({"sample_id": x["sample_id"].to_numpy()[i], "s": s, "turn": -turns[j], "ref": refs[j]})

    rest = vectors.join(asked, "sample_id", "left_anti").select("sample_id", "values")
    found = block_join(rest, own, "sample_id", solve, "sample_id long, s double, turn long, ref long")
    best = found.groupBy("sample_id").agg(F.max(F.struct("s", "turn", "ref")).alias("best"))
    return best.select("sample_id", F.col("best.ref").alias("ref_id"), F.col("best.s").alias("similarity"))


def resolve_references(arguments: list[str], samples: DataFrame) -> DataFrame:
    """(position, argument, sample_id, how): each argument as an id if it is a number, else as a path, a unique relative
    path or a unique file name; repeats of a sample go. Unknown and ambiguous arguments fail."""
    spark = samples.sparkSession
    asked = spark.createDataFrame(list(enumerate(arguments)), "position int, argument string")
    keys = F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("how"), value.alias("key")) for rank, how, value in ((0, "id", F.col("id").cast("string")), (1, "path", F.col("path")), (2, "relative path", F.col("relative_path")), (3, "file name", F.col("file_name")))])
    wanted = samples.select(F.col("id").alias("sample_id"), F.explode(keys).alias("k")).select("sample_id", "k.*").where(F.col("key").isin([str(int(a)) if _number(a) else a for a in arguments]))
    number = F.col("argument").rlike(r"^[+-]?\d+$")
    probe = asked.withColumn("key", F.when(number, F.col("argument").cast("long").cast("string")).otherwise(F.col("argument")))
    hits = probe.join(wanted, (probe["key"] == wanted["key"]) & (number == (F.col("how") == "id")), "left")
    best = hits.groupBy("position", "argument").agg(F.min("rank").alias("rank"), F.collect_list(F.struct("rank", "how", "sample_id")).alias("found"))
    chosen = best.withColumn("found", F.filter("found", lambda x: x["rank"] == F.col("rank")))
    failure = F.when(F.col("rank").isNull(), F.concat(F.lit("no indexed sample matched "), F.col("argument"))).when(F.size("found") > 1, F.concat(F.lit("ambiguous reference "), F.col("argument")))
    checked = chosen.select("position", "argument", F.when(failure.isNotNull(), F.raise_error(failure).cast("long")).otherwise(F.col("found")[0]["sample_id"]).alias("sample_id"), F.col("found")[0]["how"].alias("how"))
    return checked.withColumn("turn", F.row_number().over(Window.partitionBy("sample_id").orderBy("position"))).where("turn = 1").drop("turn")


def _number(text: str) -> bool:
    return text.lstrip("+-").isdigit() and text.lstrip("+-").isascii()
