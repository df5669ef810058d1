"""Similarity, references, hashes and duplicates."""

from pyspark.sql import functions as F

from auralith.functions.exprs import hash_bits
from auralith.operators import dedup, similarity
from auralith.plans import _relations as R

DISTANCE = 16


def similar_best_reference(spark, sf_dir):
    found = similarity.similar_to(R.vectors(spark, sf_dir), [0, 1])
    return found.select("sample_id", "ref_id", F.round("similarity", 6).alias("similarity"))


def similar_ascending_threshold(spark, sf_dir):
    found = similarity.similar_to(R.vectors(spark, sf_dir), [0, 1], limit=0, threshold=0.1, order="asc")
    return found.select("sample_id", "ref_id", F.round("similarity", 6).alias("similarity"))


def similar_to_many(spark, sf_dir):
    """More references than become constants of the plan: every fifth vector of the first five hundred."""
    found = similarity.similar_to(R.vectors(spark, sf_dir), list(range(0, 500, 5)), limit=0, threshold=-1)
    return found.select("sample_id", "ref_id", F.round("similarity", 6).alias("similarity"))


def _pairs(metric):
    def run(spark, sf_dir):
        found = similarity.pairwise_top(R.vectors(spark, sf_dir), 25, metric)
        return found.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))

    return run


def _nearest(metric):
    def run(spark, sf_dir):
        every = R.vectors(spark, sf_dir)
        found = similarity.nearest(every.where("sample_id % 20 = 0"), every, 5, metric)
        return found.select("query_id", "sample_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))

    return run


def resolve_references(spark, sf_dir):
    own = R.samples(spark, sf_dir)
    asked = ["7", "/lib/src0/en/none.wav", "12.wav", "13.aif"]
    paths = [r["path"] for r in own.where("id = 5").select("path").collect()]
    return similarity.resolve_references([asked[0], *paths, asked[2], asked[3], asked[0]], own).select(F.col("position").cast("long").alias("position"), "sample_id", "how")


def hamming_pairs(spark, sf_dir):
    return dedup.hamming_pairs(R.hashes(spark, sf_dir), DISTANCE).select("a", "b", F.col("distance").cast("long").alias("distance"))


def hash_hex(spark, sf_dir):
    rows = R.hashes(spark, sf_dir).withColumn("hex", F.lower(F.lpad(F.hex("bits"), 16, "0")))
    return rows.select("path", "hex", (hash_bits(F.col("hex")) == F.col("bits")).alias("same"), F.bit_count("bits").cast("long").alias("ones"))


def _files(spark, sf_dir):
    return R.samples(spark, sf_dir).join(R.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id").select("path", "size_bytes", "modified_at", "content")


def size_bucket_prefilter(spark, sf_dir):
    return dedup.size_candidates(R.samples(spark, sf_dir).select("path", "size_bytes"))


def exact_duplicates(spark, sf_dir):
    return dedup.exact_duplicates(_files(spark, sf_dir)).select("size_bytes", "sha256", "path", "n")


def _cull(strategy):
    def run(spark, sf_dir):
        return dedup.plan_cull(dedup.exact_duplicates(_files(spark, sf_dir)), ["size_bytes", "sha256"], strategy).select("path", "keep_path", "remove")

    return run


def perceptual_groups(spark, sf_dir):
    found = dedup.perceptual_groups(R.hashes(spark, sf_dir), DISTANCE)
    return found.select("path", "ref_path", F.col("distance").cast("long").alias("distance"), F.round("similarity", 6).alias("similarity"), "n")


def perceptual_cull(spark, sf_dir):
    return dedup.plan_cull(dedup.perceptual_groups(R.hashes(spark, sf_dir), DISTANCE), ["ref_path"]).select("path", "keep_path", "remove")


QUERIES = {
    "similar_best_reference": similar_best_reference,
    "similar_ascending_threshold": similar_ascending_threshold,
    "similar_to_many": similar_to_many,
    "pairwise_cosine_top": _pairs("cosine"),
    "pairwise_euclid_top": _pairs("euclidean"),
    "nearest_neighbors_cosine": _nearest("cosine"),
    "nearest_neighbors_euclid": _nearest("euclidean"),
    "resolve_references": resolve_references,
    "hamming_pairs": hamming_pairs,
    "hash_hex": hash_hex,
    "size_bucket_prefilter": size_bucket_prefilter,
    "exact_duplicates": exact_duplicates,
    "exact_cull_first_path": _cull("first-path"),
    "exact_cull_oldest": _cull("oldest"),
    "exact_cull_newest": _cull("newest"),
    "perceptual_groups": perceptual_groups,
    "perceptual_cull": perceptual_cull,
}

_COS = "list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))"
_EUC = "sqrt(list_reduce(list_prepend(0::double, list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda p, q: p + q))"
_BEST = f"""WITH {R.VECTORS}, refs AS (SELECT * FROM vectors WHERE sample_id IN (0, 1)),
scored AS (SELECT a.sample_id, b.sample_id AS ref_id, {_COS} AS s FROM vectors a, refs b WHERE a.sample_id NOT IN (0, 1)),
best AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, ref_id) AS rn FROM scored)
SELECT sample_id, ref_id, round(s, 6) AS similarity FROM best WHERE rn = 1"""
_FILES = f"WITH {R.SAMPLES}, files AS (SELECT path, size_bytes, modified_at, sha256(text) AS sha256 FROM samples JOIN documents ON id = doc_id), dup AS (SELECT *, count(*) OVER (PARTITION BY size_bytes, sha256) AS n FROM files QUALIFY n > 1)"
_GROUPS = f"""WITH RECURSIVE {R.HASHES}, links AS (SELECT a.path AS p, b.path AS q FROM hashes a, hashes b WHERE bit_count(xor(a.bits, b.bits)) <= {DISTANCE}),
reach AS (SELECT p, q FROM links UNION SELECT reach.p, links.q FROM reach JOIN links ON reach.q = links.p),
refs AS (SELECT p AS path, min(q) AS ref_path FROM reach GROUP BY p),
sized AS (SELECT *, count(*) OVER (PARTITION BY ref_path) AS n FROM refs QUALIFY n > 1)"""


def _pair_sql(s, d):
    return f"WITH {R.VECTORS}, p AS (SELECT a.sample_id AS left_id, b.sample_id AS right_id, {s} AS s FROM vectors a JOIN vectors b ON a.sample_id < b.sample_id) SELECT left_id, right_id, round({d[0]}, 6) AS similarity, round({d[1]}, 6) AS distance FROM p ORDER BY s {d[2]}, left_id, right_id LIMIT 25"


def _near_sql(s, d):
    return f"WITH {R.VECTORS}, p AS (SELECT a.sample_id AS query_id, b.sample_id, {s} AS s FROM vectors a JOIN vectors b ON a.sample_id <> b.sample_id WHERE a.sample_id % 20 = 0) SELECT query_id, sample_id, round({d[0]}, 6) AS similarity, round({d[1]}, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY s {d[2]}, sample_id) AS rank FROM p QUALIFY rank <= 5"


def _cull_sql(order):
    return f"{_FILES}, k AS (SELECT path, first(path) OVER (PARTITION BY size_bytes, sha256 ORDER BY {order}) AS keep_path FROM dup) SELECT path, keep_path, path <> keep_path AS remove FROM k"


ORACLE = {
    "similar_best_reference": _BEST + " ORDER BY s DESC, sample_id, ref_id LIMIT 25",
    "similar_ascending_threshold": _BEST.replace("round(s, 6) AS similarity FROM best WHERE rn = 1", "round(s, 6) AS similarity FROM best WHERE rn = 1 AND s >= 0.1 AND s >= 0"),
    "similar_to_many": _BEST.replace("sample_id IN (0, 1)", "sample_id < 500 AND sample_id % 5 = 0").replace("a.sample_id NOT IN (0, 1)", "NOT (a.sample_id < 500 AND a.sample_id % 5 = 0)"),
    "pairwise_cosine_top": _pair_sql(_COS, ("s", "1 - s", "DESC")),
    "pairwise_euclid_top": _pair_sql(_EUC, ("1 / (1 + s)", "s", "ASC")),
    "nearest_neighbors_cosine": _near_sql(_COS, ("s", "1 - s", "DESC")),
    "nearest_neighbors_euclid": _near_sql(_EUC, ("1 / (1 + s)", "s", "ASC")),
    "resolve_references": f"WITH {R.SAMPLES} SELECT 0::bigint AS position, 7::bigint AS sample_id, 'id' AS how UNION ALL SELECT 1, id, 'path' FROM samples WHERE id = 5 UNION ALL SELECT 2, id, 'file name' FROM samples WHERE file_name = '12.wav' UNION ALL SELECT 3, id, 'file name' FROM samples WHERE file_name = '13.aif'",
    "hamming_pairs": f"WITH {R.HASHES} SELECT a.path AS a, b.path AS b, bit_count(xor(a.bits, b.bits))::bigint AS distance FROM hashes a JOIN hashes b ON a.path < b.path WHERE bit_count(xor(a.bits, b.bits)) <= {DISTANCE}",
    "hash_hex": f"WITH {R.HASHES} SELECT path, lpad(lower(to_hex(u)), 16, '0') AS hex, true AS same, bit_count(bits)::bigint AS ones FROM (SELECT *, CASE WHEN bits < 0 THEN bits::hugeint + 18446744073709551616::hugeint ELSE bits::hugeint END AS u FROM hashes)",
    "size_bucket_prefilter": f"WITH {R.SAMPLES} SELECT path, size_bytes FROM samples QUALIFY count(*) OVER (PARTITION BY size_bytes) > 1",
    "exact_duplicates": f"{_FILES} SELECT size_bytes, sha256, path, n FROM dup",
    "exact_cull_first_path": _cull_sql("path"),
    "exact_cull_oldest": _cull_sql("modified_at, path"),
    "exact_cull_newest": _cull_sql("modified_at DESC, path"),
    "perceptual_groups": f"{_GROUPS} SELECT s.path, s.ref_path, bit_count(xor(a.bits, b.bits))::bigint AS distance, round(1 - bit_count(xor(a.bits, b.bits)) / 64.0::double, 6) AS similarity, s.n FROM sized s JOIN hashes a ON a.path = s.path JOIN hashes b ON b.path = s.ref_path",
    "perceptual_cull": f"{_GROUPS} SELECT path, ref_path AS keep_path, path <> ref_path AS remove FROM sized",
}
