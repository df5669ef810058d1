"""The driver's tables in the engine's shapes: each relation as a DataFrame and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions.exprs import bits_to_hash, format_of
from auralith.operators.catalog import ensure_tags

EXTENSIONS = ["wav", "aif", "flac", "ogg"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ext = F.array(*map(F.lit, EXTENSIONS))[(F.col("doc_id") % 4).cast("int")]
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)
    relative = F.concat_ws("/", "source", "lang", name)
    return docs.select(
        F.col("doc_id").alias("id"), F.lit("/lib").alias("source_root"), F.concat(F.lit("/lib/"), relative).alias("path"), relative.alias("relative_path"),
        name.alias("file_name"), ext.alias("extension"), format_of(name).alias("format"), F.col("n_chars").alias("size_bytes"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 37 % 97).cast("int")).alias("modified_at"), F.lit(None).cast("timestamp").alias("scanned_at"),
    )


SAMPLES = """samples AS (
  SELECT doc_id AS id, '/lib' AS source_root, '/lib/' || source || '/' || lang || '/' || doc_id || '.' || ext AS path,
    source || '/' || lang || '/' || doc_id || '.' || ext AS relative_path, doc_id || '.' || ext AS file_name, ext AS extension,
    CASE ext WHEN 'aif' THEN 'aiff' ELSE ext END AS format, n_chars AS size_bytes, DATE '2024-01-01' + CAST(doc_id * 37 % 97 AS INTEGER) AS modified_at
  FROM (SELECT *, ['wav', 'aif', 'flac', 'ogg'][CAST(doc_id % 4 + 1 AS INTEGER)] AS ext FROM documents))"""


def tag_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, seq, name, normalized_name, source, confidence): every tag of every sample as it is written."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lang = docs.select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") * 4).alias("seq"), F.concat(F.lit("Lang_"), "lang").alias("name"), F.lit("metadata").alias("source"), F.lit(1.0).alias("confidence"))
    source = docs.select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") * 4 + 1).alias("seq"), F.upper("source").alias("name"), F.lit("rules").alias("source"), F.lit(0.7).alias("confidence"))
    good = labels.select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") * 4 + 2).alias("seq"), F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("name"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") * 4 + 3).alias("seq"), F.lit("toxic").alias("name"), F.lit("manual").alias("source"), F.lit(1.0).alias("confidence"))
    return lang.unionByName(source).unionByName(good).unionByName(toxic).withColumn("normalized_name", F.lit(""))


TAG_WRITES = """tag_writes AS (
  SELECT doc_id AS sample_id, doc_id * 4 AS seq, 'Lang_' || lang AS name, 'lang ' || lang AS normalized_name, 'metadata' AS source, 1.0::double AS confidence FROM documents
  UNION ALL SELECT doc_id, doc_id * 4 + 1, upper(source), source, 'rules', 0.7::double FROM documents
  UNION ALL SELECT doc_id, doc_id * 4 + 2, 'quality-' || quality, 'quality ' || quality, 'manual', 1.0::double FROM labels
  UNION ALL SELECT doc_id, doc_id * 4 + 3, 'toxic', 'toxic', 'manual', 1.0::double FROM labels WHERE toxic = 1)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_tags(tag_writes(spark, sf_dir))


def sample_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auralith.functions.exprs import normalize_name

    own = tag_writes(spark, sf_dir).select("sample_id", normalize_name(F.col("name")).alias("normalized_name"))
    return own.join(tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "normalized_name"), "normalized_name").select("sample_id", "tag_id")


TAGS = TAG_WRITES + """, tags AS (
  SELECT row_number() OVER (ORDER BY min(seq)) AS id, max_by(name, seq) AS name, normalized_name, max_by(source, seq) AS source, max_by(confidence, seq) AS confidence
  FROM tag_writes GROUP BY normalized_name),
sample_tags AS (SELECT DISTINCT sample_id, tags.id AS tag_id FROM tag_writes JOIN tags USING (normalized_name))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("values"))


VECTORS = "vectors AS (SELECT vec_id AS sample_id, embedding::double[] AS vec, label FROM embeddings)"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, bits): 64 bands, a bit where a band's energy reaches the mean."""
    energy = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    mean = F.aggregate("energy", F.lit(0.0), lambda s, x: s + x) / F.size("energy")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", energy.alias("energy")).withColumn("mean", mean)
    return rows.select(F.format_string("/lib/%08d.wav", "vec_id").alias("path"), bits_to_hash(F.transform("energy", lambda e: e >= F.col("mean"))).alias("bits"))


HASHES = """hashes AS (
  SELECT printf('/lib/%08d.wav', vec_id) AS path, bits FROM (
    SELECT vec_id, list_reduce(list_prepend(0::hugeint, list_transform(range(64), lambda k: CASE WHEN e[k + 1] >= m THEN (1::hugeint) << k::integer ELSE 0::hugeint END)), lambda a, b: a + b) AS u,
      CASE WHEN u >= 9223372036854775808::hugeint THEN (u - 18446744073709551616::hugeint)::bigint ELSE u::bigint END AS bits
    FROM (SELECT vec_id, e, list_reduce(list_prepend(0::double, e), lambda a, b: a + b) / len(e) AS m FROM (SELECT vec_id, list_transform(embedding, lambda x: x::double * x::double) AS e FROM embeddings))))"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, x): each user's event values in order of time, divided by the largest magnitude."""
    events = table(spark, sf_dir, "events")
    peak = events.groupBy("user_id").agg(F.max(F.abs("value")).alias("peak"))
    from pyspark.sql.window import Window

    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return events.withColumn("pos", place).join(peak, "user_id").select("user_id", "pos", F.coalesce(F.try_divide(F.col("value"), F.col("peak")), F.lit(0.0)).alias("x"))


SIGNALS = """signals AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, coalesce(value / nullif(max(abs(value)) OVER (PARTITION BY user_id), 0), 0) AS x FROM events)"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, data): a signal per user as an array."""
    return signals(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("data"))


ARRAYS = SIGNALS + ", arrays AS (SELECT user_id, list(x ORDER BY pos) AS data FROM signals GROUP BY user_id)"


#: Users whose values make up one long signal: some 8,600 samples, so that there are several frames.
USERS = 128


def long_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, data): the values of USERS users at a time, one user after another, divided by the largest magnitude."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / USERS).cast("long").alias("id"), "user_id", "ts", "event_id", "value")
    own = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("user_id", "ts", "event_id", "value"))).alias("all"), F.max(F.abs("value")).alias("peak"))
    return own.select("id", F.transform("all", lambda v: F.coalesce(F.try_divide(v["value"], F.col("peak")), F.lit(0.0))).alias("data"))


LONG = f"""long AS (SELECT user_id // {USERS} AS id, row_number() OVER (PARTITION BY user_id // {USERS} ORDER BY user_id, ts, event_id) - 1 AS pos,
  coalesce(value / nullif(max(abs(value)) OVER (PARTITION BY user_id // {USERS}), 0), 0) AS x FROM events)"""
