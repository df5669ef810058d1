"""The service's answers, flattened, and the event stream's windows over a whole table."""

from pyspark.sql import functions as F

from auralith.operators import serving
from auralith.plans import _relations as R
from auralith.streaming.incremental import windowed_levels


def _tables(spark, sf_dir):
    members = R.table(spark, sf_dir, "embeddings").select((F.col("label") + 1).cast("long").alias("cluster_id"), F.col("vec_id").alias("sample_id"), (1 / (1 + F.abs(F.col("embedding")[0].cast("double")))).alias("score"))
    clusters = spark.range(1, 13).select("id", F.lit("kmeans").alias("method"), F.concat(F.lit("cluster-"), "id").alias("label"))
    return {"samples": R.samples(spark, sf_dir), "tags": R.tags(spark, sf_dir), "sample_tags": R.sample_tags(spark, sf_dir), "clusters": clusters, "cluster_members": members}


def _points(spark, sf_dir):
    return R.vectors(spark, sf_dir).select("sample_id", F.col("values")[0].alias("x"), F.col("values")[1].alias("y"))


def service_samples(spark, sf_dir):
    found = serving.samples(_tables(spark, sf_dir), q="src1", tag="lang de")
    return found.select("id", "path", F.array_join("tags", "|").alias("tags"))


def service_sample(spark, sf_dir):
    return serving.sample(_tables(spark, sf_dir), 17).select("id", "path", F.array_join("tags", "|").alias("tags"))


def service_tags(spark, sf_dir):
    return serving.tags(_tables(spark, sf_dir)).select("normalized_name", "sample_count")


def service_clusters(spark, sf_dir):
    found = serving.clusters(_tables(spark, sf_dir), "kmeans", points=_points(spark, sf_dir))
    return found.select("id", "label", "size", F.round("projection_x", 6).alias("projection_x"), F.round("projection_y", 6).alias("projection_y"), F.array_join(F.transform("members", lambda m: m["sample_id"].cast("string")), "|").alias("members"))


def service_cluster(spark, sf_dir):
    found = serving.cluster(_tables(spark, sf_dir), 3, _points(spark, sf_dir))
    return found.select("id", F.explode("members").alias("m")).select("id", "m.sample_id", F.round("m.score", 6).alias("score"), F.round("m.x", 6).alias("x"))


def event_windows(spark, sf_dir):
    found = windowed_levels(R.table(spark, sf_dir, "events"), "1 hour")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


QUERIES = {f.__name__: f for f in (service_samples, service_sample, service_tags, service_clusters, service_cluster, event_windows)}

_TAGGED = f"WITH {R.SAMPLES}, {R.TAGS}, named AS (SELECT sample_id, list_sort(list(DISTINCT normalized_name)) AS tags FROM sample_tags JOIN tags ON tags.id = tag_id GROUP BY sample_id), tagged AS (SELECT samples.*, coalesce(tags, []) AS tags FROM samples LEFT JOIN named ON id = sample_id)"
ORACLE = {
    "service_samples": f"{_TAGGED} SELECT id, path, array_to_string(tags, '|') AS tags FROM tagged WHERE list_contains(tags, 'lang de') AND contains(lower(path), 'src1') ORDER BY path",
    "service_sample": f"{_TAGGED} SELECT id, path, array_to_string(tags, '|') AS tags FROM tagged WHERE id = 17",
    "service_tags": f"WITH {R.TAGS} SELECT normalized_name, count(sample_id) AS sample_count FROM tags LEFT JOIN sample_tags ON tag_id = tags.id GROUP BY normalized_name, tags.id",
    "service_clusters": "SELECT id, 'cluster-' || id AS label, count(vec_id) AS size, round(avg(embedding[1]::double), 6) AS projection_x, round(avg(embedding[2]::double), 6) AS projection_y, string_agg(vec_id::varchar, '|' ORDER BY vec_id) AS members FROM range(1, 13) r(id) LEFT JOIN embeddings ON label + 1 = id GROUP BY id",
    "service_cluster": "SELECT 3::bigint AS id, vec_id AS sample_id, round(1 / (1 + abs(embedding[1]::double)), 6) AS score, round(embedding[1]::double, 6) AS x FROM embeddings WHERE label = 2",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(max(abs(value)), 6) AS peak, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL",
}
