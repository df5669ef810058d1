"""The catalog's statements and the browsing queries over them."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auralith.functions.exprs import timestamp_text
from auralith.operators import catalog as C
from auralith.plans import _relations as R

LIST = ["id", "source_root", "path", "relative_path", "file_name", "extension", "format", "size_bytes"]
_LIST = ", ".join(LIST)


def _day(df):
    return df.select(*LIST, F.col("modified_at").cast("string").alias("modified_at"))


def _tables(spark, sf_dir):
    return R.samples(spark, sf_dir), R.tags(spark, sf_dir), R.sample_tags(spark, sf_dir)


def list_samples(spark, sf_dir):
    return _day(C.list_samples(R.samples(spark, sf_dir)))


def find_by_path(spark, sf_dir):
    own = R.samples(spark, sf_dir)
    return _day(C.sample_by_path(own, own.where("id = 17").first()["path"]))


def find_by_id(spark, sf_dir):
    return _day(C.sample_by_id(R.samples(spark, sf_dir), 17))


def upsert_samples(spark, sf_dir):
    """The catalog holds the documents of the first sources; a scan finds all of them with other sizes."""
    own = R.samples(spark, sf_dir)
    stored = own.where("source_root = '/lib' and relative_path < 'src5'")
    return C.upsert_samples(stored, own.withColumn("size_bytes", F.col("size_bytes") + 1)).select("id", "path", "size_bytes")


def delete_cascade(spark, sf_dir):
    own, tags, pairs = _tables(spark, sf_dir)
    left = C.delete_sample({"samples": own, "tags": tags, "sample_tags": pairs, "feature_vectors": R.vectors(spark, sf_dir)}, own.where("format = 'ogg'").select(F.col("id").alias("sample_id")))
    return left["samples"].agg(F.count("*").alias("samples"), F.sum("id").alias("ids")).join(left["sample_tags"].agg(F.count("*").alias("sample_tags"))).join(left["feature_vectors"].agg(F.count("*").alias("vectors")))


def update_location(spark, sf_dir):
    own = R.samples(spark, sf_dir)
    moves = own.where("format = 'aiff'").select("id", F.concat(F.lit("/moved/"), "id", F.lit(".WAV")).alias("path"), F.concat("id", F.lit(".WAV")).alias("relative_path"), F.concat("id", F.lit(".WAV")).alias("file_name"), (F.col("size_bytes") * 2).alias("size_bytes"))
    return C.update_locations(own, moves).select("id", "path", "relative_path", "extension", "format", "size_bytes")


def replace_vectors(spark, sf_dir):
    own = R.vectors(spark, sf_dir).select("sample_id", F.lit("analysis").alias("namespace"), F.lit("1").alias("version"), "values").withColumn("dimensions", F.size("values"))
    new = own.where("sample_id % 3 = 0").select("sample_id", "namespace", F.lit("2").alias("version"), F.slice("values", 1, 8).alias("values"))
    return C.replace_vectors(own, new).select("sample_id", "version", F.col("dimensions").cast("long").alias("dimensions"), F.round(F.col("values")[0], 6).alias("first"))


def list_vectors(spark, sf_dir):
    own = R.vectors(spark, sf_dir).select("sample_id", F.when(F.col("sample_id") % 2 == 0, "analysis").otherwise("other").alias("namespace"), "values", F.lit(0).alias("created_at"))
    return C.vectors_in(own, "analysis").select("sample_id", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def ensure_tag_last_wins(spark, sf_dir):
    return R.tags(spark, sf_dir)


def attach_dedup(spark, sf_dir):
    own, tags, pairs = _tables(spark, sf_dir)
    new = own.select(F.col("id").alias("sample_id"), F.lit(1).cast("long").alias("tag_id"))
    return C.attach_tags(pairs, new.unionByName(new)).groupBy("tag_id").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


def remove_tag(spark, sf_dir):
    own, tags, pairs = _tables(spark, sf_dir)
    gone = pairs.join(C.tag_by_name(tags, "lang_EN").select(F.col("id").alias("tag_id")), "tag_id", "left_semi")
    return C.remove_tags(pairs, gone).groupBy("tag_id").agg(F.count("*").alias("n"))


def tag_usage(spark, sf_dir):
    own, tags, pairs = _tables(spark, sf_dir)
    used = C.tag_usage(tags, pairs).select("id", "name", "normalized_name", "sample_count")
    return used.withColumn("place", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))


def tags_for_sample(spark, sf_dir):
    own, tags, pairs = _tables(spark, sf_dir)
    return C.tags_of_sample(tags, pairs, 17).select("normalized_name", "source", "confidence")


def samples_by_tag(spark, sf_dir):
    return _day(C.samples_by_tag(*_tables(spark, sf_dir), "Quality_1"))


def samples_with_tags(spark, sf_dir):
    found = C.samples_with_tags(*_tables(spark, sf_dir))
    return found.select("id", "path", F.array_join("tags", "|").alias("tags"))


def search_substring(spark, sf_dir):
    return C.search(R.samples(spark, sf_dir), "SRC1/e").select("id", "path")


def browse_filter(spark, sf_dir):
    found = C.browse(C.samples_with_tags(*_tables(spark, sf_dir)), "src1", ["Lang-EN", "quality 1"])
    return found.select("id", "path")


def request_tag_and_query(spark, sf_dir):
    found = C.search(C.samples_by_tag(*_tables(spark, sf_dir), "lang fr"), ".wav")
    return found.select("id", "path").orderBy("path")


def playback_target(spark, sf_dir):
    return C.playback_target(*_tables(spark, sf_dir), "toxic")


def _clusters(spark, sf_dir):
    members = R.table(spark, sf_dir, "embeddings").select((F.col("label") + 1).cast("long").alias("cluster_id"), F.col("vec_id").alias("sample_id"), F.lit(1.0).alias("score"))
    clusters = spark.range(1, 13).select("id", F.when(F.col("id") % 2 == 0, "kmeans").otherwise("dbscan").alias("method"), F.concat(F.lit("Cluster "), F.col("id").cast("string")).alias("label"))
    return clusters, members


def clusters_with_size(spark, sf_dir):
    return C.clusters_with_size(*_clusters(spark, sf_dir), "kmeans").select("id", "label", "size")


def cluster_members(spark, sf_dir):
    return C.cluster_members(_clusters(spark, sf_dir)[1], 3).select("sample_id", "score")


def upsert_members(spark, sf_dir):
    members = _clusters(spark, sf_dir)[1]
    writes = members.where("cluster_id < 5").select("sample_id", (F.col("cluster_id") + 1).alias("cluster_id"), F.col("sample_id").alias("seq"), (F.col("sample_id") / 100.0).alias("score"))
    again = writes.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("score", F.col("score") + 1)
    return C.upsert_members(members, writes.unionByName(again)).select("cluster_id", "sample_id", F.round("score", 6).alias("score"))


def scan_format_filter(spark, sf_dir):
    paths = R.samples(spark, sf_dir).select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("/lib/.hidden/"), "file_name")).when(F.col("id") % 5 == 1, F.concat(F.lit("/lib/"), F.col("id").cast("string"), F.lit(".TXT"))).when(F.col("id") % 5 == 2, F.upper("path")).otherwise(F.col("path")).alias("path"))
    return C.stat_paths(paths, "/lib").select("path", "relative_path", "file_name", "extension", "format")


def export_csv_rows(spark, sf_dir):
    return C.list_samples(R.samples(spark, sf_dir)).select(*LIST, timestamp_text(F.col("modified_at").cast("timestamp")).alias("modified_at"), timestamp_text(F.col("scanned_at")).alias("scanned_at"))


def export_json_rows(spark, sf_dir):
    own = C.list_samples(R.samples(spark, sf_dir))
    return own.select("id", F.to_json(F.struct(F.col("id").alias("ID"), F.col("path").alias("Path"), F.col("size_bytes").alias("SizeBytes"))).alias("json"))


QUERIES = {f.__name__: f for f in (list_samples, find_by_path, find_by_id, upsert_samples, delete_cascade, update_location, replace_vectors, list_vectors, ensure_tag_last_wins, attach_dedup, remove_tag, tag_usage, tags_for_sample, samples_by_tag, samples_with_tags, search_substring, browse_filter, request_tag_and_query, playback_target, clusters_with_size, cluster_members, upsert_members, scan_format_filter, export_csv_rows, export_json_rows)}

_ALL = f"WITH {R.SAMPLES}, {R.TAGS}"
_TAGGED = f"{_ALL}, named AS (SELECT sample_id, list_sort(list(DISTINCT normalized_name)) AS tags FROM sample_tags JOIN tags ON tags.id = tag_id GROUP BY sample_id), tagged AS (SELECT samples.*, coalesce(tags, []) AS tags FROM samples LEFT JOIN named ON id = sample_id)"
_MEMBERS = "WITH members AS (SELECT (label + 1)::bigint AS cluster_id, vec_id AS sample_id, 1.0::double AS score FROM embeddings)"
_ROW = f"{_LIST}, modified_at::varchar AS modified_at"
ORACLE = {
    "list_samples": f"WITH {R.SAMPLES} SELECT {_ROW} FROM samples ORDER BY path",
    "find_by_path": f"WITH {R.SAMPLES} SELECT {_ROW} FROM samples WHERE path = (SELECT path FROM samples WHERE id = 17)",
    "find_by_id": f"WITH {R.SAMPLES} SELECT {_ROW} FROM samples WHERE id = 17",
    "upsert_samples": f"WITH {R.SAMPLES}, stored AS (SELECT * FROM samples WHERE relative_path < 'src5') SELECT coalesce(o.id, (SELECT max(id) FROM stored) + row_number() OVER (PARTITION BY o.id IS NULL ORDER BY s.path)) AS id, s.path, s.size_bytes + 1 AS size_bytes FROM samples s LEFT JOIN stored o ON o.path = s.path",
    "delete_cascade": f"{_ALL}, gone AS (SELECT id FROM samples WHERE format = 'ogg') SELECT (SELECT count(*) FROM samples WHERE id NOT IN (SELECT id FROM gone)) AS samples, (SELECT sum(id)::bigint FROM samples WHERE id NOT IN (SELECT id FROM gone)) AS ids, (SELECT count(*) FROM sample_tags WHERE sample_id NOT IN (SELECT id FROM gone)) AS sample_tags, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM gone)) AS vectors",
    "update_location": f"WITH {R.SAMPLES} SELECT id, CASE format WHEN 'aiff' THEN '/moved/' || id || '.WAV' ELSE path END AS path, CASE format WHEN 'aiff' THEN id || '.WAV' ELSE relative_path END AS relative_path, CASE format WHEN 'aiff' THEN 'WAV' ELSE extension END AS extension, CASE format WHEN 'aiff' THEN 'wav' ELSE format END AS format, CASE format WHEN 'aiff' THEN size_bytes * 2 ELSE size_bytes END AS size_bytes FROM samples",
    "replace_vectors": "SELECT vec_id AS sample_id, CASE WHEN vec_id % 3 = 0 THEN '2' ELSE '1' END AS version, CASE WHEN vec_id % 3 = 0 THEN 8 ELSE len(embedding) END::bigint AS dimensions, round(embedding[1]::double, 6) AS first FROM embeddings",
    "list_vectors": "SELECT vec_id AS sample_id, round(list_reduce(list_prepend(0::double, embedding::double[]), lambda a, b: a + b), 6) AS total FROM embeddings WHERE vec_id % 2 = 0 ORDER BY vec_id",
    "ensure_tag_last_wins": f"WITH {R.TAGS} SELECT id, name, normalized_name, source, confidence FROM tags",
    "attach_dedup": f"{_ALL}, a AS (SELECT sample_id, tag_id FROM sample_tags UNION SELECT id, 1 FROM samples) SELECT tag_id, count(*) AS n, sum(sample_id)::bigint AS ids FROM a GROUP BY tag_id",
    "remove_tag": f"{_ALL} SELECT tag_id, count(*) AS n FROM sample_tags WHERE tag_id <> (SELECT id FROM tags WHERE normalized_name = 'lang en') GROUP BY tag_id",
    "tag_usage": f"{_ALL}, used AS (SELECT tags.id, name, normalized_name, count(sample_id) AS sample_count FROM tags LEFT JOIN sample_tags ON tag_id = tags.id GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY sample_count DESC, normalized_name) AS place FROM used",
    "tags_for_sample": f"{_ALL} SELECT normalized_name, source, confidence FROM sample_tags JOIN tags ON tags.id = tag_id WHERE sample_id = 17 ORDER BY 1",
    "samples_by_tag": f"{_ALL} SELECT {', '.join('samples.' + c for c in LIST)}, modified_at::varchar AS modified_at FROM samples JOIN sample_tags ON sample_id = samples.id JOIN tags ON tags.id = tag_id WHERE normalized_name = 'quality 1' ORDER BY path",
    "samples_with_tags": f"{_TAGGED} SELECT id, path, array_to_string(tags, '|') AS tags FROM tagged",
    "search_substring": f"WITH {R.SAMPLES} SELECT id, path FROM samples WHERE contains(lower(path), 'src1/e') OR contains(lower(file_name), 'src1/e')",
    "browse_filter": f"{_TAGGED} SELECT id, path FROM tagged WHERE list_contains(tags, 'lang en') AND list_contains(tags, 'quality 1') AND (contains(lower(path), 'src1') OR len(list_filter(tags, lambda t: contains(t, 'src1'))) > 0) ORDER BY path",
    "request_tag_and_query": f"{_TAGGED} SELECT id, path FROM tagged WHERE list_contains(tags, 'lang fr') AND contains(lower(path), '.wav') ORDER BY path",
    "playback_target": f"{_TAGGED} SELECT min(path) AS path FROM tagged WHERE list_contains(tags, 'toxic') HAVING min(path) IS NOT NULL",
    "clusters_with_size": f"{_MEMBERS} SELECT id, 'Cluster ' || id AS label, count(sample_id) AS size FROM range(1, 13) r(id) LEFT JOIN members ON cluster_id = id WHERE id % 2 = 0 GROUP BY id ORDER BY id",
    "cluster_members": f"{_MEMBERS} SELECT sample_id, score FROM members WHERE cluster_id = 3 ORDER BY 1",
    "upsert_members": f"{_MEMBERS} SELECT cluster_id, sample_id, score FROM members UNION ALL SELECT cluster_id + 1, sample_id, round(sample_id / 100.0::double + 1, 6) FROM members WHERE cluster_id < 5",
    "scan_format_filter": f"""WITH {R.SAMPLES}, p AS (SELECT CASE id % 5 WHEN 0 THEN '/lib/.hidden/' || file_name WHEN 1 THEN '/lib/' || id || '.TXT' WHEN 2 THEN upper(path) ELSE path END AS path FROM samples),
q AS (SELECT path, CASE WHEN starts_with(path, '/lib/') THEN substr(path, 6) ELSE path END AS relative_path, regexp_extract(path, '[^/]*$') AS file_name, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS extension FROM p)
SELECT *, CASE extension WHEN 'aif' THEN 'aiff' ELSE extension END AS format FROM q WHERE extension IN ('wav', 'aif', 'flac', 'ogg') AND NOT contains('/' || relative_path, '/.')""",
    "export_csv_rows": f"WITH {R.SAMPLES} SELECT {_LIST}, strftime(modified_at, '%Y-%m-%dT%H:%M:%SZ') AS modified_at, '' AS scanned_at FROM samples ORDER BY path",
    "export_json_rows": f"""WITH {R.SAMPLES} SELECT id, '{{"ID":' || id || ',"Path":"' || path || '","SizeBytes":' || size_bytes || '}}' AS json FROM samples""",
}
