"""Taggers, rules, templates and folder plans."""

from pyspark.sql import functions as F

from auralith.functions.exprs import normalize_name, slug
from auralith.operators import rename as N
from auralith.operators import tagging as T
from auralith.plans import _relations as R

RULES = [
    {"tag": "Loud_Thing", "expr": 'Metrics["rms"] > 0.45 && Metrics.peak >= 1'},
    {"tag": "quiet", "expr": 'not (Metrics["rms"] >= 0.45)', "confidence": 0.9},
    {"tag": "odd-id", "expr": 'Metrics["user_id"] % 2 == 1 and "rms" in Metrics', "source": "ids"},
    {"tag": "quiet", "expr": 'Metrics["missing"] == 0 and Attributes["name"] contains "1"'},
    {"tag": "named", "expr": 'Attributes.name startsWith "user-1" or Attributes["name"] in ["user-2", "user-3"]'},
]


def normalize_tag(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select("p_partkey", normalize_name(F.concat_ws("_-", "p_name", "p_type")).alias("tag"))


def slugify(spark, sf_dir):
    return R.table(spark, sf_dir, "part").select("p_partkey", slug(F.concat_ws("  ", "p_type", "p_brand")).alias("slug"))


def path_tags(spark, sf_dir):
    return R.table(spark, sf_dir, "pages").select("page_id", F.array_join(T.path_names(F.regexp_replace("url", "^https?://", ""), F.col("url")), "|").alias("tags"))


def metadata_tags(spark, sf_dir):
    attributes = F.create_map(F.lit("embedded.genre"), F.concat_ws("/", "source", "lang"), F.lit("embedded.comment"), F.concat(F.lit("Neon; Rain,"), F.upper("source")))
    return R.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.metadata_names(attributes), "|").alias("tags"))


def _measured(spark, sf_dir):
    """Per user the level metrics of the signal, as maps."""
    levels = R.signals(spark, sf_dir).groupBy("user_id").agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    metrics = F.create_map(F.lit("peak"), F.col("peak"), F.lit("rms"), F.col("rms"), F.lit("user_id"), F.col("user_id").cast("double"))
    return levels.select("user_id", metrics.alias("metrics"), F.create_map(F.lit("name"), F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("attributes"))


def rule_tags(spark, sf_dir):
    tagged = _measured(spark, sf_dir).select("user_id", F.explode(T.rule_tags(RULES)).alias("t"))
    return tagged.select("user_id", "t.normalized_name", "t.source", "t.confidence")


def knn_tags(spark, sf_dir):
    every = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("values"), F.array(F.concat(F.lit("Label_"), F.col("label").cast("string"))).alias("tags"))
    found = T.knn_tags(every.where("sample_id % 20 = 0"), every.where("sample_id % 20 <> 0"))
    return found.select("sample_id", "tag", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def llm_prompt(spark, sf_dir):
    own = _measured(spark, sf_dir)
    prompt = T.llm_prompt(F.concat(F.lit("/lib/"), "user_id"), F.concat("user_id", F.lit(".wav")), F.array(F.lit("pad"), F.lit("dark")), F.col("attributes"), F.col("metrics"))
    return own.select("user_id", prompt.alias("prompt"))


def llm_parse(spark, sf_dir):
    replies = R.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return replies.select("conv_id", "turn", F.array_join(T.llm_names(F.concat(F.lit('["'), F.col("text"), F.lit("; 'Dark_Pad', loop;")), 8), "|").alias("tags"))


def clap_score_to_tags(spark, sf_dir):
    scores = F.transform(F.slice("embedding", 1, len(T.DEFAULT_LABELS)), lambda v, k: F.struct(F.get(F.array(*map(F.lit, T.DEFAULT_LABELS)), k).alias("label"), (F.abs(v.cast("double")) * 2).alias("score")))
    return R.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(T.clap_names(scores), "|").alias("tags"))


def _tagged(spark, sf_dir):
    from auralith.operators.catalog import samples_with_tags

    return samples_with_tags(R.samples(spark, sf_dir), R.tags(spark, sf_dir), R.sample_tags(spark, sf_dir))


def rename_template(spark, sf_dir):
    rendered = N.render('{{slug .Stem}}_{{join .Tags "_"}}/{{.Format | upper}} {{lower "X-"}}{{.ID}}')
    own = _tagged(spark, sf_dir).select("id", rendered.alias("text"), "source_root", "extension")
    return own.select("id", "text", N.rename_target(F.col("text"), F.col("source_root"), F.col("extension")).alias("target"))


def rename_branches(spark, sf_dir):
    rendered = N.render('{{range $i, $t := .Tags}}{{if $i}}-{{end}}{{$t}}{{else}}bare{{end}}/{{printf "%06d" .ID}}{{if gt .SizeBytes 500}}_long{{else if eq .Format "wav" "aiff"}}_short{{end}}')
    return _tagged(spark, sf_dir).select("id", rendered.alias("text"))


def organize_by_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", N.by_tags("/library/./x/..", F.col("file_name"), F.col("tags"), 2).alias("target"))


def organize_by_cluster(spark, sf_dir):
    label = F.when(F.col("label") > 0, F.concat(F.lit("Cluster "), F.col("label").cast("string")))
    return R.table(spark, sf_dir, "embeddings").select("vec_id", N.by_cluster("/clusters/", F.concat(F.col("vec_id").cast("string"), F.lit(".wav")), label).alias("target"))


def merge_tags(spark, sf_dir):
    own = R.table(spark, sf_dir, "documents").select("doc_id", T.path_tags(F.concat_ws("/", "source", "lang"), F.col("source")).alias("p"), T.metadata_tags(F.create_map(F.lit("embedded.genre"), F.concat_ws(",", "lang", "source", "lang"))).alias("m"))
    return own.select("doc_id", F.array_join(F.transform(T.merge_tags(F.col("m"), F.col("p")), lambda t: F.concat_ws(":", t["normalized_name"], t["source"])), "|").alias("tags"))


QUERIES = {f.__name__: f for f in (normalize_tag, slugify, path_tags, metadata_tags, rule_tags, knn_tags, llm_prompt, llm_parse, clap_score_to_tags, rename_template, rename_branches, organize_by_tags, organize_by_cluster, merge_tags)}

_NORM = "trim(regexp_replace(lower({}), '[_\\-\\s]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.PATH_STOP_WORDS)
_LEVELS = f"WITH {R.SIGNALS}, m AS (SELECT user_id, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, 'user-' || user_id AS name FROM signals GROUP BY user_id)"
_EUC = "sqrt(list_reduce(list_prepend(0::double, list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda p, q: p + q))"
_DISTINCT = "list_transform(list_filter(list_transform({0}, lambda v, k: {{'v': v, 'k': list_position({0}, v), 'i': k}}), lambda s: s.k = s.i AND s.v <> ''), lambda s: s.v)"
_TAGGED = f"WITH {R.SAMPLES}, {R.TAGS}, named AS (SELECT sample_id, list_sort(list(DISTINCT normalized_name)) AS tags FROM sample_tags JOIN tags ON tags.id = tag_id GROUP BY sample_id), tagged AS (SELECT samples.*, coalesce(tags, []) AS tags FROM samples LEFT JOIN named ON id = sample_id)"
ORACLE = {
    "normalize_tag": f"SELECT p_partkey, {_NORM.format(chr(39).join(['p_name || ', '_-', ' || p_type']))} AS tag FROM part",
    "slugify": f"SELECT p_partkey, replace({_NORM.format(chr(39).join(['p_type || ', '  ', ' || p_brand']))}, ' ', '-') AS slug FROM part",
    "path_tags": f"""WITH s AS (SELECT page_id, unnest(string_split(regexp_replace(url, '^https?://', ''), '/')) AS seg, generate_subscripts(string_split(regexp_replace(url, '^https?://', ''), '/'), 1) AS k FROM pages),
w AS (SELECT page_id, k, string_split_regex(trim(regexp_replace(url_decode(replace(regexp_replace(trim(seg), '\\.[^.]*$', ''), '+', ' ')), '[_\\-.()\\[\\]{{}}]', ' ', 'g')), '\\s+') AS words FROM s),
t AS (SELECT page_id, k, unnest(words) AS w0, generate_subscripts(words, 1) AS j FROM w), n AS (SELECT page_id, k, j, {_NORM.format("w0")} AS w FROM t),
u AS (SELECT page_id, w, min((k, j)) AS place FROM n WHERE octet_length(encode(w)) >= 2 AND w NOT IN ({_STOP}) AND (NOT regexp_full_match(w, '[0-9]+') OR w IN ('606', '707', '808', '909')) GROUP BY page_id, w)
SELECT p.page_id, coalesce(string_agg(w, '|' ORDER BY place), '') AS tags FROM pages p LEFT JOIN u USING (page_id) GROUP BY p.page_id""",
    "metadata_tags": "SELECT doc_id, source || '|' || lang || '|neon|rain' AS tags FROM documents",
    "rule_tags": f"""{_LEVELS} SELECT user_id, 'loud thing' AS normalized_name, 'rules' AS source, 0.7::double AS confidence FROM m WHERE rms > 0.45 AND peak >= 1
UNION ALL SELECT user_id, 'quiet', 'rules', 0.9 FROM m WHERE NOT rms >= 0.45 UNION ALL SELECT user_id, 'odd id', 'ids', 0.7 FROM m WHERE user_id % 2 = 1
UNION ALL SELECT user_id, 'quiet', 'rules', 0.7 FROM m WHERE rms >= 0.45 AND contains(name, '1') UNION ALL SELECT user_id, 'named', 'rules', 0.7 FROM m WHERE starts_with(name, 'user-1') OR name IN ('user-2', 'user-3')""",
    "knn_tags": f"""WITH {R.VECTORS}, near AS (SELECT a.sample_id, b.label, 1 / (1 + {_EUC}) AS w, b.sample_id AS other FROM vectors a JOIN vectors b ON a.sample_id % 20 = 0 AND b.sample_id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY a.sample_id ORDER BY w DESC, b.sample_id) <= 3),
s AS (SELECT sample_id, 'label ' || label AS tag, sum(w) / any_value(total) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY sample_id) AS total FROM near) GROUP BY sample_id, label)
SELECT sample_id, tag, round(score, 6) AS score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, tag) AS rank FROM s WHERE score >= 0.34""",
    "llm_prompt": f"{_LEVELS} SELECT user_id, array_to_string(['{T.PROMPT_HEAD[0]}', '{T.PROMPT_HEAD[1]}', 'path: /lib/' || user_id, 'filename: ' || user_id || '.wav', 'existing_tags: dark, pad', 'attribute.name: ' || name, 'metric.peak: ' || printf('%.6f', peak), 'metric.rms: ' || printf('%.6f', rms), 'metric.user_id: ' || printf('%.6f', user_id::double)], chr(10)) AS prompt FROM m",
    "llm_parse": f"""WITH r AS (SELECT conv_id, turn, '"' || text || '; ''Dark_Pad'', loop;' AS reply FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, turn, list_transform(string_split_regex(reply, '[,\\n;]'), lambda p: {_NORM.format('''regexp_replace(p, '^["'']+|["'']+$', '', 'g')''')}) AS names FROM r)
SELECT conv_id, turn, array_to_string({_DISTINCT.format("names")}[1:8], '|') AS tags FROM n""",
    "clap_score_to_tags": f"""WITH l AS (SELECT vec_id, unnest([{", ".join(f"'{x}'" for x in T.DEFAULT_LABELS)}]) AS label, unnest(list_transform(embedding[1:{len(T.DEFAULT_LABELS)}], lambda v: abs(v::double) * 2)) AS score FROM embeddings),
r AS (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM l)
SELECT e.vec_id, coalesce(string_agg(r.label, '|' ORDER BY rn), '') AS tags FROM embeddings e LEFT JOIN r ON r.vec_id = e.vec_id AND rn <= 3 AND score >= greatest(0.32::double, top - 0.05::double) GROUP BY e.vec_id""",
    "rename_template": f"{_TAGGED} SELECT id, id || '_' || array_to_string(tags, '_') || '/' || upper(format) || ' x-' || id AS text, '/lib/' || id || '_' || array_to_string(tags, '_') || '/' || upper(format) || ' x-' || id || '.' || extension AS target FROM tagged",
    "rename_branches": f"{_TAGGED} SELECT id, CASE WHEN len(tags) = 0 THEN 'bare' ELSE array_to_string(tags, '-') END || '/' || printf('%06d', id) || CASE WHEN size_bytes > 500 THEN '_long' WHEN format IN ('wav', 'aiff') THEN '_short' ELSE '' END AS text FROM tagged",
    "organize_by_tags": f"{_TAGGED} SELECT id, '/library/' || array_to_string(list_append(list_sort(list_transform(tags, lambda t: replace(t, ' ', '-')))[1:2], file_name), '/') AS target FROM tagged",
    "organize_by_cluster": "SELECT vec_id, '/clusters/' || CASE WHEN label > 0 THEN 'cluster-' || label ELSE 'unclustered' END || '/' || vec_id || '.wav' AS target FROM embeddings",
    "merge_tags": "SELECT doc_id, lang || ':metadata|' || source || ':metadata' AS tags FROM documents",
}
