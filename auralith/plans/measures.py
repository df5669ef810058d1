"""Time-domain measures, conversions and the feature vector."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auralith.functions import signals as S
from auralith.functions.exprs import percentile, ratio
from auralith.plans import _relations as R
from auralith.schemas import VECTOR_ORDER

WINDOW = 16
RATE = 100


def _rounded(df, key, columns):
    return df.select(key, *[F.round(c, 6).alias(n) for n, c in columns.items()])


def loudness(spark, sf_dir):
    return _rounded(R.arrays(spark, sf_dir), "user_id", S.loudness(F.col("data")))


def quality(spark, sf_dir):
    return _rounded(R.arrays(spark, sf_dir), "user_id", S.quality(F.col("data"), WINDOW))


def zero_crossing(spark, sf_dir):
    return _rounded(R.arrays(spark, sf_dir), "user_id", {"rate": S.zero_crossing_rate(F.col("data"))})


def rms_envelope(spark, sf_dir):
    """The envelope of long signals, from rows: one aggregation by window."""
    rows = R.signals(spark, sf_dir).groupBy("user_id", F.floor(F.col("pos") / WINDOW).alias("w")).agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count("*")).alias("rms"))
    return rows.select("user_id", "w", F.round("rms", 6).alias("rms"))


def dynamics(spark, sf_dir):
    found = S.dynamics(F.col("data"), F.lit(RATE), WINDOW)
    return _rounded(R.arrays(spark, sf_dir), "user_id", {k: found[k] for k in ("dynamic_range_db", "attack_sharpness", "sustain_ratio", "transient_rate", "temporal_centroid")})


def transient_rows(spark, sf_dir):
    step = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("user_id").orderBy("pos")))
    return R.signals(spark, sf_dir).select("user_id", step.alias("d")).groupBy("user_id").agg(F.sum(F.when(F.col("d") >= 0.2, 1).otherwise(0)).alias("transients"), F.round(F.max("d"), 6).alias("sharpest"))


def percentiles(spark, sf_dir):
    ordered = F.array_sort("data")
    return _rounded(R.arrays(spark, sf_dir), "user_id", {f"p{int(100 * p)}": percentile(ordered, p) for p in (0.05, 0.25, 0.5, 0.95)})


def autocorrelation(spark, sf_dir):
    return _rounded(R.arrays(spark, sf_dir), "user_id", {f"lag{k}": S.correlation_at(F.col("data"), F.lit(k)) for k in (1, 5)})


def pitch(spark, sf_dir):
    own = R.arrays(spark, sf_dir).select("user_id", S.pitch(F.col("data"), RATE, 4, 25).alias("p"))
    return own.select("user_id", F.round("p.frequency_hz", 6).alias("frequency_hz"), F.round("p.midi_note", 6).alias("midi_note"), F.round("p.confidence", 6).alias("confidence"), F.round("p.cents_from_note", 6).alias("cents"), "p.note")


def note_names(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", S.note_name(F.col("user_id").cast("int") - 5).alias("note"))


def _chroma(spark, sf_dir):
    bins = R.signals(spark, sf_dir).groupBy("user_id", (F.col("pos") % 12).alias("k")).agg(F.sum(F.col("x") * F.col("x")).alias("v"))
    own = bins.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("bins"))
    total = F.aggregate("bins", F.lit(0.0), lambda s, x: s + x)
    return own.select("user_id", F.transform("bins", lambda v: ratio(v, total)).alias("chroma"))


def correlation_key(spark, sf_dir):
    own = _chroma(spark, sf_dir).select("user_id", S.key_of(F.col("chroma")).alias("k"))
    return own.select("user_id", F.col("k.root").cast("long").alias("root"), "k.mode", F.round("k.score", 6).alias("score"))


def tonnetz(spark, sf_dir):
    own = _chroma(spark, sf_dir).select("user_id", S.tonnetz(F.col("chroma")).alias("t"))
    return own.select("user_id", *[F.round(F.col("t")[k], 6).alias(f"t{k}") for k in range(6)])


def median_filter(spark, sf_dir):
    """From rows, as a window frame: the form for signals of any length."""
    near = Window.partitionBy("user_id").orderBy("pos").rowsBetween(-8, 8)
    return R.signals(spark, sf_dir).select("user_id", "pos", F.round(F.expr("percentile(x, 0.5)").over(near), 6).alias("median"))


def local_maxima(spark, sf_dir):
    return R.arrays(spark, sf_dir).select("user_id", F.explode(S.local_maxima(F.col("data"))).alias("pos")).select("user_id", F.col("pos").cast("long").alias("pos"))


def _sum_of(df, key, data):
    return df.select(key, data.alias("d")).select(key, F.size("d").cast("long").alias("n"), F.round(F.aggregate(F.transform("d", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("weighted"))


def resample_linear(spark, sf_dir):
    return _sum_of(R.arrays(spark, sf_dir), "user_id", S.resample(F.col("data"), 3, 8))


def channel_mix(spark, sf_dir):
    """Duplicated to two channels, and the mean of neighbours as if the signal were interleaved stereo."""
    own = R.arrays(spark, sf_dir).withColumn("even", F.slice("data", F.lit(1), (F.floor(F.size("data") / 2) * 2).cast("int")))
    return own.select("user_id", F.size(S.convert_channels(F.col("data"), 1, 2)).cast("long").alias("doubled"), F.round(F.aggregate(S.convert_channels(F.col("even"), 2, 1), F.lit(0.0), lambda s, x: s + x), 6).alias("mixed"))


def normalize_peak(spark, sf_dir):
    out = S.normalize(F.col("data"), "peak", -6)
    return _rounded(R.arrays(spark, sf_dir).select("user_id", out.alias("d")), "user_id", {"peak": S.peak(F.col("d")), "rms": S.rms(F.col("d"))})


def normalize_rms(spark, sf_dir):
    out = S.normalize(F.col("data"), "rms", -3, allow_clipping=True)
    return _rounded(R.arrays(spark, sf_dir).select("user_id", out.alias("d")), "user_id", {"peak": S.peak(F.col("d")), "rms": S.rms(F.col("d"))})


def buffer_checks(spark, sf_dir):
    own = R.arrays(spark, sf_dir)
    return own.select("user_id", S.valid(F.col("data"), F.lit(2), F.lit(RATE)).alias("stereo"), S.valid(F.col("data"), F.lit(1), F.lit(RATE)).alias("mono"), S.channel_layout(F.size("data") % 4).alias("layout"), S.bitrate(F.col("user_id") * 1000, F.size("data") / RATE).alias("bitrate"))


def _classes(spark, sf_dir):
    a = F.col("data")
    made = S.dynamics(a, F.lit(RATE), WINDOW)
    m = {k: made[k] for k in ("attack_sharpness", "sustain_ratio", "transient_rate")} | {"zero_crossing_rate": S.zero_crossing_rate(a), "flatness": S.peak(a) * S.rms(a), "flux": S.rms(a) / 5, "confidence": F.abs(S.correlation_at(a, F.lit(1)))}
    return R.arrays(spark, sf_dir).select("user_id", *[F.round(v, 9).alias(k) for k, v in m.items()])


def waveform_class(spark, sf_dir):
    own = _classes(spark, sf_dir)
    kind, texture = S.waveform_class({c: F.col(c) for c in own.columns})
    return own.select("user_id", kind.alias("class"), texture.alias("texture"))


def loop_class(spark, sf_dir):
    return _classes(spark, sf_dir).select("user_id", S.loop_class(F.col("flatness") * 2).alias("class"))


def _metrics(spark, sf_dir):
    """Two analyzers' metrics per user, one name in both."""
    own = R.arrays(spark, sf_dir)
    first = F.create_map(F.lit("rms"), S.rms(F.col("data")), F.lit("duration_seconds"), F.lit(-1.0))
    second = F.create_map(F.lit("peak"), S.peak(F.col("data")), F.lit("duration_seconds"), F.size("data") / RATE)
    return own.select("user_id", F.array(first, second).alias("results"))


def _flat(results):
    """Maps merged, the later one's value for a name that is in several."""
    entries = F.flatten(F.transform(results, lambda m, k: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), k.alias("turn"), e["value"].alias("value")))))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.array_max(F.transform(F.filter(entries, lambda e: e["key"] == n), lambda e: F.struct(e["turn"].alias("t"), e["value"].alias("v"))))["v"].alias("value")))
    return F.map_from_entries(last)


def flatten_metrics_last_wins(spark, sf_dir):
    own = _metrics(spark, sf_dir).select("user_id", F.explode(_flat(F.col("results"))).alias("name", "value"))
    return own.select("user_id", "name", F.round("value", 6).alias("value"))


def metric_names(spark, sf_dir):
    own = _metrics(spark, sf_dir).select(F.explode(F.flatten(F.transform("results", F.map_keys))).alias("name"))
    return own.distinct().orderBy("name")


def feature_vector(metrics):
    return F.transform(F.array(*map(F.lit, VECTOR_ORDER)), lambda n: F.coalesce(F.try_element_at(metrics, n), F.lit(0.0)))


def feature_vector_build(spark, sf_dir):
    own = _metrics(spark, sf_dir).select("user_id", feature_vector(_flat(F.col("results"))).alias("v"))
    return own.select("user_id", F.size("v").cast("long").alias("dimensions"), F.posexplode("v").alias("at", "value")).where("value <> 0").select("user_id", "dimensions", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (loudness, quality, zero_crossing, rms_envelope, dynamics, transient_rows, percentiles, autocorrelation, pitch, note_names, correlation_key, tonnetz, median_filter, local_maxima, resample_linear, channel_mix, normalize_peak, normalize_rms, buffer_checks, waveform_class, loop_class, flatten_metrics_last_wins, metric_names, feature_vector_build)}

_W = f"WITH {R.SIGNALS}"
_DB = "CASE WHEN {0} > 0 THEN 20 * log10({0}) ELSE -120 END"
_LEVELS = "m AS (SELECT user_id, max(abs(x)) AS peak, sqrt(sum(x * x) / count(*)) AS rms, avg(abs(x)) AS mean_abs, avg(x) AS mean, count(*) AS n FROM signals GROUP BY user_id)"
_ENV = f"env AS (SELECT user_id, pos // {WINDOW} AS w, sqrt(sum(x * x) / count(*)) AS rms FROM signals GROUP BY ALL)"
_STEP = "step AS (SELECT user_id, pos, x, lag(x) OVER (PARTITION BY user_id ORDER BY pos) AS y FROM signals)"
_DYN = f"""{_W}, {_ENV}, {_STEP}, e AS (SELECT user_id, coalesce(min(rms) FILTER (rms > 0), 0) AS least, quantile_cont(rms, 0.05) AS p5, quantile_cont(rms, 0.95) AS high, quantile_cont(rms, 0.5) AS mid, sum(rms * w) FILTER (rms > 0) / greatest(max(w), 1) / nullif(sum(rms) FILTER (rms > 0), 0) AS centroid FROM env GROUP BY user_id),
d AS (SELECT user_id, coalesce(max(abs(x - y)), 0) AS sharp, count(*) FILTER (abs(x - y) >= 0.2) * {RATE}::double / count(*) AS rate, count(*) FILTER (y IS NOT NULL AND (x >= 0) <> (y >= 0))::double / greatest(count(*) - 1, 1) AS zcr FROM step GROUP BY user_id),
low AS (SELECT *, CASE WHEN least = 0 THEN p5 ELSE least END AS lo FROM e JOIN d USING (user_id)),
dyn AS (SELECT user_id, CASE WHEN lo > 0 AND high > 0 THEN 20 * log10(high / lo) ELSE 0 END AS dynamic_range_db, sharp AS attack_sharpness, CASE WHEN high > 0 THEN mid / high ELSE 0 END AS sustain_ratio, rate AS transient_rate, coalesce(centroid, 0) AS temporal_centroid, zcr FROM low)"""


def _lag(k):
    return f"(SELECT a.user_id, CASE WHEN sum(a.x * a.x) * sum(b.x * b.x) > 0 THEN sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) ELSE 0 END AS c FROM signals a JOIN signals b ON a.user_id = b.user_id AND b.pos = a.pos + {k} GROUP BY a.user_id)"


_CHROMA = f"{_W}, bins AS (SELECT user_id, pos % 12 AS k, sum(x * x) AS v FROM signals GROUP BY ALL), chroma AS (SELECT user_id, k, v / nullif(sum(v) OVER (PARTITION BY user_id), 0) AS v FROM bins)"
_PROFILES = ", ".join(f"({root}, {turn}, '{mode}', {k}, {p[(k - root) % 12]}::double)" for root in range(12) for turn, (mode, p) in enumerate((("major", S.MAJOR), ("minor", S.MINOR))) for k in range(12))
_CLASSES = f"""{_DYN}, {_LEVELS}, lag1 AS {_lag(1)}, c AS (SELECT user_id, round(attack_sharpness, 9) AS sharp, round(sustain_ratio, 9) AS sus, round(transient_rate, 9) AS rate, round(zcr, 9) AS zcr, round(peak * rms, 9) AS flat, round(rms / 5, 9) AS flux, round(abs(c), 9) AS conf FROM dyn JOIN m USING (user_id) JOIN lag1 USING (user_id)),
s AS (SELECT *, (CASE WHEN conf > 0.5 THEN 0.5::double ELSE 0 END) + (CASE WHEN flat < 0.25 THEN 0.3::double ELSE 0 END) + (CASE WHEN sus > 0.45 THEN 0.2::double ELSE 0 END) AS ton,
(CASE WHEN sharp > 0.5 THEN 0.4::double ELSE 0 END) + (CASE WHEN sus < 0.4 THEN 0.3::double ELSE 0 END) + (CASE WHEN rate > 20 THEN 0.2::double ELSE 0 END) + (CASE WHEN flux > 0.08 THEN 0.1::double ELSE 0 END) + (CASE WHEN conf < 0.35 THEN 0.1::double ELSE 0 END) AS per,
(CASE WHEN flat > 0.45 THEN 0.5::double ELSE 0 END) + (CASE WHEN zcr > 0.1 THEN 0.2::double ELSE 0 END) + (CASE WHEN conf < 0.3 THEN 0.2::double ELSE 0 END) + (CASE WHEN sus < 0.5 THEN 0.1::double ELSE 0 END) AS noi FROM c),
k AS (SELECT *, CASE WHEN noi > greatest(ton, per) THEN 'noise' WHEN per > ton THEN 'percussive' ELSE 'tonal' END AS class FROM s)"""
_METRICS = f"{_W}, {_LEVELS}, metrics AS (SELECT user_id, 'rms' AS name, rms AS value FROM m UNION ALL SELECT user_id, 'peak', peak FROM m UNION ALL SELECT user_id, 'duration_seconds', n / {RATE}.0::double FROM m)"
_NOTES = "[" + ", ".join(f"'{n}'" for n in S.NOTES) + "]"
ORACLE = {
    "loudness": f"{_W}, {_LEVELS} SELECT user_id, round(peak, 6) AS peak, round({_DB.format('peak')}, 6) AS peak_dbfs, round(rms, 6) AS rms, round({_DB.format('rms')}, 6) AS rms_dbfs, round(CASE WHEN rms > 0 THEN peak / rms ELSE 0 END, 6) AS crest_factor, round({_DB.format('rms')}, 6) AS integrated_lufs, round(mean_abs, 6) AS mean_abs FROM m",
    "quality": f"""{_W}, {_LEVELS}, {_ENV}, q AS (SELECT user_id, quantile_cont(rms, 0.1) AS a, quantile_cont(rms, 0.9) AS b, coalesce(min(rms) FILTER (rms > 0), 0) AS f FROM env GROUP BY user_id), c AS (SELECT user_id, avg((abs(x) >= 0.999)::int) AS clipping_ratio, avg((abs(x) <= 0.001)::int) AS silence_ratio FROM signals GROUP BY user_id),
r AS (SELECT user_id, CASE WHEN a > 0 THEN a ELSE f END AS noise, CASE WHEN b > 0 THEN b ELSE f END AS signal FROM q)
SELECT user_id, round(clipping_ratio, 6) AS clipping_ratio, round(mean, 6) AS dc_offset, round(silence_ratio, 6) AS silence_ratio, round(CASE WHEN noise > 0 AND signal > 0 THEN 20 * log10(signal / noise) ELSE 0 END, 6) AS estimated_snr_db FROM m JOIN c USING (user_id) JOIN r USING (user_id)""",
    "zero_crossing": f"{_DYN} SELECT user_id, round(zcr, 6) AS rate FROM dyn",
    "rms_envelope": f"{_W}, {_ENV} SELECT user_id, w, round(rms, 6) AS rms FROM env",
    "dynamics": f"{_DYN} SELECT user_id, round(dynamic_range_db, 6) AS dynamic_range_db, round(attack_sharpness, 6) AS attack_sharpness, round(sustain_ratio, 6) AS sustain_ratio, round(transient_rate, 6) AS transient_rate, round(temporal_centroid, 6) AS temporal_centroid FROM dyn",
    "transient_rows": f"{_W}, {_STEP} SELECT user_id, count(*) FILTER (abs(x - y) >= 0.2) AS transients, round(max(abs(x - y)), 6) AS sharpest FROM step GROUP BY user_id",
    "percentiles": f"{_W} SELECT user_id, " + ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{int(100 * p)}" for p in (0.05, 0.25, 0.5, 0.95)) + " FROM signals GROUP BY user_id",
    "autocorrelation": f"{_W} SELECT user_id, round(a.c, 6) AS lag1, round(b.c, 6) AS lag5 FROM {_lag(1)} a JOIN {_lag(5)} b USING (user_id)",
    "pitch": f"""{_W}, n AS (SELECT user_id, count(*) AS n FROM signals GROUP BY user_id), c AS (SELECT a.user_id, b.pos - a.pos AS lag, CASE WHEN sum(a.x * a.x) * sum(b.x * b.x) > 0 THEN sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) ELSE 0 END AS s FROM signals a JOIN signals b ON a.user_id = b.user_id AND b.pos - a.pos BETWEEN {RATE // 25} AND {RATE // 4} GROUP BY ALL),
w AS (SELECT c.*, lag(s) OVER o AS before, lead(s) OVER o AS after, max(s) OVER (PARTITION BY user_id) AS best FROM c JOIN n USING (user_id) WHERE lag <= n - 1 WINDOW o AS (PARTITION BY user_id ORDER BY lag)),
p AS (SELECT user_id, any_value(best) AS best, coalesce(min(lag) FILTER (s >= 0.9 * best AND s >= before AND s >= after), min(lag) FILTER (s = best)) AS lag FROM w GROUP BY user_id),
f AS (SELECT p.user_id, p.best, {RATE}::double / p.lag AS hz, w.s, 69 + 12 * log2({RATE}::double / p.lag / 440) AS midi FROM p JOIN w ON w.user_id = p.user_id AND w.lag = p.lag)
SELECT user_id, round(CASE WHEN best > 0 THEN hz ELSE 0 END, 6) AS frequency_hz, round(CASE WHEN best > 0 THEN midi ELSE 0 END, 6) AS midi_note, round(CASE WHEN best > 0 THEN s ELSE 0 END, 6) AS confidence, round(CASE WHEN best > 0 THEN (midi - round(midi)) * 100 ELSE 0 END, 6) AS cents, CASE WHEN best <= 0 OR round(midi) < 0 THEN '' ELSE {_NOTES}[(round(midi)::bigint % 12 + 1)::int] || (floor(round(midi) / 12) - 1)::bigint END AS note FROM f""",
    "note_names": f"SELECT DISTINCT user_id, CASE WHEN user_id < 5 THEN '' ELSE {_NOTES}[((user_id - 5) % 12 + 1)::int] || ((user_id - 5) // 12 - 1) END AS note FROM events",
    "correlation_key": f"""{_CHROMA}, prof(root, turn, mode, k, p) AS (VALUES {_PROFILES}),
r AS (SELECT user_id, root, turn, mode, (12 * sum(v * p) - sum(v) * sum(p)) / nullif(sqrt((12 * sum(v * v) - sum(v) * sum(v)) * (12 * sum(p * p) - sum(p) * sum(p))), 0) AS s FROM chroma JOIN prof USING (k) GROUP BY ALL)
SELECT user_id, root::bigint AS root, mode, round(coalesce(s, 0), 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(coalesce(s, 0), 12) DESC, root, turn) = 1""",
    "tonnetz": f"{_CHROMA} SELECT user_id, " + ", ".join(f"round(sum(v * {f}(k * {t})), 6) AS t{2 * j + i}" for j, t in enumerate(("7 * pi() / 6", "3 * pi() / 2", "2 * pi() / 3")) for i, f in enumerate(("sin", "cos"))) + " FROM chroma GROUP BY user_id",
    "median_filter": f"{_W} SELECT user_id, pos, round(quantile_cont(x, 0.5) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), 6) AS median FROM signals",
    "local_maxima": f"{_W} SELECT user_id, pos FROM (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM signals WINDOW w AS (PARTITION BY user_id ORDER BY pos)) WHERE x > b AND x >= a",
    "resample_linear": f"""{_W}, n AS (SELECT user_id, count(*) AS n, greatest(round(count(*) * 8.0::double / 3)::bigint, 1) AS m FROM signals GROUP BY user_id), k AS (SELECT user_id, n, m, unnest(range(m)) AS k FROM n),
p AS (SELECT *, least(floor(k * 3.0::double / 8)::bigint, n - 1) AS l, k * 3.0::double / 8 AS place FROM k)
SELECT p.user_id, any_value(m) AS n, round(sum((a.x + (b.x - a.x) * (place - l)) * (k + 1)), 4) AS weighted FROM p JOIN signals a ON a.user_id = p.user_id AND a.pos = l JOIN signals b ON b.user_id = p.user_id AND b.pos = least(l + 1, n - 1) GROUP BY p.user_id""",
    "channel_mix": f"{_W} SELECT user_id, 2 * count(*) AS doubled, round(sum(CASE WHEN pos < (n // 2) * 2 THEN x ELSE 0 END) / 2, 6) AS mixed FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM signals) GROUP BY user_id",
    "normalize_peak": f"{_W}, {_LEVELS} SELECT user_id, round(pow(10, -6.0 / 20), 6) AS peak, round(rms / peak * pow(10, -6.0 / 20), 6) AS rms FROM m",
    "normalize_rms": f"{_W}, {_LEVELS}, g AS (SELECT s.user_id, greatest(least(x / rms * pow(10, -3.0 / 20), 1), -1) AS y FROM signals s JOIN m USING (user_id)) SELECT user_id, round(max(abs(y)), 6) AS peak, round(sqrt(avg(y * y)), 6) AS rms FROM g GROUP BY user_id",
    "buffer_checks": f"{_W}, {_LEVELS} SELECT user_id, n % 2 = 0 AS stereo, true AS mono, CASE n % 4 WHEN 1 THEN 'mono' WHEN 2 THEN 'stereo' ELSE (n % 4) || '-channel' END AS layout, CASE WHEN user_id > 0 THEN floor(user_id * 1000 * 8.0::double / (n / {RATE}::double))::bigint ELSE 0 END AS bitrate FROM m",
    "waveform_class": f"{_CLASSES} SELECT user_id, class, CASE WHEN class = 'noise' THEN 'noisy' WHEN class = 'percussive' OR sharp >= 0.5 OR rate >= 20 THEN 'transient' WHEN flat >= 0.4 THEN 'noisy' WHEN sus >= 0.65 THEN 'sustained' ELSE 'hybrid' END AS texture FROM k",
    "loop_class": f"{_CLASSES} SELECT user_id, CASE WHEN flat * 2 >= 0.65 THEN 'loop' WHEN flat * 2 < 0.35 THEN 'oneshot' ELSE 'ambiguous' END AS class FROM k",
    "flatten_metrics_last_wins": f"{_METRICS} SELECT user_id, name, round(value, 6) AS value FROM metrics",
    "metric_names": "SELECT unnest(['duration_seconds', 'peak', 'rms']) AS name FROM (SELECT 1 FROM events LIMIT 1)",
    "feature_vector_build": f"{_METRICS} SELECT user_id, {len(VECTOR_ORDER)}::bigint AS dimensions, (list_position([{', '.join(repr(n) for n in VECTOR_ORDER)}], name) - 1)::bigint AS at, round(value, 6) AS value FROM metrics WHERE value <> 0",
}
