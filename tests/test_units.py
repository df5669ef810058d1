"""Small inputs with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from auralith.functions import exprs as E
from auralith.functions import signals as S
from auralith.functions.rules import RuleError, compile_rule
from auralith.operators import catalog, clustering, dedup, rename, similarity, tagging
from auralith.operators.blocks import join_sets
from auralith.operators.components import components


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in values]) for i, values in rows], "sample_id long, values array<double>")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_vector_measures(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, E.cosine(a(1, 0), a(0, 1))) == 0
    assert one(spark, E.euclidean(a(0, 0), a(3, 4))) == 5
    for bad in (E.cosine(a(0, 0), a(1, 1)), E.euclidean(a(1), a(1, 2))):
        with pytest.raises(PySparkException):
            one(spark, bad)
    assert one(spark, E.hamming(E.hash_bits(F.lit("f0")), E.hash_bits(F.lit("0f")))) == 8
    assert one(spark, E.hash_bits(F.lit("ffffffffffffffff"))) == -1
    with pytest.raises(PySparkException):
        one(spark, E.hash_bits(F.lit("xyz")))


def test_names(spark):
    assert one(spark, E.normalize_name(F.lit("  Dark__Ambient - Pad "))) == "dark ambient pad"
    assert one(spark, E.slug(F.lit("Huge Pad"))) == "huge-pad"
    assert one(spark, E.format_of(F.lit("a.b.AIF"))) == "aiff"
    assert one(spark, E.format_of(F.lit("notes.txt"))) == "unknown"


def test_pairwise_and_neighbours(spark):
    found = similarity.pairwise_top(vectors(spark, [(1, (1, 0)), (2, (0.9, 0.1)), (3, (0, 1))]), 3).collect()
    assert [(r["left_id"], r["right_id"]) for r in found] == [(1, 2), (2, 3), (1, 3)]
    pool = vectors(spark, [(1, (1, 1)), (2, (0.9, 1.1)), (3, (-1, -1)), (4, (1.1, 0.95))])
    near = similarity.nearest(pool.where("sample_id = 1"), pool, 2, "euclidean").orderBy("rank").collect()
    assert [r["sample_id"] for r in near] == [4, 2]
    assert near[0]["distance"] == pytest.approx(0.1118033989, abs=1e-4)
    assert similarity.nearest(pool, pool, 0).count() == 0


def test_similar_to(spark):
    pool = vectors(spark, [(1, (1, 0)), (2, (0.95, 0.05)), (3, (0.7, 0.3)), (4, (0, 1))])
    assert [r["sample_id"] for r in similarity.similar_to(pool, [1], 1, 0.8).collect()] == [2]
    assert [r["sample_id"] for r in similarity.similar_to(pool, [1, 2], 1, 0.8).collect()] == [3]
    two = vectors(spark, [(1, (1, 0)), (2, (0, 1)), (3, (0.8, 0.2)), (4, (0.1, 0.9))])
    assert [r["sample_id"] for r in similarity.similar_to(two, [1, 2], 0, 0.95, "asc").collect()] == [3, 4]
    for bad in ({"limit": -1}, {"threshold": 2}, {"order": "up"}):
        with pytest.raises(ValueError):
            similarity.similar_to(pool, [1], **bad)
    with pytest.raises(LookupError):
        similarity.similar_to(pool, [99])


def test_references(spark):
    own = spark.createDataFrame([(1, "/a/x.wav", "x.wav", "x.wav"), (2, "/b/x.wav", "b/x.wav", "x.wav"), (3, "/b/7", "b/7", "7")], "id long, path string, relative_path string, file_name string")
    got = similarity.resolve_references(["1", "/b/x.wav", "b/7", "1"], own).orderBy("position").collect()
    assert [r["sample_id"] for r in got] == [1, 2, 3]
    for bad in ("7", "nothing"):  # a number is an id only
        with pytest.raises(PySparkException):
            similarity.resolve_references([bad], own).collect()
    both = spark.createDataFrame([(1, "/a/x.wav", "a/x.wav", "x.wav"), (2, "/b/x.wav", "b/x.wav", "x.wav")], own.schema)
    with pytest.raises(PySparkException):
        similarity.resolve_references(["x.wav"], both).collect()


def test_components(spark):
    edges = spark.createDataFrame([(a, a + 1) for a in range(40)] + [(100, 90), (90, 95), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90}
    assert components(edges.limit(0)).count() == 0


def test_duplicates(spark):
    files = spark.createDataFrame([("/b", 4, "same", "2025-01-01"), ("/a", 4, "same", "2024-01-01"), ("/c", 9, "different", "2024-01-01")], "path string, size_bytes long, content string, modified_at string")
    found = dedup.exact_duplicates(files)
    assert {r["path"] for r in found.collect()} == {"/a", "/b"}
    keep = lambda s: dedup.plan_cull(found, ["sha256"], s).first()["keep_path"]
    assert [keep(s) for s in ("first-path", "oldest", "newest", "unheard-of")] == ["/a", "/a", "/b", "/a"]
    hashes = spark.createDataFrame([("a", 0xF0), ("b", 0xF1), ("c", 0x0F)], "path string, bits long")
    got = dedup.perceptual_groups(hashes, 2).orderBy("path").collect()
    assert [(r["path"], r["ref_path"], r["distance"]) for r in got] == [("a", "a", 0), ("b", "a", 1)]


def test_kmeans(spark):
    found = clustering.kmeans(vectors(spark, [(1, (0, 0)), (2, (0.1, 0.1)), (3, (10, 10)), (4, (10.1, 10.2))]), 2)
    got = {r["sample_id"]: r["cluster"] for r in found.memberships.collect()}
    assert got[1] == got[2] != got[3] == got[4]
    for k in (0, 5):
        with pytest.raises(ValueError):
            clustering.kmeans(vectors(spark, [(1, (0, 0))]), k)


def test_dbscan(spark):
    found = clustering.dbscan(vectors(spark, [(1, (0, 0)), (2, (0.1, 0.1)), (3, (5, 5)), (4, (5.1, 5.1)), (5, (20, 20))]), 0.3, 2)
    assert {r["sample_id"]: r["cluster"] for r in found.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: -1}


def test_projections(spark):
    own = vectors(spark, [(1, (0, 0, 0)), (2, (5, 0, 0)), (3, (0, 5, 0)), (4, (1, 1, 1))])
    for method in ("pca", "tsne"):
        points = {(round(r["x"], 6), round(r["y"], 6)) for r in clustering.project_2d(own, method).collect()}
        assert len(points) == 4 and all(x == x and abs(x) < 1e6 for p in points for x in p)
    with pytest.raises(ValueError):
        clustering.project_2d(own, "umap")


def test_path_tags(spark):
    names = lambda p: one(spark, tagging.path_names(F.lit(p), F.lit("")))
    assert names("Drums/808 Kicks/Dark-Glitch_Hit_01.wav") == ["drums", "808", "kicks", "dark", "glitch"]
    assert names("Black+Octopus+Sound/Didgeridoo%20Loops/BFD_Cm_88BPM.wav") == ["black", "octopus", "didgeridoo", "bfd", "cm", "88bpm"]


def test_metadata_tags(spark):
    attributes = F.create_map(*[F.lit(x) for x in ("embedded.genre", "Cyberpunk/Dark Ambient", "embedded.artist", "Unit Test", "embedded.comment", "Neon; Rain")])
    assert one(spark, tagging.metadata_names(attributes)) == ["cyberpunk", "dark ambient", "unit test", "neon", "rain"]


def test_rules(spark):
    row = spark.sql("select '/a/b.wav' path, 'b.wav' relative_path, 'b.wav' file_name, 'wav' extension, 'wav' format, 10L size_bytes, map('rms', 0.5D, 'hz', 60D) metrics, map('key', 'C major') attributes")
    holds = lambda text: row.select(compile_rule(text).alias("x")).first()["x"]
    assert holds('Metrics["hz"] < 100 && Sample.Format == "wav"')
    assert holds('not ("loop" in Metrics) and Metrics.loop == 0')
    assert holds('Attributes["key"] startsWith "C" and Attributes.key endsWith "major" and not (Attributes.key contains "minor")')
    assert holds("Sample.SizeBytes >= 2 ** 3 + 1 ? Metrics.rms > 0.4 : false")
    assert holds('Sample.Extension in ["aif", "wav"] and "x" not in Metrics')
    assert not holds("Metrics.rms * 2 > 1 || Metrics.hz / 0 > 1")
    for bad in ("", "Metrics.rms", "Metrics.rms >", "Nope.x == 1", 'Metrics.rms == "a"', "1 +"):
        with pytest.raises(RuleError):
            compile_rule(bad)
    with pytest.raises(RuleError):
        tagging.rule_tags([{"tag": " ", "expr": "true"}])
    assert tagging.read_rules('{"rules": [{"tag": "a"}]}') == tagging.read_rules('[{"tag": "a"}]')


def test_knn_tags(spark):
    examples = spark.createDataFrame([(1, [0.1, 0.2, 0.15], ["Dark", "pad"]), (2, [0.9, 0.8, 0.85], ["bright", "stab"])], "sample_id long, values array<double>, tags array<string>")
    got = tagging.knn_tags(vectors(spark, [(9, (0.12, 0.18, 0.14))]), examples, k=1).orderBy("rank").collect()
    assert [r["tag"] for r in got] == ["dark", "pad"]


def test_label_scores(spark):
    scores = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("score")) for n, s in (("impact", 0.31), ("pad", 0.44), ("bass", 0.40))])
    assert one(spark, tagging.clap_names(scores)) == ["pad", "bass"]
    assert one(spark, tagging.clap_names(scores, defaults=False, floor=0.3)) == ["pad", "bass", "impact"]


def test_llm(spark):
    assert one(spark, tagging.llm_names(F.lit("[\"Dark_Pad\",'lofi'; dark pad\n warm ]"), 8)) == ["dark pad", "lofi", "warm"]
    asked = []
    df = spark.createDataFrame([("hello",)], "prompt string")
    got = tagging.llm_tags(df, "prompt", lambda request: f"{request['messages'][1]['content']}, loop", "m").first()["tags"]
    assert [t["name"] for t in got] == ["hello", "loop"] and asked == []


def test_templates(spark):
    row = spark.sql("select 1L id, 'Huge Pad.wav' file_name, 'wav' extension, 'wav' format, array('pad', 'dark') tags, map('key', 'F# minor') attributes, map('a', 'b') metadata, '/lib' source_root")
    text = rename.render('{{slug .Stem}}_{{join .Tags "_"}}_{{ .Attributes.key | lower }}.wav')
    assert row.select(text.alias("x")).first()["x"] == "huge-pad_dark_pad_f# minor.wav"
    assert row.select(rename.render('{{upper (index .Attributes "key")}}').alias("x")).first()["x"] == "F# MINOR"
    target = lambda t: one(spark, rename.rename_target(F.lit(t), F.lit("/lib"), F.lit("wav")))
    assert target(" a/../b ") == "/lib/b.wav"
    assert target("/x/y.aif") == "/x/y.aif"
    with pytest.raises(PySparkException):
        target("  ")
    for bad in ("{{", "{{.Nope}}", "{{nope .Stem}}"):
        with pytest.raises(rename.TemplateError):
            rename.render(bad)
    tags = F.array(*map(F.lit, ("dark", "drums", "dark")))
    assert one(spark, rename.by_tags("/library", F.lit("impact.wav"), tags, 2)) == "/library/dark/drums/impact.wav"
    assert one(spark, rename.by_cluster("/clusters", F.lit("tone.wav"), F.lit("Cluster 7"))) == "/clusters/cluster-7/tone.wav"
    assert one(spark, rename.by_cluster("/clusters", F.lit("tone.wav"), F.lit(None).cast("string"))) == "/clusters/unclustered/tone.wav"


def test_conversions(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, S.resample(a(0, 0.25, 1, 0.75), 2, 4)) == pytest.approx([0, 0.125, 0.25, 0.625, 1, 0.875, 0.75, 0.75])
    assert one(spark, S.resample(a(0, 0.33, 0.66, 1), 4, 2)) == pytest.approx([0, 0.66])
    assert one(spark, S.convert_channels(a(0.5, -0.5, 1, 0, -0.25, -0.75), 2, 1)) == pytest.approx([0, 0.5, -0.5])
    assert one(spark, S.convert_channels(a(0.5, 1), 1, 2)) == [0.5, 0.5, 1, 1]
    assert max(map(abs, one(spark, S.normalize(a(0.25, -0.5), "peak", -6)))) == pytest.approx(10 ** (-6 / 20))
    with pytest.raises(PySparkException):
        one(spark, S.normalize(a(0.25, -0.5), "peak", 1))
    with pytest.raises(PySparkException):
        one(spark, S.normalize(a(0, 0), "rms", -10))
    assert max(one(spark, S.normalize(a(0.25, 0.5), "peak", 1, allow_clipping=True))) == 1
    with pytest.raises(ValueError):
        S.convert_channels(a(1), 3, 1)


def test_catalog_numbers_and_upsert(spark):
    old = spark.createDataFrame([(5, "/r", "/r/a.wav", "a.wav", "a.wav", "wav", "wav", 1, None, None)], "id long, source_root string, path string, relative_path string, file_name string, extension string, format string, size_bytes long, modified_at timestamp, scanned_at timestamp")
    new = spark.createDataFrame([(None, "/r", f"/r/{n}.wav", f"{n}.wav", f"{n}.wav", "wav", "wav", 2, None, None) for n in "abc"], old.schema)
    got = {r["path"]: (r["id"], r["size_bytes"]) for r in catalog.upsert_samples(old, new).collect()}
    assert got == {"/r/a.wav": (5, 2), "/r/b.wav": (6, 2), "/r/c.wav": (7, 2)}
    empty = old.limit(0)
    assert catalog.upsert_samples(empty, new).count() == 3
    writes = spark.createDataFrame([(1, "Pad", "", "a", 0.1), (2, "pad ", "", "b", 0.2), (3, "x", "X", "c", 0.3)], "seq long, name string, normalized_name string, source string, confidence double")
    assert {(r["id"], r["name"], r["normalized_name"], r["source"]) for r in catalog.ensure_tags(writes).collect()} == {(1, "pad ", "pad", "b"), (2, "x", "X", "c")}


def test_numbered_ranges(spark):
    """Enough rows that the ranges are a sample's, and columns that the offsets do not read."""
    n = 200_000
    rows = spark.range(n).select(F.format_string("%08d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("other"))
    got = catalog.numbered(rows, "id", ["path"], 5).toPandas()
    assert len(got) == n and (got["id"] == got["path"].astype(int) + 6).all()


@pytest.mark.parametrize("distance", [3, 16])
def test_hashes_against_all_pairs(spark, distance):
    """More hashes than a block holds, with copies, nulls and negative ones."""
    rng = np.random.default_rng(5)
    bits = rng.integers(-(1 << 63), 1 << 63, 5000) & rng.integers(-(1 << 63), 1 << 63, 5000)  # two bits of three are clear
    bits[2500:4000] = bits[:1500] ^ (np.int64(1) << rng.integers(0, 63, 1500))
    bits[4000:] = bits[:1000]
    paths = [f"{k:05d}" for k in range(5000)]
    hashes = spark.createDataFrame(pd.DataFrame({"path": paths, "bits": bits})).unionByName(spark.createDataFrame([("x", None), ("y", None)], "path string, bits long"))
    a, b = np.triu_indices(5000, 1)
    apart = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64))
    near = apart <= distance
    want = set(zip(a[near].tolist(), b[near].tolist(), apart[near].tolist(), strict=True))
    found = dedup.hamming_pairs(hashes, distance)
    got = [(int(r["a"]), int(r["b"]), r["distance"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0
    parent = join_sets(np.arange(5000), a[near], b[near])
    groups = {int(r["path"]): int(r["ref_path"]) for r in dedup.perceptual_groups(hashes, distance).collect()}
    many = np.bincount(parent, minlength=5000)[parent] > 1
    assert groups == {k: int(parent[k]) for k in np.flatnonzero(many).tolist()}


def test_perceptual_cull_of_many_blocks(spark):
    """A chain of hashes 16 bits apart over several blocks, hashes that stay alone, and no join through the driver."""
    rng = np.random.default_rng(6)
    bits = np.concatenate(([0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, -1], rng.integers(0, 4096, 5000) * 0x1001001001001 & 0x7FFFFFFFFFFFFFFF)).astype(np.int64)
    hashes = spark.createDataFrame(pd.DataFrame({"path": [f"{k:05d}" for k in range(len(bits))], "bits": bits}))
    links = dedup._hash_links(hashes.select("bits").distinct(), 16)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()
    one = np.unique(bits)
    near = np.argwhere(np.bitwise_count(one.view(np.uint64)[:, None] ^ one.view(np.uint64)) <= 16)
    parent = join_sets(np.arange(len(one)), *near.T)
    own = parent[np.searchsorted(one, bits)]
    first = {g: int(np.flatnonzero(own == g)[0]) for g in np.unique(own).tolist()}
    many = np.bincount(own, minlength=len(one))[own] > 1
    got = {int(r["path"]): (int(r["keep_path"]), r["remove"]) for r in dedup.plan_cull(dedup.perceptual_groups(hashes, 16), ["ref_path"]).collect()}
    assert got == {k: (first[own[k]], first[own[k]] != k) for k in np.flatnonzero(many).tolist()}


def test_pitch_scores_once(spark):
    """The scores of all lags are worked out once, not again for each place that reads them."""
    rows = spark.createDataFrame([(1, [float(np.sin(2 * np.pi * k / 8)) for k in range(64)]), (2, [0.0] * 9), (3, [1.0]), (4, [])], "id long, data array<double>")
    own = rows.select("id", S.pitch(F.col("data"), 100, 4, 25).alias("p")).select("id", "p.frequency_hz", "p.note", F.round("p.confidence", 6).alias("s"))
    assert sorted(map(tuple, own.collect())) == [(1, 12.5, "G-1", 1.0), (2, 0, "", 0), (3, 0, "", 0), (4, 0, "", 0)]
    assert own._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1
