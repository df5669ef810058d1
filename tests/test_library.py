"""Whole verbs over temporary folders."""

import http.client
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralith.api import Library, convert_target
from auralith.service import serve
from auralith.sources import audio, scan
from auralith.streaming.incremental import analyze_stream, scan_stream, windowed_levels


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    for name, hz in (("kicks/deep.wav", 55), ("kicks/deep copy.wav", 55), ("bells/Dark-Bell.WAV", 880), ("bells/tone.aif", 870)):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        x = 0.4 * np.sin(2 * np.pi * hz * np.arange(8000) / 8000)
        path.write_bytes(audio.encode(audio.Signal(8000, 1, 16, x), "aiff" if path.suffix == ".aif" else "wav"))
    (root / "notes.txt").write_text("x")
    (root / ".hidden").mkdir()
    (root / ".hidden/ghost.wav").write_bytes((root / "kicks/deep.wav").read_bytes())
    return str(root)


def test_scan(spark, folder):
    rows = scan.scan(spark, folder).collect()
    assert [r["relative_path"] for r in rows] == ["bells/Dark-Bell.WAV", "bells/tone.aif", "kicks/deep copy.wav", "kicks/deep.wav"]
    assert [r["format"] for r in rows] == ["wav", "aiff", "wav", "wav"] and rows[0]["extension"] == "wav"
    assert scan.scan(spark, folder, include_hidden=True).count() == 5
    with pytest.raises(ValueError):
        scan.scan(spark)
    assert scan.scan_store(spark, "file:" + folder).count() == 4


def test_verbs(spark, folder, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.scan(folder) == 4 and lib.scan(folder) == 4
    assert lib.table("samples").select("id").distinct().count() == 4
    lib.analyze()
    vectors = lib.table("feature_vectors")
    assert vectors.count() == 4 and vectors.first()["dimensions"] == 95
    deep = f"{folder}/kicks/deep.wav"
    found = lib.similar(deep, limit=1).collect()
    assert found[0]["path"].endswith("deep copy.wav") and found[0]["similarity"] == pytest.approx(1)
    lib.auto_tag([{"tag": "Low", "expr": "Metrics.frequency_hz < 100"}, {"tag": "named", "expr": 'Sample.Extension == "aif"'}])
    assert {(r["name"], r["sample_count"]) for r in lib.tags().collect()} == {("low", 2), ("named", 1)}
    lib.add_tag(deep, "My_Tag")
    assert [r["path"] for r in lib.browse(tags=("my tag",)).collect()] == [deep]
    assert lib.play_target("my-tag") == deep and lib.play_target(deep) == deep
    lib.remove_tag(deep, "my tag")
    assert lib.browse(tags=("my tag",)).count() == 0
    assert lib.cluster(2).agg(F.sum("size")).first()[0] == 4 and lib.table("clusters").count() == 2
    plan = lib.dedup(exact=True)
    assert {r["path"] for r in plan.where("remove").collect()} == {deep}
    assert lib.dedup(perceptual=True).count() >= 2
    with pytest.raises(ValueError):
        lib.dedup()
    target = lib.rename(deep, "low/{{slug .Stem}}_{{join .Tags \"-\"}}", dry_run=False)
    assert target == f"{folder}/low/deep_low.wav" and os.path.exists(target) and not os.path.exists(deep)
    lib.dedup(exact=True, delete=True, dry_run=False)
    assert lib.table("samples").count() == 3 and not os.path.exists(target)
    lib.export(f"{tmp_path}/out.csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out.csv").count() == 3
    lib.convert(f"{folder}/bells/tone.aif", f"{tmp_path}/tone.wav", rate=4000, channels=2)
    got = audio.read_wav((tmp_path / "tone.wav").read_bytes())
    assert (got.rate, got.channels, got.frames) == (4000, 2, 4000)
    assert lib.convert(f"{folder}/bells/tone.aif", form="wav") == f"{folder}/bells/tone.wav"
    metrics, attributes, _ = lib.info(f"{folder}/bells/tone.aif")
    assert metrics["frequency_hz"] == pytest.approx(870, abs=30) and attributes["channel_layout"] == "mono"


def test_modes(spark, folder, tmp_path):
    with open(f"{folder}/kicks/broken.wav", "wb") as f:
        f.write(b"RIFF")
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.scan(folder)
    with pytest.raises(Exception, match="not a WAV file"):
        lib.analyze().count()
    found = lib.analyze(mode="PERMISSIVE", dry_run=True)
    assert [r["error"] is None for r in found.orderBy("id").collect()].count(False) == 1


def test_streams(spark, folder, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        scan_stream(spark, f"file:{folder}", f"{tmp_path}/samples", f"{tmp_path}/c1").awaitTermination()
        analyze_stream(spark, f"file:{folder}", f"{tmp_path}/vectors", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/samples").count() == 4
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 4


def test_event_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/events")
    stream = windowed_levels(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from levels").first()[0] == events.count()


def test_convert_targets():
    assert convert_target("/a/b.wav", form="aiff") == ("/a/b.aiff", "aiff")
    assert convert_target("/a/b.wav", "/c", "wav") == ("/c.wav", "wav")
    assert convert_target("/a/b.wav", "/c.aif") == ("/c.aif", "aiff")
    for bad in (("", ""), ("/c.txt", ""), ("/c.wav", "aiff"), ("", "doc")):
        with pytest.raises(ValueError):
            convert_target("/a/b.wav", *bad)


def test_service(spark, folder, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    lib.scan(folder)
    lib.analyze()
    lib.add_tag(f"{folder}/kicks/deep.wav", "My Tag")
    lib.cluster(2)
    server = serve(lib, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path, method="GET"):
        link = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=120)
        link.request(method, path)
        reply = link.getresponse()
        body = reply.read()
        return reply.status, json.loads(body) if reply.headers["Content-Type"] == "application/json" else body

    try:
        assert get("/api/health") == (200, {"status": "ok"})
        assert get("/")[0] == 200 and get("/api/health", "POST")[0] == 405 and get("/api/nothing")[0] == 404
        status, rows = get("/api/samples?q=DEEP")
        assert status == 200 and len(rows) == 2
        number = rows[1]["id"]
        assert rows[1]["tags"] == ["my tag"] and get(f"/api/samples/{number}")[1]["file_name"] == "deep.wav"
        assert get(f"/api/samples/{number}/audio")[1][:4] == b"RIFF"
        assert get("/api/samples/999")[0] == 404 and get("/api/samples/x")[0] == 400
        assert [(t["normalized_name"], t["sample_count"]) for t in get("/api/tags")[1]] == [("my tag", 1)]
        assert [r["id"] for r in get("/api/tags/My%20Tag/samples")[1]] == [number]
        clusters = get("/api/clusters?projection=pca")[1]
        assert sum(len(c["members"]) for c in clusters) == 4
        assert get(f"/api/clusters/{clusters[0]['id']}")[1]["label"] == clusters[0]["label"] and get("/api/clusters/99")[0] == 404
    finally:
        server.shutdown()
