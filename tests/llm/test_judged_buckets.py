"""Pairs that only a second look at a bucket finds, and distances worked out side by side."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auralith.llm import fuzzy_lines as L
from auralith.llm.common import Tables
from auralith.llm.verified import _dealt, verified_parts


def in_one_half(x, y):
    """Of a bucket of 12, evens or odds."""
    return int(x) // 12 == int(y) // 12 and int(x) % 2 == int(y) % 2


def bucket_rows(buckets):
    rng = np.random.default_rng(9)
    fps = [sum(1 << int(k) for k in rng.choice(62, 8, replace=False)) for _ in range(12 * buckets)]
    return [(k, fps[k], 10, 7 + k // 12 << 32 | 1000 + k, *(((10 * c + 1) << 40) + (k << 33) + k for c in (1, 2, 3))) for k in range(12 * buckets)]


def test_buckets_stay_whole_where_joins_change_their_mind(spark, tmp_path):
    """A join that is first to sort and then broadcast leaves its rows where they were read."""
    spark.range(4000).selectExpr("id % 8 as c", "id % 97 as key", "id as h").repartition(4).write.parquet(f"{tmp_path}/rows")
    spark.range(776).selectExpr("id % 8 as c", "id % 97 as key", "repeat('x', 2000) as wide").write.parquet(f"{tmp_path}/keys")
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        rows, keys = (spark.read.parquet(f"{tmp_path}/{k}") for k in ("rows", "keys"))
        joined = rows.unionByName(rows.where("h < 0")).join(keys.select("c", "key").distinct(), ["c", "key"], "left_semi")

        def seen(batches):
            own = {pair for batch in batches for pair in zip(batch.column("c").to_pylist(), batch.column("key").to_pylist(), strict=True)}
            yield pa.RecordBatch.from_pylist([{"c": c, "key": key} for c, key in own], pa.schema([("c", pa.int64()), ("key", pa.int64())]))

        found = [tuple(r) for r in _dealt(joined).mapInArrow(seen, "c long, key long").collect()]
        assert len(found) == len(set(found)) == 776
    finally:
        for key in options:
            spark.conf.unset(key)


def test_no_row_for_each_pair_that_is_judged(spark, make, monkeypatch):
    """The second look writes links between parts only, however many pairs of a bucket it has to refuse."""
    classes = spark.createDataFrame([(*r[:3], 7 << 32 | 1000 + r[0], *r[4:]) for r in bucket_rows(40)], "h long, fp long, size int, m0 long, m1 long, m2 long, m3 long")
    written = {}
    keep = Tables.keep

    def count(self, df, name):
        found = keep(self, df, name)
        written[name] = found.count()
        return found

    def fetch(pairs):
        return pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().withColumn("line", F.col("h").cast("string"))

    monkeypatch.setattr(Tables, "keep", count)
    parts = verified_parts(classes, make([(1, "a")]), Tables(spark, "judged"), fetch, in_one_half, 3, 0.8, 4096, lambda size: np.full(len(size), 20))
    assert {r["node"]: r["component"] for r in parts.collect()} == {k: k - k % 12 + k % 2 for k in range(480)}
    assert max(written.values()) <= 4 * 480


@pytest.mark.parametrize("letters", ["abcdefgh é漢", "".join(map(chr, range(0x4E00, 0x4E00 + 700)))])
@pytest.mark.parametrize("longest", [5, 70, 400])
def test_many_distances_at_once(letters, longest):
    rng = random.Random(longest)
    a, b = [], []
    for _ in range(120):
        x = [rng.choice(letters) for _ in range(rng.randint(1, longest))]
        y = list(x)
        for _ in range(rng.randint(0, max(1, int(len(x) * rng.choice([0.1, 0.2, 0.3, 0.6]))))):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randint(0, 1)] = [rng.choice(letters)] if rng.random() < 0.6 else []
        a.append("".join(x))
        b.append("".join(y) or "x")
    for least in (0.5, 0.8, 0.95):
        most = np.array([int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)])
        want = [L.edit_distance(x, y) <= n for x, y, n in zip(a, b, most.tolist(), strict=True)]
        assert L._within(a, b, most).tolist() == want and L.all_similar(a, b, least).tolist() == want
    assert L.all_similar([], [], 0.8).tolist() == []
