"""No table of a row per hash goes through the driver."""

import numpy as np
import pandas as pd

from auralith.operators import components, dedup


def test_perceptual_cull_sends_no_table_through_the_driver(spark, monkeypatch):
    plans = []

    def keep(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, path)

    kept = components.keep
    monkeypatch.setattr(components, "keep", keep)
    monkeypatch.setattr(dedup, "keep", keep)
    bits = np.array([0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, -1, 0x3333333333333333], np.int64)
    hashes = spark.createDataFrame(pd.DataFrame({"path": list("fedcba"), "bits": bits}))
    out = dedup.plan_cull(dedup.perceptual_groups(hashes, 16), ["ref_path"])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["path"]: (r["keep_path"], r["remove"]) for r in out.collect()} == {"f": ("c", True), "e": ("c", True), "d": ("c", True), "c": ("c", False)}
    assert len(plans) >= 5 and not [p for p in plans if "Broadcast" in p]
