"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="auralith-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where none is set (tests, local mode) one of
    this driver's own, which goes when it ends."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        alone = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
        if not given.isDefined() and not alone:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = given.get() if given.isDefined() else f"file://{_own_folder()}"
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for tables between rounds."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """The rows written once and read again, so that loops do not grow the plan and lost executors cost nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (src, dst): the smallest node reachable. Works on any ordered type.
    Joins are named: tables of a row a node are small enough for Spark to send them through the driver, round after round."""
    spark = edges.sparkSession
    base = scratch(spark, "components")

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, before, k = keep(tidy(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))), f"{base}/0"), None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        k += 1
        now = keep(tidy(small), f"{base}/{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = now.groupBy("u").agg(F.min("v").alias("v"))
    return labels.unionByName(labels.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))
