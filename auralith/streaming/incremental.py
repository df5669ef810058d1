"""Incremental scan and analysis: new files below a root flow into catalog tables, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auralith.functions.exprs import extension, format_of
from auralith.operators.analyzers import analyze_files, feature_vectors

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """New audio files below the root as rows (path, file_name, extension, format, size_bytes, modified_at, content)."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    name = F.substring_index("path", "/", -1)
    rows = files.select("path", name.alias("file_name"), extension(name).alias("extension"), format_of(name).alias("format"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    return rows.where(F.col("format") != "unknown")


def scan_stream(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the samples of new files to a Parquet table and stops when all that are there are done."""
    return file_stream(spark, root).drop("content").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyze_stream(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the feature vectors of new files; the sample's id is the hash of its path, so that a repeated batch gives
    the same rows. A batch is written under its own number, which makes a retry overwrite it."""

    def write(batch: DataFrame, number: int) -> None:
        found = feature_vectors(analyze_files(batch.withColumn("id", F.xxhash64("path")), "PERMISSIVE"))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return file_stream(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_levels(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, peak, rms) of an event stream by tumbling window, events later than `late` left out."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    groups = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    return groups.select(F.col("window.start").alias("window_start"), "event_type", "n", "peak", "rms")
