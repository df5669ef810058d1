"""Files as samples: listing by the cluster's own readers, or by a walk where names matter that those leave out."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralith.functions.exprs import FORMATS
from auralith.operators.catalog import stat_paths

COLUMNS = "source_root string, path string, relative_path string, file_name string, extension string, format string, size_bytes long, modified_at timestamp"


def _walk(root: str, include_hidden: bool, follow_symlinks: bool) -> Iterator[tuple]:
    base = os.path.abspath(root)
    if not os.path.isdir(base):
        raise NotADirectoryError(f"scan root {root!r} is not a directory")
    for folder, folders, names in os.walk(base):
        if not include_hidden:
            folders[:] = [d for d in folders if not d.startswith(".")]
        folders.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            extension = Path(name).suffix.lower().lstrip(".")
            if name.startswith(".") and not include_hidden or extension not in FORMATS or os.path.islink(path) and not follow_symlinks:
                continue
            stat = os.stat(path)
            yield base, path, os.path.relpath(path, base).replace(os.sep, "/"), name, extension, FORMATS[extension], stat.st_size, pd.Timestamp(stat.st_mtime_ns // 1000, unit="us")


def scan(spark: SparkSession, *roots: str, include_hidden: bool = False, follow_symlinks: bool = False) -> DataFrame:
    """Samples below the roots, which all executors must see, ordered by path; each root is walked by one task."""
    if not roots:
        raise ValueError("scan requires at least one root")

    def run(batches):
        for pdf in batches:
            for root in pdf["root"]:
                rows = list(_walk(root, include_hidden, follow_symlinks))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    jobs = spark.createDataFrame([(os.path.abspath(r),) for r in roots], "root string").repartition(len(roots))
    return jobs.mapInPandas(run, COLUMNS).dropDuplicates(["path"]).orderBy("path")


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """Samples below a root in any store that Spark reads, without their contents; hidden names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    found = stat_paths(files, root)
    return found.join(files, "path").select(F.lit(root.rstrip("/")).alias("source_root"), "path", "relative_path", "file_name", "extension", "format", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below the root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
