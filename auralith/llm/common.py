"""What the operators of this package share: shared-folder tables, text batches, hashes and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralith.operators.components import shared_dir

#: Input bytes that one cell of a key exchange, or one reducer, should stand for.
CELL_BYTES = 8 << 20


class Tables:
    """Tables written to the shared folder in one job and read again, so that lost executors cost no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Deletes all tables but these: what is returned must read no others."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        files = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for found in files.listStatus(base):
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the rows' size; the files' size for a plain scan."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # a plan without statistics
        return 0


def cells_for(df: DataFrame, per: int = CELL_BYTES) -> int:
    """How many cells an exchange over this input takes: grows with the input, so that a cell's size does not."""
    return max(8, min(1 << 20, math.ceil(input_bytes(df) / per)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Holds the cycle collector while large caches without cycles grow; it would walk them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: What this worker process keeps between tasks, by the operator that keeps it.
_kept: dict[str, list] = {}


def keep_between_tasks(owner: str, cache) -> None:
    _kept.setdefault(owner, []).append(cache)


def release_others(owner: str | None) -> None:
    """Workers live on from one operator to the next: empties the caches of all operators but the owner."""
    for name, caches in _kept.items():
        for cache in caches if name != owner else ():
            cache.clear()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: idle workers count as well as busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `most` bytes of text, one row at least."""
    release_others(owner)
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
            ends = np.cumsum(size)
            start = 0
            while start < n:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of a fixed number of bits as 32-bit words: that at key modulo `bits` (unsigned) is set for each key (long)."""
    words = keys.groupBy(F.shiftright(F.pmod("key", F.lit(bits)), 5).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 32 as int))")).alias("set"))
    out = np.zeros(bits // 32, np.uint32)
    for word, value in words.collect():  # at most bits / 32 rows
        out[word] = value
    return out


def connected_components(edges: DataFrame, tables: Tables, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges (src, dst): component is the smallest node reachable.

    Alternating star contraction: each round points every node at the smallest neighbour it knows
    (large star: the larger neighbours; small star: the smaller ones), so paths halve and hubs are met
    through map-side minima, never gathered. Each round is written to the shared folder.
    Null nodes are left out. No edges: no rows.
    """
    edges = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))
    now = tables.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    known, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = large.where("u <> v").distinct()
        floor = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        k += 1
        after = tables.keep(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}{k}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tables.drop(f"{name}{k - 1}")
        now = after
        if state == known:
            break
        known = state
    labels = now.groupBy("u").agg(F.min("v").alias("v"))
    nodes = labels.unionByName(labels.select(F.col("v").alias("u"), "v")).distinct()
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component"))


def rewrite(df: DataFrame, found: DataFrame, change: Callable[[str, list], str | None], id_col: str, text_col: str) -> DataFrame:
    """The input's rows and columns with change(text, what) as the text where found has a row (doc_id, what) for the id;
    rows for which that is None go. Null texts stay as they are."""
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].cast("long").alias("id"))
    joined = whole.join(found.select("doc_id", "what"), F.col("id") == F.col("doc_id"), "left").select("row", "what")
    names = df.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                row = part.column("row")
                texts, whats = pc.struct_field(row, [names.index(text_col)]).to_pylist(), part.column("what").to_pylist()
                new = [t if not w or t is None else change(t, w) for t, w in zip(texts, whats, strict=True)]
                keep = pa.array([n is not None or t is None for n, t in zip(new, texts, strict=True)])
                fields = [pa.array(new, pa.string()) if n == text_col else pc.struct_field(row, [k]) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], ["row"]).filter(keep)
        give_back()

    done = joined.mapInArrow(run, T.StructType([joined.schema["row"]]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in names])
