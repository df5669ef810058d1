"""SimHash near-dedup with a wider radius, every link verified on the texts' shingles.

Texts that share four fifths of their five-word shingles differ in some ten of 64 bits. So the fingerprints of
simhash.py are compared up to a radius at which unrelated texts may meet, and a link also needs a Jaccard
similarity of the shingle sets, also where fingerprints are equal. With `wide`, texts that share a min-hash band of
their shingles meet too. Texts of the same shingle set are one class, compared through the one with the smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, bit_filter, mix64, text_slices
from .simhash import LARGE, fingerprint, shingle_hashes
from .verified import BAND_COLUMNS, band_columns, verified_parts

WORDS, RADIUS, SIMILARITY = 5, 8, 0.8
#: Bits by which texts that share a min-hash band may differ: those of similarity 0.8 differ in ten on average.
WIDE = 20
#: Bits of the filter that says which documents' shingles to fetch: 2 MB, whatever the corpus.
FILTER_BITS = 1 << 24


def shingle_set(hashes: np.ndarray) -> bytes:
    """The distinct shingles of a text as sorted 32-bit numbers."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes()


def set_hash(hashes: np.ndarray) -> int:
    """Names the set of the shingle hashes, whatever their order and number; signed."""
    return int(mix64(np.unique(hashes).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def jaccard(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
    shared = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - shared
    return shared / whole if whole else 1.0


def near_texts(df: DataFrame, words: int = WORDS, radius: int = RADIUS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, wide: int | None = None) -> DataFrame:
    """(doc_id, component_id): one row per input row whose id is not null; component_id is the smallest doc_id reachable.

    Texts link if their shingle sets are equal, or their fingerprints differ in at most `radius` bits while the sets'
    Jaccard similarity is at least `least`; with `wide`, also if they share a min-hash band and differ in at most that
    many bits. Null, empty and blank texts have no shingles: they link with one another. Rows with a null id are left out; rows that share an id are one document if their texts link, and
    else appear each; an empty table gives no rows.
    """
    tables, bands = Tables(df.sparkSession, "near-texts"), BAND_COLUMNS if wide else ()
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).where("doc_id is not null")

    def read(batches):
        for batch in text_slices(batches, "text", 1 << 20):
            hashes = [shingle_hashes(t or "", words) for t in batch.column("text").to_pylist()]
            prints = np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)
            sets = pa.array([set_hash(h) for h in hashes], pa.int64())
            size = [len(np.unique((h >> np.uint64(32)).astype("<u4"))) for h in hashes]
            own = band_columns(np.concatenate([*hashes, np.zeros(0, np.uint64)]), np.array([len(h) for h in hashes], np.int64)) if bands else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets, pa.array(prints), pa.array(size, pa.int32()), *map(pa.array, own)], ["doc_id", "h", "fp", "size", *bands])

    prints = tables.keep(rows.mapInArrow(read, ", ".join(["doc_id long, h long, fp long, size int", *(f"{c} long" for c in bands)])), "prints")
    # rows of a set may differ in how often they have a shingle, so in the fingerprint: any one's does
    classes = tables.keep(prints.groupBy("h").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("size", *bands))), "classes")

    def fetch(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(classes.select("h", "first"), "h")
        wanted = df.sparkSession.sparkContext.broadcast(bit_filter(need.select(F.col("first").alias("key")), FILTER_BITS))

        def send(batches):
            for batch in text_slices(batches, "text"):
                at = np.asarray(batch.column("doc_id")).view(np.uint64) % np.uint64(FILTER_BITS)
                hit = np.flatnonzero(wanted.value[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1))
                part = batch.take(pa.array(hit))
                hashes = [shingle_hashes(t or "", words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([set_hash(h) for h in hashes], pa.int64()), pa.array([shingle_set(h) for h in hashes], pa.binary())], ["first", "h", "line"])

        found = rows.mapInArrow(send, "first long, h long, line binary").join(need, ["first", "h"])
        return tables.keep(found.groupBy("h").agg(F.first("line").alias("line")), "sets")

    parts = verified_parts(classes, df, tables, fetch, lambda x, y: jaccard(x, y) >= least, radius, least, large, (lambda size: np.full(len(size), wide)) if wide else None)
    of = classes.join(parts, classes["h"] == parts["node"], "left").select("h", "first", F.coalesce("component", "h").alias("part"))
    named = of.groupBy("part").agg(F.min("first").alias("component_id"))
    by_set = tables.keep(of.join(named, "part").select("h", "component_id"), "named")
    tables.drop_but("prints", "named")
    return prints.join(by_set, "h").select("doc_id", "component_id")


def one_of_each(df: DataFrame, words: int = WORDS, radius: int = RADIUS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", wide: int | None = None) -> DataFrame:
    """The input's rows, all columns, but those of documents linked to one with a smaller id. Rows that share an id
    are one document; rows with a null id stay."""
    found = near_texts(df, words, radius, least, id_col, text_col, wide=wide).where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(found, df[id_col].cast("long") == found["__gone"], "left_anti")
