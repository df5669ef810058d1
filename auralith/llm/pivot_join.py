"""Embedding near-duplicates by an exact metric range join.

A cosine of at least c between directions is a distance of at most r = sqrt(2 - 2c) between unit vectors.
Pivots partition the vectors into cells by nearest pivot. A vector visits another cell only if the triangle
inequality lets it be within r of a member: its distance to that cell's pivot lies within r of the members'
range of distances, and its distance to the bisecting plane is at most r. Each pair of cells is met in one
direction; a cell is dealt out in blocks of bounded size, each of which joins with its visitors as a stream.
Equal vectors are one class from the start, with a number of its own. A block sends sums of links and a spanning
forest, never pairs. Pivots grow with the square root of the vectors, which bounds what is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, connected_components, mix64
from .simhash import join_sets

#: Vectors that a cell should have, that a block has on average at most, and that pivots are chosen from (or the square
#: root of all vectors, if that is more).
CELL, BLOCK, SAMPLE = 4096, 8192, 4096
#: Vectors looked at together when they are dealt out, against all pivots.
SLICE = 256
SLACK = 1e-9


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first among the sample's unit vectors, beginning with the first."""
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(n, len(sample)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-12:
            break
        picked.append(k)
        near = np.maximum(near, sample @ sample[k])
    return sample[picked]


def vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, ok, vec binary, dim, k1, k2) per row, and the binary's type; not ok: null id, null, zero, empty or with a
    component that is null or not finite."""
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"

    def run(batches):
        for batch in batches:
            rows = batch.column("v")
            ok, data, dim = [], [], []
            for k, doc in enumerate(batch.column("vec_id").to_pylist()):
                v = rows[k].values if rows[k].is_valid else None
                x = None if v is None or v.null_count or not len(v) else v.to_numpy(zero_copy_only=False).astype(kind)
                good = doc is not None and x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                ok.append(good)
                data.append((x + x.dtype.type(0)).tobytes() if good else None)  # one zero only
                dim.append(len(x) if good else 0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ok), pa.array(data, pa.binary()), pa.array(dim, pa.int32())], ["vec_id", "ok", "vec", "dim"])

    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    read = rows.mapInArrow(run, "vec_id long, ok boolean, vec binary, dim int")
    return read.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit("second"), F.reverse(F.hex("vec")))), kind


def near_vectors(df: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row; vectors link at a cosine of at least `least`.

    Null and zero vectors, those with null or non-finite components and rows with a null id link with nothing;
    vectors of different lengths never link. n_links counts the other rows linked directly, repeated ones each;
    component_id is the smallest vec_id reachable, the own one included (null for a null id, which is not kept).
    An empty table gives no rows; other columns are not read. Exact: every pair is compared or ruled out.
    """
    spark = df.sparkSession
    tables = Tables(spark, "pivots")
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    read, kind = vectors(df, id_col, vector_col)
    rows = tables.keep(read, "rows")
    grouped = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("name"), F.count("*").alias("m"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    classes = tables.keep(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbered once, as written
    pivots = {}
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row a vector length
        own = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("k1"), "k1", "k2").limit(max(SAMPLE, math.isqrt(r["n"]))).select("vec").collect()
        pivots[r["dim"]] = choose_pivots(_unit([x["vec"] for x in own], kind), -(-r["n"] // cell))
    shared = spark.sparkContext.broadcast(pivots)  # of a length at most n / cell vectors, SAMPLE or the square root of n

    def home(batches):
        for batch in batches:
            dims, cells, far = np.asarray(batch.column("dim")), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            data = batch.column("vec").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                near = _unit([data[k] for k in at], kind) @ shared.value[int(d)].T
                cells[at] = near.argmax(1)
                far[at] = np.sqrt(np.maximum(0, 2 - 2 * near.max(1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "m", "vec", "dim")), pa.array(cells), pa.array(far)], ["id", "m", "vec", "dim", "cell", "far"])

    housed = tables.keep(classes.select("id", "m", "vec", "dim").mapInArrow(home, "id long, m long, vec binary, dim int, cell int, far double"), "housed")
    ranges = {(r["dim"], r["cell"]): (r["lo"], r["hi"], -(-r["n"] // block)) for r in housed.groupBy("dim", "cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect()}  # a row a cell
    bounds = spark.sparkContext.broadcast(ranges)

    def deal(batches):
        """Rows for the blocks: every vector to its own block and, as a visitor, to the later ones it may have links in."""
        spans = {}
        for d, own in shared.value.items():  # an empty cell is in no one's reach
            ends = [bounds.value.get((d, k), (np.inf, -np.inf, 0)) for k in range(len(own))]
            spans[d] = tuple(np.array(x) for x in zip(*ends, strict=True))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                data, dims, cells = part.column("vec").to_pylist(), np.asarray(part.column("dim")), np.asarray(part.column("cell"))
                turn_of = mix64(np.asarray(part.column("id")).view(np.uint64))
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    own, (lo, hi, blocks) = shared.value[d], spans[d]
                    near = _unit([data[k] for k in at], kind) @ own.T
                    p, q = cells[at], np.arange(len(own))
                    homes, which = np.unique(p, return_inverse=True)
                    gaps = np.sqrt(np.maximum(0, 2 - 2 * own[homes] @ own.T))[which]
                    far = np.sqrt(np.maximum(0, 2 - 2 * near))
                    plane = near[np.arange(len(at)), p][:, None] - near <= (radius + SLACK) * gaps + SLACK
                    come = (p[:, None] < q) & plane & (far >= lo - radius - 1e-7) & (far <= hi + radius + 1e-7)
                    a, c = np.nonzero(come)
                    # visitors go to every block of another cell and to the later ones of their own, members to one
                    turn = (turn_of[at] % blocks[p].astype(np.uint64)).astype(np.int64)
                    a, c, from_block = np.concatenate((a, np.arange(len(at)))), np.concatenate((c, p)), np.concatenate((np.zeros(len(a), np.int64), turn))
                    times = blocks[c] - from_block
                    row = np.repeat(np.arange(len(a)), times)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + from_block[row]
                    visitor = ~((row >= len(a) - len(at)) & (block == from_block[row]))
                    t = part.take(pa.array(at[a[row]]))
                    yield pa.RecordBatch.from_arrays([t.column("dim"), pa.array(c[row].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(visitor.astype(np.int32)), t.column("id"), t.column("m"), t.column("vec")], ["dim", "cell", "block", "visitor", "id", "m", "vec"])

    dealt = housed.mapInArrow(deal, "dim int, cell int, block int, visitor int, id long, m long, vec binary")
    streams = dealt.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "visitor")

    def join(batches):
        now, own, parent, links = None, [], None, None  # the block at hand; its members until they are complete

        def settle():
            nonlocal own, parent, links
            own = (np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own]))
            parent, links = np.arange(len(own[0])), np.zeros(len(own[0]), np.int64)
            for k in range(0, len(own[0]), 256):
                yield from meet(own[0][k : k + 256], own[1][k : k + 256], own[2][k : k + 256], k)

        def meet(ids, m, x, at=None):
            """Visitors, or from `at` on the block's own members, against all members."""
            nonlocal parent
            n = len(own[0])
            cos = x @ own[2].T
            a, b = np.nonzero(cos >= least - 1e-12)
            if at is not None:
                ahead = at + a < b
                a, b = a[ahead], b[ahead]
            close = np.flatnonzero(np.abs(cos[a, b] - least) < 1e-12)
            if len(close):
                exact = np.array([float(np.dot(x[i], own[2][j]) / (np.linalg.norm(x[i]) * np.linalg.norm(own[2][j]))) for i, j in zip(a[close], b[close], strict=True)])
                keep = np.ones(len(a), bool)
                keep[close] = exact >= least
                a, b = a[keep], b[keep]
            if not len(a):
                return
            np.add.at(links, b, m[a])
            used = []
            if at is None:
                counts = np.bincount(a, own[1][b], len(ids)).astype(np.int64)
                parent = join_sets(np.concatenate((parent, np.arange(n, n + len(ids)))), n + a, b, used)[:n]
                some = np.flatnonzero(counts)
                yield rows_of(ids[some], counts[some], None, None)
            else:
                np.add.at(links, at + a, own[1][b])
                parent = join_sets(parent, at + a, b, used)
            if used:
                every = np.concatenate((own[0], ids))
                yield rows_of(None, None, every[np.concatenate([u[0] for u in used])], every[np.concatenate([u[1] for u in used])])

        def close():
            if now is not None:
                if isinstance(own, list):
                    yield from settle()
                some = np.flatnonzero(links)
                yield rows_of(own[0][some], links[some], None, None)

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("dim", "cell", "block", "visitor")], 1)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                key, visitor = tuple(keys[s, :3].tolist()), keys[s, 3]
                if key != now:
                    yield from close()
                    now, own = key, []
                for k in range(s, e, 1024):
                    part = batch.slice(k, min(1024, e - k))
                    ids, m, x = np.asarray(part.column("id")), np.asarray(part.column("m")), _unit(part.column("vec").to_pylist(), kind)
                    if not visitor:
                        own.append((ids, m, x))
                        continue
                    if isinstance(own, list):
                        if not own:  # a block without members of its own
                            own = [(ids[:0], m[:0], x[:0])]
                        yield from settle()
                    yield from meet(ids, m, x)
        yield from close()

    def rows_of(ids, links, a, b):
        n = len(ids) if ids is not None else len(a)
        none = pa.nulls(n, pa.int64())
        pick = [none if v is None else pa.array(v, pa.int64()) for v in (ids, links, a, b)]
        return pa.RecordBatch.from_arrays(pick, ["id", "links", "src", "dst"])

    joined = tables.keep(streams.mapInArrow(join, "id long, links long, src long, dst long"), "links")
    linked = joined.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(joined.where("src is not null").select("src", "dst"), tables)
    of = classes.select("k1", "k2", "id", "name", "m").join(linked, "id", "left").join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id"))
    names = of.groupBy("part").agg(F.min("name").alias("component"))
    named = tables.keep(of.drop("component").join(names, "part").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "component"), "named")
    tables.drop_but("rows", "named")
    own = rows.where("ok").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
