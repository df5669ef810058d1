"""Exact and perceptual duplicates, and plans for which to keep."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auralith.functions.exprs import hamming
from auralith.operators.blocks import block_join, join_sets
from auralith.operators.components import components, keep, scratch

DEFAULT_DISTANCE = 8
#: Hashes to a block where a pair of blocks returns links: few blocks, few links.
LINK_ROWS = 4096
STRATEGIES = ("first-path", "oldest", "newest")


def size_candidates(files: DataFrame) -> DataFrame:
    """Files whose size some other file shares; the sizes are counted without the contents."""
    sizes = files.groupBy("size_bytes").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return files.join(sizes, "size_bytes", "left_semi")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """files (path, size_bytes, content, ...): those with an equal of the same size and SHA-256, with sha256 and n."""
    hashed = size_candidates(files).withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256)).drop("content")
    groups = hashed.groupBy("size_bytes", "sha256").agg(F.count("*").alias("n")).where("n > 1")
    return hashed.join(groups, ["size_bytes", "sha256"])


def _order(strategy: str) -> list[Column]:
    """An unknown strategy keeps the first path."""
    return {"oldest": [F.asc("modified_at"), F.asc("path")], "newest": [F.desc("modified_at"), F.asc("path")]}.get(strategy, [F.asc("path")])


def plan_cull(grouped: DataFrame, group: list[str], strategy: str = "first-path") -> DataFrame:
    """Adds keep_path, the group's member to keep, and remove. The keeper is found by an aggregate, so that a large
    group never has to be ordered in one task."""
    when = F.col("modified_at").cast("timestamp").cast("double") if "modified_at" in grouped.columns else F.lit(0.0)
    key = {"oldest": F.struct(when.alias("a"), F.col("path").alias("p")), "newest": F.struct((-when).alias("a"), F.col("path").alias("p"))}.get(strategy, F.struct(F.lit(0.0).alias("a"), F.col("path").alias("p")))
    keepers = grouped.groupBy(*group).agg(F.min(key)["p"].alias("keep_path"))
    return grouped.join(keepers.hint("merge"), group).withColumn("remove", F.col("path") != F.col("keep_path"))


#: Share of all pairs that bands may propose of evenly spread hashes; beyond it every pair of blocks is compared.
BAND_SHARE = 1 / 16


def _masks(distance: int) -> list[int]:
    """Two of distance + 2 bands of the 64 bits: hashes at most `distance` bits apart agree on one of these at least."""
    n = distance + 2
    cuts = [min(64, 64 * k // n) for k in range(n + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(bands, 2)]


def _in_bands(distance: int) -> bool:
    return sum(2.0 ** -m.bit_count() for m in _masks(distance)) <= BAND_SHARE


def _banded(one: DataFrame, distance: int) -> DataFrame:
    """(p, q) with p < q of distinct hashes (bits), by an equi-join on bands. The join is named: Spark takes the rows
    of an explode to be as small as what they come from and would send them through the driver."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(k).alias("c"), F.col("bits").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for k, m in enumerate(_masks(distance))])
    rows = one.select("bits", F.explode(keys).alias("k")).select("bits", "k.c", "k.key")
    near = rows.alias("x").join(rows.alias("y").hint("merge"), (F.col("x.c") == F.col("y.c")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.bits") < F.col("y.bits")))
    return near.select(F.col("x.bits").alias("p"), F.col("y.bits").alias("q")).where(hamming(F.col("p"), F.col("q")) <= distance).distinct()


def _blocks(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The hashes of two blocks in order, and whether they are one block."""
    x, y = (np.sort(k["bits"].to_numpy()) for k in (x, y))
    return x, y, np.array_equal(x, y)


def _hits(x: np.ndarray, y: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of hashes at most `distance` bits apart, in portions."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    for start in range(0, len(x), 128):
        a, b = np.nonzero(np.bitwise_count(x[start : start + 128, None] ^ y[None, :]) <= distance)
        yield a + start, b


def _blocked(one: DataFrame, distance: int) -> DataFrame:
    """(p, q) with p < q of distinct hashes (bits), by comparing all blocks."""

    def solve(x, y):
        x, y, same = _blocks(x, y)
        a, b = np.concatenate([np.stack(k) for k in _hits(x, y, distance)], axis=1)
        once = a < b if same else slice(None)
        p, q = x[a[once]], y[b[once]]
        return pd.DataFrame({"p": np.minimum(p, q), "q": np.maximum(p, q)})

    return block_join(one, one, "bits", solve, "p long, q long", symmetric=True)


def _hash_links(one: DataFrame, distance: int) -> DataFrame:
    """(src, dst) of distinct hashes (bits): links enough that components are those of all links."""
    if _in_bands(distance):
        return _banded(one, distance).toDF("src", "dst")

    def solve(x, y):
        x, y, same = _blocks(x, y)
        both = x if same else np.concatenate((x, y))
        parent = np.arange(len(both))
        for a, b in _hits(x, y, distance):
            parent = join_sets(parent, a, b if same else b + len(x))
        some = np.flatnonzero(parent != np.arange(len(both)))
        return pd.DataFrame({"src": both[some], "dst": both[parent[some]]})

    return block_join(one, one, "bits", solve, "src long, dst long", symmetric=True, rows=LINK_ROWS)


def hamming_pairs(hashes: DataFrame, distance: int, id_col: str = "path") -> DataFrame:
    """(a, b, distance) with a < b of hashes (id, bits) at most `distance` bits apart.

    By the pigeonhole two such hashes agree on two of distance + 2 bands, which is an equi-join; where the bands are so
    narrow that this saves little, blocks of hashes are compared. Equal hashes are one class until the pairs are made.
    """
    hashes = keep(hashes.select(id_col, "bits").where("bits is not null"), scratch(hashes.sparkSession, "hashes"))
    one = keep(hashes.select("bits").distinct(), scratch(hashes.sparkSession, "classes"))
    near = _banded(one, distance) if _in_bands(distance) else _blocked(one, distance)
    near = near.unionByName(one.select(F.col("bits").alias("p"), F.col("bits").alias("q")))
    left = near.join(hashes.select(F.col("bits").alias("p"), F.col(id_col).alias("i")).hint("merge"), "p")
    both = left.join(hashes.select(F.col("bits").alias("q"), F.col(id_col).alias("j")).hint("merge"), "q")
    return both.where((F.col("i") < F.col("j")) | (F.col("p") != F.col("q")) & (F.col("i") > F.col("j"))).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), hamming(F.col("p"), F.col("q")).alias("distance"))


def perceptual_groups(hashes: DataFrame, distance: int = DEFAULT_DISTANCE) -> DataFrame:
    """(path, bits, ref_path, ref_bits, distance, similarity, n): members of groups of two and more under the transitive
    closure of "at most `distance` bits apart" (0 or less: the default), each with the group's smallest path and its
    distance to that one. Closure works on distinct hashes; equal ones join by their hash. No join goes through the driver."""
    distance = distance if distance > 0 else DEFAULT_DISTANCE
    one = keep(hashes.select("bits").where("bits is not null").distinct(), scratch(hashes.sparkSession, "classes"))
    parts = components(_hash_links(one, distance))
    member = hashes.join(parts.hint("merge"), hashes["bits"] == parts["node"], "left").select(*[hashes[c] for c in hashes.columns], F.coalesce("component", "bits").alias("part"))
    member = keep(member, scratch(hashes.sparkSession, "perceptual"))
    groups = member.groupBy("part").agg(F.min(F.struct("path", "bits")).alias("ref"), F.count("*").alias("n")).where("n > 1")
    apart = hamming(F.col("bits"), F.col("ref.bits"))
    return member.join(groups.hint("merge"), "part").select(*hashes.columns, F.col("ref.path").alias("ref_path"), F.col("ref.bits").alias("ref_bits"), apart.alias("distance"), (1 - apart / 64.0).alias("similarity"), "n")
