"""Block joins: every row of one side against every row of the other, in blocks of bounded size.

For operators whose definition is all pairs. Both sides are dealt into blocks; each pair of blocks is one
group, solved in numpy, which returns a few rows (the best k, counts, links), never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2048


def blocks_of(df: DataFrame, rows: int = ROWS) -> int:
    return max(1, -(-df.count() // rows))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def block_join(left: DataFrame, right: DataFrame, key: str, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, symmetric: bool = False, rows: int = ROWS) -> DataFrame:
    """solve(left block, right block) for all pairs of blocks; with symmetric, for those with left <= right only."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # attributes of its own, also in a self-join
    n_left, n_right = blocks_of(left, rows), blocks_of(right, rows)
    own, other = F.pmod(F.xxhash64(key), F.lit(n_left)), F.pmod(F.xxhash64(key), F.lit(n_right))
    rights = F.sequence(F.col("lb"), F.lit(n_right - 1).cast("long")) if symmetric else F.sequence(F.lit(0).cast("long"), F.lit(n_right - 1).cast("long"))
    lefts = F.sequence(F.lit(0).cast("long"), F.col("rb")) if symmetric else F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))
    a = left.withColumn("lb", own).withColumn("rb", F.explode(rights))
    b = right.withColumn("rb", other).withColumn("lb", F.explode(lefts))

    def run(pair, x, y):
        if x.empty or y.empty:
            return pd.DataFrame()
        return solve(x, y)

    return a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb")).applyInPandas(run, schema)


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray, used: list | None = None) -> np.ndarray:
    """Union of the sets of a[i] and b[i]; parent[x] is the smallest member of x's set, before and after.
    With used, the pairs that joined two sets are appended there."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        high, first = np.unique(np.maximum(ra, rb), return_index=True)
        if used is not None:
            used.append((a[first], b[first]))
        parent[high] = np.minimum(ra, rb)[first]
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent
