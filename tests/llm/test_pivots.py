import numpy as np
import pytest

from auralith.llm import pivot_join

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, m string"


def brute(rows, least):
    good = {}
    for k, (i, v) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float32).astype(np.float64)
        if i is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            good[k] = x / np.linalg.norm(x)
    links = {k: {j for j in good if j != k and len(good[j]) == len(x) and float(x @ good[j]) >= least - 1e-13} for k, x in good.items()}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        part = None if i is None else min(rows[j][0] for j in seen)
        out.append((str(i), len(links.get(k, ())), part, i is not None and part == i))
    return sorted(out, key=str)


def got(spark, rows, least=0.9, **options):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(((str(r[0]), r[1], r[2], r[3]) for r in pivot_join.near_vectors(df, least, **options).collect()), key=str)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.9, 0.4358899]), (11, [-1.0, 0.0]), (12, [-0.0, 3.0]), (13, [0.0, 3.0]), (14, [1e30, 0.0])]
    assert got(spark, rows) == brute(rows, 0.9)


@pytest.mark.parametrize("cell,block", [(4096, 8192), (7, 5), (20, 1000)])
def test_clusters_in_many_cells(spark, cell, block):
    rng = np.random.default_rng(cell)
    centres = rng.standard_normal((12, 8))
    rows = [(int(k), (centres[k % 12] + rng.standard_normal(8) * rng.choice([0.0, 0.1, 0.3])).astype(np.float32).tolist()) for k in rng.permutation(240)]
    assert got(spark, rows, cell=cell, block=block) == brute(rows, 0.9)
    assert got(spark, rows, 0.5, cell=cell, block=block) == brute(rows, 0.5)


def test_one_id_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    assert got(spark, rows) == brute(rows, 0.9)


def test_ids_in_step(spark):
    """Ids that are all multiples of a number of blocks are dealt to all of them, with the same links."""
    rng = np.random.default_rng(3)
    rows = [(64 * k, (rng.standard_normal(3) * 0.2 + 1).astype(np.float32).tolist()) for k in range(200)]
    assert got(spark, rows, 0.99, cell=100, block=16) == brute(rows, 0.99)


def test_empty(spark):
    assert got(spark, [(1, [1.0])])[0] == ("1", 0, 1, True)
    assert pivot_join.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
