"""Every registered query of the engine's own operators against its SQL, or its row count where it has none."""

import pytest

from auralith import plans
from tests.compare import differences

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), sf, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"kmeans_clusters", "tsne_2d"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
