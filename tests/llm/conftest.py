import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids from 0) or (id, text) pairs, with extra columns whose names operators use themselves."""

    def build(rows, lang="en"):
        pairs = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        data = [(i, t, lang, None if k % 3 else "src", None, "mine", -1, 7, "x") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(data, SCHEMA + ", component_id string, start long, k int, h string").repartition(3)

    return build


@pytest.fixture(scope="session")
def texts(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()


#: Rows that every operator must take: null, empty, blank, repeated, one word, a long text, a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here now"), (5, "same words here now"), (6, "long " * 30_000), (None, "same words here now"), (7, "é́ 漢字 \U0001f600 <|endoftext|> 'll")]
