"""The entry points, and the oracle of a few quick queries on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "clean_text" in q


@pytest.mark.parametrize("name", ["clean_text", "semantic_factuality", "adversarial_contradictions", "chunk_sliding", "dedup_documents", "metacog_features"])
def test_oracle(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    a = e.queries()[name](spark, DIR).toPandas()
    b = con.execute(e.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    norm = lambda x: sorted(tuple(round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r) for r in x[cols].values.tolist())
    assert norm(a) == norm(b)
