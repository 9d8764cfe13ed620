"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from quern import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_candidates_hold_all_matches(spark):
    for name, pattern in (("and", r"secret\W+token"), ("or", "password|secret"), ("scan_all", r"\d")):
        from quern.operators import search

        own = {r[0] for r in queries.QUERIES[f"candidates_{name}"](spark, DIR).collect()}
        assert {r[0] for r in search.files_with_matches(search.search(queries.corpus(spark, DIR), pattern)).collect()} <= own


def test_entry_has_all_queries():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql())
