"""Every registered mesh query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from meshspark import jobs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def test_each_query_has_sql():
    assert jobs.queries().keys() == jobs.oracle_sql().keys()


@pytest.mark.parametrize("name", jobs.queries())
def test_query(spark, con, name):
    ours = jobs.queries()[name](spark, SF).toPandas()
    theirs = con.execute(jobs.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
