"""Every query against its statement in DuckDB, on the smallest tables."""

import duckdb
import pytest

from meterlake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    if name not in catalogue.ORACLE:
        assert rows
        return
    oracle = duck.sql(catalogue.ORACLE[name])
    assert sorted(oracle.columns) == columns
    at = [oracle.columns.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in at) for r in oracle.fetchall()), key=repr)
