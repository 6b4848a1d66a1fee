"""Queries that SQL can express, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillstone.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
