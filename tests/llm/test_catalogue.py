"""Every query of the subpackage with an oracle gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest
from tessera.llm import catalogue

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = catalogue.QUERIES[name](spark, DATA)
    found = con.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [df.columns.index(c) for c in found.columns]
    assert sorted((tuple(r[k] for k in at) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
