"""Queries that SQL can express give what DuckDB gives."""

import os

import duckdb
import pytest

from satchel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    names, result = sorted(df.columns), con.execute(ORACLE_SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
