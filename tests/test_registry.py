"""Every registered query with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from satchel import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    result = duck.execute(registry.ORACLE_SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
