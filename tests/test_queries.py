"""Each query of the engine gives the rows of its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from tidewell import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else repr(value)
    return value


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_query(spark, duck, name):
    found = engine.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    result = duck.execute(engine.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in order]) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(engine.QUERIES) == set(engine.ORACLE_SQL)
