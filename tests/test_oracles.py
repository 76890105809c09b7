"""Every domain query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from parcelrisk.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, v) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert ordered(tuple(r[c] for c in columns) for r in df.collect()) == ordered(tuple(r[i] for i in place) for r in want.fetchall())
