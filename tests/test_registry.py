"""Every query with SQL agrees with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from breezeframe.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr(tuple(rounded(r[c]) for c in columns)) for r in df.collect())
    assert rows == sorted(repr(tuple(rounded(r[k]) for k in at)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
