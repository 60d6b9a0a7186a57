"""Every query with SQL gives the same rows in Spark and DuckDB, on whole tables."""

import datetime
import decimal

import duckdb
import pytest

from riskloom.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def ordered(rows):
    def key(row):
        return tuple((v is None, str(v) if isinstance(v, (datetime.date, str)) else 0 if v is None else v) for v in row)

    return sorted(rows, key=key)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, duck, name):
    found = QUERIES[name](spark, folder)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    names = sorted(columns)
    ours = ordered(tuple(plain(row[n]) for n in names) for row in found.collect())
    at = [columns.index(n) for n in names]
    theirs = ordered(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
