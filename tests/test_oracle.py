"""Every registered query against its comparing SQL, on the smallest data set."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(row[c]) for c in columns) for row in df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == ordered(tuple(plain(row[i]) for i in at) for row in cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
