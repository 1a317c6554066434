"""Registered queries against their SQL on the test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from suite.registry import QUERIES
from suite.views import BASE_TABLES

FOLDER = os.environ.get("INSTQC_DATA", "/root/testdata/sf0.001")
QUICK = ["src2", "src4", "prj5", "jn1", "jn3", "agg2", "agg7", "agg12", "win5", "win8", "cc3", "rul11", "evl14", "lbl2"]
NAMES = sorted(QUERIES) if os.environ.get("INSTQC_FULL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def text(value):
    return None if value is None else repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(records, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(text(r[i]) for i in order) for r in records), key=lambda r: tuple((v is None, v or "") for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), columns)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["case_id", "rule_id", "severity", "labels", "reason"]
