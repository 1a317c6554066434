"""Registered corpus queries against their SQL."""

import duckdb
import pytest

import instqc.llm.queries  # noqa: F401
from instqc.llm.registry import QUERIES, SQL
from tests.test_suite import rows

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cursor.fetchall(), columns)


def test_names():
    assert "pipeline" in QUERIES and all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14))
