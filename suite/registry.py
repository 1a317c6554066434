"""Registration of a query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instqc.session import ship
from suite.oracle import oracle
from suite.views import Inputs


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    doubles: str


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: str = ""):
    def add(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql, doubles)
        return build

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: doubles at six decimals, arrays as comma-joined text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return tidy(QUERIES[name].build(Inputs(spark, folder)))


def sql_of(name: str) -> str | None:
    q = QUERIES[name]
    return None if q.sql is None else oracle(q.sql, q.doubles)
