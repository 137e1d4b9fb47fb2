"""Catalogue of runnable queries and their SQL twins.

A query is declared once with its output schema (``name:type`` with i, d, s, b); the schema fixes
column names, types and decimals on both engines.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from canopyframe.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPARK_TYPE = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
DUCK_TYPE = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def _fields(schema: str) -> list[tuple[str, str, int]]:
    out = []
    for part in schema.split():
        name, t = part.split(":")
        out.append((name, t[0], int(t[1:] or 6)))
    return out


def shape(df: DataFrame, schema: str) -> DataFrame:
    cols = []
    for name, t, digits in _fields(schema):
        c = F.col(name).cast(SPARK_TYPE[t])
        if t == "d":
            c = F.round(c, digits) + F.lit(0.0)
        cols.append(c.alias(name))
    return df.select(*cols)


def shape_sql(body: str, schema: str) -> str:
    cols = []
    for name, t, digits in _fields(schema):
        c = f"CAST({name} AS {DUCK_TYPE[t]})"
        if t == "d":
            c = f"round({c}, {digits}) + CAST(0 AS DOUBLE)"
        cols.append(f"{c} AS {name}")
    return f"SELECT {', '.join(cols)} FROM ({body}) AS answer"


def query(name: str, schema: str, sql: str | None = None):
    def register(fn: Callable[[fixtures.Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(fixtures.Fixtures(spark, sf_dir)), schema)
        if sql is not None:
            ORACLES[name] = fixtures.with_views(shape_sql(sql, schema))
        return fn
    return register
