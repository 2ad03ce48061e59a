"""Small registry that pairs a Spark query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def call(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    call.__name__ = name
    QUERIES[name] = call
    if sql is not None:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(fn):
        add(name, fn, sql)
        return fn
    return wrap
