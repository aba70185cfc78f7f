"""Names of the queries, each with its Spark form and, where SQL can say it, its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of :class:`Tables` under its name, with its SQL counterpart."""

    def add(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[key] = sql
        return build

    return add
