"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valsieve.catalog.oracle import with_tables
from valsieve.catalog.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``name`` with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql, tables)
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from valsieve.catalog import (  # noqa: F401
        journal_queries, metric_queries, output_queries, quality_queries, screen_queries, source_queries, universe_queries,
        verification_queries,

    )
