"""Every query of the library by name, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Enter a query in the catalogue."""

    def enter(query):
        QUERIES[name] = query
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return query

    return enter


def load() -> None:
    """Import the modules that enter queries."""
    from quillon.plans import etl, evalstats, facts, reports, requests, scalars, scoring, textpairs, timeseries, vectors  # noqa: F401


load()
