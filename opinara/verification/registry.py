"""Queries over the benchmark tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; names start with the operator's number in the survey."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


MODULES = ("reading_queries", "daily_queries", "study_queries", "table_queries", "text_queries",
           "scoring_queries", "source_queries", "stream_queries", "headline_queries")


def load_all() -> None:
    from importlib import import_module, util

    for name in MODULES:
        if util.find_spec(f"opinara.verification.{name}"):
            import_module(f"opinara.verification.{name}")
