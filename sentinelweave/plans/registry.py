"""Registered queries: a Spark callable per operator and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentinelweave.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL a checker runs on the same tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, ctes)
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from sentinelweave.plans import (  # noqa: F401
        queries_assembly, queries_evaluation, queries_events, queries_expressions, queries_gates, queries_ingest,
        queries_load, queries_matching, queries_review,
    )
