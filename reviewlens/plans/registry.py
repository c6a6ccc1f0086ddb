"""The register of queries: name, Spark callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlens.plans.oracle import with_views

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str | tuple[str, ...] = ()) -> Callable[[Run], Run]:
    """Register a query under a name, with its SQL over the given views when SQL can express it."""
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return run
    return add


def load() -> None:
    """Import every module that registers queries."""
    from reviewlens.plans import (  # noqa: F401
        column_queries, comparison_queries, filter_queries, measure_queries, name_queries,
        profile_queries, ranking_queries, sales_queries, source_queries, stream_queries, text_queries,
    )
