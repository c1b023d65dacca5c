"""Every query by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame, with its SQL if there is any."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def load() -> None:
    """Imports the modules that register queries."""
    from tidemark.plans import crawl, diagnostics, evaluation, handoff, labels, linking, pages, panel, queues, retrieval, search, selection, signals, textfeatures  # noqa: F401
