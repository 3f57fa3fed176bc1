"""Queries by name, each with the SQL that must give the same rows (None where SQL can't express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Import every module of queries."""
    from .queries import aggregates, folds, graph, joins, merges, ordering, requests, scalars, scans, streams, windows  # noqa: F401
