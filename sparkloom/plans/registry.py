"""Every query of the library by name, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


from . import accuracy, clusters, context, decisions, folds, gates, graphs, joins, reports, resolution, scheduling, texts, edits, lookups, source, changes  # noqa: E402, F401
