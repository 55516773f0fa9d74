"""Composite plans and the catalogue of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name; each takes (spark, folder of the tables)."""
    from tempograph.plans import catalog, composites

    return catalog.queries() | composites.queries()


def oracle_sql() -> dict[str, str]:
    from tempograph.plans import catalog, composites

    return catalog.oracle_sql() | composites.oracle_sql()
