"""SQL over DataFrames that are passed by name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def run(text: str, **tables: DataFrame) -> DataFrame:
    """``text`` with {name} for each table; nothing is executed."""
    return next(iter(tables.values())).sparkSession.sql(text, **tables)
