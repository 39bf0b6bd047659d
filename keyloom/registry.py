"""Driver-facing queries of the keyword operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import content, phrases, planned, reports, routing

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (phrases, content, planned, routing, reports)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
