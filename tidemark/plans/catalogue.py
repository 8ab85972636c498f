"""The library's queries on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import checks, governance, market, records, runs, streams
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each symbol with their mean of five; the newest bars whose close crosses above it."""
    return market.newest_crossings(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries", "records", "runs", "governance", "streams", "checks"]
