"""The queries over the supplied tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelweave.plans import files, queries  # noqa: F401  files registers its queries on import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = queries.QUERIES
ORACLE_SQL: dict[str, str] = queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.minsum_filters(spark, sf_dir)
