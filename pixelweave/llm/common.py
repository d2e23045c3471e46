"""Helpers that the operators of this subpackage share: staged tables, partition counts and plain column picking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.sources.staging import dropped, shuffles_freed, staged

__all__ = ["SUB_BATCH", "dropped", "map_arrow", "partitions", "read", "shuffles_freed", "staged", "text_or_empty"]

#: Rows that a Python function gets at once; texts may be long.
SUB_BATCH = 512


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = SUB_BATCH) -> DataFrame:
    """mapInArrow, with batches cut to a bounded number of rows so that what a task holds stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
