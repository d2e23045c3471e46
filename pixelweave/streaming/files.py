"""A streaming front end: new files under a path are decoded or optimised as they arrive (an extension; images have no event time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelweave.plans import optimise
from pixelweave.sources import png

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.png", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    return png.images(arriving(spark, path))


def optimised(spark: SparkSession, path: str, out: str, checkpoint: str, level: int = 9) -> StreamingQuery:
    """Optimises each micro-batch of new files into a table; runs until what is there is done."""

    def one(batch: DataFrame, number: int) -> None:
        optimise.optimise(batch, level).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, path).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
