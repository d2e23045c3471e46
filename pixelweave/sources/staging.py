"""Staged tables: costly intermediates are written once in the folder that driver and executors share.

All tables of an application lie in one folder, which is deleted when the driver ends; ``dropped`` deletes a table
that no later step reads, ``cleared`` all of them at once (for sessions that go on).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark remove the shuffle files of an execution as soon as it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}  # by application
_USED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir. Only a local master (one machine) may do without that setting; the session's own settings stay as they are."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _LOCAL.get(context.applicationId)
        if folder is None:
            folder = _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='pixelweave-')}"
    own = f"{folder.rstrip('/')}/pixelweave-{context.applicationId}"
    if own not in _USED:
        _USED.add(own)
        atexit.register(_at_exit, spark, own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session is stopped
        with contextlib.suppress(Exception):  # a driver that ends must end
            _delete(spark, path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executions within remove their shuffle files when they end; the session's own setting is put back."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later steps start from files that outlive any executor. by: a folder for each of its values."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def dropped(df: DataFrame, part: str = "") -> None:
    """Delete a staged table, or one folder of it, that no later step reads."""
    _delete(df.sparkSession, f"{df.staged_at}/{part}".rstrip("/"))


def cleared(spark: SparkSession) -> None:
    """Delete all staged tables of the application; results that read them must have been consumed."""
    _delete(spark, shared_folder(spark))
