"""Writing results: files replaced atomically, a table, and the report."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_file(path: str | os.PathLike) -> bytes:
    """Empty for a file that can't be read."""
    try:
        return Path(path).read_bytes()
    except OSError:
        return b""


def replace_file(path: str | os.PathLike, data: bytes) -> None:
    """Through a file beside the target and a rename; a copy where a rename isn't possible; nothing is left behind."""
    target = Path(path)
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.replace(name, target)
        except OSError:
            shutil.copyfile(name, target)
    finally:
        Path(name).unlink(missing_ok=True)


def names(results: DataFrame, key: str = "path", root: str | None = None) -> DataFrame:
    """Adds ``name``, where a row's file goes below the target folder: its path below ``root``, or its last part if there is no root."""
    plain = F.regexp_replace(F.col(key), r"^file:/*", "/")
    if root is None:
        return results.withColumn("name", F.element_at(F.split(plain, "/"), -1))
    base = Path(root).resolve().as_posix().rstrip("/") + "/"
    return results.withColumn("name", F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 2**31 - 1)).otherwise(F.regexp_replace(plain, "^/+", "")))


def write_files(results: DataFrame, folder: str, key: str = "path", root: str | None = None) -> None:
    """Each row's content to a file in a folder that all executors mount, named as ``names`` says; rows that failed are left out.

    Raises ValueError before anything is written if two rows would have one name, or a name would leave the folder.
    """
    good = names(results.where(F.col("status") != "failed"), key, root)
    wrong = good.groupBy("name").count().where((F.col("count") > 1) | F.col("name").isNull() | (F.col("name") == "") | F.array_contains(F.split("name", "/"), "..")).first()
    if wrong is not None:
        raise ValueError(f"{wrong['count']} rows for the file name {wrong['name']!r}")
    Path(folder).mkdir(parents=True, exist_ok=True)

    def put(rows) -> None:
        for r in rows:
            target = Path(folder, r["name"])
            target.parent.mkdir(parents=True, exist_ok=True)
            replace_file(target, bytes(r["content"]))

    good.select("name", "content").foreachPartition(put)


def write_table(results: DataFrame, path: str) -> None:
    """As Parquet, under its commit protocol."""
    results.write.mode("overwrite").parquet(path)
