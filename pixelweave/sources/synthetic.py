"""Generated pictures: gradients, blocks, noise, solid, checker, horizontal and text-like patterns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.model import RGBA, Image
from pixelweave.operators import writer

PATTERNS = ("gradient", "blocks", "noise", "solid", "checker", "horizontal", "text")


def pattern(kind: str, width: int, height: int) -> Image:
    """An opaque 8-bit RGBA picture."""
    y, x = np.mgrid[0:height, 0:width]
    mixed = (x * 2654435761 ^ y * 40503 * 65537) * 2246822519 & 0xFFFFFFFF
    planes = {
        "gradient": (x * 255 // max(1, width - 1), y * 255 // max(1, height - 1), (x + y) * 255 // max(1, width + height - 2)),
        "blocks": ((x // 8 * 37) & 255, (y // 8 * 61) & 255, ((x // 8 + y // 8) * 17) & 255),
        "noise": ((mixed >> 5) & 255, (mixed >> 13) & 255, (mixed >> 21) & 255),
        "solid": (x * 0 + 64, x * 0 + 128, x * 0 + 192),
        "checker": ((x // 8 + y // 8) % 2 * 255,) * 3,
        "horizontal": ((x * 8) & 255, x * 0 + 100, x * 0 + 50),
        "text": (np.where((x % 6 < 4) & (y % 10 < 7) & ((mixed >> 7) % 3 > 0), 0, 255),) * 3,
    }[kind]
    s = np.stack([*planes, np.full_like(x, 255)], 2)
    return Image(width, height, 8, RGBA, s.astype(np.uint8).tobytes())


def files(spark: SparkSession, kinds: Sequence[str] = PATTERNS, sizes: Iterable[tuple[int, int]] = ((64, 64),)) -> DataFrame:
    """(kind, width, height, path, content): an unfiltered file of each pattern and size, generated where it is needed."""

    def made(kind: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), width.to_pylist(), height.to_pylist(), strict=True)
        return pa.array([writer.write(pattern(k, w, h), writer.WriteOptions(np.zeros(h, np.int64))) for k, w, h in rows], pa.binary())

    wanted = spark.createDataFrame([(k, w, h) for k in kinds for w, h in sizes], "kind string, width bigint, height bigint")
    path = F.concat(F.lit("synthetic/"), "kind", F.lit("_"), "width", F.lit("x"), "height", F.lit(".png"))
    return wanted.withColumn("path", path).withColumn("content", F.arrow_udf(made, "binary")("kind", "width", "height"))
