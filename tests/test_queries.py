"""Every query against its SQL on the smallest tables, and column functions against plain Python."""

import pytest
from pyspark.sql import functions as F

from pixelweave.functions import scalars
from pixelweave.operators import deflate, inflate
from pixelweave.plans.registry import ORACLE_SQL, QUERIES, flagship
from tests.conftest import SF


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rounded(df.select(*columns).collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        assert got == rounded(duck.sql(ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_scalars(spark):
    df = spark.range(1, 259).select(F.col("id").alias("n"))
    rows = df.where("n >= 3").select("n", scalars.length_code("n" and F.col("n")).alias("c"), scalars.distance_code(F.col("n")).alias("d")).collect()
    assert all(r["c"] == 257 + deflate.LENGTH_CODE[r["n"]] and r["d"] == deflate.distance_code(r["n"]) for r in rows)
    one = spark.range(1).select(
        scalars.reversed_bits(F.lit(6), F.lit(4)).alias("r"),
        scalars.swapped(F.lit(b"\1\2\3\4"), 4).alias("s"),
        scalars.big_endian(F.lit(b"\0\0\1\2"), 1, 4).alias("b"),
        scalars.chunk("IEND", F.lit(b"")).alias("c"),
        scalars.trimmed_alpha(F.lit(b"\1\xff\2\xff\xff")).alias("t"),
        scalars.rgba_key(F.lit(1), F.lit(2), F.lit(3), F.lit(0)).alias("k"),
        scalars.zlib_header_ok(F.lit(0x78), F.lit(1)).alias("z"),
        scalars.match_score(F.lit(10), F.lit(100)).alias("m"),
        scalars.scanline_bytes(F.lit(3), F.lit(3), F.lit(2)).alias("w"),
        scalars.paeth(F.lit(10), F.lit(20), F.lit(10)).alias("p"),
    ).first()
    assert (one["r"], bytes(one["s"]), one["b"], bytes(one["t"]), one["k"], one["z"], one["w"], one["p"]) == (6, b"\4\3\2\1", 258, b"\1\xff\2", 0, True, 1, 20)
    assert bytes(one["c"]).hex() == "0000000049454e44ae426082"
    assert one["m"] == 2560 - 32 * inflate.DISTANCE_EXTRA[deflate.distance_code(100)]
