"""Queries over tiles of one to three scanlines, as the last range of ids leaves them, against their SQL."""

import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pixelweave import model
from pixelweave.operators import compress, deflate, writer
from pixelweave.plans.registry import ORACLE_SQL, QUERIES
from pixelweave.plans.tiles import TALL
from tests.test_queries import rounded


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Ten tiles each of one, two and three scanlines."""
    folder = tmp_path_factory.mktemp("small")
    ids = [TALL * tile + y for tile in range(30) for y in range(1 + tile // 10)]
    values = np.random.default_rng(1).normal(0, 0.125, (len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(values), pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    wanted = rounded(con.sql(ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert rounded(df.select(*columns).collect()) == wanted
    return wanted


def test_gradient_of_one_scanline_is_null(spark, small):
    assert sum(r[0] is None for r in same_as_sql(spark, small, "tile_gradient")) == 10


@pytest.mark.parametrize("name", ["search_by_file", "search_report"])
def test_short_tiles_get_smaller(spark, small, name):
    same_as_sql(spark, small, name)


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Sixty tiles of two scanlines with more values of 144 and above."""
    folder = tmp_path_factory.mktemp("wide")
    ids = [TALL * tile + y for tile in range(60) for y in range(2)]
    values = np.random.default_rng(2).normal(0, 0.15, (len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(values), pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), folder / "embeddings.parquet")
    return str(folder)


def test_report_of_short_tiles_of_wide_values(spark, wide):
    """One uniform filter has too many bytes of nine bits for both scanlines, one for each has not."""
    assert same_as_sql(spark, wide, "search_report") == [(60 * (68 + 130), 60, "wrote")]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_search_of_short_noise(height):
    """Values about the middle have under 144 under the average filter or none, so eight bits each: less than stored."""
    rng = np.random.default_rng(height)
    for _ in range(60):
        x = np.clip(rng.normal(127, 16, (height, 64)), 0, 255).astype(np.uint8)
        image = model.Image(64, height, 8, model.GRAY, x.tobytes())
        stored = writer.write(image, writer.WriteOptions(np.zeros(height, np.int64), deflate.Options(deflate.STORE)))
        made = compress.compress(image, compress.CompressOptions(3)).data
        assert len(made) < len(stored)
        assert compress.verify(made, image) is None


def test_library_stores_where_the_fixed_code_is_less():
    data = bytes(range(45)) + bytes(range(200, 220))  # 20 bytes of nine bits, no matches
    made = writer.best_zlib(data, deflate.Options(deflate.BEST, 1))
    assert len(made) < len(deflate.zlib_compress(data, deflate.Options(deflate.STORE))) <= len(zlib.compress(data, 9))
    assert zlib.decompress(made) == data
