"""Recolouring keeps the picture, filter choices are what brute force gives, and every search result decodes to its input."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave import __main__ as cli
from pixelweave import model
from pixelweave.model import Image
from pixelweave.operators import compress, deflate, filters, recolour, writer
from pixelweave.plans import optimise
from pixelweave.sources import png, sink, synthetic
from pixelweave.streaming import files as streaming
from tests.test_png import random_image, rgba_hash


def graphic():
    y, x = np.mgrid[0:24, 0:32]
    s = np.stack([x // 8 * 64, y // 8 * 85, np.where((x + y) % 3 == 0, 255, 0), np.full_like(x, 255)], 2)
    return Image(32, 24, 8, model.RGBA, s.astype(np.uint8).tobytes())


def test_reductions_keep_the_picture():
    rng = np.random.default_rng(5)
    steps = [recolour.zero_transparent, recolour.strip_opaque, recolour.colour_key, recolour.optimise_alpha, recolour.reduce_colours, recolour.sort_palette]
    for color, depths in model.DEPTHS.items():
        for depth in depths:
            for few in (False, True):
                image = random_image(rng, 12, 9, color, depth)
                if few:
                    top = (1 << depth) - 1
                    s = image.samples() % 2 * top
                    image = image.changed(pixels=model.pack(s, depth))
                for step in steps:
                    changed = step(image)
                    assert recolour.equivalent(changed, image) is None, (color, depth, step)
                    assert recolour.equivalent(png.read(writer.write(changed)), image) is None
                for a, r, s in itertools.product((False, True), repeat=3):
                    assert recolour.equivalent(compress.variant(image, a, r, s), image) is None


def test_gray_becomes_one_bit():
    y, x = np.mgrid[0:32, 0:32]
    v = np.where((7 * x + 13 * y + (x ^ y)) % 5 > 2, 255, 0)
    image = recolour.reduce_colours(Image(32, 32, 8, model.GRAY, v.astype(np.uint8).tobytes()))
    assert (image.color_type, image.bit_depth) == (model.GRAY, 1)


def test_palette_compaction():
    palette = bytearray(30)
    palette[6:9] = palette[21:24] = b"\1\2\3"
    palette[15:18] = b"\4\5\6"
    pixels = bytes([(2, 5, 7)[i % 3] for i in range(256)])
    image = Image(16, 16, 8, model.INDEXED, pixels, palette=bytes(palette))
    small = recolour.reduce_colours(image)
    assert small.bit_depth == 1 and len(small.palette) == 6 and recolour.equivalent(small, image) is None


def test_colour_key_is_the_least_free():
    s = np.zeros((1, 4, 4), np.int64)
    s[0, :, 3] = [255, 255, 0, 255]
    s[0, 1, 2] = 1
    s[0, 3, 2] = 2
    keyed = recolour.colour_key(Image(4, 1, 8, model.RGBA, model.pack(s, 8)))
    assert keyed.single["tRNS"] == b"\0\0\0\0\0\3" and keyed.color_type == model.RGB


def test_sixteen_bits_with_equal_bytes():
    s = np.arange(12).reshape(3, 4, 1) * 257
    image = Image(4, 3, 16, model.GRAY, model.pack(s, 16), single={"tRNS": b"\1\1"})
    assert recolour.sixteen_to_eight(image).single["tRNS"] == b"\0\1"
    assert recolour.sixteen_to_eight(image.changed(single={"tRNS": b"\1\2"})).bit_depth == 16


def test_cheapest_path_is_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(1, 5)
        cost = np.array([[rng.randint(0, 40) for _ in range(n)] for _ in range(5)])
        total = lambda p: (sum(cost[k, y] for y, k in enumerate(p)) + 16 * sum(a != b for a, b in itertools.pairwise(p)))  # noqa: B023, E731
        best = min(total(p) for p in itertools.product(range(5), repeat=n))
        assert total(filters.cheapest_path(cost, 16).tolist()) == best


@pytest.mark.parametrize("level", [0, 1, 2, 3, 4, 5, 6, 7])
def test_levels(level):
    image = graphic()
    choice = filters.choose(image.rows, image.stride, level)
    assert len(choice) == image.height and choice.max() <= 4
    data = zlib.compress(filters.apply(image.rows, image.stride, choice))
    assert (filters.undo(zlib.decompress(data), 0, image.height, image.row, image.stride) == image.rows).all()


def test_strategy_table():
    assert [len(compress.strategies(k)) for k in (0, 1, 3, 4, 6, 7, 9)] == [1, 3, 3, 6, 6, 35, 35]
    assert {s.passes for s in compress.strategies(9)} == {5} and {s.filter_level for s in compress.strategies(8)} == {0, 1, 2, 3, 4, 5, 7}
    table = compress.strategies(9)
    assert all(s.filter_level not in (4, 7) for s in compress.pruned(table, compress.LARGE, False, 1.0))
    assert all(s.filter_level < 3 for s in compress.pruned(table, 10, False, 7.9))
    assert not any(s.reduce or s.sort for s in compress.pruned(table, 10, True, 1.0))


@pytest.mark.parametrize("options", [compress.CompressOptions(0), compress.CompressOptions(3), compress.CompressOptions(5), compress.CompressOptions(5, multi=False), compress.CompressOptions(9, multi=False), compress.CompressOptions(9, strip=True)])
def test_compress(options):
    image = graphic()
    result = compress.compress(image, options)
    assert compress.verify(result.data, image) is None and result.strategy != "safe"
    if options.multi and options.level >= 5:  # one strategy alone recolours without looking at the size
        assert len(result.data) <= len(writer.write(image))


def test_animation_is_kept():
    image = rgba_hash(8, 8)
    image.animated = True
    image.frames = [model.Frame(8, 8, from_idat=True), model.Frame(4, 3, 2, 1, 1, 10, pixels=rgba_hash(4, 3).pixels)]
    assert compress.verify(compress.compress(image, compress.CompressOptions(5)).data, image) is None


def test_plan_over_files(spark):
    rows = [(k, writer.write(synthetic.pattern(k, 24, 16), writer.WriteOptions(np.zeros(16, np.int64)))) for k in synthetic.PATTERNS]
    rows += [("bad", b"no image"), ("none", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in optimise.optimise(files, level=4).collect()}
    assert len(got) == len(rows) and {got["bad"]["status"], got["none"]["status"]} == {"failed"}
    for k, content in rows[:-2]:
        assert recolour.equivalent(png.read(bytes(got[k]["content"])), png.read(content)) is None
        assert len(got[k]["content"]) <= len(content)
    assert optimise.totals(optimise.optimise(files.limit(0), level=1)).count() == 0


def test_equal_keys_keep_their_own_pictures(spark):
    image = lambda h: Image(16, h, 8, model.GRAY, np.random.default_rng(h).integers(0, 3, 16 * h).astype(np.uint8).tobytes())
    flat = lambda i: writer.write(i, writer.WriteOptions(np.zeros(i.height, np.int64)))
    contents = [("k", flat(image(16))), ("k", flat(image(40))), ("k", flat(image(16))), (None, flat(image(9))), (None, None), ("k", b"no image")]
    for multi in (True, False):
        got = optimise.optimise(spark.createDataFrame(contents, "path string, content binary"), level=5, multi=multi).collect()
        assert len(got) == 6
        seen = sorted((r["path"] or "", png.read(bytes(r["content"])).pixels) for r in got if r["status"] != "failed")
        assert seen == sorted((k or "", png.read(c).pixels) for k, c in contents[:4])
        assert sorted(r["path"] or "" for r in got if r["status"] == "failed") == ["", "k"]
        assert all(len(r["content"]) <= r["original_bytes"] for r in got if r["status"] != "failed")


def test_alpha_of_animations():
    image = rgba_hash(8, 8)
    s = image.samples()
    s[::2, :, 3] = 0
    image = image.changed(pixels=model.pack(s, 8), animated=True)
    f = s[:3, :4].copy()
    image.frames = [model.Frame(8, 8, from_idat=True), model.Frame(4, 3, 2, 1, 1, 10, pixels=model.pack(f, 8))]
    done = recolour.optimise_alpha(image)
    assert done.pixels != image.pixels and recolour.equivalent(done, image) is None and done.color_type == model.RGBA
    s[:, :, 3] = f[:, :, 3] = 255
    image = image.changed(pixels=model.pack(s, 8))
    image.frames[1] = model.Frame(4, 3, 2, 1, 1, 10, pixels=model.pack(f, 8))
    done = recolour.optimise_alpha(image)
    assert done.color_type == model.RGB and recolour.equivalent(png.read(writer.write(done)), image) is None
    f[0, 0, 3] = 7
    image.frames[1] = model.Frame(4, 3, 2, 1, 1, 10, pixels=model.pack(f, 8))
    assert recolour.optimise_alpha(image).color_type == model.RGBA


def test_one_pass_is_kept_where_it_is_less(monkeypatch):
    image = graphic()
    choice = np.zeros(24, np.int64)
    whole = compress.finalist(image, choice, deflate.ULTRA, 3)
    once = compress.encode(image, choice, deflate.BEST, 1)
    monkeypatch.setattr(compress, "encode", lambda i, c, level, passes: once if passes == 1 else whole + bytes(500))
    assert compress.finalist(image, choice, deflate.ULTRA, 3, len(once)) == once
    assert compress.finalist(image, choice, deflate.ULTRA, 3, len(whole) + 500) == whole + bytes(500)
    assert [compress.passes_for(n, 5) for n in (1, compress.LARGE, compress.HUGE, compress.FIVE, compress.FIVE + 1, compress.THREE, compress.THREE + 1)] == [5, 4, 5, 5, 3, 3, 2]
    assert compress.level_for(compress.HUGE, 7, deflate.DEFAULT) == deflate.BEST and compress.level_for(compress.HUGE, 3, deflate.DEFAULT) == deflate.DEFAULT


def test_folders(spark, tmp_path, capsys):
    for n, name in enumerate(("a/x.png", "b/x.png", "x.png")):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(writer.write(synthetic.pattern("blocks", 16, 8 + n), writer.WriteOptions(np.zeros(8 + n, np.int64))))
    assert cli.main(["-o", "2", "-v", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert "x.png: kept" in (said := capsys.readouterr().out) and "wrote: 1 files" in said
    for n, name in enumerate(("a/x.png", "b/x.png", "x.png")):
        assert png.read((tmp_path / "out" / name).read_bytes()).height == 8 + n
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    assert cli.main(["-o", "2", "-s", str(tmp_path / "in"), str(tmp_path / "one")]) == 2
    assert "bad.png" in capsys.readouterr().err and (tmp_path / "one" / "b" / "x.png").exists() and not (tmp_path / "one" / "bad.png").exists()
    (tmp_path / "file").write_bytes(b"")
    assert cli.main(["-o", "1", str(tmp_path / "in"), str(tmp_path / "file")]) == 3


def test_command_line(tmp_path):
    source, target = tmp_path / "a.png", tmp_path / "b.png"
    source.write_bytes(writer.write(graphic(), writer.WriteOptions(np.zeros(24, np.int64))))
    assert cli.main(["-o", "3", str(source), str(target)]) == 0
    assert recolour.equivalent(png.read(target.read_bytes()), graphic()) is None
    assert cli.main(["-o", "10", str(source), str(target)]) == 1 and cli.main(["x", "y", "z"]) == 1
    assert cli.main([str(tmp_path / "none"), str(target)]) == 2
    assert cli.main(["-o", "0", str(source), str(tmp_path / "no" / "b.png")]) == 3
    assert sink.read_file(tmp_path / "none") == b"" and not list(tmp_path.glob(".*"))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in ("solid", "checker"):
        (tmp_path / "in" / f"{k}.png").write_bytes(writer.write(synthetic.pattern(k, 16, 16)))
    q = streaming.optimised(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), level=1)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.png", "wrote", b"1"), ("x/b.png", "failed", None)], "path string, status string, content binary")
    sink.write_files(rows, str(tmp_path / "files"))
    assert [p.name for p in (tmp_path / "files").iterdir()] == ["a.png"]
    same = spark.createDataFrame([("/r/x/a.png", "wrote", b"1"), ("/r/y/a.png", "kept", b"2")], "path string, status string, content binary")
    with pytest.raises(ValueError, match="2 rows"):
        sink.write_files(same, str(tmp_path / "clash"))
    sink.write_files(same, str(tmp_path / "apart"), root="/r")
    assert (tmp_path / "apart/x/a.png").read_bytes() == b"1" and (tmp_path / "apart/y/a.png").read_bytes() == b"2"
    with pytest.raises(ValueError, match="file name"):
        sink.write_files(same.limit(1).withColumn("path", F.lit("/r/../a.png")), str(tmp_path / "out"), root="/r")
    sink.write_table(rows, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
