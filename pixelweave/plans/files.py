"""Queries over files made of the tiles: rules, filters by level, recolouring, interlacing, animation, metadata, tokens, strategies."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave import model
from pixelweave.operators import compress, deflate, filters, inflate, recolour, writer
from pixelweave.plans import optimise, queries, tiles
from pixelweave.plans.queries import GRAY_ROWS, OPAQUE, query
from pixelweave.sources import png, synthetic


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, rows): the scanlines of each tile in order."""
    return tiles.gray(spark, sf_dir).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"]).alias("rows"))


def each(ddl: str, fn, column: str = "rows") -> Column:
    """A value of a DDL type made of the array of each tile."""
    kind = png.arrow_struct(ddl)
    return F.arrow_udf(lambda c: pa.array([fn(np.array(v, np.uint8)) for v in c.to_pylist()], kind), ddl)(column)


def _gray(x: np.ndarray) -> model.Image:
    return model.Image(x.shape[1], x.shape[0], 8, model.GRAY, x.tobytes())


def _sums(x: np.ndarray) -> dict:
    """The sum of a table's values, and the sum with each one's place as its weight: what a decoded picture is told by."""
    flat = x.reshape(-1).astype(np.int64)
    return {"total": int(flat.sum()), "moment": int(flat @ np.arange(len(flat)))}


def _levels(x: np.ndarray) -> list[dict]:
    out = []
    costs = filters.magnitudes(filters.residuals(x, 1))
    for level in range(8):
        choice = filters.choose(x, 1, level)
        back = filters.undo(filters.apply(x, 1, choice), 0, *x.shape, 1)
        cost = int(costs[choice, np.arange(len(x))].sum()) + {5: 32, 6: 32, 7: 64}.get(level, 0) * int((choice[1:] != choice[:-1]).sum())
        out.append({"level": level, "rows": len(choice), **_sums(back), "cheapest": cost if level in (0, 5, 6, 7) else None})
    return out


def _path_sql(penalty: int, name: str) -> str:
    step = ", ".join("list_min([{}]) + v.c[{}]".format(", ".join(f"w.c[{j}] + {0 if j == k else penalty}" for j in range(1, 6)), k) for k in range(1, 6))
    return f"""{name} AS (SELECT image_id, y, c FROM vec WHERE y = 0 UNION ALL SELECT v.image_id, v.y, [{step}] FROM {name} w JOIN vec v ON v.image_id = w.image_id AND v.y = w.y + 1),
  {name}_end AS (SELECT image_id, arg_max(list_min(c), y) AS c FROM {name} GROUP BY image_id)"""


@query(f"""WITH RECURSIVE {queries._VECTORS}, best AS (SELECT image_id, CAST(sum(list_min(c)) AS BIGINT) AS c, count(*) AS n FROM vec GROUP BY image_id), {_path_sql(32, "p32")}, {_path_sql(64, "p64")},
  s AS (SELECT image_id, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 64 + x)) AS BIGINT) AS moment FROM px GROUP BY image_id)
  SELECT image_id, CAST(level AS INTEGER) AS level, n AS rows, total, moment, CASE WHEN level = 0 THEN best.c WHEN level IN (5, 6) THEN p32_end.c WHEN level = 7 THEN p64_end.c END AS cheapest
  FROM best JOIN s USING (image_id) JOIN p32_end USING (image_id) JOIN p64_end USING (image_id), (SELECT unnest(range(8)) AS level)""")
def filter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way to choose filters, applied and undone: the pixels that come back, and the cost of the choice where sums decide it."""
    ddl = "array<struct<level:int,rows:bigint,total:bigint,moment:bigint,cheapest:bigint>>"
    return lines(spark, sf_dir).select("image_id", F.explode(each(ddl, _levels)).alias("l")).select("image_id", "l.*")


def _seen(image: model.Image) -> dict:
    """Sums over the 8-bit samples of what a picture looks like, red, green, blue, alpha in turn."""
    return _sums(recolour.canonical(image) // 257)


_SEEN = "CAST(sum(r + g + b + a) AS BIGINT) AS total, CAST(sum(r * (y * 16 + x) * 4 + g * ((y * 16 + x) * 4 + 1) + b * ((y * 16 + x) * 4 + 2) + a * ((y * 16 + x) * 4 + 3)) AS BIGINT) AS moment"


def _recoloured(x: np.ndarray) -> dict:
    rgba = x.reshape(len(x), -1, 4).copy()
    rgba[:, :, 3] = 255
    image = model.Image(rgba.shape[1], rgba.shape[0], 8, model.RGBA, rgba.tobytes())
    made = compress.variant(image, True, True, True)
    return {"color_type": made.color_type, "bit_depth": made.bit_depth, "entries": len(made.palette) // 3, **_seen(png.read(writer.write(made)))}


@query(f"""WITH {OPAQUE}, s AS (SELECT image_id, bool_and(r = g AND g = b) AS gray, count(DISTINCT (r, g, b)) AS n, {_SEEN} FROM px GROUP BY image_id)
  SELECT image_id, CASE WHEN gray THEN 0 WHEN n <= 256 THEN 3 ELSE 2 END AS color_type, CASE WHEN NOT gray AND n <= 16 THEN CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 ELSE 4 END ELSE 8 END AS bit_depth,
  CASE WHEN gray OR n > 256 THEN 0 ELSE n END AS entries, total, moment FROM s""")
def recoloured_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque RGBA tiles through alpha, colour and palette steps: the type they get, and what they look like when read again."""
    return lines(spark, sf_dir).select("image_id", each("struct<color_type:int,bit_depth:int,entries:bigint,total:bigint,moment:bigint>", _recoloured).alias("r")).select("image_id", "r.*")


def _keyed(x: np.ndarray) -> dict:
    rgba = x.reshape(len(x), -1, 4).copy()
    rgba[:, :, 3] = np.where(rgba[:, :, 3] % 2 == 0, 0, 255)
    image = model.Image(rgba.shape[1], rgba.shape[0], 8, model.RGBA, rgba.tobytes())
    made = recolour.colour_key(image)
    key = made.single.get("tRNS")
    return {"colour_key": None if key is None else key[1] << 16 | key[3] << 8 | key[5], **_seen(png.read(writer.write(made)))}


@query(f"""WITH {queries.BINARY}, v AS (SELECT DISTINCT image_id, CAST(r * 65536 + g * 256 + b AS BIGINT) AS c FROM px WHERE a <> 0), o AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY c) - 1 AS k FROM v),
  free AS (SELECT image_id, coalesce(min(CASE WHEN c <> k THEN k END), count(*)) AS free FROM o GROUP BY image_id), s AS (SELECT image_id, bool_or(a = 0) AS clear, {_SEEN.replace("sum(", "sum(CASE WHEN a = 0 THEN 0 ELSE 1 END * (").replace(") AS BIGINT", ")) AS BIGINT")} FROM px GROUP BY image_id)
  SELECT image_id, CASE WHEN clear THEN coalesce(free, 0) END AS colour_key, total, moment FROM s LEFT JOIN free USING (image_id)""")
def colour_key_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least colour that no visible pixel has, as the key of tiles with binary alpha, and what they look like when read again."""
    return lines(spark, sf_dir).select("image_id", each("struct<colour_key:bigint,total:bigint,moment:bigint>", _keyed).alias("k")).select("image_id", "k.*")


@query(f"WITH {queries.GRAY}, s AS (SELECT image_id, max(y) + 1 AS height, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 64 + x)) AS BIGINT) AS moment FROM px GROUP BY image_id) SELECT image_id, height, true AS interlaced, total, moment FROM s")
def interlaced_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written in seven passes and read again."""

    def one(x: np.ndarray) -> dict:
        back = png.read(writer.write(_gray(x), writer.WriteOptions(interlace=True)))
        return {"height": back.height, "interlaced": back.interlaced, **_sums(back.rows)}

    return lines(spark, sf_dir).select("image_id", each("struct<height:bigint,interlaced:boolean,total:bigint,moment:bigint>", one).alias("i")).select("image_id", "i.*")


@query(f"""WITH {queries.GRAY}, h AS (SELECT image_id, max(y) + 1 AS h FROM px GROUP BY image_id), f AS (SELECT image_id, h, unnest(range(h)) AS k FROM h),
  s AS (SELECT f.image_id, f.k, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * CASE WHEN f.k = 0 THEN y * 64 + x ELSE x END) AS BIGINT) AS moment FROM f JOIN px ON px.image_id = f.image_id AND (f.k = 0 OR px.y = f.k) GROUP BY ALL)
  SELECT image_id, CAST(k AS INTEGER) AS frame, CASE k WHEN 0 THEN 0 ELSE 2 * k - 1 END AS sequence, CASE WHEN k = 0 THEN h ELSE 1 END AS height, k AS y, CAST(k + 1 AS INTEGER) AS delay_num, total, moment FROM f JOIN s USING (image_id, k)""")
def animation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as animations: the image, then each further scanline as a frame over it; sequence numbers are dense, pixels come back."""

    def one(x: np.ndarray) -> list[dict]:
        image = _gray(x)
        image.animated = True
        image.frames = [model.Frame(64, len(x), delay_num=1, delay_den=10, from_idat=True)] + [model.Frame(64, 1, 0, k, k + 1, 10, 0, 1, pixels=x[k].tobytes()) for k in range(1, len(x))]
        back = png.read(writer.write(image))
        seen = [np.frombuffer(back.pixels if f.from_idat else f.pixels, np.uint8) for f in back.frames]
        return [{"frame": k, "sequence": f.sequence, "height": f.height, "y": f.y, "delay_num": f.delay_num, **_sums(p)} for k, (f, p) in enumerate(zip(back.frames, seen, strict=True))]

    ddl = "array<struct<frame:int,sequence:bigint,height:bigint,y:bigint,delay_num:int,total:bigint,moment:bigint>>"
    return lines(spark, sf_dir).select("image_id", F.explode(each(ddl, one)).alias("f")).select("image_id", "f.*")


@query(f"WITH {GRAY_ROWS} SELECT image_id, CAST(unnest(range(10)) AS INTEGER) AS seq, unnest(['IHDR', 'gAMA', 'sRGB', 'sBIT', 'tRNS', 'bKGD', 'pHYs', 'tEXt', 'IDAT', 'IEND']) AS type FROM (SELECT DISTINCT image_id FROM rows)")
def metadata_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata given in any order and in every layout is written where the format wants it, what doesn't fit is dropped."""

    def one(x: np.ndarray) -> bytes:
        image = _gray(x)
        image.text = [("tEXt", b"Title\0tile")]
        image.single = {"pHYs": bytes(9), "sBIT": b"\5\6\5\x08", "bKGD": b"\0\1", "sRGB": b"\0", "gAMA": bytes(4), "tRNS": b"\0\7"}
        return writer.write(image)

    made = lines(spark, sf_dir).select("image_id", each("binary", one).alias("content"))
    return png.chunk_table(made, "image_id").select("image_id", "seq", "type")


@query(f"""WITH {queries.COSTS}, best AS (SELECT image_id, y, arg_min(ft, (cost, ft)) AS ft FROM costs GROUP BY image_id, y),
  b AS (SELECT r.image_id, r.y * 65 + x + 1 AS p, d AS v FROM residuals r JOIN best ON best.image_id = r.image_id AND best.y = r.y AND best.ft = r.ft UNION ALL SELECT image_id, y * 65, ft FROM best)
  SELECT image_id, count(*) AS bytes, count(*) AS token_bytes, count(*) AS block_bytes, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * p) AS BIGINT) AS moment, CAST(sum(v * p) AS BIGINT) AS library_moment FROM b GROUP BY image_id""")
def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package's encoder over each filtered tile, read back by the traced decoder as blocks and tokens, and by the library: how many bytes they stand for, and which.

    A block that isn't at the least of the three codings, or not as long as its price says, takes its bytes out of the count.
    """

    def one(x: np.ndarray) -> dict:
        data = filters.apply(x, 1, filters.choose(x, 1, 0))
        z = deflate.compress(data, deflate.Options(deflate.BEST, 2, max_block=1500, row=65))
        found = inflate.trace(z, len(data))
        good = 0
        for k, (kind, _, size, at, bits) in enumerate(found.blocks):
            cost = deflate.block_costs([(n, d) for b, n, d in found.tokens if b == k], size, at)
            good += size if bits == (cost["stored"] if kind == 0 else min(cost.values())) else 0
        library = _sums(np.frombuffer(zlib.decompress(z, -15), np.uint8))["moment"]
        return {"bytes": len(found.data), "token_bytes": sum(n if d else 1 for _, n, d in found.tokens), "block_bytes": good, **_sums(np.frombuffer(found.data, np.uint8)), "library_moment": library}

    ddl = "struct<bytes:bigint,token_bytes:bigint,block_bytes:bigint,total:bigint,moment:bigint,library_moment:bigint>"
    return lines(spark, sf_dir).select("image_id", each(ddl, one).alias("t")).select("image_id", "t.*")


@query(f"WITH {GRAY_ROWS}, v AS (SELECT image_id, y, list_concat([0], line) AS l FROM rows) SELECT image_id, y, len(l)::INTEGER AS size, CAST(list_sum(l) AS BIGINT) AS total, CAST(list_sum(list_transform(l, lambda v, k: v * (k - 1))) AS BIGINT) AS moment, CAST(list_sum(list_transform(l, lambda v, k: v * (k - 1))) AS BIGINT) AS library_moment FROM v")
def deflate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scanline through the package's own encoder, and back by its traced decoder and the library's."""

    def one(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            z = deflate.zlib_compress(bytes([0, *r]), deflate.Options(deflate.BEST, 2))
            back = inflate.trace(z[2:-4], 65).data
            out.append({"size": len(back), **_sums(np.frombuffer(back, np.uint8)), "library_moment": _sums(np.frombuffer(zlib.decompress(z), np.uint8))["moment"]})
        return pa.array(out, kind)

    ddl = "struct<size:int,total:bigint,moment:bigint,library_moment:bigint>"
    kind = png.arrow_struct(ddl)
    return tiles.gray(spark, sf_dir).select("image_id", "y", F.arrow_udf(one, ddl)("row").alias("z")).select("image_id", "y", "z.*")


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS traced_sha256, sha256(coalesce(text, '')) AS library_sha256 FROM documents")
def deflate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the package's own encoder (all windows and block sizes), and back by its traced decoder and the library's."""

    def all_of(texts: pa.Array) -> pa.Array:
        raw = texts.to_pylist()
        streams = deflate.compress_all(raw, deflate.Options(deflate.BEST, 2))
        return pa.array([{"bytes": len(x), "traced": inflate.trace(z, len(x)).data, "library": zlib.decompress(z, -15)} for x, z in zip(raw, streams, strict=True)], kind)

    ddl = "struct<bytes:bigint,traced:binary,library:binary>"
    kind = png.arrow_struct(ddl)
    made = F.arrow_udf(all_of, ddl)
    texts = tiles.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    dealt = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("doc_id", "raw"))  # the work is worth more than the move
    return dealt.select("doc_id", made("raw").alias("made")).select("doc_id", "made.bytes", F.sha2("made.traced", 256).alias("traced_sha256"), F.sha2("made.library", 256).alias("library_sha256"))


@query(
    "SELECT CAST(row_number() OVER (ORDER BY g, k) - 1 AS INTEGER) AS ordinal, f AS filter_level, 12 AS deflate_level, 5 AS passes, a AS alpha, r AS reduce, s AS sort FROM (VALUES "
    "(1, [0, 1, 2, 3, 4, 5, 7], true, false, false), (2, [0, 1, 2, 3, 5, 7], false, false, false), (3, [0, 1, 2, 3, 5], true, false, true), (4, [0, 1, 2, 3, 4, 5, 7], true, true, false), (5, [0, 1, 2, 3, 5, 7], true, true, true), (6, [0, 2, 3, 5], false, true, true)"
    ") t(g, fs, a, r, s), LATERAL (SELECT unnest(fs) AS f, unnest(range(len(fs))) AS k)"
)
def strategy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategies of the highest level, in order of precedence."""
    return optimise.strategy_table(spark, 9)


@query("WITH e AS (SELECT p_partkey AS k, octet_length(encode(p_name)) AS original, octet_length(encode(p_type)) AS made FROM part) SELECT k AS part, CASE WHEN made < original THEN 'wrote' ELSE 'kept' END AS status, least(made, original) AS bytes FROM e")
def keep_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of what is kept: the new one only if strictly smaller."""
    n = lambda c: F.octet_length(c).cast("bigint")
    rows = tiles.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), n("p_name").alias("original"), n("p_type").alias("made"))
    return rows.select("part", F.when(F.col("made") < F.col("original"), "wrote").otherwise("kept").alias("status"), F.least("made", "original").alias("bytes"))


def _cases() -> list[tuple[str, bytes]]:
    """Files that a rule rejects, repairs or lets pass."""
    ihdr = ("IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0))
    rows = bytes(13) + bytes(13)
    idat, end = ("IDAT", zlib.compress(rows)), ("IEND", b"")
    make = lambda *parts: model.SIGNATURE + b"".join(writer.chunk(k, d) for k, d in parts)
    good = make(ihdr, idat, end)
    spoiled = lambda k, d: writer.chunk(k, d)[:-1] + bytes([writer.chunk(k, d)[-1] ^ 1])
    indexed = ("IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 3, 0, 0, 0))
    return [
        ("good", good), ("short", good[:19]), ("signature", b"x" + good[1:]), ("type", model.SIGNATURE + b"\0\0\0\0a1bc" + bytes(4)), ("cut", good[:50]), ("cut late", good[:-6]),
        ("critical crc", model.SIGNATURE + spoiled(*ihdr) + writer.chunk(*idat)), ("ancillary crc", make(ihdr) + spoiled("tEXt", b"a\0b") + writer.chunk(*idat) + writer.chunk(*end)),
        ("no header", make(idat, end)), ("two headers", make(ihdr, ihdr, idat)), ("no data", make(ihdr, end)), ("bad depth", make(("IHDR", struct.pack(">IIBBBBB", 4, 2, 4, 2, 0, 0, 0)), idat)),
        ("no palette", make(indexed, idat)), ("bad palette", make(indexed, ("PLTE", b"ab"), idat)), ("short palette", make(indexed, ("PLTE", b"abc"), ("IDAT", zlib.compress(b"\0\5\0\0\0\0\0\0\0\0")), end)),
        ("unknown critical", make(ihdr, ("ABCD", b""), idat)), ("unknown private", make(ihdr, ("abCd", b""), idat, end)), ("bad filter", make(ihdr, ("IDAT", zlib.compress(b"\7" + rows[1:])), end)),
        ("short data", make(ihdr, ("IDAT", zlib.compress(rows[:-1])), end)), ("bad checksum", make(ihdr, ("IDAT", idat[1][:-1] + b"\xff"), end)), ("no checksum", make(ihdr, ("IDAT", idat[1][:-4]), end)),
        ("no end", make(ihdr, idat)), ("junk behind", good + b"junk"), ("bad tRNS", make(ihdr, ("tRNS", b"a"), idat, end)), ("bad gAMA", make(ihdr, ("gAMA", b"a"), idat, end)), ("late acTL", make(ihdr, idat, ("acTL", bytes(8)), end)),
        ("stray fcTL", make(ihdr, ("fcTL", bytes(26)), idat, end)), ("bad fcTL", make(ihdr, ("acTL", bytes(8)), ("fcTL", bytes(26)), idat, end)),
    ]


@query(
    "SELECT * FROM (VALUES ('good', true, 0), ('short', false, 0), ('signature', false, 0), ('type', false, 0), ('cut', false, 0), ('cut late', true, 1), ('critical crc', false, 0), ('ancillary crc', true, 1), "
    "('no header', false, 0), ('two headers', false, 0), ('no data', false, 0), ('bad depth', false, 0), ('no palette', false, 0), ('bad palette', false, 0), ('short palette', true, 1), ('unknown critical', false, 0), "
    "('unknown private', true, 0), ('bad filter', false, 0), ('short data', false, 0), ('bad checksum', false, 0), ('no checksum', true, 0), ('no end', true, 1), ('junk behind', true, 0), ('bad tRNS', true, 1), "
    "('bad gAMA', true, 1), ('late acTL', true, 1), ('stray fcTL', true, 0), ('bad fcTL', false, 0)) t(name, accepted, warnings)"
)
def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of malformed and unusual files, and with how many warnings."""
    files = spark.createDataFrame(_cases(), "name string, content binary")
    image = F.col("image")
    return png.images(files).select("name", image["error"].isNull().alias("accepted"), F.coalesce(F.when(image["error"].isNull(), F.size(image["warnings"])), F.lit(0)).alias("warnings"))


@query(f"""WITH {GRAY_ROWS}, d AS (SELECT image_id, y, unnest(range(64)) AS x, unnest(line) AS v FROM rows), n AS (SELECT image_id, count(*) FILTER (WHERE v % 17 <> 0) AS differing, min(CASE WHEN v % 17 <> 0 THEN y * 64 + x END) AS pos FROM d GROUP BY image_id)
  SELECT image_id, differing, pos // 64 AS y, pos % 64 AS x FROM n""")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles against their quantised selves: how many pixels differ, and the first that does; scanlines meet by one join."""
    a, b = tiles.gray(spark, sf_dir), tiles.quantised(spark, sf_dir).withColumnRenamed("row", "other")
    bad = F.filter(F.transform("row", lambda v, k: F.when(v != F.get("other", k), F.col("y") * 64 + k)), lambda v: v.isNotNull())
    both = a.join(b, ["image_id", "y"]).select("image_id", bad.alias("bad"))
    sums = both.groupBy("image_id").agg(F.sum(F.size("bad")).alias("differing"), F.min(F.array_min("bad")).alias("at"))
    return sums.select("image_id", "differing", F.floor(F.col("at") / 64).alias("y"), (F.col("at") % 64).alias("x"))


@query(f"WITH {queries.BYTES}, c AS (SELECT doc_id, p // 65535 AS block, count(*) AS n, count(*) FILTER (WHERE v >= 144) AS high FROM bytes GROUP BY ALL) SELECT doc_id, block, 3 + 8 * n + high + 7 AS fixed_bits, 32 + 8 + 8 * n AS stored_bits, CASE WHEN 3 + 8 * n + high + 7 <= 40 + 8 * n THEN 'fixed' ELSE 'stored' END AS coding FROM c")
def literal_block_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed or stored for each largest-size block of a text as literals; a stored one starts on a byte."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    texts = tiles.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).where(F.octet_length("raw") > 0)
    cut = texts.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / 65535).cast("int"))).alias("block"))
    part = cut.select("doc_id", F.col("block").cast("bigint").alias("block"), F.substring(F.col("raw"), F.col("block") * 65535 + 1, F.lit(65535)).alias("part"))
    n = F.octet_length("part").cast("bigint")
    both = part.select("doc_id", "block", (10 + 8 * n + queries.high_bytes(F.col("part"))).alias("fixed_bits"), (40 + 8 * n).alias("stored_bits"))
    return both.withColumn("coding", F.when(F.col("fixed_bits") <= F.col("stored_bits"), "fixed").otherwise("stored"))


# --- files of all colour types ------------------------------------------------------------------------------------------------


def _coloured(image_id: int, x: np.ndarray) -> model.Image:
    """A tile as gray, truecolour, indexed with a transparent entry, 16-bit gray, gray with alpha, or 4-bit gray, by its number."""
    h, kind = len(x), image_id % 6
    if kind == 1:
        return model.Image(21, h, 8, model.RGB, x[:, :63].tobytes())
    if kind == 2:
        palette = b"".join(bytes([17 * i, 255 - 17 * i, i]) for i in range(16))
        return model.Image(64, h, 8, model.INDEXED, (x // 17).tobytes(), palette=palette, alpha_palette=b"\0")
    if kind == 3:
        return model.Image(32, h, 16, model.GRAY, x.tobytes())
    if kind == 4:
        return model.Image(32, h, 8, model.GRAY_ALPHA, x.tobytes())
    if kind == 5:
        return model.Image(64, h, 4, model.GRAY, model.pack(x[:, :, None] // 17, 4))
    return model.Image(64, h, 8, model.GRAY, x.tobytes())


def coloured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): tiles as files of six colour types, unfiltered and every second one interlaced."""

    def made(ids: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for k, r in zip(ids.to_pylist(), rows.to_pylist(), strict=True):
            image = _coloured(k, np.array(r, np.uint8))
            out.append(writer.write(image, writer.WriteOptions(np.zeros(image.height, np.int64), interlace=k // 6 % 2 == 1)))
        return pa.array(out, pa.binary())

    return lines(spark, sf_dir).select("image_id", F.arrow_udf(made, "binary")("image_id", "rows").alias("content"))


def _pixels(files: DataFrame, content: str) -> DataFrame:
    """What each file's picture looks like: a row of 16-bit samples for each pixel."""

    def one(files: pa.Array) -> pa.Array:
        out = []
        for v in files:
            s = recolour.canonical(png.read(v.as_py()))
            out.append([{"y": y, "x": x, "r": p[0], "g": p[1], "b": p[2], "a": p[3]} for y, line in enumerate(s.tolist()) for x, p in enumerate(line)])
        return pa.array(out, kind)

    ddl = "array<struct<y:bigint,x:bigint,r:int,g:int,b:int,a:int>>"
    kind = png.arrow_struct(ddl)
    return files.select("image_id", F.explode(F.arrow_udf(one, ddl)(F.col(content))).alias("p")).select("image_id", "p.*")


_LOOKS = f"""WITH {GRAY_ROWS}, k AS (SELECT image_id, y, line, image_id % 6 AS kind, list_transform(line, lambda v: v // 17) AS few FROM rows),
  w AS (SELECT *, CASE kind WHEN 1 THEN 21 WHEN 3 THEN 32 WHEN 4 THEN 32 ELSE 64 END AS width FROM k), p AS (SELECT *, unnest(range(width)) AS x FROM w),
  s AS (SELECT image_id, y, x,
    CASE kind WHEN 1 THEN line[3*x+1] * 257 WHEN 2 THEN few[x+1] * 17 * 257 WHEN 3 THEN line[2*x+1] * 256 + line[2*x+2] WHEN 4 THEN line[2*x+1] * 257 WHEN 5 THEN few[x+1] * 4369 ELSE line[x+1] * 257 END AS r,
    CASE kind WHEN 1 THEN line[3*x+2] * 257 WHEN 2 THEN (255 - 17 * few[x+1]) * 257 WHEN 3 THEN line[2*x+1] * 256 + line[2*x+2] WHEN 4 THEN line[2*x+1] * 257 WHEN 5 THEN few[x+1] * 4369 ELSE line[x+1] * 257 END AS g,
    CASE kind WHEN 1 THEN line[3*x+3] * 257 WHEN 2 THEN few[x+1] * 257 WHEN 3 THEN line[2*x+1] * 256 + line[2*x+2] WHEN 4 THEN line[2*x+1] * 257 WHEN 5 THEN few[x+1] * 4369 ELSE line[x+1] * 257 END AS b,
    CASE kind WHEN 2 THEN CASE WHEN few[x+1] = 0 THEN 0 ELSE 65535 END WHEN 4 THEN line[2*x+2] * 257 ELSE 65535 END AS a FROM p)
  SELECT image_id, y, x, CAST(CASE WHEN a = 0 THEN 0 ELSE r END AS INTEGER) AS r, CAST(CASE WHEN a = 0 THEN 0 ELSE g END AS INTEGER) AS g, CAST(CASE WHEN a = 0 THEN 0 ELSE b END AS INTEGER) AS b, CAST(a AS INTEGER) AS a FROM s"""


@query(_LOOKS)
def decode_colour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of six colour types and depths, plain and interlaced, decoded to 16-bit pixels."""
    return _pixels(coloured_files(spark, sf_dir), "content")


# --- the search ---------------------------------------------------------------------------------------------------------------


def _searched(files: DataFrame, level: int) -> DataFrame:
    """The pixels of what the search keeps; files that failed or grew have none."""
    found = optimise.optimise(files, level, key="image_id")
    good = found.where((F.col("status") != "failed") & (F.octet_length("content") <= F.col("original_bytes")))
    return _pixels(good, "content")


@query(_LOOKS)
def search_colour_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search at its highest level over files of six colour types: what is kept looks the same."""
    return _searched(coloured_files(spark, sf_dir), 9)


@query(f"WITH {queries.GRAY} SELECT image_id, y, x, CAST(v * 257 AS INTEGER) AS r, CAST(v * 257 AS INTEGER) AS g, CAST(v * 257 AS INTEGER) AS b, 65535 AS a FROM px")
def optimise_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over the tiles' files: what is kept looks the same and isn't larger."""
    return _searched(queries.tile_files(spark, sf_dir), 5)


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as files whose data are stored, so that their sizes follow from their heights."""
    plain = lambda x: writer.write(_gray(x), writer.WriteOptions(np.zeros(len(x), np.int64), deflate.Options(deflate.STORE)))
    return lines(spark, sf_dir).select("image_id", each("binary", plain).alias("content"))


_STORED = f"WITH {GRAY_ROWS}, n AS (SELECT image_id, 65 * count(*) AS n FROM rows GROUP BY image_id), f AS (SELECT image_id, 57 + 6 + 5 * ((n + 65534) // 65535) + n AS original_bytes FROM n)"


@query(f"{_STORED} SELECT image_id, 'wrote' AS status, original_bytes FROM f")
def search_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search says of each of the stored files: all of them get smaller."""
    return optimise.optimise(_stored_files(spark, sf_dir), 3, key="image_id").select("image_id", "status", "original_bytes")


@query(f"{_STORED} SELECT 'wrote' AS status, count(*) AS files, CAST(sum(original_bytes) AS BIGINT) AS before FROM f HAVING count(*) > 0")
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the search over the stored files by status."""
    return optimise.totals(optimise.optimise(_stored_files(spark, sf_dir), 3, key="image_id")).select("status", "files", "before")


# --- generated pictures ---------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT k AS kind, w::BIGINT AS width, h::BIGINT AS height FROM (SELECT unnest(['gradient', 'blocks', 'noise', 'solid', 'checker', 'horizontal', 'text']) AS k), (VALUES (32, 32), (64, 48), (128, 128)) s(w, h)),
  p AS (SELECT kind, width, height, y, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height)) AS y FROM d)),
  m AS (SELECT *, CAST(xor(x * 2654435761, y * 40503 * 65537)::HUGEINT * 2246822519 % 4294967296 AS BIGINT) AS m FROM p),
  c AS (SELECT *, CASE kind WHEN 'gradient' THEN x * 255 // greatest(1, width - 1) WHEN 'blocks' THEN (x // 8 * 37) & 255 WHEN 'noise' THEN (m >> 5) & 255 WHEN 'solid' THEN 64
      WHEN 'checker' THEN (x // 8 + y // 8) % 2 * 255 WHEN 'horizontal' THEN (x * 8) & 255 ELSE CASE WHEN x % 6 < 4 AND y % 10 < 7 AND (m >> 7) % 3 > 0 THEN 0 ELSE 255 END END AS r FROM m),
  c2 AS (SELECT *, CASE kind WHEN 'gradient' THEN y * 255 // greatest(1, height - 1) WHEN 'blocks' THEN (y // 8 * 61) & 255 WHEN 'noise' THEN (m >> 13) & 255 WHEN 'solid' THEN 128 WHEN 'horizontal' THEN 100 ELSE r END AS g,
      CASE kind WHEN 'gradient' THEN (x + y) * 255 // greatest(1, width + height - 2) WHEN 'blocks' THEN ((x // 8 + y // 8) * 17) & 255 WHEN 'noise' THEN (m >> 21) & 255 WHEN 'solid' THEN 192 WHEN 'horizontal' THEN 50 ELSE r END AS b FROM c)
  SELECT kind, width, height, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue, CAST(sum((r + 2 * g + 3 * b) * (y * width + x)) AS BIGINT) AS moment FROM c2 GROUP BY kind, width, height""")
def generated_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generators as a source: each picture is written to a file, read again, and summed up."""

    def one(files: pa.Array) -> pa.Array:
        out = []
        for v in files:
            image = png.read(v.as_py())
            s = image.samples()[:, :, :3].reshape(-1, 3)
            out.append({"red": int(s[:, 0].sum()), "green": int(s[:, 1].sum()), "blue": int(s[:, 2].sum()), "moment": int((s @ [1, 2, 3]) @ np.arange(len(s)))})
        return pa.array(out, kind)

    ddl = "struct<red:bigint,green:bigint,blue:bigint,moment:bigint>"
    kind = png.arrow_struct(ddl)
    files = synthetic.files(spark, synthetic.PATTERNS, ((32, 32), (64, 48), (128, 128)))
    return files.select("kind", "width", "height", F.arrow_udf(one, ddl)("content").alias("s")).select("kind", "width", "height", "s.*")
