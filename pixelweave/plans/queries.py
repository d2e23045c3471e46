"""The queries over derived tiles and bytes, each with the SQL that says the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave import model
from pixelweave.functions import scalars
from pixelweave.operators import deflate, huffman, inflate, writer
from pixelweave.plans import optimise, tiles
from pixelweave.plans.tiles import table
from pixelweave.sources import png

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- SQL of the derived relations ---------------------------------------------------------------------------------------

GRAY_ROWS = """rows AS (SELECT label::BIGINT * 4294967296 + vec_id // 320 AS image_id, row_number() OVER (PARTITION BY label, vec_id // 320 ORDER BY vec_id) - 1 AS y,
  list_transform(embedding, lambda e: CAST(greatest(least(floor((CAST(e AS DOUBLE) + 1) * 127.5), 255), 0) AS INTEGER)) AS line FROM embeddings)"""
GRAY = f"{GRAY_ROWS}, px AS (SELECT image_id, y, unnest(range(64)) AS x, unnest(line) AS v FROM rows)"
QUANT = f"{GRAY_ROWS}, px AS (SELECT image_id, y, unnest(range(64)) AS x, unnest(list_transform(line, lambda v: v // 17 * 17)) AS v FROM rows)"


def rgba_sql(alpha: str = "a0") -> str:
    return f"""{GRAY_ROWS}, raw AS (SELECT image_id, y, line, unnest(range(16)) AS x FROM rows),
  px4 AS (SELECT image_id, y, x, line[4*x+1] AS r, line[4*x+2] AS g, line[4*x+3] AS b, line[4*x+4] AS a0 FROM raw),
  px AS (SELECT image_id, y, x, r, g, b, {alpha} AS a FROM px4)"""


OPAQUE, BINARY = rgba_sql("255"), rgba_sql("CASE WHEN a0 % 2 = 0 THEN 0 ELSE 255 END")
RESIDUALS = f"""{GRAY}, near AS (SELECT image_id, y, x, v, coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS l,
    coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS u FROM px),
  near3 AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS c FROM near),
  residuals AS (SELECT image_id, y, x, ft, CAST((v - CASE ft WHEN 0 THEN 0 WHEN 1 THEN l WHEN 2 THEN u WHEN 3 THEN (l + u) // 2 ELSE
      CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END END + 512) % 256 AS INTEGER) AS d
    FROM near3, (SELECT unnest(range(5)) AS ft))"""
COSTS = f"{RESIDUALS}, costs AS (SELECT image_id, y, CAST(ft AS INTEGER) AS ft, CAST(sum(CASE WHEN d > 127 THEN 256 - d ELSE d END) AS BIGINT) AS cost FROM residuals GROUP BY ALL)"
BYTES = """bytes AS (SELECT doc_id, unnest(range(octet_length(encode(coalesce(text, ''))))) AS p,
  CAST('0x' || unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS INTEGER) AS v FROM documents)"""


# --- scanline filters ---------------------------------------------------------------------------------------------------


@query(f"WITH {COSTS} SELECT image_id, y, arg_min(ft, (cost, ft)) AS ft, min(cost) AS cost FROM costs GROUP BY image_id, y")
def minsum_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter with the least sum of signed magnitudes for each scanline."""
    best = F.array_min(F.transform("costs", lambda v, k: F.struct(v.alias("cost"), k.alias("ft"))))
    return tiles.cost_vectors(tiles.gray(spark, sf_dir)).withColumn("best", best).select("image_id", "y", F.col("best.ft").alias("ft"), F.col("best.cost").alias("cost"))


@query(f"WITH {RESIDUALS} SELECT image_id, y, x, CAST(ft AS INTEGER) AS ft, d FROM residuals")
def filter_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.residuals(tiles.gray(spark, sf_dir)).select("image_id", "y", F.posexplode("d").alias("x", "d"), "ft").select("image_id", "y", F.col("x").cast("bigint").alias("x"), "ft", "d")


@query(f"WITH {COSTS}, best AS (SELECT image_id, y, arg_min(ft, (cost, ft)) AS ft FROM costs GROUP BY image_id, y) SELECT image_id, ft, count(*) AS n FROM best GROUP BY image_id, ft")
def filter_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minsum_filters(spark, sf_dir).groupBy("image_id", "ft").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RESIDUALS}, n AS (SELECT image_id, y, ft, d, count(*) AS n FROM residuals GROUP BY ALL),
  e AS (SELECT image_id, y, CAST(ft AS INTEGER) AS ft, round(-sum(n / 64.0 * log2(n / 64.0)), 6) AS entropy FROM n GROUP BY ALL)
  SELECT image_id, y, arg_min(ft, (entropy, ft)) AS ft, min(entropy) AS entropy FROM e GROUP BY image_id, y""")
def entropy_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter with the least entropy for each scanline."""
    own = tiles.residuals(tiles.gray(spark, sf_dir)).withColumn("entropy", tiles.entropy(F.col("d")))
    return own.groupBy("image_id", "y").agg(F.min_by("ft", F.struct("entropy", "ft")).alias("ft"), F.min("entropy").alias("entropy"))


@query(f"WITH {COSTS} SELECT image_id, ft, CAST(sum(cost) AS BIGINT) AS cost FROM costs GROUP BY image_id, ft")
def uniform_filter_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = tiles.cost_vectors(tiles.gray(spark, sf_dir)).groupBy("image_id").agg(*[F.sum(F.col("costs")[k]).alias(f"c{k}") for k in range(5)])
    return sums.select("image_id", F.posexplode(F.array(*[f"c{k}" for k in range(5)])).alias("ft", "cost"))


@query(f"WITH {COSTS}, u AS (SELECT image_id, ft, CAST(sum(cost) AS BIGINT) AS cost FROM costs GROUP BY image_id, ft) SELECT image_id, arg_min(ft, (cost, ft)) AS ft, min(cost) AS cost FROM u GROUP BY image_id")
def best_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_filter_costs(spark, sf_dir).groupBy("image_id").agg(F.min_by("ft", F.struct("cost", "ft")).alias("ft"), F.min("cost").alias("cost"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each image: its scanlines' costs in order, folded to the cheapest path."""
    rows = tiles.cost_vectors(tiles.gray(spark, sf_dir)).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "costs"))).alias("s"))
    return rows.select("image_id", tiles.cheapest_path(F.transform("s", lambda v: v["costs"]), 32).alias("best"))


_VECTORS = f"{COSTS}, vec AS (SELECT image_id, y, list(cost ORDER BY ft) AS c FROM costs GROUP BY image_id, y)"
_STEP = ", ".join("list_min([{}]) + v.c[{}]".format(", ".join(f"w.c[{j}] + {0 if j == k else 32}" for j in range(1, 6)), k) for k in range(1, 6))
_CAME = ", ".join("list_min([{}])[2]".format(", ".join(f"[w.c[{j}] + {0 if j == k else 32}, {j - 1}]" for j in range(1, 6))) for k in range(1, 6))


@query(f"WITH RECURSIVE {_VECTORS}, walk AS (SELECT image_id, y, c FROM vec WHERE y = 0 UNION ALL SELECT v.image_id, v.y, [{_STEP}] FROM walk w JOIN vec v ON v.image_id = w.image_id AND v.y = w.y + 1) SELECT image_id, arg_max(list_min(c), y) AS total FROM walk GROUP BY image_id")
def viterbi_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the cheapest filter path of each image; a change costs half a scanline."""
    return _paths(spark, sf_dir).select("image_id", F.col("best.total").alias("total"))


@query(f"""WITH RECURSIVE {_VECTORS}, walk AS (SELECT image_id, y, c, [0, 0, 0, 0, 0]::BIGINT[] AS came FROM vec WHERE y = 0
    UNION ALL SELECT v.image_id, v.y, [{_STEP}], [{_CAME}]::BIGINT[] FROM walk w JOIN vec v ON v.image_id = w.image_id AND v.y = w.y + 1),
  ends AS (SELECT image_id, max(y) AS y FROM walk GROUP BY image_id),
  back AS (SELECT w.image_id, w.y, CAST(list_position(w.c, list_min(w.c)) - 1 AS BIGINT) AS ft, w.came FROM walk w JOIN ends USING (image_id, y)
    UNION ALL SELECT w.image_id, w.y, b.came[b.ft + 1], w.came FROM back b JOIN walk w ON w.image_id = b.image_id AND w.y = b.y - 1)
  SELECT image_id, y, CAST(ft AS INTEGER) AS ft FROM back""")
def viterbi_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters of that path."""
    return _paths(spark, sf_dir).select("image_id", F.posexplode("best.path").alias("y", "ft")).withColumn("y", F.col("y").cast("bigint"))


# --- bytes ---------------------------------------------------------------------------------------------------------------


def _per_text(spark: SparkSession, sf_dir: str, ddl: str, one: Callable[[np.ndarray], object]) -> DataFrame:
    """doc_id and a value made of the text's UTF-8 bytes, whole and null as empty."""
    kind = png.arrow_struct(ddl)
    made = F.arrow_udf(lambda b: pa.array([one(np.frombuffer(v.as_py(), np.uint8)) for v in b], kind), ddl)
    return table(spark, sf_dir, "documents").select("doc_id", made(F.coalesce("text", F.lit("")).cast("binary")).alias("made"))


@query(f"WITH {BYTES} SELECT v AS value, count(*) AS n FROM bytes GROUP BY v")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of byte values over all texts: each task sums its texts, 256 rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, np.int64)
        for batch in batches:
            for v in batch.column(0):
                if v.is_valid:
                    n += np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["value", "n"])

    return table(spark, sf_dir, "documents").select("text").mapInArrow(run, "value int, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


@query(f"""WITH {BYTES}, n AS (SELECT doc_id, v, count(*) AS n FROM bytes GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM n GROUP BY doc_id),
  e AS (SELECT doc_id, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, coalesce(entropy, 0.0) AS entropy FROM documents LEFT JOIN e USING (doc_id)""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(x: np.ndarray) -> float:
        p = np.bincount(x, minlength=256)
        p = p[p > 0] / max(1, len(x))
        return round(float(-(p * np.log2(p)).sum()), 6) + 0.0

    return _per_text(spark, sf_dir, "double", one).withColumnRenamed("made", "entropy")


@query(f"""WITH {BYTES}, n AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  s AS (SELECT doc_id, sum(v) AS a, sum((n - p) * v) AS b FROM bytes JOIN n USING (doc_id) GROUP BY doc_id)
  SELECT n.doc_id, CAST((1 + coalesce(a, 0)) % 65521 + 65536 * ((n + coalesce(b, 0)) % 65521) AS BIGINT) AS adler32 FROM n LEFT JOIN s USING (doc_id)""")
def adler32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_text(spark, sf_dir, "bigint", lambda x: zlib.adler32(x)).withColumnRenamed("made", "adler32")


_CRC_TABLE = "list_transform(range(256), lambda k: " + "list_reduce(list_concat([k], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)" + ")"


@query(f"""WITH t AS MATERIALIZED (SELECT {_CRC_TABLE} AS t)
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc32 FROM documents, t""")
def crc32_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc32"))


def high_bytes(raw: Column) -> Column:
    """How many bytes are 144 or more: what nine-bit literals of the fixed code are for."""
    return F.length(F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[\\u0000-\\u008f]+", ""))


def _earlier(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ``size`` bytes occurred before, and where they did so last."""
    if len(x) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.zeros(len(x) - size + 1, np.int64)
    for k in range(size):
        key = key << 8 | x[k : len(x) - size + 1 + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    return order[1:][same], order[:-1][same]


def _matches_sql(size: int) -> str:
    key = " + ".join(f"coalesce(lead(v, {k}) OVER w, 0) * {256 ** (size - 1 - k)}::BIGINT" for k in range(size))
    return f"""WITH {BYTES}, k AS (SELECT doc_id, p, {key} AS k, lead(v, {size - 1}) OVER w AS last FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
  m AS (SELECT doc_id, p - lag(p) OVER (PARTITION BY doc_id, k ORDER BY p) AS d FROM k WHERE last IS NOT NULL),
  s AS (SELECT doc_id, count(*) AS n, CAST(sum(d) AS BIGINT) AS distance, max(d) AS furthest FROM m WHERE d <= 32768 GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n, coalesce(distance, 0) AS distance, coalesce(furthest, 0) AS furthest FROM documents LEFT JOIN s USING (doc_id)"""


def _matches(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    def one(x: np.ndarray) -> dict:
        at, before = _earlier(x, size)
        d = (at - before)[at - before <= deflate.WINDOW]
        return {"n": len(d), "distance": int(d.sum()), "furthest": int(d.max(initial=0))}

    return _per_text(spark, sf_dir, "struct<n:bigint,distance:bigint,furthest:bigint>", one).select("doc_id", "made.*")


@query(_matches_sql(3))
def prev_trigram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions whose three bytes occurred within the window before, with the nearest distances, over whole texts."""
    return _matches(spark, sf_dir, 3)


@query(_matches_sql(4))
def tag_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for tags of four bytes."""
    return _matches(spark, sf_dir, 4)


@query("SELECT doc_id, k AS block, k * 65535 AS first_byte, least(65535, n - k * 65535) AS size FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, unnest(range(greatest(1, (octet_length(encode(coalesce(text, ''))) + 65534) // 65535))) AS k FROM documents)")
def block_split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at the largest block size; an empty text is one empty block."""
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    blocks = table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / 65535)).cast("bigint"))))
    first = F.col("block") * 65535
    return blocks.select("doc_id", "block", first.alias("first_byte"), F.least(F.lit(65535), F.col("n") - first).alias("size"))


@query(f"WITH {BYTES}, s AS (SELECT doc_id, sum(CASE WHEN v < 144 THEN 8 ELSE 9 END) AS b FROM bytes GROUP BY doc_id) SELECT doc_id, CAST(3 + coalesce(b, 0) + 7 AS BIGINT) AS bits FROM documents LEFT JOIN s USING (doc_id)")
def fixed_block_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of a text as literals of one fixed block: its head, its bytes, the end."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", (3 + 8 * F.octet_length(raw) + high_bytes(raw) + 7).cast("bigint").alias("bits"))


# --- codes -----------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT d, 3 + (d - 1) % 256 AS n FROM (SELECT unnest(range(1, 32769)) AS d)),
  b AS (SELECT n, d, CASE WHEN n = 258 OR n < 7 THEN 0 ELSE length(bin(n - 3)) - 3 END AS le, CASE WHEN d < 3 THEN 0 ELSE length(bin(d - 1)) - 2 END AS de FROM a)
  SELECT n, CAST(CASE WHEN n = 258 THEN 285 ELSE 257 + 4 * le + ((n - 3) >> le) END AS INTEGER) AS length_code, CAST(le AS INTEGER) AS length_extra,
  d, CAST(2 * de + ((d - 1) >> de) AS INTEGER) AS distance_code, CAST(de AS INTEGER) AS distance_extra FROM b""")
def length_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and extra bits of every length and every distance of the format; the SQL has them in closed form."""
    n, d = F.col("n"), F.col("d")
    every = spark.range(1, 32769).select(F.col("id").alias("d"), (3 + (F.col("id") - 1) % 256).alias("n"))
    return every.select("n", scalars.length_code(n).alias("length_code"), scalars.length_extra(n).alias("length_extra"), "d", scalars.distance_code(d).alias("distance_code"), scalars.distance_extra(d).alias("distance_extra"))


@query(f"""WITH {BYTES}, f AS (SELECT v AS symbol, count(*) AS n FROM bytes GROUP BY v),
  r AS (SELECT symbol, row_number() OVER (ORDER BY n DESC, symbol) - 1 AS k FROM f),
  l AS (SELECT symbol, CASE WHEN k < 8 THEN 4 WHEN k < 16 THEN 5 WHEN k < 24 THEN 6 WHEN k < 32 THEN 7 ELSE 12 END AS bits FROM r),
  w AS (SELECT bits, symbol, row_number() OVER (PARTITION BY bits ORDER BY symbol) - 1 AS at, sum(power(2, 12 - bits)) OVER (ORDER BY bits, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
  SELECT symbol, bits, CAST(coalesce(before, 0) / power(2, 12 - bits) AS BIGINT) AS code FROM w""")
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes of byte values whose lengths follow their frequency rank: the codes before fill the same space."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1  # 256 rows at most
    bits = F.when(F.col("k") < 8, 4).when(F.col("k") < 16, 5).when(F.col("k") < 24, 6).when(F.col("k") < 32, 7).otherwise(12)
    own = byte_histogram(spark, sf_dir).withColumn("k", rank).select(F.col("value").alias("symbol"), bits.alias("bits"))
    before = F.coalesce(F.sum(F.pow(F.lit(2), 12 - F.col("bits"))).over(Window.orderBy("bits", "symbol").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select("symbol", "bits", (before / F.pow(F.lit(2), 12 - F.col("bits"))).cast("bigint").alias("code"))


@query("SELECT CAST(k AS BIGINT) AS symbol, CASE WHEN k < 144 THEN 8 WHEN k < 256 THEN 9 WHEN k < 280 THEN 7 ELSE 8 END AS bits FROM (SELECT unnest(range(288)) AS k)")
def fixed_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(288).select(F.col("id").alias("symbol"), scalars.fixed_bits(F.col("id")).alias("bits"))


@query("""WITH RECURSIVE bytes AS (SELECT lang, CAST('0x' || unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS INTEGER) AS v FROM documents),
  f AS (SELECT lang, v, count(*) AS n FROM bytes GROUP BY ALL), w AS (SELECT lang, list_sort(list(n)) AS coins FROM f GROUP BY lang),
  tree AS (SELECT lang, coins AS left_, 0::HUGEINT AS bits FROM w UNION ALL
    SELECT lang, list_sort(list_append(left_[3:], left_[1] + left_[2])), bits + left_[1] + left_[2] FROM tree WHERE len(left_) > 1),
  whole AS (SELECT lang, max(bits) AS bits FROM tree GROUP BY lang),
  merged AS (SELECT lang, coins, coins AS line, 1 AS k FROM w UNION ALL
    SELECT lang, coins, list_sort(list_concat(coins, list_transform(range(len(line) // 2), lambda i: line[2 * i + 1] + line[2 * i + 2]))), k + 1 FROM merged WHERE k < 9)
  SELECT w.lang, len(w.coins)::INTEGER AS symbols, CAST(whole.bits AS BIGINT) AS bits, CAST(list_sum(merged.line[1:2 * len(w.coins) - 2]) AS BIGINT) AS bits_of_nine
  FROM w JOIN whole ON whole.lang IS NOT DISTINCT FROM w.lang JOIN merged ON merged.lang IS NOT DISTINCT FROM w.lang AND k = 9""")
def huffman_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits that the bytes of a language's texts take in their optimal code, and in the best one of nine bits at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n[lang] = n.get(lang, 0) + np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)
        for lang, own in n.items():
            some = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "value", "n"])

    def one(counts: pa.Array) -> pa.Array:
        out = []
        for c in counts.to_pylist():
            cost = lambda lengths: sum(a * b for a, b in zip(c, lengths, strict=True))  # noqa: B023, E731
            out.append({"symbols": len(c), "bits": cost(huffman.code_lengths(c, 255)), "bits_of_nine": cost(huffman.code_lengths(c, 9))})
        return pa.array(out, kind)

    ddl = "struct<symbols:int,bits:bigint,bits_of_nine:bigint>"
    kind = png.arrow_struct(ddl)
    texts = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sums = texts.mapInArrow(counted, "lang string, value int, n bigint").groupBy("lang", "value").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list("n")).alias("n"))  # 256 counts at most
    return whole.select("lang", F.arrow_udf(one, ddl)("n").alias("x")).select("lang", "x.*")


# --- tile statistics ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {rgba_sql()}, d AS (SELECT image_id, y, sqrt(power(r - lag(r) OVER w, 2) + power(g - lag(g) OVER w, 2) + power(b - lag(b) OVER w, 2)) AS d FROM px WINDOW w AS (PARTITION BY image_id, x ORDER BY y))
  SELECT image_id, round(avg(d), 6) AS gradient FROM d GROUP BY image_id""")
def tile_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean length of the vertical step, from one window over scanlines; null for a tile of one scanline, which has none."""
    rows = tiles.gray(spark, sf_dir).withColumn("up", F.lag("row").over(Window.partitionBy("image_id").orderBy("y")))
    step = lambda k: F.sqrt(sum((F.pow(F.get("row", k * 4 + c) - F.get("up", k * 4 + c), F.lit(2)) for c in range(3)), F.lit(0.0)))
    sums = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda a, k: a + step(k))
    return rows.groupBy("image_id").agg(F.round(F.avg(F.when(F.col("up").isNotNull(), sums)) / 16, 6).alias("gradient"))


@query(f"WITH {rgba_sql()} SELECT image_id, count(DISTINCT (r, g, b, a)) AS colours FROM px GROUP BY image_id")
def tile_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = tiles.rgba(spark, sf_dir)
    key = ((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")).cast("bigint") * 256 + F.col("a")
    return px.groupBy("image_id").agg(F.count_distinct(key).alias("colours"))


@query(f"""WITH {rgba_sql()}, c AS (SELECT image_id, 0 AS channel, r AS v FROM px UNION ALL SELECT image_id, 1, g FROM px UNION ALL SELECT image_id, 2, b FROM px UNION ALL SELECT image_id, 3, a FROM px),
  n AS (SELECT image_id, channel, v, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT image_id, channel, sum(n) AS t FROM n GROUP BY ALL)
  SELECT image_id, channel, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM n JOIN t USING (image_id, channel) GROUP BY image_id, channel""")
def channel_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each channel: counts by value, then one sum with the total beside it."""
    px = tiles.rgba(spark, sf_dir).select("image_id", F.posexplode(F.array("r", "g", "b", "a")).alias("channel", "v"))
    n = px.groupBy("image_id", "channel", "v").agg(F.count(F.lit(1)).alias("n"))
    sums = n.groupBy("image_id", "channel").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select("image_id", "channel", F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


@query(f"WITH {OPAQUE}, o AS (SELECT image_id, bool_and(a = 255) AS opaque, count(*) AS n FROM px GROUP BY image_id), p AS ({'WITH ' + BINARY} SELECT image_id, bool_and(a = 255) AS binary_opaque FROM px GROUP BY image_id) SELECT image_id, opaque, binary_opaque, n FROM o JOIN p USING (image_id)")
def opaque_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an alpha channel can go: of opaque tiles and of tiles with binary alpha."""
    one = tiles.rgba(spark, sf_dir, "opaque").groupBy("image_id").agg(F.bool_and(F.col("a") == 255).alias("opaque"), F.count(F.lit(1)).alias("n"))
    two = tiles.rgba(spark, sf_dir, "binary").groupBy("image_id").agg(F.bool_and(F.col("a") == 255).alias("binary_opaque"))
    return one.join(two, "image_id")


@query(f"WITH {rgba_sql()} SELECT image_id, bool_and(r = g AND g = b) AS gray, count(*) FILTER (WHERE r = g AND g = b) AS gray_pixels FROM px GROUP BY image_id")
def gray_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    return tiles.rgba(spark, sf_dir).groupBy("image_id").agg(F.bool_and(gray).alias("gray"), F.count_if(gray).alias("gray_pixels"))


@query(f"WITH {QUANT} SELECT image_id, CASE WHEN bool_and(v % 255 = 0) THEN 1 WHEN bool_and(v % 85 = 0) THEN 2 WHEN bool_and(v % 17 = 0) THEN 4 ELSE 8 END AS depth FROM px GROUP BY image_id")
def depth_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest bits for a gray tile."""
    rows = tiles.quantised(spark, sf_dir)
    fits = lambda m: F.bool_and(F.forall("row", lambda v: v % m == 0))
    return rows.groupBy("image_id").agg(F.when(fits(255), 1).when(fits(85), 2).when(fits(17), 4).otherwise(8).alias("depth"))


@query(f"WITH {rgba_sql()} SELECT image_id, y, x, CASE WHEN a = 0 THEN 0 ELSE r * 257 END AS r, CASE WHEN a = 0 THEN 0 ELSE g * 257 END AS g, CASE WHEN a = 0 THEN 0 ELSE b * 257 END AS b, a * 257 AS a FROM (SELECT image_id, y, x, r, g, b, CASE WHEN a % 5 = 0 THEN 0 ELSE a END AS a FROM px)")
def canonical_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit RGBA; wholly transparent pixels are zero."""
    px = tiles.rgba(spark, sf_dir).withColumn("a", F.when(F.col("a") % 5 == 0, 0).otherwise(F.col("a")))
    wide = lambda c: F.when(F.col("a") == 0, 0).otherwise(scalars.to_16_bits(F.col(c), 255)).cast("int").alias(c)
    return px.select("image_id", "y", F.col("x").cast("bigint").alias("x"), wide("r"), wide("g"), wide("b"), (F.col("a") * 257).alias("a"))


@query(f"WITH {BINARY}, n AS (SELECT image_id, count(*) FILTER (WHERE a = 0) AS cleared, count(DISTINCT CASE WHEN a = 0 THEN 0 ELSE r * 65536 + g * 256 + b END) AS colours FROM px GROUP BY image_id) SELECT * FROM n")
def transparent_zeroing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels whose colour is cleared, and the colours that are left."""
    px = tiles.rgba(spark, sf_dir, "binary")
    colour = F.when(F.col("a") == 0, 0).otherwise(F.col("r") * 65536 + F.col("g") * 256 + F.col("b"))
    return px.groupBy("image_id").agg(F.count_if(F.col("a") == 0).alias("cleared"), F.count_distinct(colour).alias("colours"))


@query(f"WITH {BINARY}, c AS (SELECT DISTINCT image_id, g FROM px WHERE a <> 0), every AS (SELECT image_id, k FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(256)) AS k)) SELECT image_id, min(k)::BIGINT AS gray_key FROM every e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.image_id = e.image_id AND c.g = e.k) GROUP BY image_id")
def unused_colour_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least gray value that no visible pixel has; images that use all 256 have none."""
    used = tiles.rgba(spark, sf_dir, "binary").where("a <> 0").select("image_id", F.col("g").cast("bigint").alias("k")).distinct()
    every = tiles.gray(spark, sf_dir).select("image_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    return every.join(used, ["image_id", "k"], "left_anti").groupBy("image_id").agg(F.min("k").alias("gray_key"))


# --- palettes ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {QUANT}, f AS (SELECT image_id, v, min(y * 64 + x) AS first, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS index, n FROM f")
def palette_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours numbered by their first occurrence."""
    px = tiles.quantised(spark, sf_dir).select("image_id", "y", F.posexplode("row").alias("x", "v"))
    f = px.groupBy("image_id", "v").agg(F.min(F.col("y") * 64 + F.col("x")).alias("first"), F.count(F.lit(1)).alias("n"))
    return f.select("image_id", "v", (F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1).cast("bigint").alias("index"), "n")


@query(f"WITH {QUANT} SELECT image_id, count(DISTINCT v) AS entries, CASE WHEN count(DISTINCT v) <= 2 THEN 1 WHEN count(DISTINCT v) <= 4 THEN 2 WHEN count(DISTINCT v) <= 16 THEN 4 ELSE 8 END AS depth FROM px GROUP BY image_id")
def palette_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in use and the depth that they need."""
    px = tiles.quantised(spark, sf_dir).select("image_id", F.explode(F.array_distinct("row")).alias("v"))
    n = px.groupBy("image_id").agg(F.count_distinct("v").alias("entries"))
    return n.withColumn("depth", F.when(F.col("entries") <= 2, 1).when(F.col("entries") <= 4, 2).when(F.col("entries") <= 16, 4).otherwise(8))


@query(f"WITH {QUANT}, f AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL) SELECT image_id, v, n, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, v) - 1 AS place FROM f")
def palette_frequency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by use, of equal ones the darker first."""
    f = tiles.quantised(spark, sf_dir).select("image_id", F.explode("row").alias("v")).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    light = scalars.luminance(F.col("v"), F.col("v"), F.col("v"))
    return f.select("image_id", "v", "n", (F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), light, "v")) - 1).cast("bigint").alias("place"))


@query(f"""WITH {QUANT}, e AS (SELECT image_id, v, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS w FROM px UNION ALL SELECT image_id, v, lead(v) OVER (PARTITION BY image_id, x ORDER BY y) FROM px)
  SELECT image_id, least(v, w) AS u, greatest(v, w) AS w, least(count(*), 65535) AS weight FROM e WHERE w IS NOT NULL AND v <> w GROUP BY 1, 2, 3""")
def palette_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two entries are neighbours: pairs within a scanline and with the one below, counted in arrays first."""
    rows = tiles.quantised(spark, sf_dir).withColumn("below", F.lead("row").over(Window.partitionBy("image_id").orderBy("y")))
    across = F.zip_with(F.slice("row", 1, 63), F.slice("row", 2, 63), lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")))
    down = F.zip_with("row", F.coalesce("below", F.col("row")), lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")))
    pairs = rows.select("image_id", F.explode(F.concat(across, down)).alias("e")).where("e.u <> e.w")
    return pairs.groupBy("image_id", "e.u", "e.w").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("weight"))


@query(f"""WITH {GRAY}, p AS (SELECT image_id, y * 64 + x AS p, v FROM px), o AS (SELECT unnest([1, 2, 3, 4, 60, 61, 62, 63, 64, 65, 66, 67, 68, 124, 125, 126, 127, 128, 129, 130, 131, 132]) AS d)
  SELECT a.image_id, CAST(d AS INTEGER) AS d, count(*) AS hits FROM p a, o, p b WHERE b.image_id = a.image_id AND b.p = a.p - d AND b.v = a.v GROUP BY 1, 2""")
def stride_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal bytes at near and row distances of an image's bytes: one window over scanlines gives both rows above."""
    w = Window.partitionBy("image_id").orderBy("y")
    blank = F.transform("row", lambda v: v * 0 - 1)
    rows = tiles.gray(spark, sf_dir).withColumns({"one": F.coalesce(F.lag("row").over(w), blank), "two": F.coalesce(F.lag("row", 2).over(w), blank), "three": F.coalesce(F.lag("row", 3).over(w), blank)})
    rows = rows.withColumn("past", F.concat("three", "two", "one", "row"))
    offsets = [1, 2, 3, 4, *range(60, 69), *range(124, 133)]
    hits = lambda d: F.size(F.filter(F.sequence(F.lit(192), F.lit(255)), lambda i: F.get("past", i) == F.get("past", i - d)))
    each = rows.select("image_id", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), hits(d).alias("hits")) for d in offsets])).alias("h"))
    return each.groupBy("image_id", "h.d").agg(F.sum("h.hits").cast("bigint").alias("hits")).where("hits > 0")


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, event_type, n - k AS g, count(*) AS len, min(n) AS first FROM o GROUP BY ALL) SELECT user_id, event_type, first, len FROM r""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of a user in time order (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(w).cast("bigint").alias("n"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("k"))
    return o.groupBy("user_id", "event_type", (F.col("n") - F.col("k")).alias("g")).agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("len")).drop("g")


# --- candidates -------------------------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost table: uniform filters of gray (variant 0) and quantised (variant 1) tiles."""
    parts = []
    for v, rows in enumerate((tiles.gray(spark, sf_dir), tiles.quantised(spark, sf_dir))):
        sums = tiles.cost_vectors(rows).groupBy("image_id").agg(*[F.sum(F.col("costs")[k]).alias(f"c{k}") for k in range(5)], F.count(F.lit(1)).alias("h"))
        parts.append(sums.select("image_id", F.lit(v).alias("variant_id"), (F.col("h") * 64).alias("bytes"), F.posexplode(F.array(*[f"c{k}" for k in range(5)])).alias("k", "proxy")))
    return parts[0].unionByName(parts[1]).select("image_id", "variant_id", "bytes", (F.col("variant_id") * 5 + F.col("k")).alias("ordinal"), "proxy")


def _candidates_sql() -> str:
    one = lambda rel: RESIDUALS.replace(GRAY, rel)
    part = lambda rel, v: f"SELECT * FROM (WITH {one(rel)} SELECT image_id, {v} AS variant_id, CAST(ft AS INTEGER) + {5 * v} AS ordinal, CAST(sum(CASE WHEN d > 127 THEN 256 - d ELSE d END) AS BIGINT) AS proxy FROM residuals GROUP BY ALL)"
    return f"cand AS ({part(GRAY, 0)} UNION ALL {part(QUANT, 1)}), rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY proxy, ordinal) AS rank FROM cand)"


@query(f"WITH {_candidates_sql()} SELECT image_id, variant_id, ordinal, proxy, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 4")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four cheapest candidates of each image."""
    return optimise.ranked(_candidates(spark, sf_dir)).where("rank <= 4").select("image_id", "variant_id", "ordinal", "proxy", "rank")


@query(f"""WITH {_candidates_sql()}, t AS (SELECT image_id, count(DISTINCT variant_id) AS n, any_value(variant_id) AS v FROM rk WHERE rank <= 4 GROUP BY image_id),
  o AS (SELECT rk.image_id, min(rank) AS other FROM rk JOIN t USING (image_id) WHERE variant_id <> v GROUP BY rk.image_id)
  SELECT image_id, variant_id, ordinal, proxy, CAST(rank AS INTEGER) AS rank FROM rk JOIN t USING (image_id) LEFT JOIN o USING (image_id)
  WHERE CASE WHEN n = 1 AND other IS NOT NULL THEN rank < 4 OR rank = other ELSE rank <= 4 END""")
def candidate_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finalists: of candidates of one variant alone the last gives way to the best of another."""
    return optimise.finalists(_candidates(spark, sf_dir)).select("image_id", "variant_id", "ordinal", "proxy", "rank")


@query(f"""WITH {_candidates_sql()}, h AS (SELECT image_id, count(*) * 64 * CASE image_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 4000 END AS bytes FROM (WITH {GRAY_ROWS} SELECT image_id FROM rows) GROUP BY image_id),
  c AS (SELECT rk.*, CASE WHEN bytes >= 1048576 THEN 2 WHEN bytes >= 262144 THEN 3 ELSE 4 END AS k FROM rk JOIN h USING (image_id)),
  t AS (SELECT image_id, count(DISTINCT variant_id) AS n, any_value(variant_id) AS v FROM c WHERE rank <= k GROUP BY image_id),
  o AS (SELECT c.image_id, min(rank) AS other FROM c JOIN t USING (image_id) WHERE variant_id <> v GROUP BY c.image_id)
  SELECT image_id, variant_id, ordinal, proxy, CAST(rank AS INTEGER) AS rank FROM c JOIN t USING (image_id) LEFT JOIN o USING (image_id)
  WHERE CASE WHEN n = 1 AND other IS NOT NULL THEN rank < k OR rank = other ELSE rank <= k END""")
def finalist_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finalists of images of all size classes: tiles that count as they are, a thousand or four thousand times as large."""
    times = F.when(F.col("image_id") % 3 == 0, 1).when(F.col("image_id") % 3 == 1, 1000).otherwise(4000)
    return optimise.finalists(_candidates(spark, sf_dir).withColumn("bytes", F.col("bytes") * times)).select("image_id", "variant_id", "ordinal", "proxy", "rank")


@query(f"WITH {GRAY_ROWS}, q AS (SELECT image_id, y, line, list_transform(line, lambda v: v // 17 * 17) AS quant FROM rows), m AS (SELECT image_id, bool_and(line = quant) AS same FROM q GROUP BY image_id) SELECT image_id, CAST(CASE WHEN same THEN 1 ELSE 2 END AS BIGINT) AS variants, 3::BIGINT AS built FROM m")
def variant_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of a tile (as it is, quantised, quantised twice), told apart by their bytes."""
    bytes_of = lambda r: F.sha2(F.concat_ws(",", F.transform(r, lambda v: v.cast("string"))), 256)
    again = lambda r: F.transform(r, lambda v: (F.floor(v / 17) * 17).cast("int"))
    own = tiles.gray(spark, sf_dir)
    marks = own.select("image_id", "y", F.posexplode(F.array(bytes_of(F.col("row")), bytes_of(again("row")), bytes_of(again(again("row"))))).alias("variant", "mark"))
    whole = marks.groupBy("image_id", "variant").agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("y", "mark"))), lambda s: s["mark"])), 256).alias("mark"))
    return whole.groupBy("image_id").agg(F.count_distinct("mark").alias("variants"), F.count(F.lit(1)).alias("built"))


@query("SELECT 1 AS level, 3::BIGINT AS strategies UNION ALL SELECT 5, 6 UNION ALL SELECT 9, 35")
def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [optimise.strategy_table(spark, k).agg(F.lit(k).alias("level"), F.count(F.lit(1)).alias("strategies")) for k in (1, 5, 9)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PASSES = ", ".join(f"({k}, {x0}, {y0}, {dx}, {dy})" for k, (x0, y0, dx, dy) in enumerate(model.ADAM7))


@query(f"""WITH {GRAY}, t(pass, x0, y0, dx, dy) AS (VALUES {_PASSES}) SELECT image_id, CAST(pass AS INTEGER) AS pass, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total,
  CAST(sum(v * ((y - y0) // dy * 64 + (x - x0) // dx)) AS BIGINT) AS moment FROM px, t WHERE x >= x0 AND y >= y0 AND (x - x0) % dx = 0 AND (y - y0) % dy = 0
  AND NOT EXISTS (SELECT 1 FROM t s WHERE s.pass < t.pass AND x >= s.x0 AND y >= s.y0 AND (x - s.x0) % s.dx = 0 AND (y - s.y0) % s.dy = 0) GROUP BY image_id, pass""")
def adam7_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each interlace pass with their place in it; the pass follows from the coordinates."""
    px = tiles.gray(spark, sf_dir).select("image_id", "y", F.posexplode("row").alias("x", "v"))
    number, across, down = F.lit(None), F.lit(None), F.lit(None)
    for k, (x0, y0, dx, dy) in reversed(list(enumerate(model.ADAM7))):
        here = (F.col("x") >= x0) & (F.col("y") >= y0) & ((F.col("x") - x0) % dx == 0) & ((F.col("y") - y0) % dy == 0)
        number, across, down = F.when(here, k).otherwise(number), F.when(here, F.floor((F.col("x") - x0) / dx)).otherwise(across), F.when(here, F.floor((F.col("y") - y0) / dy)).otherwise(down)
    moved = px.select("image_id", "v", number.alias("pass"), (down * 64 + across).alias("place"))
    return moved.groupBy("image_id", "pass").agg(F.count(F.lit(1)).alias("pixels"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("place")).alias("moment"))


# --- files ---------------------------------------------------------------------------------------------------------------------------


def tile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): each gray tile as a PNG file."""

    def encode(rows: pa.Array) -> pa.Array:
        out = []
        for r in rows.to_pylist():
            x = np.array(r, np.uint8)
            out.append(writer.write(model.Image(x.shape[1], x.shape[0], 8, model.GRAY, x.tobytes())))
        return pa.array(out, pa.binary())

    whole = tiles.gray(spark, sf_dir).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda s: s["row"]).alias("rows"))
    return whole.select("image_id", F.arrow_udf(encode, "binary")("rows").alias("content"))


@query(f"WITH {GRAY_ROWS}, i AS (SELECT image_id, count(*) AS h FROM rows GROUP BY image_id) SELECT image_id, CAST(t.seq AS INTEGER) AS seq, t.type, true AS crc_ok, t.critical, CASE WHEN t.type = 'IHDR' THEN 64::BIGINT END AS width, CASE WHEN t.type = 'IHDR' THEN h END AS height FROM i, (VALUES (0, 'IHDR', true), (1, 'IDAT', true), (2, 'IEND', true)) t(seq, type, critical)")
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the encoded tiles, their class, and the header's fields read by column functions."""
    own = png.chunk_table(tile_files(spark, sf_dir), "image_id")
    fields = scalars.header(F.col("data"))
    ihdr = lambda n: F.when(F.col("type") == "IHDR", fields[n]).alias(n)
    return own.select("image_id", "seq", "type", "crc_ok", scalars.class_bits(F.col("type"))["critical"].alias("critical"), ihdr("width"), ihdr("height"))


@query(f"WITH {GRAY} SELECT image_id, y, x, v FROM px")
def decode_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the encoded tiles, decoded again."""
    back = png.images(tile_files(spark, sf_dir)).select("image_id", "image.width", F.col("image.pixels").alias("p"))
    values = F.transform(F.sequence(F.lit(1), F.octet_length("p")), lambda k: F.conv(F.hex(F.substring(F.col("p"), k, F.lit(1))), 16, 10).cast("int"))
    px = back.select("image_id", "width", F.posexplode(values).alias("k", "v"))
    return px.select("image_id", F.floor(F.col("k") / F.col("width")).alias("y"), (F.col("k") % F.col("width")).alias("x"), "v")
