"""Relations derived from the supplied tables, as scanlines in arrays: a row stays a row until a result needs its pixels.

Neighbours above come from one window over scanlines; residuals, sums and entropies are array expressions on a
scanline, so no plan multiplies the data by its pixels before it aggregates. A tile takes the vectors of a label from a
range of TALL ids: tiles grow in number with the data, never in size, and so do the windows over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.functions import scalars

WIDTH, TALL = 64, 320


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, row): 64 gray samples of each vector; vectors of a label and a range of ids make an image."""
    v = lambda e: F.greatest(F.least(F.floor((e.cast("double") + 1) * 127.5), F.lit(255)), F.lit(0)).cast("int")
    tile = F.col("label").cast("bigint") * (1 << 32) + F.floor(F.col("vec_id") / TALL)
    y = F.row_number().over(Window.partitionBy("image_id").orderBy("vec_id")).cast("bigint") - 1
    rows = table(spark, sf_dir, "embeddings").select(tile.alias("image_id"), "vec_id", F.transform("embedding", v).alias("row"))
    return rows.select("image_id", y.alias("y"), "row")


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 16 levels."""
    return gray(spark, sf_dir).withColumn("row", F.transform("row", lambda v: (F.floor(v / 17) * 17).cast("int")))


def rgba(spark: SparkSession, sf_dir: str, alpha: str = "own") -> DataFrame:
    """(image_id, y, x, r, g, b, a): scanlines read as 16 pixels. alpha: own, opaque, or binary (by parity)."""
    px = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WIDTH // 4 - 1)), lambda k: F.slice("row", k * 4 + 1, 4))).alias("x", "p")
    rows = gray(spark, sf_dir).select("image_id", "y", px)
    a = {"own": F.col("p")[3], "opaque": F.lit(255), "binary": F.when(F.col("p")[3] % 2 == 0, 0).otherwise(255)}[alpha]
    return rows.select("image_id", "y", "x", F.col("p")[0].alias("r"), F.col("p")[1].alias("g"), F.col("p")[2].alias("b"), a.alias("a"))


def with_above(rows: DataFrame) -> DataFrame:
    above = F.lag("row").over(Window.partitionBy("image_id").orderBy("y"))
    return rows.withColumn("up", F.coalesce(above, F.transform("row", lambda v: v * 0)))


def residual(kind: int, bpp: int = 1) -> Column:
    """The residual bytes of a scanline (columns row and up) under a filter."""
    at = lambda c, i: F.when(i < 0, 0).otherwise(F.get(F.col(c), i))

    def one(v: Column, i: Column) -> Column:
        left, up, corner = at("row", i - bpp), F.get(F.col("up"), i), at("up", i - bpp)
        predicted = (F.lit(0), left, up, F.floor((left + up) / 2), scalars.paeth(left, up, corner))[kind]
        return F.pmod(v - predicted, F.lit(256)).cast("int")

    return F.transform("row", one)


def residuals(rows: DataFrame) -> DataFrame:
    """(image_id, y, ft, d): five rows for each scanline."""
    each = F.array(*[F.struct(F.lit(k).alias("ft"), residual(k).alias("d")) for k in range(5)])
    return with_above(rows).select("image_id", "y", F.explode(each).alias("f")).select("image_id", "y", "f.ft", "f.d")


def total(values: Column, of: object = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + of(v))


def row_costs(rows: DataFrame) -> DataFrame:
    """(image_id, y, ft, cost): sums of signed magnitudes."""
    return residuals(rows).select("image_id", "y", "ft", total(F.col("d"), scalars.magnitude).alias("cost"))


def cost_vectors(rows: DataFrame) -> DataFrame:
    """(image_id, y, costs): the five sums of a scanline in one array."""
    return with_above(rows).select("image_id", "y", F.array(*[total(residual(k), scalars.magnitude) for k in range(5)]).alias("costs"))


def entropy(values: Column) -> Column:
    """Shannon entropy of an array, in bits a value, to 6 places: one fold over the sorted values, which sums n log n of their runs."""
    n = F.size(values)
    term = lambda run: F.when(run > 1, run * F.log2(run)).otherwise(0.0)
    start = F.struct(F.lit(None).cast("int").alias("v"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, v: Column) -> Column:
        same = F.coalesce(a["v"] == v, F.lit(False))
        return F.struct(v.cast("int").alias("v"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), F.when(same, a["sum"]).otherwise(a["sum"] + term(a["run"])).alias("sum"))

    return F.round(F.aggregate(F.array_sort(values), start, step, lambda a: F.log2(n) - (a["sum"] + term(a["run"])) / n), 6)


def cheapest_path(costs: Column, penalty: int) -> Column:
    """struct(total, path) of the cheapest filters over an array of cost vectors; ties go to the lower filter."""
    states = range(5)
    path = F.lit(None).cast("array<int>")
    start = F.struct(F.array(*[F.lit(0).cast("bigint")] * 5).alias("c"), F.array(*[F.array().cast("array<int>")] * 5).alias("p"))

    def step(acc: Column, own: Column) -> Column:
        fresh = F.size(acc["p"][0]) == 0
        came = []
        for k in states:
            options = F.array(*[F.struct((acc["c"][j] + F.when(fresh | F.lit(j == k), 0).otherwise(penalty)).alias("v"), F.lit(j).alias("j")) for j in states])
            came.append(F.array_min(options))
        total_ = F.array(*[came[k]["v"] + own[k] for k in states])
        paths = F.array(*[F.concat(F.get(acc["p"], came[k]["j"]), F.array(F.lit(k))) for k in states])
        return F.struct(total_.alias("c"), paths.alias("p"))

    def last(acc: Column) -> Column:
        best = F.array_min(F.array(*[F.struct(acc["c"][k].alias("v"), F.lit(k).alias("k")) for k in states]))
        return F.struct(best["v"].alias("total"), F.coalesce(F.get(acc["p"], best["k"]), path).alias("path"))

    return F.aggregate(costs, start, step, last)
