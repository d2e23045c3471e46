"""Language identification by Bayesian evidence fusion.

Three kinds of evidence meet in one posterior over LANGUAGES: the likelihood of the whole text under byte-trigram
models counted over all labelled documents; the language that the markup declares, with a reliability counted over all rows; and a prior
of the host, smoothed hierarchically by its site (the part of the name that is registered), its address suffix and all rows, from grouped sums of the text-only posteriors (a row's own
part is taken out of its host's). A row's trigrams overlap, so their log-likelihood is scaled by SCALE. Host priors are joined salted,
since one host may have a third of all rows.

Null and empty texts have no text evidence; rows without host, suffix or declaration have that evidence neutral. A text that fits no model
(mean log-likelihood of a trigram under FLOOR) or has fewer than LEAST trigrams with letters is ``und``. Repeated rows count as often as
they occur; labels outside LANGUAGES teach nothing; extra columns are ignored; texts of any length are read whole, and an empty table gives no rows.
Of languages with equal posteriors the first of LANGUAGES is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import SUB_BATCH, read, staged, text_or_empty

LANGUAGES = ("de", "en", "es", "fr")
CELLS = 1 << 15
SCALE, FLOOR, LEAST = 0.3, -9.5, 1
#: Weight of the level above in a level's prior, in rows.
ABOVE = 20.0
SALTS = 32


def _folding() -> np.ndarray:
    """Bytes to letters: A-Z as a-z, other ASCII as a space, others as they are."""
    table = np.arange(256)
    table[:128] = 32
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    return table.astype(np.uint32)


_FOLD = _folding()


def trigrams(text: str) -> np.ndarray:
    """Cells of the trigrams that have a letter."""
    x = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(x) < 3:
        return np.empty(0, np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    code = (a << np.uint32(16)) | (b << np.uint32(8)) | c
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def trained(docs: DataFrame, text: str = "text", label: str = "lang") -> np.ndarray:
    """Log-probabilities, a row for each language, counted over all rows that have one of LANGUAGES as their label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LANGUAGES), CELLS), np.int64)
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = trigrams(t)
                if len(found):
                    counts[LANGUAGES.index(lang)] += np.bincount(found, minlength=CELLS)
        lang, cell = np.nonzero(counts)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(counts[lang, cell])], names=["lang", "cell", "n"])

    rows = docs.select(F.col(label).alias("lang"), text_or_empty(text).alias("text")).where(F.col("lang").isin(*LANGUAGES))
    sums = rows.mapInArrow(run, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.full((len(LANGUAGES), CELLS), 0.5)
    found = sums.toArrow()  # at most languages times cells rows
    counts[found["lang"].to_numpy(), found["cell"].to_numpy()] += found["n"].to_numpy()
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def evidence(model: np.ndarray, text: Column) -> Column:
    """struct(ll, n): the summed log-likelihood by language, and the number of trigrams."""
    both = np.ascontiguousarray(model.T)

    def run(texts: pa.Array) -> pa.Array:
        ll, n = [], []
        for at in range(0, len(texts), SUB_BATCH):
            for t in texts.slice(at, SUB_BATCH).to_pylist():
                found = trigrams(t or "")
                ll.append(both[found].sum(0, dtype=np.float64).round(6).tolist())
                n.append(len(found))
        return pa.StructArray.from_arrays([pa.array(ll, pa.list_(pa.float64())), pa.array(n, pa.int64())], ["ll", "n"])

    return F.arrow_udf(run, "struct<ll:array<double>,n:bigint>")(text)


def _normal(logs: Column) -> Column:
    """Probabilities of an array of log-weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def _sums(df: DataFrame, by: list[str], p: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(F.col(p)[k]).alias(f"{p}{k}") for k in range(len(LANGUAGES))])


def _array(p: str) -> Column:
    return F.array(*[F.col(f"{p}{k}") for k in range(len(LANGUAGES))])


def _smoothed(own: Column, above: Column) -> Column:
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
    return F.zip_with(own, above, lambda a, b: (F.greatest(a, F.lit(0.0)) + ABOVE * b) / (total + ABOVE))


def identified(rows: DataFrame, model: np.ndarray, keys: list[str]) -> DataFrame:
    """rows: keys, text, declared, host, site, suffix (each may be null). Adds text_lang, lang and posterior, drops the rest."""
    none = F.lit("")
    seen = rows.select(*keys, "declared", *[F.coalesce(c, none).alias(c) for c in ("host", "site", "suffix")], evidence(model, text_or_empty()).alias("e"))
    scaled = F.transform(F.col("e.ll"), lambda v: v * SCALE)
    seen = staged(seen.select(*keys, "declared", "host", "site", "suffix", scaled.alias("ll"), F.col("e.n").alias("n"), (F.array_max("e.ll") / F.greatest("e.n", F.lit(1))).alias("fit")), "evidence")
    p = F.when(F.col("n") >= LEAST, _normal(F.col("ll"))).otherwise(F.array(*[F.lit(1 / len(LANGUAGES))] * len(LANGUAGES)))
    seen = seen.withColumn("p", p)

    # reliability of declarations: agreement with the text, over all rows
    said = [F.sum(F.when(F.col("declared") == x, F.col("p")[k])) for k, x in enumerate(LANGUAGES)]
    right, told = seen.where(F.col("declared").isin(*LANGUAGES)).agg(sum((F.coalesce(s, F.lit(0.0)) for s in said), F.lit(0.0)), F.count(F.lit(1))).first()
    trust = min(0.999, ((right or 0) + 9) / (told + 10))
    declared = F.array(*[F.when(F.col("declared") == x, F.lit(float(np.log(trust)))).when(F.col("declared").isin(*LANGUAGES), F.lit(float(np.log((1 - trust) / (len(LANGUAGES) - 1))))).otherwise(F.lit(0.0)) for x in LANGUAGES])

    # host, site, suffix, all rows: a prior of each, smoothed by the level above
    hosts = staged(_sums(seen.where("host <> ''"), ["host", "site", "suffix"], "p"), "hosts")
    whole = _sums(seen, [], "p").first()
    sums = [float(v or 0) + 1 for v in whole]
    every = F.array(*[F.lit(v / sum(sums)) for v in sums])
    flat = lambda df, by: df.groupBy(*by).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(len(LANGUAGES))])
    suffixes = flat(hosts, ["suffix"]).select("suffix", _smoothed(_array("p"), every).alias("by_suffix"))
    sites = flat(hosts, ["site", "suffix"]).join(suffixes, "suffix").select("site", "suffix", _smoothed(_array("p"), F.col("by_suffix")).alias("by_site"))
    priors = hosts.select("host", "site", "suffix", _array("p").alias("own")).join(sites, ["site", "suffix"]).select("host", "site", "suffix", "own", "by_site")
    priors = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    met = salted.join(priors, ["host", "site", "suffix", "salt"], "left")
    without = F.zip_with("own", "p", lambda a, b: a - b)
    prior = F.when(F.col("own").isNotNull(), _smoothed(without, F.col("by_site"))).otherwise(every)
    fused = F.transform(F.arrays_zip(F.col("ll").alias("ll"), prior.alias("prior"), declared.alias("said")), lambda v: v["ll"] + F.log(v["prior"]) + v["said"])
    post = _normal(fused)
    met = met.withColumn("post", post)
    name = lambda c: F.element_at(F.array(*map(F.lit, LANGUAGES)), F.array_position(c, F.array_max(c)).cast("int"))
    vague = (F.col("n") < LEAST) | (F.col("fit") < FLOOR)
    return met.select(*keys, "declared", F.when(vague, "und").otherwise(name(F.col("p"))).alias("text_lang"), F.when(vague, "und").otherwise(name(F.col("post"))).alias("lang"), F.round(F.array_max("post"), 6).alias("posterior"))


_TAG = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def site_of(host: Column) -> Column:
    """The last two labels of a host, or three where a generic label stands before a country's; hosts of fewer labels as they are."""
    parts = F.split(host, r"\.")
    generic = host.rlike(r"\.(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}$")
    wanted = F.when(generic, 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - wanted + 1, F.lit(1)), wanted), ".")


def from_pages(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), _TAG, " ").alias("text"), F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", 1)), F.lit("")).alias("declared"), host.alias("host"))
    return rows.withColumn("site", site_of(F.col("host"))).withColumn("suffix", F.element_at(F.split("host", r"\."), -1))


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents have a source in a host's place; markup in their text may declare a language."""
    declared = F.nullif(F.lower(F.regexp_extract(text_or_empty(), r"(?i)<html[^<>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2})", 1)), F.lit(""))
    return docs.select("doc_id", text_or_empty().alias("text"), declared.alias("declared"), F.col("source").alias("host"), F.col("source").alias("site"), F.lit("").alias("suffix"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = trained(docs)
    kept = ["doc_id", "page_id"]
    by_doc = from_documents(docs).withColumn("page_id", F.lit(None).cast("bigint"))
    by_page = from_pages(read(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("bigint"))
    return identified(by_doc.unionByName(by_page), model, kept)
