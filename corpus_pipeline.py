"""A corpus pipeline of five stages over ``documents``: quality, language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and hands them to the next. All stages but the last return the columns they were given, so columns
beyond those of ``documents`` are carried along. Rows are told apart by their values: equal rows meet equal decisions,
a null doc_id is a row like any other, a null text is an empty one. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import language, packing, pii, quality, simhash
from pixelweave.llm.common import read, staged, text_or_empty


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below one half; it never learns from the held-out third of the labels."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), allowed=lambda key: quality.remainder(key, 3) != 1)
    return docs.where(quality.scores(model, text_or_empty()) >= 0.5)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the language found and drops documents without any."""
    keys = ["doc_id", "source", "mark"]
    mark = F.xxhash64(text_or_empty())
    rows = language.from_documents(docs).withColumns({"source": F.col("host"), "mark": F.xxhash64("text")})
    found = language.identified(rows, language.trained(docs), keys).where("lang <> 'und'")
    found = found.groupBy(*keys).agg(F.first("lang").alias("found"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("mark"))
    same = whole["row.doc_id"].eqNullSafe(found["doc_id"]) & whole["row.source"].eqNullSafe(found["source"]) & (whole["mark"] == found["mark"])
    return whole.join(found, same).select(*[found["found"].alias("lang") if c == "lang" else whole["row"][c].alias(c) for c in docs.columns])


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles, resemblance of 0.8 or more), that with the least doc_id."""
    return simhash.first_alike(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    clean = docs.withColumn("text", pii.redaction(pii.train(docs), F.col("text")))
    return clean.withColumn("n_chars", F.length(text_or_empty()).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; a row for each piece."""
    return packing.packed(staged(packing.pieces(docs), "pieces"))


STAGES = [("quality", keep_quality), ("language", keep_languages), ("near_duplicates", keep_first_copies), ("personal_data", redact), ("packing", pack)]

#: No SQL expresses the trained stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
