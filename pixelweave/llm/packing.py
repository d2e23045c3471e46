"""Packing: token pieces into sequences of at most SIZE tokens, shortest pack first over the length histogram.

Documents are cut at SIZE tokens, so only their last pieces have other lengths and the histogram has SIZE bins at
most. Lengths are placed longest first into the pack pattern with the most room (the shortest pack), which is kept as
a pattern and a count. Where nothing open has room, fresh packs take as many pieces of the length as fit, so many
short pieces fill packs too. Every bin opens two patterns and splits one at most, so there are 3 * SIZE patterns at most,
whatever the number of documents. Patterns are joined back to pieces by their rank among pieces of equal length. The
rank is counted within salted parts and shifted by the parts before, so a length that a third of all pieces have is
spread evenly. A null or empty text is its end token alone. Repeated rows are packed as often as they occur, ranked
by doc_id (nulls first) and start; extra columns are ignored. A text of any length is encoded whole, and an empty
table gives no pieces. Ids are those of the vocabulary file's own library: names of its special tokens in a text are
these tokens.
"""

from __future__ import annotations

import array
import functools
import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import map_arrow, partitions, read, staged, text_or_empty

SIZE = 1024
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a ``tokenizers`` file, whole texts at once; names of its added tokens are these tokens.

    Its vocabulary is in the order of its merges, so ids are ranks and give the same ids as the file's own library
    (a test compares them) in a fraction of the time.
    """
    whole = json.loads(Path(path).read_text())
    model, added = whole["model"], {t["content"]: t["id"] for t in whole["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in whole["added_tokens"]):
        raise ValueError(f"{path}: added tokens that take more than their own name")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    ranks = {bytes(map(byte.__getitem__, t)): k for t, k in model["vocab"].items() if t not in added}
    return tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and its end token, cut at ``size``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        encode = functools.partial(encoder(vocabulary).encode, allowed_special="all")
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = array.array("I", [*encode(text), 0]).tobytes()
            n = len(ids) // 4
            for at in range(0, n, size):
                part = ids[4 * at : 4 * (at + size)]
                rows.append((k, at, len(part) // 4, zlib.crc32(part), n))
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(df.select(F.col(key).cast("bigint"), text_or_empty(text)), run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", rows=256)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a pack, number of such packs): each length goes, longest first, to the packs with the most room."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)  # by free tokens
    widest = 0
    done = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while widest and not room[widest]:
                widest -= 1
            copies = 1
            if widest < length:
                copies = min(size // length, left)
                pack, n = [], left // copies
            else:
                pack, held = room[widest].pop()
                n = min(held, left)
                if held > n:
                    room[widest].append((pack, held - n))
            left -= n * copies
            pack = [*pack, *[length] * copies]
            free = size - sum(pack)
            if free:
                room[free].append((pack, n))
                widest = max(widest, free)
            else:
                done.append((pack, n))
    return done + [p for free in sorted(room) for p in room[free]]


def slots(packs: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first ranks of its runs of slots, the sequence of each first rank, the offset in the sequence."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in packs:
        at = 0
        for k, length in enumerate(lengths):
            # the same length several times in a pack: one run of ranks for each
            out[length].append((taken[length], sequence, at))
            taken[length] += n
            at += length
        sequence += n
    return {k: tuple(np.array(v, np.int64).T) for k, v in out.items()}


def packed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...)."""
    spark = cut.sparkSession
    parts = partitions(spark)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(8 * parts)).cast("int"))
    counts = cut.groupBy("salt", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    place = slots(patterns(histogram, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("salt", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    ranked = cut.repartition(parts, "salt").withColumn("own", F.row_number().over(Window.partitionBy("salt", "length").orderBy("doc_id", "start")))
    ranked = ranked.join(shifts, ["salt", "length"]).withColumn("rank", F.col("shift") + F.col("own") - 1)

    def put(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for k in np.unique(length).tolist():
            own = np.flatnonzero(length == k)
            first, base, at = place[k]
            run = np.searchsorted(first, rank[own], "right") - 1
            sequence[own], offset[own] = base[run] + rank[own] - first[run], at[run]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    put_to = F.arrow_udf(put, "struct<sequence_id:bigint,offset:bigint>")(F.col("length"), F.col("rank"))
    return ranked.withColumn("to", put_to).select("doc_id", "start", "length", *[c for c in cut.columns if c not in ("doc_id", "start", "length", "salt")], "to.sequence_id", "to.offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(staged(pieces(read(spark, sf_dir, "documents")), "pieces"))
