"""Links of alike texts for ``simhash.first_alike``: sets of five-word shingles with a Jaccard similarity of at least 0.8.

Shingles are those of ``sketch``. Texts of equal sets are one node, so copies cost nothing. Candidates are the pairs that the
fingerprints' grid join proposes, and pairs that share one of BANDS bands of ROWS minimum hashes; a pair of resemblance r
shares none with probability (1 - r^ROWS)^BANDS, which is 5e-8 at 0.8. Every candidate is decided by its exact sets. Cells of
up to SMALL texts give all their pairs, larger ones a star around the least; where a larger cell still has texts of several
components, these are compared with each other too, in blocks of BLOCK whose pairs are separate tasks. Empty and null texts are one node without links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import SUB_BATCH, dropped, partitions, staged
from pixelweave.llm.components import components
from pixelweave.llm.sketch import _mixed, shingle_hashes, words

BANDS, ROWS = 32, 4
SMALL, BLOCK = 8, 1024
_SALT = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_FACTOR = _mixed(_SALT) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The text's distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(words(text)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have four fifths of their union in common."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    twice = int((both[1:] == both[:-1]).sum())
    return 5 * twice >= 4 * (len(both) - twice)


def bands(own: np.ndarray) -> np.ndarray:
    """The cells of a set: a hash for each band of minimum hashes; none for an empty set."""
    if not len(own):
        return own
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, ((own[None, at : at + 1024] ^ _SALT[:, None]) * _FACTOR[:, None]).min(1), out=least)
    rows, out = least.reshape(BANDS, ROWS), _SALT[:BANDS].copy()
    for k in range(ROWS):
        out = _mixed(out + rows[:, k])
    return out


def mark(own: np.ndarray) -> int:
    """What a set of shingles is known by."""
    return xxhash.xxh64_intdigest(own.tobytes())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (cell, mark) sorted by both: candidate pairs as kind 0, the rows of cells over SMALL as kind 1."""

    def told(cell: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(begins, len(cell)))
        first, large, at = np.repeat(begins, size), np.repeat(size > SMALL, size), np.arange(len(cell))
        ray = at[large & (at > first)]
        a, b = [mark[first[ray]]], [mark[ray]]
        for step in range(1, SMALL):
            k = at[step:][~large[step:] & (first[step:] == first[:-step])]
            a.append(mark[k - step])
            b.append(mark[k])
        n = sum(map(len, a))
        kind = np.repeat(np.array([0, 1], np.int32), [n, int(large.sum())])
        return pa.record_batch([pa.array(kind), pa.array(np.concatenate([*a, cell[large]])), pa.array(np.concatenate([*b, mark[large]]))], names=["kind", "a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, mark = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held.append((cell, mark))
        if cell[-1] == held[0][0][0]:
            continue
        cell, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(cell, cell[-1], "left"))
        yield told(cell[:last], mark[:last])
        held = [(cell[last:], mark[last:])]
    if held:
        yield told(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (a, b, x, y) sorted by a, with the pair's texts: the pairs that are alike."""
    now, own = None, None
    for batch in batches:
        for at in range(0, batch.num_rows, SUB_BATCH):
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(at, SUB_BATCH).columns), strict=True):
                if a != now:
                    now, own = a, shingles(x)
                if alike(own, shingles(y)):
                    out.append((a, b))
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (cell, i, j, mark, root, text) sorted by the first three: links that join the components of each pair of blocks."""

    def told(held: list[tuple]) -> pa.RecordBatch:
        groups: dict[int, list] = {}
        for mark, root, own in held:
            groups.setdefault(root, []).append((mark, own))
        left, out = list(groups.values()), []
        while len(left) > 1:
            todo, left = list(left[0]), left[1:]
            while todo and left:
                mark, own = todo.pop()
                apart = []
                for g in left:
                    hit = next((m for m, s in g if alike(own, s)), None)
                    if hit is None:
                        apart.append(g)
                    else:
                        out.append((mark, hit))
                        todo += g
                left = apart
        return pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    now, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, SUB_BATCH):
            for *where, mark, root, text in zip(*(c.to_pylist() for c in batch.slice(at, SUB_BATCH).columns), strict=True):
                if where != now:
                    if held:
                        yield told(held)
                    now, held = where, []
                held.append((mark, root, shingles(text)))
    if held:
        yield told(held)


def links(nodes: DataFrame, small: DataFrame, proposed: DataFrame) -> DataFrame:
    """Links (a, b) that join all alike texts that meet. nodes: mark, text; small: mark, cells; a row for each mark. proposed: further pairs (a, b) to decide."""
    spark, parts = nodes.sparkSession, partitions(nodes.sparkSession)
    laid = small.select(F.explode("cells").alias("cell"), "mark")
    met = staged(laid.repartition(parts, "cell").sortWithinPartitions("cell", "mark").mapInArrow(_met, "kind int, a bigint, b bigint"), "cells")
    every = met.where("kind = 0").select("a", "b").unionByName(proposed)
    pairs = staged(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()
    texts = staged(nodes.join(ids, "mark", "left_semi"), "texts")  # each text of a large cell is in a pair
    first, second = (texts.select(F.col("mark").alias(m), F.col("text").alias(t)) for m, t in (("a", "x"), ("b", "y")))
    whole = pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").sortWithinPartitions("a")
    near = staged(whole.mapInArrow(_decided, "a bigint, b bigint"), "near")
    dropped(pairs)

    large = met.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("mark"))
    if large.isEmpty():
        dropped(met)
        dropped(texts)
        return near
    rows = large.join(components(near), F.col("mark") == F.col("node"), "left").select("cell", "mark", F.coalesce("root", "mark").alias("root"))
    mixed = rows.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")).where("low <> high").select("cell", "n")
    dealt = rows.join(mixed, "cell").withColumn("block", F.pmod(F.xxhash64("mark"), F.col("n")))
    dealt = dealt.select("cell", "mark", "root", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "mark", "root").join(texts, "mark")
    across = dealt.select("cell", "i", "j", "mark", "root", "text").repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return near.unionByName(across.mapInArrow(_across, "a bigint, b bigint"))
