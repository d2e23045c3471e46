"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two
embeddings is a lower bound of the fingerprints' Hamming distance, so fingerprints that differ in at most 4 bits are
within 4 there. The 32 coordinates fall in two halves, and a pair within 4 is within 2 in the first half or within 1
in the second: the grid range-join lays each fingerprint into the unit cells around it, one step around for the first
half and one step down for the second, which makes every such pair meet in a cell. Pairs that meet are
verified exactly. A cell gives a spanning forest of its links, never all its pairs; cells over CELL fingerprints are
split into blocks whose pairs are separate tasks.

Null and empty texts have fingerprint zero, linked like any other; texts of fewer than four words are one shingle.
Equal fingerprints are one node, so copies cost nothing. ``first_alike`` uses the join for candidates of texts alike by their shingle sets. Rows with a null doc_id get a component too, but name none.
Texts are read whole; repeated rows give repeated results; extra columns are ignored (``first_of_each`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import near
from pixelweave.llm.common import map_arrow, partitions, read, staged, text_or_empty
from pixelweave.llm.components import components
from pixelweave.llm.sketch import shingle_hashes, words

WORDS, BITS, SEED = 4, 4, 42
#: Fingerprints of a cell that one task compares.
CELL = 4096
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, wide: int = WORDS) -> int:
    """The unsigned fingerprint of a whole text."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(wide, len(found)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[: len(starts) - last].tolist(), ends[last:].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", wide: int = WORDS) -> DataFrame:
    """(key, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, wide) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(F.col(key), text_or_empty(text)), run, f"{key} {kind}, fp bigint")


def embedding(fps: np.ndarray) -> np.ndarray:
    """32 bit counts from 0 to 2, two bits each."""
    return (fps & _LOW) + ((fps >> _ONE) & _LOW)


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of each fingerprint, and the place of the fingerprint: (cell, index)."""
    e = embedding(fps)
    first, second = e & np.uint64(0xFFFFFFFF), e >> np.uint64(32)
    mark = np.uint64(1 << 40)  # tells the halves' cells apart
    every = np.arange(len(fps))
    out, at = [first, second | mark], [every, every]
    for k in range(16):
        unit, shift = np.uint64(1 << (2 * k)), np.uint64(2 * k)
        v = (first >> shift) & np.uint64(3)
        up, down = v < 2, v > 0
        also = ((second >> shift) & np.uint64(3)) > 0
        out += [first[up] + unit, first[down] - unit, (second[also] - unit) | mark]
        at += [every[up], every[down], every[also]]
    return np.concatenate(out), np.concatenate(at)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Places (i, j) of links that join what is linked among fps, n - 1 at most: breadth first, each node against those not yet reached."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = _near(fps[left], fps[i], bits)
            if hit.any():
                got = left[hit]
                out += [(int(i), int(j)) for j in got]
                todo += got.tolist()
                left = left[~hit]
    return out


def cell_links(cell: np.ndarray, fps: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Links among rows sorted by cell, as an n x 2 array of fingerprints: of small cells all, of others a forest."""
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begins, len(cell)))
    out = []
    small = np.repeat(size <= 8, size)
    at = np.flatnonzero(small)
    for step in range(1, 8):
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        if not len(at):
            break
        hit = at[_near(fps[at], fps[at + step], bits)]
        out.append(np.stack([fps[hit], fps[hit + step]], 1))
    for b, n in zip(begins[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        own = fps[b : b + n]
        if pairs := forest(own, bits):
            out.append(own[np.array(pairs)])
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _batch(kind: int, a: np.ndarray, b: np.ndarray, place: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.zeros(n, np.int64) if place is None else place)], names=["kind", "a", "b", "place"])


def _join_cells(limit: int, bits: int) -> object:
    """Over rows (cell, fp) sorted by cell: links as kind 0; of cells over the limit, whose links are made elsewhere, the rows as kind 1 with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot, told = None, 0
        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            while len(cell):
                if hot is not None:
                    n = int(np.searchsorted(cell, hot, "right"))
                    if n:
                        yield _batch(1, cell[:n], fps[:n], np.arange(told, told + n))
                    told += n
                    cell, fps = cell[n:], fps[n:]
                    if not len(cell):
                        break
                    hot = None
                last = int(np.searchsorted(cell, cell[-1], "left"))
                done, cell_d, fps_d = last, cell[:last], fps[:last]
                if done:
                    begins = np.flatnonzero(np.concatenate([[True], cell_d[1:] != cell_d[:-1]]))
                    size = np.diff(np.append(begins, done))
                    large = np.repeat(size > limit, size)
                    for b, n in zip(begins[size > limit].tolist(), size[size > limit].tolist(), strict=True):
                        yield _batch(1, cell_d[b : b + n], fps_d[b : b + n], np.arange(n))
                    links = cell_links(cell_d[~large], fps_d[~large], bits)
                    if len(links):
                        yield _batch(0, links[:, 0].copy(), links[:, 1].copy())
                    cell, fps = cell[last:], fps[last:]
                if len(cell) > limit:
                    hot, told = cell[-1], 0
                    continue
                break
        if len(cell):
            links = cell_links(cell, fps, bits)
            if len(links):
                yield _batch(0, links[:, 0].copy(), links[:, 1].copy())

    return run


def _block_links(bits: int) -> object:
    """Over rows (cell, i, j, fp) sorted by the first three: a forest of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> pa.RecordBatch:
            own = np.array(held, np.int64).view(np.uint64)
            pairs = np.array(forest(own, bits), np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(own[pairs[:, 0]].view(np.int64)), pa.array(own[pairs[:, 1]].view(np.int64))], names=["a", "b"])

        for batch in batches:
            for *where, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != now:
                    if len(held) > 1:
                        yield told()
                    now, held = where, []
                held.append(fp)
        if len(held) > 1:
            yield told()

    return run


def links(fps: DataFrame, bits: int = BITS, limit: int = CELL) -> DataFrame:
    """Links (a, b) that join all fingerprints (column fp, distinct) within ``bits`` of each other, up to 4; two fingerprints that are linked meet in a cell."""
    if bits > 4:
        raise ValueError("the grid covers 4 bits at most")
    spark, parts = fps.sparkSession, partitions(fps.sparkSession)

    def lay(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        cell, at = cells(own.view(np.uint64))
        return pa.record_batch([pa.array(cell.view(np.int64)), pa.array(own[at])], names=["cell", "fp"])

    laid = map_arrow(fps.select("fp").where("fp is not null"), lay, "cell bigint, fp bigint", rows=4096)
    met = laid.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_join_cells(limit, bits), "kind int, a bigint, b bigint, place bigint")
    met = staged(met, "cells")
    near = met.where("kind = 0").select("a", "b")
    hot = met.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("fp"), F.floor(F.col("place") / limit).alias("block"))
    blocks = hot.groupBy("cell").agg((F.max("block") + 1).alias("n"))
    dealt = hot.join(blocks, "cell").select("cell", "fp", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    within = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_block_links(bits), "a bigint, b bigint")
    return near.unionByName(within)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, wide: int = WORDS) -> DataFrame:
    """(key, fp, component_id) for each row: the least key that links reach, the row's own included."""
    own = staged(fingerprints(df, key, text, wide), "fingerprints")
    nodes = staged(own.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links(nodes, bits))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, wide: int = WORDS) -> DataFrame:
    """One row of each near-duplicate group: that with the least key (nulls last), of equal ones the least by its columns."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t or "", wide) for t in texts.to_pylist()], np.uint64).view(np.int64))

    rows = docs.select(F.arrow_udf(run, "bigint")(text_or_empty(text)).alias("fp"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.struct(*docs.columns).alias("row")).alias("doc"))
    nodes = staged(rows.groupBy("fp").agg(F.min("doc").alias("doc")), "nodes")
    roots = components(links(nodes, bits))
    placed = nodes.select("fp", F.col("doc.none").alias("none"), F.col("doc.key").alias("key")).join(roots, F.col("fp") == F.col("node"), "left")
    first = placed.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct("none", "key", "fp")).alias("first")).select(F.col("first.fp").alias("fp"))
    return nodes.join(first, "fp", "left_semi").select("doc.row.*")


def _known(texts: pa.Array) -> pa.Array:
    """The mark, fingerprint and band cells of each text, all from its five-word shingle hashes."""
    marks, fps, cells = [], [], []
    for t in texts.to_pylist():
        every = shingle_hashes(words(t or ""))
        own = np.unique(every)
        marks.append(near.mark(own))
        fps.append(majority(every))
        cells.append(near.bands(own).view(np.int64))
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
    values = np.concatenate([*cells, np.empty(0, np.int64)])
    columns = [pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
    return pa.StructArray.from_arrays(columns, ["mark", "fp", "cells"])


def candidates(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of marks that the grid range-join proposes. nodes: mark, fp. Of the marks of one fingerprint the least stands for it."""
    told = staged(nodes.groupBy("fp").agg(F.min("mark").alias("least")), "told")
    found = links(told, bits)
    for side in ("a", "b"):
        found = found.join(told.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_mark")), side)
    same = nodes.join(told, "fp").where("mark <> least").select(F.col("least").alias("a"), F.col("mark").alias("b"))
    return found.select(F.col("a_mark").alias("a"), F.col("b_mark").alias("b")).unionByName(same)


def first_alike(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each group of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

    The kept row is that with the least key (nulls last), of equal ones the least by its columns. The fingerprints of five-word
    shingles go through the grid range-join, whose links are candidates. Most pairs at a similarity of 0.8 differ in more than
    ``bits`` bits, so the candidates are completed by bands of minimum hashes (``near``); every one is decided by its exact sets.
    Empty and null texts are one group.
    """
    rows = docs.select(F.arrow_udf(_known, "struct<mark:bigint,fp:bigint,cells:array<bigint>>")(text_or_empty(text)).alias("known"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.struct(*docs.columns).alias("row")).alias("doc"))
    rows = rows.select(F.col("known.mark").alias("mark"), F.struct("doc.none", "doc.key", "doc.row", "known.fp", "known.cells").alias("doc"))
    nodes = staged(rows.groupBy("mark").agg(F.min("doc").alias("doc")), "nodes")
    proposed = candidates(nodes.select("mark", F.col("doc.fp").alias("fp")), bits)
    found = near.links(nodes.select("mark", text_or_empty(f"doc.row.{text}").alias("text")), nodes.select("mark", F.col("doc.cells").alias("cells")), proposed)
    placed = nodes.select("mark", F.col("doc.none").alias("none"), F.col("doc.key").alias("key")).join(components(found), F.col("mark") == F.col("node"), "left")
    first = placed.groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min(F.struct("none", "key", "mark")).alias("first")).select(F.col("first.mark").alias("mark"))
    return nodes.join(first, "mark", "left_semi").select("doc.row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
