"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

Words are runs without ASCII white space, A-Z lower-cased; a text of one to four words is one shingle, an empty or
null text has the empty sketch. A sketch is the K smallest distinct shingle hashes of 48 bits, in ascending order, so the
sketch of a whole is the merge of its parts' sketches (parts that overlap by WORDS - 1 words). Sketches below K
hashes are complete and their estimates exact; otherwise the standard error of a resemblance r is the root of r (1 - r) / K at
most, 0.031 at 0.5. A fingerprint has at most 8 * K characters, whatever the length of its text. Two empty sketches resemble each other fully,
an empty and another not at all. Repeated rows give repeated results, ordered by their text among equal keys; columns other than the key and the text are ignored;
an empty table gives no rows, and a single document is its own next one.
"""

from __future__ import annotations

import binascii
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import SUB_BATCH, partitions, read, text_or_empty

K, WORDS = 256, 5
BYTES = 6  # of a hash
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(found: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    wide = min(WORDS, len(h))
    if not wide:
        return h
    n = len(h) - wide + 1
    out = np.full(n, wide, np.uint64)
    for j in range(wide):
        out = _mixed(out + h[j : j + n])
    return out


def sketch(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(words(text)) >> np.uint64(64 - 8 * BYTES))[:K]


def merge(*parts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:K]


def distinct(s: np.ndarray) -> float:
    """Estimated number of distinct shingles."""
    return float(len(s)) if len(s) < K else (K - 1) / (float(s[-1]) / 2.0 ** (8 * BYTES))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Common hashes among all up to where both sketches are complete: K of their union at least, all if neither was cut."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    cut = [s[-1] for s in (a, b) if len(s) >= K]
    if cut:
        both = both[: np.searchsorted(both, min(cut), "right")]
    twice = int((both[1:] == both[:-1]).sum())
    return twice / (len(both) - twice)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; an empty a is contained in anything."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b) * distinct(merge(a, b)) / distinct(a))


def packed(s: np.ndarray) -> str:
    return binascii.b2a_base64(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes(), newline=False).decode()


def unpacked(s: str) -> np.ndarray:
    out = np.zeros((len(raw := binascii.a2b_base64(s)) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8")[:, 0]


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint and the estimated number of distinct shingles, a row for each row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(map(packed, found), pa.string()), pa.array(map(distinct, found), pa.float64())], names=[key, "fingerprint", "shingles"])

    return df.select(F.col(key), text_or_empty(text)).mapInArrow(run, f"{key} {kind}, fingerprint string, shingles double")


def merged_by(df: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """One fingerprint for each key (nulls are one key): every task merges what it has first, so a hot key is a row a task."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        out = lambda: pa.record_batch([pa.array(list(held), batch.schema.field(0).type), pa.array([packed(s) for s in held.values()], pa.string())], names=[key, "fingerprint"])
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s is not None:
                    held[k] = merge(held[k], unpacked(s)) if k in held else unpacked(s)
            if len(held) > 4096:
                yield out()
                held = {}
        if held:
            yield out()

    schema = f"{key} {kind}, fingerprint string"
    part = df.select(F.col(key), F.col(fingerprint)).mapInArrow(run, schema)
    final = part.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            ks, ss = [], []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None and k == now:
                    held = merge(held, unpacked(s))
                    continue
                if held is not None:
                    ks, ss = [*ks, now], [*ss, packed(held)]
                now, held = k, unpacked(s)
            yield pa.record_batch([pa.array(ks, batch.schema.field(0).type), pa.array(ss, pa.string())], names=[key, "fingerprint"])
        if held is not None:
            yield pa.record_batch([pa.array([now], batch.schema.field(0).type), pa.array([packed(held)], pa.string())], names=[key, "fingerprint"])

    return final.mapInArrow(last, schema)


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text) dealt so that each partition also has the row that follows its last one.

    The columns are bucket, tail, key, text, sorted by them; tail rows are copies that only serve as a last row's next
    one. Buckets begin at quantiles of the key, so they are of like size; ids alone decide them. Null keys come first.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    rows = df.select(F.col(key).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    stats = rows.agg(F.percentile_approx("id", [i / parts for i in range(parts)], 10_000).alias("cuts"), F.min("id").alias("least"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    cuts = np.array(sorted({*(stats["cuts"] or ()), *(() if stats["least"] is None else (stats["least"],))}), np.int64)
    last = max(0, len(cuts) - 1)

    def place(ids: pa.Array) -> pa.Array:
        """The row's bucket, and that of which it is the next row (or -1)."""
        null = np.asarray(ids.is_null())
        x = np.asarray(ids.fill_null(0)).astype(np.int64)
        at = np.where(null, 0, np.maximum(np.searchsorted(cuts, x, "right") - 1, 0))
        first = null if stats["nulls"] else ~null & (x == cuts[0] if len(cuts) else False)
        begins = ~null & (at > 0) & (cuts[at] == x) if len(cuts) else np.zeros(len(x), bool)
        also = np.where(first, last, np.where(begins, at - 1, -1))
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(also.astype(np.int32))], ["at", "also"])

    placed = rows.withColumn("place", F.arrow_udf(place, "struct<at:int,also:int>")(F.col("id")))
    to = F.when(F.col("place.also") < 0, F.array(F.struct(F.col("place.at").alias("bucket"), F.lit(False).alias("tail")))).otherwise(F.array(F.struct(F.col("place.at").alias("bucket"), F.lit(False).alias("tail")), F.struct(F.col("place.also").alias("bucket"), F.lit(True).alias("tail"))))
    dealt = placed.select(F.explode(to).alias("to"), "id", "text").select("to.bucket", "to.tail", "id", "text")
    return dealt.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket", "tail", "id", "text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("shingles", pa.float64()), ("kept_in_edited", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = None  # bucket, id, text, sketch of the row that waits for its next one
    for batch in batches:
        for at in range(0, batch.num_rows, SUB_BATCH):
            part = batch.slice(at, SUB_BATCH)
            for bucket, tail, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                own = sketch(text)
                if held and held[0] == bucket:
                    _, k, x, s = held
                    new = edited(x, text)
                    e = sketch(new)
                    out.append((k, len(x), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), packed(s), packed(e), resemblance(s, e), resemblance(s, own), distinct(s), containment(s, e)))
                held = None if tail else (bucket, key, text, own)
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FIELDS, strict=True)], schema=_FIELDS)
                out = []


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = with_next(read(spark, sf_dir, "documents"), "doc_id", "text")
    return dealt.mapInArrow(_pairs, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shingles double, kept_in_edited double")
