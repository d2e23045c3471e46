"""Quality classifier: attention-based multiple-instance learning.

A document is the bag of its passages (PASSAGE bytes each, the whole text). Every passage is described by the shares
of its byte classes, its word shape and how well it compresses, encoded by one hidden layer, and weighted by gated
attention (tanh times sigmoid); the weighted passage representation gives the score. Encoder, attention and output
are learned together from document labels alone, on at most BAGS labelled documents (the documented bound of the
sample, taken by a hash of the id) of which at most MOST passages each, evenly spread, are learned from; scores read all
passages. Null and empty texts are one passage without bytes and have a score too; without
any label the score is 0.5 for all. Repeated rows get equal scores; extra columns are ignored; an empty table gives no rows.
Of several labels of a document the least counts.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import SUB_BATCH, read, text_or_empty

PASSAGE = 512
BAGS, MOST = 4000, 64
HIDDEN, GATE, EPOCHS, STEP = 16, 8, 40, 0.01

#: Byte classes: letters by letter, then groups.
_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"-_", b"\"'`", b"()[]{}<>", b"/\\@:;=+~^")


def _classes() -> np.ndarray:
    table = np.full(256, 26 + len(_GROUPS), np.int64)
    table[97:123] = np.arange(26)
    for k, g in enumerate(_GROUPS):
        table[list(g)] = 26 + k
    table[128:] = 27 + len(_GROUPS)
    return table


_TABLE = _classes()
_N = 28 + len(_GROUPS)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
WIDTH = _N + 5


def learned_from(bag: np.ndarray) -> np.ndarray:
    """At most MOST passages of a bag, evenly spread from the first to the last."""
    return bag if len(bag) <= MOST else bag[np.linspace(0, len(bag) - 1, MOST).round().astype(np.int64)]


def passages(text: str) -> np.ndarray:
    """A row of WIDTH numbers for each passage."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    if not raw:
        return out
    x = np.frombuffer(raw, np.uint8)
    which = np.arange(len(x)) // PASSAGE
    counts = np.bincount(which * _N + _TABLE[x], minlength=n * _N).reshape(n, _N)
    size = counts.sum(1)
    out[:, :_N] = counts / size[:, None]
    gap = _SPACE[x]
    begins = ~gap
    begins[1:] &= gap[:-1]
    found = np.bincount(which[begins], minlength=n)
    out[:, _N] = found / size * 5
    out[:, _N + 1] = [len(zlib.compress(raw[k : k + PASSAGE], 1)) for k in range(0, len(raw), PASSAGE)]
    out[:, _N + 1] /= size + 16
    out[:, _N + 2] = size / PASSAGE
    out[:, _N + 3] = (counts > 0).sum(1) / _N
    out[:, _N + 4] = np.log1p(len(raw)) / 10
    return out


@dataclasses.dataclass
class Model:
    """Weights: shift and scale of the features, encoder, gates, attention, output."""

    shift: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def score(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _forward(self.parts, (rows - self.shift) * self.scale, starts)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.diff(np.append(starts, len(x)))
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t, g = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["sig"])))
    e = (t * g) @ w["att"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    a = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"sizes": sizes, "h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    up = (f["p"] - y) / len(y)
    dz = np.repeat(up[:, None] * w["out"], f["sizes"], 0)
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
    dgate = de[:, None] * w["att"]
    dt, dg = dgate * f["g"] * (1 - f["t"] ** 2), dgate * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ w["tan"].T + dg @ w["sig"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"enc": x.T @ dx, "enc_b": dx.sum(0), "tan": f["h"].T @ dt, "sig": f["h"].T @ dg, "att": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ up, "out_b": up.sum()}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    w = {"enc": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "enc_b": np.zeros(HIDDEN), "tan": rng.normal(0, 0.3, (HIDDEN, GATE)), "sig": rng.normal(0, 0.3, (HIDDEN, GATE)), "att": rng.normal(0, 0.3, GATE), "out": np.zeros(HIDDEN), "out_b": np.zeros(())}
    if not bags:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), w)
    every = np.concatenate(bags)
    shift, scale = every.mean(0), 1 / (every.std(0) + 1e-3)
    bags = [(b - shift) * scale for b in bags]
    m, v, k = {n: 0.0 for n in w}, {n: 0.0 for n in w}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), 64):
            take = order[at : at + 64]
            sizes = [len(bags[i]) for i in take]
            grad = _gradient(w, np.concatenate([bags[i] for i in take]), np.cumsum([0, *sizes[:-1]]), y[take])
            k += 1
            for n, d in grad.items():
                d = d + 1e-4 * w[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * d, 0.999 * v[n] + 0.001 * d * d
                rate = STEP * (1 - epoch / EPOCHS)
                w[n] = w[n] - rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)
    return Model(shift, scale, w)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", allowed: Callable[[Column], Column] | None = None) -> Model:
    """Fit on at most BAGS of the labelled rows that ``allowed`` (a condition on the key) lets through; labels other than 0 and 1 are left out."""
    usable = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col(key).isNotNull())
    if allowed is not None:
        usable = usable.where(allowed(F.col(key)))
    one = usable.groupBy(key).agg(F.min("y").alias("y"))
    some = one.orderBy(F.xxhash64(key), key).limit(BAGS)
    rows = docs.select(F.col(key), text_or_empty(text).alias("text")).join(F.broadcast(some), key)

    def described(batch: pa.RecordBatch) -> pa.Array:
        return [learned_from(passages(t)).tobytes() for t in batch.to_pylist()]

    found = rows.select(key, "y", F.arrow_udf(lambda t: pa.array(described(t), pa.binary()), "binary")("text").alias("bag")).orderBy(F.xxhash64(key), key).limit(BAGS).collect()
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in found]
    return fit(bags, np.array([r["y"] for r in found], np.float64))


def scores(model: Model, text: Column) -> Column:
    """The score of each text, from 0 to 1."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), SUB_BATCH):
            bags = [passages(t or "") for t in texts.slice(at, SUB_BATCH).to_pylist()]
            sizes = [len(b) for b in bags]
            out.append(model.score(np.concatenate(bags), np.cumsum([0, *sizes[:-1]])))
        return pa.array(np.round(np.concatenate(out), 9) if out else [], pa.float64())

    return F.arrow_udf(run, "double")(text)


def remainder(key: Column, of: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % of


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"), allowed=lambda key: remainder(key, 3) != 1)
    scored = docs.select("doc_id", scores(model, text_or_empty()).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
