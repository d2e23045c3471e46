"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

A restaurant stands for each context (the word before; the end token before a text) and one root restaurant is the
parent of all; its base is uniform over the training words and one unknown. The customers of the root are the tables
of the contexts' restaurants. Gibbs sampling draws the number of tables of each dish from its exact conditional (generalised
Stirling numbers) given the other dishes of its restaurant and the root's probabilities; an epoch seats all
contexts for some sweeps, then the root, whose counts follow. Predictive probabilities are averaged over the samples.
Stirling numbers of dishes of over EXACT customers come from a contour integral; a pair seen once has one table in any seating and isn't drawn.

How it is laid out: documents become blocks of tokens (a written table); each block sends its distinct pairs to
buckets by context, as packed arrays, and gets back what each pair needs. A bucket keeps its pairs seen more often as one row of packed arrays
(a state: contexts, words, counts, tables); before each seating it sends the distinct words of these pairs with their tables to groups of
word buckets, where the root is seated, and gets their probabilities back. So no step moves pairs as rows. A context with more tokens than a bucket has on
average is spread over all buckets by its next words; there are fewer of them than buckets. Its tables
are summed over all buckets before each sweep, so that it is seated as any other. There are as many messages as buckets times blocks, and
buckets times groups, at most: so buckets grow in number with the tokens, and with the shuffle partitions only while each still has tokens enough.
Words and pairs go by 64-bit hashes.

Null texts are empty: the end token alone. Tokens are runs without ASCII white space, A-Z lower-cased. Rows with a null
doc_id count as training rows. Repeated rows count as often as they occur; texts are read whole; extra columns are ignored; an
empty table gives no rows. Draws are made from hashes of the pairs and the turn, so ties don't occur and scores don't depend on how
the data are dealt, but for the last digits of sums.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import dropped, map_arrow, partitions, read, staged, text_or_empty

DISCOUNT, STRENGTH = 0.9, 2.0  # of the contexts' restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
EPOCHS, BURN, SAMPLES = 2, 2, 3
EXACT = 512  # customers of a dish whose Stirling numbers are tabulated
NODES, POINTS = 40, 12  # of the integral and the interpolation for others
BLOCK = 2_200_000  # tokens of a block, about
BUCKETS = 2  # for each shuffle partition, at least
FULL = 4_000_000  # tokens of a bucket, about: more tokens make more buckets
FEW, SMALL = 64, 100_000  # more buckets than FEW have SMALL tokens each at least, on average, however many shuffle partitions there are
GROUPS, SPREAD = 64, 16  # groups of word buckets, about: this many, or a bucket's 16th if that is more
END = b" "  # no word has a space


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1) for each hash and turn."""
    return (mixed(h + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


# --- seating ---------------------------------------------------------------------------------------------------------


@functools.cache
def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of discount d, for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT + 1):
            stay = np.log(np.maximum(c - 1 - d * t, 0))
            out[c, 1:] = np.logaddexp(out[c - 1, :-1], np.where(np.isfinite(out[c - 1, 1:]), stay + out[c - 1, 1:], -np.inf))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _saddle(s: np.ndarray, d: float) -> np.ndarray:
    """The mean size of a table where x is exp(-s): the saddle point of c customers at t tables is where it is c / t."""
    u = -np.expm1(-s)
    return d * u ** (d - 1) * np.exp(-s) / (1 - u**d)


def log_stirling(c: np.ndarray | int, t: np.ndarray, d: float) -> np.ndarray:
    """Log S(c, t) for any c over EXACT and real t from 1 to c: t! S(c, t) / c! is the c-th coefficient of ((1 - (1 - x)^d) / d)^t, an integral
    over x = exp(-s) on a contour through the saddle point (where that is nearer to 0 than 1 / c, through 1 / c)."""
    t = np.asarray(t, np.float64)
    c = np.broadcast_to(np.asarray(c, np.float64), t.shape)
    want = c / t
    low, high = -np.log(c), np.full(t.shape, 3.5)
    for _ in range(26):
        middle = (low + high) / 2
        over = _saddle(np.exp(middle), d) > want
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    mu = np.exp(low)
    spread = t * np.maximum((_saddle(mu * 0.999, d) - _saddle(mu * 1.001, d)) / (0.002 * mu), 1e-300)
    line = c * mu >= 50
    end = np.where(line, np.minimum(np.pi, 9 / np.sqrt(spread)), np.minimum(2 * np.sqrt(1 + 45 / (c * mu)), 1.5 / mu))
    v = np.linspace(0, 1, NODES + 1) * end[..., None]
    m, on = mu[..., None], line[..., None]
    s = np.where(on, m + 1j * v, m * (1 + 1j * v) ** 2)
    step = np.where(on, 1.0 + 0j, 2 * m * (1 + 1j * v))  # ds / (i dv)
    with np.errstate(all="ignore"):  # t = c, which is known
        value = t[..., None] * np.log(1 - (-np.expm1(-s)) ** d) + c[..., None] * s
        top = value[..., :1].real
        w = (np.exp(value - top) * step).real
    w[..., [0, -1]] /= 2
    integral = w.sum(-1) * end / NODES / np.pi
    with np.errstate(invalid="ignore", divide="ignore"):
        out = top[..., 0] + np.log(integral) + log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(d)
    return np.where(t >= c, 0.0, np.where(t == c - 1, np.log(c * (c - 1) / 2 * (1 - d)), out))


def _likely(c: np.ndarray, start: np.ndarray, base: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last table count that has any weight: ten deviations around the mode, where the logarithm of the weight is level.

    At the contour's point mu there are c / mean(mu) tables, so the mode is sought over mu, down to 1 / c; below, tables are so few that the
    point stays at 1 / c.
    """

    def slope(mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = np.clip(c / _saddle(mu, d), 1.0, c)
        return t, np.log1p(-((-np.expm1(-mu)) ** d)) + np.log(base) + np.log((start + t) / (t + 0.5))

    low, high = -np.log(c), np.full(len(c), 3.5)
    for _ in range(30):
        middle = (low + high) / 2
        up = slope(np.exp(middle))[1] > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    mu = np.exp((low + high) / 2)
    t, _ = slope(mu)
    (t0, h0), (t1, h1) = slope(mu / 1.01), slope(mu * 1.01)
    with np.errstate(all="ignore"):
        bend = (h0 - h1) / (t1 - t0)
    least, at_least = slope(1 / c)
    own = base * (1 - (1 / c) ** d)
    few = np.clip((start * own - 0.5) / np.maximum(1 - own, 1e-12), 1.0, c)
    bend = np.where(at_least > 0, bend, 1 / (few + 0.5) - 1 / (start + few))
    t = np.where(at_least > 0, t, few)
    wide = 10 / np.sqrt(np.maximum(np.nan_to_num(bend, nan=1e-12, posinf=1e12), 1e-12))
    return np.maximum(1, np.floor(t - wide - 12)).astype(np.int64), np.minimum(c, np.ceil(t + wide + 24)).astype(np.int64)


def _seat_large(c: np.ndarray, others: np.ndarray, base: np.ndarray, luck: np.ndarray, d: float, strength: float) -> np.ndarray:
    """Draws among all of 1 to c tables, c over EXACT: log S is interpolated (Chebyshev nodes in log t) over the counts that have any weight."""
    out = np.empty(len(c), np.int64)
    angle = (np.arange(POINTS) + 0.5) * np.pi / POINTS
    nodes = np.cos(angle)
    to_series = 2 / POINTS * np.cos(np.arange(POINTS)[:, None] * angle)  # from values at the nodes to Chebyshev coefficients
    to_series[0] /= 2
    for at in range(0, len(c), 128):
        some = slice(at, at + 128)
        start = strength / d + others[some]
        first, last = _likely(c[some].astype(np.float64), start, base[some], d)
        a, b = np.log(first), np.log(np.maximum(last, first + 1))
        values = log_stirling(c[some, None], np.minimum(np.exp((a + b)[:, None] / 2 + (b - a)[:, None] / 2 * nodes), c[some, None] - 2), d)
        series = values @ to_series.T
        for k, (f, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            every = np.arange(f, e + 1)
            if e > 0.8 * c[at + k]:  # towards t = c log S bends too much
                w = np.concatenate([log_stirling(c[at + k], every[x : x + 1024], d) for x in range(0, len(every), 1024)])
            else:
                w = np.polynomial.chebyshev.chebval((2 * np.log(every) - a[k] - b[k]) / (b[k] - a[k]), series[k])
            w = w + np.log((start[k] + every - 1) * (d * base[at + k])).cumsum()
            w = np.exp(w - w.max()).cumsum()
            out[at + k] = f + int(np.searchsorted(w, luck[at + k] * w[-1], "left"))
    return out


def seat(c: np.ndarray, others: np.ndarray, base: np.ndarray, luck: np.ndarray, d: float, strength: float) -> np.ndarray:
    """Numbers of tables of dishes with c customers each, drawn given the restaurant's other tables and the dish's base probability."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    large = order[np.searchsorted(c[order], EXACT, "right") :]
    out[large] = _seat_large(c[large], others[large], base[large], luck[large], d, strength)
    order = order[: len(order) - len(large)]
    if not len(order):
        return out
    values, begins = np.unique(c[order], return_index=True)
    for value, own in zip(values.tolist(), np.split(order, begins[1:]), strict=True):
        if value < 2:
            continue
        s = stirling(d)[value, 1 : value + 1]
        i = np.arange(len(s))
        for at in range(0, len(own), max(1, 200_000 // len(s))):
            rows = own[at : at + max(1, 200_000 // len(s))]
            w = np.cumsum(np.log(strength + d * (others[rows, None] + i)), 1)
            w += s + (i + 1) * np.log(base[rows, None])
            w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
            out[rows] = 1 + (w < luck[rows, None] * w[:, -1:]).sum(1)
    return out


# --- blocks ----------------------------------------------------------------------------------------------------------

BLOCKS = "block bigint, doc_ids array<bigint>, sizes binary, words binary, ids binary"


def held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 10 == 0


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32

    def fresh() -> defaultdict:
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        known[END]
        return known

    known, keys, parts, total = fresh(), [], [], 0

    def block() -> pa.RecordBatch:
        words = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        sizes = np.fromiter(map(len, parts), np.int32, len(parts))
        cells = [[number], [keys], [sizes.tobytes()], [words.tobytes()], [np.concatenate(parts).tobytes()]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["block", "doc_ids", "sizes", "words", "ids"])

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                found = text.encode("utf-8", "surrogatepass").lower().split()
                found.append(END)
                parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                keys.append(key)
                total += len(found)
                if total >= BLOCK:
                    yield block()
                    number += 1
                    known, keys, parts, total = fresh(), [], [], 0
    if keys:
        yield block()


class Block:
    """A block's arrays, and its distinct pairs in the order of their buckets."""

    def __init__(self, keys: list, sizes: bytes, words: bytes, ids: bytes) -> None:
        self.keys = keys
        self.sizes = np.frombuffer(sizes, np.int32)
        self.words = np.frombuffer(words, np.uint64)
        self.ids = np.frombuffer(ids, np.int32)
        self.out = np.fromiter(map(held_out, keys), bool, len(keys))
        self.taught = np.repeat(~self.out, self.sizes)

    def pairs(self, parts: int, hot: np.ndarray) -> None:
        before = np.zeros_like(self.ids)
        before[1:] = self.ids[:-1]  # a text's end token stands before the next text
        n = len(self.words)
        key, place = np.unique(before.astype(np.int64) * n + self.ids, return_inverse=True)
        u, w = key // n, key % n
        bucket = (self.words[u] % np.uint64(parts)).astype(np.int64)
        if len(hot):
            spread = np.isin(self.words, hot)[u]
            bucket[spread] = (mixed(self.words[w[spread]]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.u, self.w, self.bucket, self.place = u[order], w[order], bucket[order], rank[place]
        self.seen = np.bincount(self.place[self.taught], minlength=len(order)).astype(np.int32)

    def cuts(self, parts: int) -> list[tuple[int, int, int]]:
        """(bucket, first, last) of the pairs of each bucket that has some."""
        ends = np.searchsorted(self.bucket, np.arange(parts + 1))
        return [(b, int(s), int(e)) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > s]


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for k in range(batch.num_rows):
            number, keys, *rest = (batch.column(c)[k].as_py() for c in range(5))
            yield number, Block(keys, *rest)


CELLS = "abcdefghi"
MESSAGE = "kind int, bucket bigint, block bigint, " + ", ".join(f"{c} binary" for c in CELLS)
_MESSAGE = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in CELLS)])
REPLIES, COLD, HOT, CONTEXTS, ONCE = range(5)  # kinds of what a bucket finds: for blocks, states of its own and of spread contexts, contexts, words of pairs seen once
WORDS, ROOT, TOTALS = 5, 6, 7  # tables of words, of the root's customers, and the root's sums


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MESSAGE)], schema=_MESSAGE)


def _msg(kind: int, bucket: int, block: int, *arrays: np.ndarray | bytes) -> tuple:
    return (kind, bucket, block, *[x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays], *[None] * (len(CELLS) - len(arrays)))


def _thin(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest takes, after the type's letter."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.char.encode() + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, chr(x[0]), offset=1).astype(np.int64)


class State:
    """A bucket's pairs seen more often, by context: the distinct words (by bucket, then hash), the contexts with the numbers of their pairs; of each
    pair the place of its word and its count; of each context its pairs seen once; of each pair its tables, and their sum over the samples."""

    def __init__(self, row: tuple) -> None:
        self.kind, self.bucket = row[0], row[1]
        self.words, self.contexts = np.frombuffer(row[3], np.uint64), np.frombuffer(row[4], np.uint64)
        self.sizes, self.which, self.c, self.once, self.t, self.sums = map(_wide, row[5:11])
        self.base = np.frombuffer(row[11] or b"", np.float64)  # of each word

    @classmethod
    def row(cls, kind: int, bucket: int, u: np.ndarray, w: np.ndarray, c: np.ndarray, once: np.ndarray, parts: int) -> tuple:
        """Of pairs sorted by context, each with one table."""
        words, which = np.unique(w, return_inverse=True)
        order = np.argsort(words % np.uint64(parts), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        begins = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        numbers = (np.diff(np.append(begins, len(u))), rank[which], c, once[begins], np.ones(len(u), np.int64), np.zeros(len(u), np.int64))
        return _msg(kind, bucket, -1, words[order], u[begins], *map(_thin, numbers))

    def again(self, t: np.ndarray, sums: np.ndarray, base: np.ndarray) -> tuple:
        return _msg(self.kind, self.bucket, -1, self.words, self.contexts, *map(_thin, (self.sizes, self.which, self.c, self.once, t, sums)), base)

    @property
    def begins(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def luck(self) -> np.ndarray:
        """The hash of each pair, from which its draws are made."""
        return mixed(np.repeat(self.contexts, self.sizes)) + self.words[self.which]


def _by_group(h: np.ndarray, parts: int, width: int) -> list[tuple[int, int, int]]:
    """(group, first, last) of hashes sorted by bucket; a group has width buckets."""
    group = ((h % np.uint64(parts)) // np.uint64(width)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(h) else np.empty(0, np.int64)
    return [(int(group[s]), int(s), int(e)) for s, e in zip(edges, np.append(edges, len(h))[1:], strict=True)]


def _batched(rows: list[tuple], many: int = 64) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), many):
        yield _messages(rows[at : at + many])


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _send_pairs(parts: int, hot: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _each_block(batches):
            block.pairs(parts, hot)
            rows = []
            for bucket, s, e in block.cuts(parts):
                u = block.u[s:e]
                first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                sizes = np.diff(np.append(first, len(u))).astype(np.int32)
                rows.append(_msg(0, bucket, number, block.words[u[first]], sizes, block.words[block.w[s:e]], _thin(block.seen[s:e])))
            yield from _batched(rows)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The messages of each bucket, rows sorted by bucket."""
    now, held = None, []
    for row in _each_row(batches):
        if row[1] != now:
            if held:
                yield now, held
            now, held = row[1], []
        held.append(row)
    if held:
        yield now, held


def _delivered(messages: DataFrame, parts: int) -> DataFrame:
    return messages.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "block", "kind")


def _meet(parts: int, width: int, hot: np.ndarray) -> Callable:
    """Counts of all pairs of a bucket. To each block a code for each of its pairs (0 unseen, 1 once, 2 more often) and places among the pairs
    seen more often; the states of these pairs, those of spread contexts after the others; contexts with their pairs seen once; to groups,
    words with their pairs seen once."""

    def met(bucket: int, rows: list[tuple]) -> list[tuple]:
        u = np.concatenate([np.repeat(np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.int32)) for r in rows])
        w = np.concatenate([np.frombuffer(r[5], np.uint64) for r in rows])
        n = np.concatenate([_wide(r[6]) for r in rows])
        sizes = [len(r[5]) // 8 for r in rows]
        key = mixed(u) + w
        order = np.argsort(key, kind="stable")
        begins = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        first = order[begins]
        c = np.bincount(group, weights=n, minlength=len(first)).astype(np.int64)
        del key, order, begins
        gu, gw = u[first], w[first]
        contexts, of = np.unique(gu[c > 0], return_inverse=True)
        once = np.bincount(of, weights=c[c > 0] == 1, minlength=len(contexts)).astype(np.int64)
        more = np.flatnonzero(c >= 2)
        more = more[np.argsort(gu[more], kind="stable")]
        spread = np.isin(gu[more], hot)
        more, cold = np.concatenate([more[~spread], more[spread]]), int((~spread).sum())
        number = np.zeros(len(c), np.int32)
        number[more] = np.arange(len(more))
        code = np.minimum(c, 2).astype(np.uint8)[group]
        out, at = [], 0
        for r, size in zip(rows, sizes, strict=True):
            own = code[at : at + size]
            out.append(_msg(REPLIES, bucket, r[2], own, number[group[at : at + size][own == 2]]))
            at += size
        for kind, own in ((COLD, more[:cold]), (HOT, more[cold:])):
            if len(own):
                out.append(State.row(kind, bucket, gu[own], gw[own], c[own], once[np.searchsorted(contexts, gu[own])], parts))
        out.append(_msg(CONTEXTS, bucket, -1, contexts, _thin(once)))
        words, times = np.unique(gw[c == 1], return_counts=True)
        order = np.argsort(words % np.uint64(parts), kind="stable")
        words, times = words[order], times[order]
        return out + [_msg(ONCE, g, bucket, words[s:e], _thin(times[s:e])) for g, s, e in _by_group(words, parts, width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _gathered(batches):
            yield from _batched(met(bucket, rows))

    return run


def _summed(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a group's messages, their sums, and the place of each word sent."""
    words, of = np.unique(np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows]), return_inverse=True)
    return words, np.bincount(of, weights=np.concatenate([_wide(r[4]) for r in rows]), minlength=len(words)).astype(np.int64), of


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One message of words seen in pairs that occur once for each group."""
    for group, rows in _gathered(batches):
        words, n, _ = _summed(rows)
        yield _messages([_msg(ONCE, group, -1, words, _thin(n))])


def _customers(parts: int, width: int) -> Callable:
    """Of each state its words and their tables, to the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in map(State, _each_row(batches)):
            k = np.bincount(state.which, weights=state.t, minlength=len(state.words)).astype(np.int64)
            yield from _batched([_msg(state.kind, g, state.bucket, state.words[s:e], _thin(k[s:e])) for g, s, e in _by_group(state.words, parts, width)])

    return run


def _root(parts: int, base: float, tables: float, turn: int, samples: int, last: bool) -> Callable:
    """Customers less discounts of the root's words, its tables drawn given the number of all its tables before: to each state those that it sent or,
    the last time, to each bucket its own; and for each group the sums of customers and tables."""

    def seated(group: int, rows: list[tuple]) -> list[tuple]:
        words, k, of = _summed(rows)
        others, flat = np.full(len(k), max(0.0, tables - 1)), np.full(len(k), base)
        mean = np.zeros(len(k))
        for at in range(0, len(k), 10_000):
            some = slice(at, at + 10_000)
            mean[some] = np.mean([seat(k[some], others[some], flat[some], uniform(words[some], turn + s), ROOT_DISCOUNT, ROOT_STRENGTH) for s in range(samples)], 0)
        left, out, at = k - ROOT_DISCOUNT * mean, [_msg(TOTALS, group, -1, np.array([k.sum(), mean.sum()], np.float64))], 0
        if last:
            bucket = (words % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            return out + [_msg(ROOT, b, -1, words[order[s:e]], left[order[s:e]]) for b, s, e in _by_group(words[order], parts, 1)]
        for r in rows:
            size = len(r[3]) // 8
            if r[0] != ONCE:
                out.append(_msg(r[0], r[2], group, left[of[at : at + size]]))
            at += size
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _gathered(batches):
            yield from _batched(seated(group, rows))

    return run


def _root_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each_row(batches):
        k, mean = np.frombuffer(row[3], np.float64)
        yield pa.record_batch([pa.array([k]), pa.array([mean])], names=["k", "mean"])


def _with_base(rows: list[tuple], left: float, everyone: float) -> tuple[State, np.ndarray]:
    """A state and the root's probability of each of its words, from the groups' replies in their order."""
    return State(rows[0]), (np.concatenate([np.frombuffer(r[3], np.float64) for r in rows[1:]]) + left) / everyone


def _restaurants(epoch: int, last: bool, left: float, everyone: float) -> Callable:
    """Sweeps over the contexts of each bucket, spread ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _gathered(batches):
            state, p = _with_base(rows, left, everyone)
            base, luck, begins, t = p[state.which], state.luck(), state.begins, state.t
            sums = np.zeros(len(t), np.int64)
            for sweep in range(BURN + (SAMPLES if last else 0)):
                others = np.repeat(state.once + np.add.reduceat(t, begins), state.sizes) - t
                t = seat(state.c, others, base, uniform(luck, 100 * epoch + sweep), DISCOUNT, STRENGTH)
                if last and sweep >= BURN:
                    sums += t
            yield _messages([state.again(t, sums, b"")])

    return run


def _spread(left: float, everyone: float) -> Callable:
    """States of spread contexts with the probabilities of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _gathered(batches):
            state, p = _with_base(rows, left, everyone)
            yield _messages([state.again(state.t, state.sums, p)])

    return run


def _sweep(turn: int, totals: dict[int, int], sample: bool) -> Callable:
    """One sweep over the pairs of spread contexts, given all tables of each of these contexts; samples are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in map(State, _each_row(batches)):
            others = np.repeat(np.array([totals[x] for x in state.contexts.view(np.int64).tolist()], np.int64), state.sizes) - state.t
            t = seat(state.c, others, state.base[state.which], uniform(state.luck(), turn), DISCOUNT, STRENGTH)
            yield _messages([state.again(t, state.sums + t * sample, state.base)])

    return run


def _tables(states: DataFrame, sums: bool = False) -> dict[int, int]:
    """All tables of each context of these states, or their sums over the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state in map(State, _each_row(batches)):
            yield pa.record_batch([pa.array(state.contexts.view(np.int64)), pa.array(np.add.reduceat(state.sums if sums else state.t, state.begins))], names=["u", "t"])

    return {r["u"]: r["t"] for r in states.mapInArrow(run, "u bigint, t bigint").groupBy("u").agg(F.sum("t").alias("t")).collect()}


def _fixed(contexts: DataFrame, hot: np.ndarray) -> dict[int, int]:
    """The pairs seen once of each spread context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            u, once = np.frombuffer(row[3], np.uint64), _wide(row[4])
            own = np.isin(u, hot)
            yield pa.record_batch([pa.array(u[own].view(np.int64)), pa.array(once[own])], names=["u", "t"])

    return {r["u"]: r["t"] for r in contexts.mapInArrow(run, "u bigint, t bigint").groupBy("u").agg(F.sum("t").alias("t")).collect()}


def _answers(parts: int, opened: dict[int, float], left: float, everyone: float, unknown: float) -> Callable:
    """In each bucket its tables come first (block -1): words, the root's customers, contexts, states. Requests of kind 1 are hashes, replied by the
    tokens, the probability and the tables of each word; those of kind 0 are places, replied by the discounted counts of pairs."""
    hot = np.array(list(opened), np.int64).view(np.uint64)
    hot_tables = np.array(list(opened.values()), np.float64)

    def words(bucket: int, tables: dict[int, tuple]) -> tuple[np.ndarray, ...]:
        if WORDS not in tables:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        h, n = np.frombuffer(tables[WORDS][3], np.uint64), np.frombuffer(tables[WORDS][4], np.int64)
        p, t = np.full(len(h), unknown), np.zeros(len(h))
        if ROOT in tables:
            p[np.searchsorted(h, np.frombuffer(tables[ROOT][3], np.uint64))] = (np.frombuffer(tables[ROOT][4], np.float64) + left) / everyone
        if CONTEXTS in tables:
            u, once = np.frombuffer(tables[CONTEXTS][3], np.uint64), _wide(tables[CONTEXTS][4])
            own = ~np.isin(u, hot)
            t[np.searchsorted(h, u[own])] = once[own]
        if COLD in tables:
            state = State(tables[COLD])
            t[np.searchsorted(h, state.contexts)] += np.add.reduceat(state.sums, state.begins) / SAMPLES
        own = (hot % np.uint64(parts)).astype(np.int64) == bucket
        t[np.searchsorted(h, hot[own])] = hot_tables[own]
        return h, n, p, t

    def values(tables: dict[int, tuple]) -> np.ndarray:
        states = [State(tables[k]) for k in (COLD, HOT) if k in tables]
        return np.concatenate([(x.c - DISCOUNT * (x.sums / SAMPLES)).astype(np.float32) for x in states])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _gathered(batches):
            tables = {r[0]: r for r in rows if r[2] < 0}
            known, *columns = words(bucket, tables)
            of_pairs = values(tables) if any(r[0] == 0 for r in rows if r[2] >= 0) else None
            out = []
            for kind, _, block, a, *_ in rows:
                if block < 0:
                    continue
                if kind:
                    asked = np.frombuffer(a, np.uint64)
                    at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
                    hit = known[at] == asked if len(known) else np.zeros(len(asked), bool)
                    n, p, t = (np.where(hit, x[at], 0) if len(known) else np.zeros(len(asked), x.dtype) for x in columns)
                    out.append(_msg(1, bucket, block, n, p.astype(np.float32), t.astype(np.float32)))
                else:
                    out.append(_msg(0, bucket, block, of_pairs[np.frombuffer(a, np.int32)]))
            yield from _batched(out)

    return run


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, h, n) sorted by bucket to one table each, sorted by unsigned hash."""
    held: list[list[np.ndarray]] = []

    def table() -> pa.RecordBatch:
        bucket, h, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h.view(np.uint64))
        return _messages([_msg(WORDS, int(bucket[0]), -1, h[order], n[order])])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = np.flatnonzero(np.diff(cols[0])) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            part = [c[s:e] for c in cols]
            if held and held[-1][0][0] != part[0][0]:
                yield table()
                held = []
            held.append(part)
    if held:
        yield table()


def _ask(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _each_block(batches):
            bucket = block.words % np.uint64(parts)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(parts + 1).astype(np.uint64))
            rows = [_msg(1, b, number, block.words[order[s:e]]) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if e > s]
            for at in range(0, len(rows), 256):
                yield _messages(rows[at : at + 256])

    return run


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(parts: int, hot: np.ndarray, total: int, vocabulary: int, unknown: float) -> Callable:
    """Rows of a block, sorted by kind: its arrays (-1), values (0), words (1), codes (2); a row for each document."""

    def scored(held: dict[int, list[tuple]]) -> pa.RecordBatch:
        *_, rest = held[-1][0]
        block = Block(*rest)
        block.pairs(parts, hot)
        bucket = block.words % np.uint64(parts)
        order = np.argsort(bucket, kind="stable")
        joined = lambda kind, column, t: np.concatenate([np.frombuffer(r[column], t) for r in held.get(kind, [])] or [np.empty(0, t)])
        n, p, b = np.empty(len(order), np.int64), np.empty(len(order)), np.empty(len(order))
        n[order], p[order], tables = joined(1, 3, np.int64), joined(1, 4, np.float32), joined(1, 5, np.float32)
        b[order] = tables
        p[n == 0] = unknown
        b = np.where(n == 0, 1.0, (STRENGTH + DISCOUNT * b) / (STRENGTH + n))
        code = joined(2, 3, np.uint8)
        own = np.where(code == 1, 1 - DISCOUNT, 0.0)
        own[code == 2] = joined(0, 3, np.float32)
        pair = np.log10(own / (STRENGTH + n[block.u]) + b[block.u] * p[block.w])
        base = np.log10((n + 0.1) / (total + 0.1 * (vocabulary + 1)))
        first = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        sums = lambda x: np.add.reduceat(x, first)
        columns = [pa.array(block.keys, pa.int64()), pa.array(block.out), pa.array(block.sizes.astype(np.int64)), pa.array(sums((n > 0).astype(np.int64)[block.ids])), pa.array(np.full(len(first), total)), pa.array(sums(base[block.ids])), pa.array(sums(pair[block.place]))]
        return pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, defaultdict(list)
        for batch in batches:
            for k in range(batch.num_rows):
                number, kind, _, a, b, c, *rest = (col[k].as_py() for col in batch.columns)
                if number != now:
                    if held:
                        yield scored(held)
                    now, held = number, defaultdict(list)
                held[kind].append((None, None, None, a, b, c, rest))
        if held:
            yield scored(held)

    return run


def frequent_share(parts: int) -> float:
    """The share of all tokens over which a context is spread."""
    return 1 / parts


def bucket_count(shuffle_partitions: int, tokens: int) -> int:
    return max(min(BUCKETS * shuffle_partitions, max(FEW, tokens // SMALL)), -(-tokens // FULL))


def _bucket(h: str, parts: int) -> Column:
    """An unsigned hash modulo the number of buckets."""
    high, low = F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND((1 << 32) - 1)
    return ((high % parts) * ((1 << 32) % parts) + low) % parts


def scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    spark = df.sparkSession
    blocks = staged(df.select(F.col(key).cast("bigint"), text_or_empty(text)).mapInArrow(_make_blocks, BLOCKS), "blocks")

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _each_block(batches):
            n = np.bincount(block.ids[block.taught], minlength=len(block.words))
            some = np.flatnonzero(n)
            for at in range(0, len(some), 50_000):
                own = some[at : at + 50_000]
                yield pa.record_batch([pa.array(block.words[own].view(np.int64)), pa.array(n[own])], names=["h", "n"])

    words = staged(blocks.mapInArrow(taught, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total, vocabulary = (x or 0 for x in words.agg(F.sum("n"), F.count(F.lit(1))).first())
    parts = bucket_count(partitions(spark), total)
    frequent = [r["h"] for r in words.where(F.col("n") > total * frequent_share(parts)).select("h").collect()]  # fewer than parts
    hot = np.array(frequent, np.int64).view(np.uint64)

    width = -(-parts // min(parts, max(GROUPS, parts // SPREAD)))
    groups = -(-parts // width)

    met = staged(_delivered(blocks.mapInArrow(_send_pairs(parts, hot), MESSAGE), parts).mapInArrow(_meet(parts, width, hot), MESSAGE), "met", by="kind")
    of_kind = lambda df, kind: df.where(F.col("kind") == kind).select("kind", "bucket", "block", *CELLS)
    contexts, cold, spread = of_kind(met, CONTEXTS), of_kind(met, COLD), of_kind(met, HOT)
    once = staged(_delivered(of_kind(met, ONCE), groups).mapInArrow(_once, MESSAGE), "once")
    dropped(met, f"kind={ONCE}")
    fixed = _fixed(contexts, hot) if frequent else {}
    base = 1 / (vocabulary + 1)
    tables = float(vocabulary)

    def seated_root(turn: int, samples: int, last: bool) -> tuple[DataFrame, float, float]:
        """The root's replies; what is left to each word, and the customers with the strength: they make a word's probability."""
        nonlocal tables
        sent = (cold.unionByName(spread) if frequent else cold).mapInArrow(_customers(parts, width), MESSAGE).unionByName(once)
        root = staged(_delivered(sent, groups).mapInArrow(_root(parts, base, tables, turn, samples, last), MESSAGE), "root")
        everyone, tables = (float(x or 0) for x in of_kind(root, TOTALS).mapInArrow(_root_sums, "k double, mean double").agg(F.sum("k"), F.sum("mean")).first())
        return root, (ROOT_STRENGTH + ROOT_DISCOUNT * tables) * base, ROOT_STRENGTH + everyone

    pieces: list[DataFrame] = []  # the staged states
    for epoch in range(EPOCHS):
        root, *scale = seated_root(1000 * epoch, 1, False)
        before, last = pieces, epoch == EPOCHS - 1
        cold = staged(_delivered(cold.unionByName(of_kind(root, COLD)), parts).mapInArrow(_restaurants(epoch, last, *scale), MESSAGE), "seated")
        pieces = [cold]
        if frequent:
            spread = staged(_delivered(spread.unionByName(of_kind(root, HOT)), parts).mapInArrow(_spread(*scale), MESSAGE), "spread")
            for sweep in range(BURN + (SAMPLES if last else 0)):
                now, done = _tables(spread), spread
                totals = {u: fixed.get(u, 0) + now.get(u, 0) for u in frequent}
                spread = staged(spread.mapInArrow(_sweep(100 * epoch + sweep, totals, last and sweep >= BURN), MESSAGE), "spread")
                dropped(done)
            pieces.append(spread)
        for table in before:
            dropped(table)
        if not epoch:
            for kind in (COLD, HOT):
                dropped(met, f"kind={kind}")
        dropped(root)
    root, *scale = seated_root(1000 * EPOCHS, SAMPLES, True)
    unknown = scale[0] / scale[1]

    sums = _tables(spread, sums=True) if frequent else {}
    opened = {u: fixed.get(u, 0) + sums.get(u, 0) / SAMPLES for u in frequent}
    word_tables = words.select(_bucket("h", parts).alias("bucket"), "h", "n").repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_packed_words, MESSAGE)
    replies = of_kind(met, REPLIES)
    places = replies.where("octet_length(b) > 0").select("kind", "bucket", "block", F.col("b").alias("a"), *[F.lit(None).cast("binary").alias(c) for c in CELLS[1:]])
    asked = blocks.mapInArrow(_ask(parts), MESSAGE)
    for table in (word_tables, of_kind(root, ROOT), contexts, *pieces, places):
        asked = asked.unionByName(table)
    answers = staged(_delivered(asked, parts).mapInArrow(_answers(parts, opened, *scale, unknown), MESSAGE), "answers")
    for table in (root, *pieces, once, words):
        dropped(table)
    dropped(met, f"kind={CONTEXTS}")

    nothing = F.lit(None).cast("binary")
    codes = replies.select("block", F.lit(2).alias("kind"), "bucket", "a", nothing.alias("b"), nothing.alias("c"), F.lit(None).cast("array<bigint>").alias("doc_ids"), *[nothing.alias(x) for x in ("sizes", "words", "ids")])
    back = answers.select("block", "kind", "bucket", "a", "b", "c", F.lit(None).cast("array<bigint>").alias("doc_ids"), *[nothing.alias(x) for x in ("sizes", "words", "ids")])
    own = blocks.select("block", F.lit(-1).alias("kind"), F.lit(-1).cast("bigint").alias("bucket"), nothing.alias("a"), nothing.alias("b"), nothing.alias("c"), "doc_ids", "sizes", "words", "ids")
    every = own.unionByName(codes).unionByName(back).repartition(parts, "block").sortWithinPartitions("block", "kind", "bucket")
    return every.mapInArrow(_score(parts, hot, total, vocabulary, unknown), RESULT)


def perplexity(scored: DataFrame) -> DataFrame:
    """Of held-out and of training rows: tokens and perplexity a token, of the model and of the base."""
    ppl = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), ppl("score").alias("perplexity"), ppl("base_score").alias("base_perplexity"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
