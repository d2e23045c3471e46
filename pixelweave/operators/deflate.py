"""DEFLATE encoding: matches, parses, block splitting and bit output.

A stream is taken in regions of REGION bytes, so what is held is bounded; matches reach into the window before a region.
For every position and every key length the nearest earlier occurrence is found by sorting hashed keys, however many
others there are, so no chain is ever left early. The first pass is lazy; later passes find the cheapest path under prices of the
pass before, from the end to the beginning, many segments of the stream in lock-step. Every block takes the least of
stored, fixed and dynamic coding. The bit stream is plain DEFLATE: any decoder reads it.
"""

from __future__ import annotations

import dataclasses
import math
import zlib
from collections.abc import Sequence

import numpy as np

from pixelweave.operators import huffman
from pixelweave.operators.inflate import CODE_ORDER, DISTANCE_BASE, DISTANCE_EXTRA, FIXED_LENGTHS, LENGTH_BASE, LENGTH_EXTRA

STORE, FAST, DEFAULT, BEST, ULTRA = 0, 1, 6, 9, 12
WINDOW, LONGEST, NICE = 32768, 258, 32
REGION = 1 << 21
#: Key lengths whose nearest earlier occurrences are candidates.
KEYS = {FAST: (3, 5, 8, 16, 64), DEFAULT: (3, 4, 5, 6, 8, 11, 16, 32, 64, 128, 258)}
KEYS |= dict.fromkeys((BEST, ULTRA), (3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 258))
#: Segments of the lock-step search: least and most bytes, and how far each looks beyond its end.
SEGMENT, AHEAD = (512, 8192), 320
#: Segments (or ranges) from which on they are dealt by their longest matches, and the classes of those.
MANY, BY_LONGEST = 64, ((3, 8), (9, 24), (25, 80), (81, LONGEST))
#: Bytes of short data that are searched side by side.
BATCH = 1 << 20

LENGTH_CODE = [0] * 259
for _k, _b in enumerate(LENGTH_BASE):
    for _n in range(_b, 259):
        LENGTH_CODE[_n] = _k


def distance_code(d: int) -> int:
    """From 1 on; codes double their range every second code."""
    if d <= 4:
        return d - 1
    high = int(d - 1).bit_length() - 1
    return 2 * high + ((d - 1) >> (high - 1) & 1)


_LENGTH_CODE, _LENGTH_BASE, _LENGTH_EXTRA = np.array(LENGTH_CODE), np.array(LENGTH_BASE), np.array(LENGTH_EXTRA)
_DISTANCE_CODE = np.searchsorted(np.array(DISTANCE_BASE), np.arange(WINDOW + 1), "right") - 1
_DISTANCE_BASE, _DISTANCE_EXTRA = np.array(DISTANCE_BASE), np.array(DISTANCE_EXTRA)


@dataclasses.dataclass(frozen=True)
class Options:
    level: int = BEST
    passes: int = 1
    split: bool = True
    max_block: int = 65535
    row: int = 0  # bytes of a scanline; near and row distances need no probes of their own, as the nearest occurrence is always found

    @property
    def keys(self) -> tuple[int, ...]:
        return KEYS.get(self.level, KEYS[BEST])


Token = tuple[int, int]  # (byte, 0) or (length, distance)
Tokens = np.ndarray | Sequence[Token]  # rows of that


def as_tokens(tokens: Tokens) -> np.ndarray:
    return np.asarray(tokens, np.int64).reshape(-1, 2)


def sizes_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens[:, 1] > 0, tokens[:, 0], 1)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _MIX + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Finder:
    """Match frontiers of a region: for each position, ever longer matches at ever longer distances, each the nearest of its length."""

    def __init__(self, data: bytes, options: Options, start: int = 0, end: int | None = None) -> None:
        self.data, self.start, self.end = data, start, len(data) if end is None else end
        self.bytes = np.frombuffer(data, np.uint8, self.end - start, start)
        found = self._search(options.keys)
        n = self.end - start
        place, size, dist = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        order = np.argsort(place, kind="stable")  # a position's matches stay in the order of their lengths
        self.first = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(place, minlength=n), out=self.first[1:])
        self.size, self.dist = size[order].astype(np.int64), dist[order].astype(np.int64)
        self._longest: tuple[list[int], list[int]] | None = None

    def _search(self, keys: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        begin = max(0, self.start - WINDOW)
        x = np.frombuffer(self.data, np.uint8, self.end - begin, begin)
        n, shift = len(x), self.start - begin
        if n < 3:
            return []
        # hashes of 1, 2, 4 ... 256 bytes; where the data end a hash takes what there is, and no length beyond the end is used
        hashes = [_mixed(x.astype(np.uint64), np.uint64(1))]
        for k in range(8):
            h, p = hashes[-1], 1 << k
            hashes.append(_mixed(h, np.concatenate([h[p:], np.zeros(min(p, n), np.uint64)])))
        bits = np.uint64(max(1, (n - 1).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        active = np.arange(n)
        known = np.zeros(n, np.int64)  # how far a position's candidates reach so far
        out = []
        for key in keys:
            active = active[active <= n - key]
            if len(active) < 2:
                break
            k = key.bit_length() - 1
            h = hashes[k]
            own = _mixed(h[active], h[active + key - (1 << k)])
            packed = np.sort((own & ~low) | active.astype(np.uint64))
            same = (packed[1:] ^ packed[:-1]) <= low
            at = (packed & low).astype(np.int64)
            later, before = at[1:][same], at[:-1][same]
            kept = np.zeros(n, bool)
            kept[later] = kept[before] = True
            active = np.flatnonzero(kept)
            fresh = (known[later] < key) & (later - before <= WINDOW) & (later >= shift)
            later, before = later[fresh], before[fresh]
            if len(later):
                size = self._common(hashes, later, before, n)
                good = size >= key
                later, before, size = later[good], before[good], size[good]
                known[later] = size
                out.append((later - shift, size, later - before))
        return out

    @staticmethod
    def _common(hashes: list[np.ndarray], i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
        """How many bytes at i and j are equal, LONGEST at most: powers of two from the largest down."""
        most, size = np.minimum(LONGEST, n - i), np.zeros(len(i), np.int64)
        for k in (8, 7, 6, 5, 4, 3, 2, 1, 0):
            fits = np.flatnonzero(size + (1 << k) <= most)
            h = hashes[k]
            equal = fits[h[i[fits] + size[fits]] == h[j[fits] + size[fits]]]
            size[equal] += 1 << k
        return size

    def at(self, i: int) -> list[Token]:
        """(length, distance) pairs, both ascending."""
        s, e = self.first[i - self.start], self.first[i - self.start + 1]
        return list(zip(self.size[s:e].tolist(), self.dist[s:e].tolist(), strict=True))

    def longest(self) -> tuple[list[int], list[int]]:
        """For each position the match of the best score (256 for a byte, less 32 for an extra bit of the distance; of equal ones the nearer) as lists of lengths and distances; 0 for none."""
        if self._longest is None:
            n = self.end - self.start
            size, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
            counts = np.diff(self.first)
            some = np.flatnonzero(counts)
            if len(some):
                score = 256 * self.size - 32 * _DISTANCE_EXTRA[_DISTANCE_CODE[self.dist]]
                rank = np.arange(len(score)) - np.repeat(self.first[some], counts[some])
                best = np.maximum.reduceat(((score + 512) << 8) | (255 - rank), self.first[some])
                pick = self.first[some] + 255 - (best & 255)
                size[some], dist[some] = self.size[pick], self.dist[pick]
            self._longest = size.tolist(), dist.tolist()
        return self._longest


class Joined:
    """The match frontiers of several regions one after the other, for one search in lock-step."""

    def __init__(self, finders: Sequence[Finder]) -> None:
        self.start, self.end = 0, sum(f.end - f.start for f in finders)
        before = np.cumsum([0, *[len(f.size) for f in finders]])
        self.bytes = np.concatenate([f.bytes for f in finders])
        self.first = np.concatenate([*[f.first[:-1] + b for f, b in zip(finders, before[:-1], strict=True)], before[-1:]])
        self.size, self.dist = np.concatenate([f.size for f in finders]), np.concatenate([f.dist for f in finders])


def greedy(finder: Finder) -> np.ndarray:
    """Lazy parse: a match waits for up to three positions while a later one is longer by more than it skips."""
    data, n = finder.bytes.tolist(), finder.end - finder.start
    size, dist = finder.longest()
    out: list[Token] = []
    i = 0
    while i < n:
        k = size[i]
        if k < 3:
            out.append((data[i], 0))
            i += 1
            continue
        if k < NICE:
            for skip in range(1, min(4, n - i)):
                if size[i + skip] > k + skip:
                    out += [(data[i + j], 0) for j in range(skip)]
                    i += skip
                    k = size[i]
                    break
        out.append((k, dist[i]))
        i += k
    return as_tokens(out)


def histograms(tokens: Tokens) -> tuple[list[int], list[int]]:
    t = as_tokens(tokens)
    match = t[:, 1] > 0
    literals = np.bincount(t[~match, 0], minlength=288) + np.bincount(257 + _LENGTH_CODE[t[match, 0]], minlength=288)
    literals[256] = 1
    return literals.tolist(), np.bincount(_DISTANCE_CODE[t[match, 1]], minlength=32).tolist()


def prices(tokens: Tokens, turn: int) -> tuple[list[int], list[int]]:
    """Costs in 1/1024 bits of literal-length and distance symbols: entropy first, then more and more the code itself, at last with small fixed nudges."""
    share = {0: 1.0, 1: 0.5, 2: 0.15}.get(turn, 0.4)
    out = []
    for counts in histograms(tokens):
        total, lengths = sum(counts), huffman.code_lengths(counts)
        unseen = min(15, max(lengths) + 1) if total else 5
        own = []
        for k, (c, n) in enumerate(zip(counts, lengths, strict=True)):
            bits = share * math.log2(total / c) + (1 - share) * n if c else unseen
            cost = round(1024 * min(15.0, max(1.0, bits)))
            own.append(cost + ((k * 37 + turn * 11) % 97 - 48 if turn >= 3 else 0))
        out.append(own)
    return out[0], out[1]


def _segments(ranges: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """First position, end, end of what is looked at, and range of each segment; longest first. Many ranges make segments enough, so theirs are longer."""
    total = sum(e - s for s, e in ranges)
    span = min(SEGMENT[1], max(SEGMENT[0] if len(ranges) < MANY else 4 * SEGMENT[0], total // 128 if len(ranges) < MANY else total // 1024))
    rows = [(a, min(a + span, e), min(a + span + AHEAD, e), g) for g, (s, e) in enumerate(ranges) for a in range(s, e, span)]
    rows.sort(key=lambda r: r[0] - r[2])
    return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def cheapest_steps(finder: Finder | Joined, ranges: list[tuple[int, int]], costs: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """For every position of the ranges (relative to the region) the size and distance of the step that begins the cheapest way to the range's end.

    Each segment is searched from its end backwards, all of them in lock-step; a segment starts AHEAD beyond its end, where the
    way's cost hardly depends on where it started. Of equal ways matches come before literals, longer and nearer ones first.
    Segments are columns; where there are many, those whose longest matches are of one class of BY_LONGEST are done together, as each
    class prices all lengths up to its longest.
    """
    n = finder.end - finder.start
    literal, distance = (np.array([c[k] for c in costs], np.int64) for k in (0, 1))
    by_length = np.zeros((LONGEST + 1, len(costs)), np.int64)
    by_length[3:] = literal[:, 257 + _LENGTH_CODE[3:]].T + 1024 * _LENGTH_EXTRA[_LENGTH_CODE[3:], None]
    by_code = distance[:, :30] + 1024 * _DISTANCE_EXTRA
    of = np.zeros(n, np.int64)
    for g, (s, e) in enumerate(ranges):
        of[s:e] = g
    counts = np.diff(finder.first)
    longest = np.zeros(n, np.int64)
    longest[counts > 0] = finder.size[finder.first[1:][counts > 0] - 1]
    single = literal[of, finder.bytes]
    match = by_code[np.repeat(of, counts), _DISTANCE_CODE[finder.dist]] << 9
    starts, ends, beyond, group = _segments(ranges)
    reach = beyond - starts
    table = np.zeros((int(reach.max(initial=0)) + 1, len(starts)), np.int64)
    step_size, step_distance = np.ones(n, np.int64), np.zeros(n, np.int64)
    tie, each = 511 - np.arange(LONGEST + 1)[:, None], np.arange(max(1, int(counts.max(initial=0))))[:, None]
    rows = len(starts)
    last = max(0, len(match) - 1)
    for s in range(1, len(table)):
        while reach[rows - 1] < s:
            rows -= 1
        at = beyond[:rows] - s
        now = table[s - 1, :rows] + single[at]
        far = np.minimum(longest[at], s)
        for least, most in BY_LONGEST if rows >= MANY else ((3, LONGEST),):
            r = np.flatnonzero((far >= least) & (far <= most))
            if not len(r):
                continue
            here, places, most = at[r], np.arange(len(r)), int(far[r].max())
            own = counts[here]
            cell = np.minimum(finder.first[here] + each[: int(own.max())], last)
            size = np.where(each[: len(cell)] < own, np.minimum(finder.size[cell], s), 0)
            lengths = by_length[3 : most + 1] if len(costs) == 1 else by_length[3 : most + 1, group[r]]
            ways = ((table[s - most : s - 2, r][::-1] + lengths) << 9) | tie[3 : most + 1]
            np.minimum.accumulate(ways, axis=0, out=ways)
            value = np.where(size >= 3, ways[np.maximum(size - 3, 0), places] + match[cell], 1 << 62)
            k = value.argmin(0)
            best = value[k, places]
            better = (best >> 9) <= now[r]
            now[r[better]] = best[better] >> 9
            mine = better & (here < ends[r])
            step_size[here[mine]] = 511 - (best[mine] & 511)
            step_distance[here[mine]] = finder.dist[cell[k[mine], places[mine]]]
        table[s, :rows] = now
    return step_size, step_distance


def walked(finder: Finder, steps: tuple[np.ndarray, np.ndarray], start: int, end: int) -> np.ndarray:
    """The tokens of a range (relative to the region), step by step."""
    size, dist = steps[0][start:end].tolist(), steps[1][start:end]
    at, i, n = [], 0, end - start
    while i < n:
        at.append(i)
        i += size[i]
    at = np.array(at, np.int64)
    taken, far = steps[0][start:end][at], dist[at]
    return np.stack([np.where(far > 0, taken, finder.bytes[start:end][at]), far], 1)


def optimal(finder: Finder, literal: list[int], distance: list[int]) -> np.ndarray:
    """The cheapest path over a region under given prices."""
    n = finder.end - finder.start
    if not n:
        return as_tokens([])
    return walked(finder, cheapest_steps(finder, [(0, n)], [(literal, distance)]), 0, n)


class Writer:
    """Bits, least significant first."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.bits = 0

    def put(self, value: int, size: int) -> None:
        if size:
            self.values.append(value)
            self.sizes.append(size)
            self.bits += size

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.parts.append((values.astype(np.uint64), sizes.astype(np.int64)))
        self.bits += int(sizes.sum())

    def _flush(self) -> None:
        if self.sizes:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def align(self) -> None:
        self.put(0, -self.bits % 8)

    def data(self) -> bytes:
        """What was put, packed some thousand values at a time; bits of a byte that isn't full go to the next pack."""
        self._flush()
        out, rest = [], np.empty(0, np.uint8)
        for values, sizes in self.parts:
            for k in range(0, len(sizes), 1 << 16):
                v, n = values[k : k + (1 << 16)], sizes[k : k + (1 << 16)]
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                bits = np.concatenate([rest, ((np.repeat(v, n) >> place.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)])
                full = len(bits) - len(bits) % 8
                out.append(np.packbits(bits[:full], bitorder="little").tobytes())
                rest = bits[full:]
        return b"".join([*out, np.packbits(rest, bitorder="little").tobytes()])


FIXED_DISTANCES = [5] * 30


def _body_bits(literals: list[int], distances: list[int], by_literal: list[int], by_distance: list[int]) -> int:
    bits = sum(c * n for c, n in zip(literals, by_literal, strict=False)) + sum(c * n for c, n in zip(distances, by_distance, strict=False))
    return bits + sum(literals[257 + k] * e for k, e in enumerate(LENGTH_EXTRA)) + sum(distances[k] * e for k, e in enumerate(DISTANCE_EXTRA))


def block_costs(tokens: Tokens, size: int, at_bit: int = 0) -> dict[str, int]:
    """Exact bits of the three codings, their three-bit heads included; stored data is cut at 65535 bytes."""
    literals, distances = histograms(tokens)
    by_literal, by_distance = _trees(literals, distances)
    symbols, code, *_ = huffman.header(by_literal, by_distance)
    n_code = max(4, max(k for k, s in enumerate(CODE_ORDER) if code[s]) + 1)
    head = 14 + 3 * n_code + sum(code[s] + bits for s, _, bits in symbols)
    pieces = max(1, -(-size // 65535))
    stored = 3 + (-(at_bit + 3) % 8) + 32 + 40 * (pieces - 1) + 8 * size
    return {"stored": stored, "fixed": 3 + _body_bits(literals, distances, FIXED_LENGTHS, FIXED_DISTANCES), "dynamic": 3 + head + _body_bits(literals, distances, by_literal, by_distance)}


def _trees(literals: list[int], distances: list[int]) -> tuple[list[int], list[int]]:
    by_distance = huffman.code_lengths(distances[:30])
    if not any(by_distance):
        by_distance[0] = 1  # a dynamic block must name a distance code
    by_literal = huffman.code_lengths(literals[:286])
    return by_literal, by_distance


def _put_tokens(out: Writer, tokens: np.ndarray, by_literal: list[int], by_distance: list[int]) -> None:
    """A value for each token: its code, the extra bits of its length, the code and extra bits of its distance, one above the other."""
    code = lambda lengths: np.array([huffman.reverse(c, n) for c, n in zip(huffman.canonical(lengths), lengths, strict=True)], np.int64)
    a, a_bits, b, b_bits = code(by_literal), np.array(by_literal), code(by_distance), np.array(by_distance)
    t = as_tokens(tokens)
    match = t[:, 1] > 0
    values, sizes = np.empty(len(t) + 1, np.int64), np.empty(len(t) + 1, np.int64)
    literal = t[~match, 0]
    values[:-1][~match], sizes[:-1][~match] = a[literal], a_bits[literal]
    n, d = t[match, 0], t[match, 1]
    k, c = _LENGTH_CODE[n], _DISTANCE_CODE[d]
    value, size = a[257 + k], a_bits[257 + k]
    for more, bits in ((n - _LENGTH_BASE[k], _LENGTH_EXTRA[k]), (b[c], b_bits[c]), (d - _DISTANCE_BASE[c], _DISTANCE_EXTRA[c])):
        value, size = value | (more << size), size + bits
    values[:-1][match], sizes[:-1][match] = value, size
    values[-1], sizes[-1] = a[256], a_bits[256]
    out.put_all(values, sizes)


def put_stored(out: Writer, raw: bytes, last: bool) -> None:
    for at in range(0, max(1, len(raw)), 65535):
        part = raw[at : at + 65535]
        out.put(int(last and at + 65535 >= len(raw)), 1)
        out.put(0, 2)
        out.align()
        out.put(len(part), 16)
        out.put(len(part) ^ 0xFFFF, 16)
        out.put_all(np.frombuffer(part, np.uint8), np.full(len(part), 8))


def put_block(out: Writer, tokens: Tokens, raw: bytes, last: bool) -> str:
    """Writes the cheapest coding: fixed unless another is less, then stored unless dynamic is."""
    costs = block_costs(tokens, len(raw), out.bits)
    kind = "fixed" if costs["fixed"] <= min(costs.values()) else "stored" if costs["stored"] <= costs["dynamic"] else "dynamic"
    if kind == "stored":
        put_stored(out, raw, last)
        return kind
    out.put(int(last), 1)
    out.put(1 if kind == "fixed" else 2, 2)
    if kind == "fixed":
        _put_tokens(out, tokens, FIXED_LENGTHS, FIXED_DISTANCES)
        return kind
    by_literal, by_distance = _trees(*histograms(tokens))
    symbols, code, n_literals, n_distances = huffman.header(by_literal, by_distance)
    n_code = max(4, max(k for k, s in enumerate(CODE_ORDER) if code[s]) + 1)
    out.put(n_literals - 257, 5)
    out.put(n_distances - 1, 5)
    out.put(n_code - 4, 4)
    for k in range(n_code):
        out.put(code[CODE_ORDER[k]], 3)
    own = [huffman.reverse(c, n) for c, n in zip(huffman.canonical(code), code, strict=True)]
    for s, extra, bits in symbols:
        out.put(own[s], code[s])
        out.put(extra, bits)
    _put_tokens(out, tokens, by_literal, by_distance)
    return kind


def _estimate(literals: np.ndarray, distances: np.ndarray) -> float:
    """Bits of a block by the entropy of its histograms, its extra bits, and a price of the header by active symbols."""
    bits = 60.0 + 6 * int((literals > 0).sum() + (distances > 0).sum())
    for h in (literals, distances):
        used = h[h > 0]
        if len(used):
            bits += float((used * np.log2(used.sum() / used)).sum())
    return bits + float(literals[257:286] @ np.array(LENGTH_EXTRA)) + float(distances[:30] @ np.array(DISTANCE_EXTRA))


def split_tokens(tokens: Tokens, size: int, most: int, least: int = 4096) -> list[tuple[int, int]]:
    """Token ranges of blocks: the cheapest segmentation over cuts about every max(4096, size/1024) bytes; one block if none is feasible."""
    t = as_tokens(tokens)
    ends = np.cumsum(sizes_of(t))
    every = max(4096, size // 1024)
    cuts = [0]
    while cuts[-1] < len(t):
        k = int(np.searchsorted(ends, (ends[cuts[-1] - 1] if cuts[-1] else 0) + every, "left"))
        cuts.append(min(k + 1, len(t)))
    if len(cuts) <= 2:
        return [(0, len(t))]
    sums = [(np.zeros(288, np.int64), np.zeros(32, np.int64))]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = (np.array(h) for h in histograms(t[a:b]))
        x[256] = 0
        sums.append((sums[-1][0] + x, sums[-1][1] + y))
    place = [0, *[int(ends[c - 1]) for c in cuts[1:]]]
    cost, came = [0.0] + [math.inf] * (len(cuts) - 1), [0] * len(cuts)
    for j in range(1, len(cuts)):
        for i in range(j - 1, -1, -1):
            span = place[j] - place[i]
            if span > most:
                break
            if (span < least and j < len(cuts) - 1) or cost[i] == math.inf:
                continue
            literals = sums[j][0] - sums[i][0]
            literals[256] = 1
            total = cost[i] + _estimate(literals, sums[j][1] - sums[i][1])
            if total < cost[j]:
                cost[j], came[j] = total, i
    if cost[-1] == math.inf:
        return [(0, len(t))]
    out, j = [], len(cuts) - 1
    while j:
        out.append((cuts[came[j]], cuts[j]))
        j = came[j]
    return out[::-1]


def split_fixed(size: int, most: int) -> list[tuple[int, int]]:
    return [(at, min(at + most, size)) for at in range(0, max(1, size), most)]


def _best_blocks(finders: Sequence[Finder], options: Options) -> list[list[np.ndarray]]:
    """The tokens of each block of each region: passes over all of it, cuts where the codes change, passes over each block with its own prices."""
    sizes = [f.end - f.start for f in finders]
    borders = np.cumsum([0, *sizes]).tolist()
    whole = list(zip(borders[:-1], borders[1:], strict=True))
    tokens = [greedy(f) for f in finders]
    joined = Joined(finders) if len(finders) > 1 and options.passes > 1 else finders[0]
    best, cheapest = list(tokens), [min(block_costs(t, n).values()) for t, n in zip(tokens, sizes, strict=True)]
    for turn in range(options.passes - 1):
        steps = cheapest_steps(joined, whole, [prices(t, turn) for t in tokens])
        tokens = [walked(joined, steps, a, b) for a, b in whole]
        for k, n in enumerate(sizes):
            total = min(block_costs(tokens[k], n).values())
            if total < cheapest[k]:
                best[k], cheapest[k] = tokens[k], total
    parts = [[t[a:b] for a, b in (split_tokens(t, n, options.max_block) if options.split else [(0, len(t))])] for t, n in zip(best, sizes, strict=True)]
    cut = [(k, i) for k, p in enumerate(parts) if len(p) > 1 for i in range(len(p))]
    if cut and options.passes >= 2:
        span = [int(sizes_of(parts[k][i]).sum()) for k, i in cut]
        begins = [borders[k] + sum(int(sizes_of(p).sum()) for p in parts[k][:i]) for k, i in cut]
        ranges = [(a, a + n) for a, n in zip(begins, span, strict=True)]
        for turn in range(min(2, options.passes - 1)):
            steps = cheapest_steps(joined, ranges, [prices(parts[k][i], turn) for k, i in cut])
            for (k, i), (a, b) in zip(cut, ranges, strict=True):
                again = walked(joined, steps, a, b)
                if min(block_costs(again, b - a).values()) < min(block_costs(parts[k][i], b - a).values()):
                    parts[k][i] = again
    return parts


def _put_blocks(out: Writer, parts: list[np.ndarray], data: bytes, at: int, end: bool) -> None:
    for k, part in enumerate(parts):
        size = int(sizes_of(part).sum())
        put_block(out, part, data[at : at + size], end and k == len(parts) - 1)
        at += size


def compress(data: bytes, options: Options | None = None) -> bytes:
    """A raw DEFLATE stream."""
    options = options or Options()
    out = Writer()
    if options.level == STORE:
        put_stored(out, data, True)
        return out.data()
    for start in range(0, max(1, len(data)), REGION):
        finder = Finder(data, options, start, min(len(data), start + REGION))
        _put_blocks(out, _best_blocks([finder], options)[0], data, start, finder.end == len(data))
    return out.data()


def compress_all(all_data: Sequence[bytes], options: Options | None = None) -> list[bytes]:
    """A raw DEFLATE stream for each; short data are searched side by side, BATCH bytes at a time, and equal data of a batch once."""
    options = options or Options()
    found: list[bytes] = []
    held: dict[bytes, int] = {}

    places: list[int] = []
    size = 0
    for data in all_data:
        if data not in held:
            if held and size + len(data) > BATCH:
                made = _side_by_side(list(held), options)
                found += [made[k] for k in places]
                held, places, size = {}, [], 0
            held[data] = len(held)
            size += len(data)
        places.append(held[data])
    made = _side_by_side(list(held), options)
    return found + [made[k] for k in places]


def _side_by_side(all_data: list[bytes], options: Options) -> list[bytes]:
    if len(all_data) < 2 or options.level == STORE or max(map(len, all_data)) > REGION:
        return [compress(data, options) for data in all_data]
    made = []
    for data, parts in zip(all_data, _best_blocks([Finder(data, options) for data in all_data], options), strict=True):
        out = Writer()
        _put_blocks(out, parts, data, 0, True)
        made.append(out.data())
    return made


def zlib_compress(data: bytes, options: Options | None = None) -> bytes:
    return b"\x78\x01" + compress(data, options) + zlib.adler32(data).to_bytes(4, "big")
