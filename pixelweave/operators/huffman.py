"""Prefix codes: optimal and length-limited code lengths, canonical codes, and the code-length header of a dynamic block."""

from __future__ import annotations

import functools
import heapq
from itertools import groupby

from pixelweave.operators.inflate import CODE_ORDER


def _unlimited(weights: list[int]) -> list[int]:
    heap = [(w, k, (k,)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    depth, number = [0] * len(weights), len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for k in (*a[2], *b[2]):
            depth[k] += 1
        heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
        number += 1
    return depth


def package_merge(weights: list[int], limit: int) -> list[int]:
    """Optimal lengths of at most ``limit`` bits: the cheapest 2n - 2 of the packages built limit times over."""
    coins = sorted((w, (k,)) for k, w in enumerate(weights))
    packages: list[tuple[int, tuple]] = []
    for _ in range(limit):
        row = sorted(coins + packages)
        packages = [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)]
        last = row
    depth = [0] * len(weights)
    for _, members in last[: 2 * len(weights) - 2]:
        for k in members:
            depth[k] += 1
    return depth


def code_lengths(frequencies: list[int], limit: int = 15) -> list[int]:
    """A length for each symbol, 0 for unused ones; a single used symbol has one bit."""
    used = [k for k, f in enumerate(frequencies) if f]
    out = [0] * len(frequencies)
    if not used:
        return out
    if len(used) == 1:
        out[used[0]] = 1
        return out
    weights = [int(frequencies[k]) for k in used]
    depth = _unlimited(weights)
    if max(depth) > limit:
        depth = package_merge(weights, limit)
    for k, d in zip(used, depth, strict=True):
        out[k] = d
    return out


def canonical(lengths: list[int]) -> list[int]:
    """The code of each symbol, most significant bit first: by length, then symbol."""
    codes, code = [0] * len(lengths), 0
    for n in range(1, max(lengths, default=0) + 1):
        for k, own in enumerate(lengths):
            if own == n:
                codes[k] = code
                code += 1
        code <<= 1
    return codes


def reverse(value: int, bits: int) -> int:
    return int(format(value, f"0{bits}b")[::-1], 2) if bits else 0


#: What runs cost under given prices: these recur from header to header, the flat ones in each.
_MEMOS: dict[tuple[float, ...], dict] = {}


def _run(value: int, n: int, prices: list[float], memo: dict) -> tuple[float, tuple]:
    """The cheapest symbols (symbol, extra value, extra bits) for a run of equal lengths, the value itself sent first unless it is 0."""
    if n <= 0:
        return 0.0, ()
    key = (value, n)
    if key not in memo:
        options = [(value, 0, 0, 1)]
        if value == 0:
            options += [(17, k - 3, 3, k) for k in {min(n, 10), 3} if 3 <= k <= n] + [(18, k - 11, 7, k) for k in {min(n, 138)} if k >= 11]
            options += [(18, n - 3 - 11, 7, n - 3)] if 14 <= n <= 141 else []
        best = None
        for symbol, extra, bits, took in options:
            cost, rest = _run(value, n - took, prices, memo) if value == 0 else _repeats(value, n - took, prices, memo)
            cost += prices[symbol] + bits
            if best is None or cost < best[0]:
                best = (cost, ((symbol, extra, bits), *rest))
        memo[key] = best
    return memo[key]


def _repeats(value: int, n: int, prices: list[float], memo: dict) -> tuple[float, tuple]:
    """After the value was sent: plain copies or repeats of three to six."""
    if n <= 0:
        return 0.0, ()
    key = (value, n, "repeat")
    if key not in memo:
        best = None
        for symbol, extra, bits, took in [(value, 0, 0, 1), *[(16, k - 3, 2, k) for k in (6, 5, 4, 3) if k <= n]]:
            cost, rest = _repeats(value, n - took, prices, memo)
            cost += prices[symbol] + bits
            if best is None or cost < best[0]:
                best = (cost, ((symbol, extra, bits), *rest))
        memo[key] = best
    return memo[key]


def header(literals: list[int], distances: list[int]) -> tuple[list[tuple[int, int, int]], list[int], int, int]:
    """As _header; the header of a block is asked for when it is priced and when it is written."""
    return _header(tuple(literals), tuple(distances))


@functools.lru_cache(4096)
def _header(literals: tuple[int, ...], distances: tuple[int, ...]) -> tuple[list[tuple[int, int, int]], list[int], int, int]:
    """The code lengths of both trees as run symbols, the lengths of the run symbols' code, and the trimmed sizes.

    Runs may cross from one tree to the other. Prices start flat and follow the code that the choice before gave,
    until they repeat or five rounds are over.
    """
    n_literals = max(257, max(k for k, v in enumerate(literals) if v) + 1)
    n_distances = max(1, max((k for k, v in enumerate(distances) if v), default=0) + 1)
    lengths = [*literals[:n_literals], *distances[:n_distances]]
    runs = [(v, len(list(g))) for v, g in groupby(lengths)]
    prices: list[float] = [4.0] * 19
    best = None
    for _ in range(5):
        if len(_MEMOS) > 4096:
            _MEMOS.clear()
        memo = _MEMOS.setdefault(tuple(prices), {})
        symbols = [s for v, n in runs for s in _run(v, n, prices, memo)[1]]
        counts = [0] * 19
        for s, *_ in symbols:
            counts[s] += 1
        code = code_lengths(counts, 7)
        total = sum(code[s] + bits for s, _, bits in symbols) + 3 * (max(k for k, s in enumerate(CODE_ORDER) if code[s]) + 1)
        if best is None or total < best[0]:
            best = (total, symbols, code)
        follow = [float(c) if c else 7.0 for c in code]
        if follow == prices:
            break
        prices = follow
    return best[1], best[2], n_literals, n_distances
