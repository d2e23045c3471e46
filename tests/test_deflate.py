"""Codes and streams: known answers, an exhaustive oracle, a matrix of streams, malformed streams; the library decodes all we write."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.operators import deflate, filters, huffman, inflate


def cost(f, lengths):
    return sum(a * b for a, b in zip(f, lengths, strict=True))


def brute(f, limit):
    """The least cost over all length vectors that fit a code."""
    return min(cost(f, v) for v in itertools.product(range(1, limit + 1), repeat=len(f)) if sum(2.0**-n for n in v) <= 1)


def test_exhaustive_lengths():
    for n in range(2, 6):
        for f in itertools.product((1, 2, 3), repeat=n):
            for limit in range(max(2, (n - 1).bit_length()), 6):
                assert cost(f, huffman.code_lengths(list(f), limit)) == brute(f, limit)


def test_limited_lengths():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(fib, 15)
    assert max(lengths) == 15 and sum(2.0**-n for n in lengths) == 1
    assert huffman.code_lengths([0, 7, 0]) == [0, 1, 0] and huffman.code_lengths([0, 0]) == [0, 0]
    assert sum(2.0**-n for n in huffman.code_lengths(list(range(1, 289)))) == 1


def test_canonical():
    assert huffman.canonical([3, 3, 3, 3, 3, 2, 4, 4]) == [2, 3, 4, 5, 6, 0, 14, 15]


PATTERNS = {"constant": lambda i: 0xAA, "step": lambda i: (i * 31 + (i >> 8)) & 255, "hash": lambda i: (i * 2654435761 >> 13) & 255}


@pytest.mark.parametrize("pattern", PATTERNS)
@pytest.mark.parametrize("level,passes", [(1, 1), (6, 1), (9, 2), (12, 3)])
def test_matrix(pattern, level, passes):
    for n in (1000, 9000):
        data = bytes(map(PATTERNS[pattern], range(n)))
        z = deflate.zlib_compress(data, deflate.Options(level, passes))
        assert zlib.decompress(z) == data and inflate.inflate_zlib(z, n) == data
        assert inflate.trace(z[2:-4], n).data == data


@pytest.mark.parametrize("n", [65535, 65664, 70000])
def test_block_borders(n):
    for f in PATTERNS.values():
        data = bytes(map(f, range(n)))
        assert zlib.decompress(deflate.zlib_compress(data, deflate.Options(deflate.FAST))) == data
    assert zlib.decompress(deflate.zlib_compress(data, deflate.Options(deflate.STORE))) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.text("ab\n ", max_size=800).map(str.encode), st.sampled_from([1, 2, 3]))
def test_any_bytes(data, passes):
    z = deflate.zlib_compress(data, deflate.Options(deflate.BEST, passes, row=16))
    assert zlib.decompress(z) == data and inflate.inflate_zlib(z, len(data)) == data


def test_tokens_and_blocks():
    data = b"abcabcabcabcxyz" * 900 + random.Random(1).randbytes(9000)
    z = deflate.compress(data, deflate.Options(deflate.BEST, 2, max_block=6000))
    found = inflate.trace(z, len(data))
    assert len(found.blocks) > 1 and sum(b[2] for b in found.blocks) == len(data)
    assert sum(n if d else 1 for _, n, d in found.tokens) == len(data)


def test_no_worse_than_the_library():
    text = (" ".join(str(k * k) for k in range(3000))).encode()
    assert len(deflate.zlib_compress(text, deflate.Options(deflate.ULTRA, 3))) <= len(zlib.compress(text, 9))


def photo(width, height):
    rng = np.random.default_rng(width)
    y, x = np.mgrid[0:height, 0:width]
    base = sum(np.sin(x / a + b) * np.cos(y / c + d) * 40 for a, b, c, d in rng.random((6, 4)) * [40, 6, 40, 6] + [5, 0, 5, 0])
    s = np.stack([base + rng.normal(0, 4, (height, width)) + 128 + 10 * k for k in range(3)], 2).clip(0, 255).astype(np.uint8)
    rows = s.reshape(height, -1)
    return filters.apply(rows, 3, filters.choose(rows, 3, 0))


@pytest.mark.parametrize("size", [(64, 64), (256, 256), (768, 512)])
def test_pictures_are_less_than_the_library_makes_them(size):
    data = photo(*size)
    z = deflate.zlib_compress(data, deflate.Options(deflate.ULTRA, 2))
    assert zlib.decompress(z) == data and len(z) < len(zlib.compress(data, 9))


def test_nearest_matches_by_brute_force():
    """Every match is real, and none of a key length is missed: for each of them the nearest occurrence is at hand."""
    data = bytes(random.Random(4).choices(b"abc", k=700)) + b"xyz" * 200 + bytes(random.Random(5).choices(b"ab", k=500))
    for start in (0, 900):
        finder = deflate.Finder(data, deflate.Options(deflate.ULTRA), start)
        for i in range(start, len(data)):
            found = finder.at(i)
            assert all(data[i : i + n] == data[i - d : i - d + n] and (n == 258 or i + n == len(data) or data[i + n] != data[i + n - d]) for n, d in found)
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))
            for key in (3, 7, 16, 64):
                at = data.rfind(data[i : i + key], 0, i + key - 1) if i + key <= len(data) else -1
                assert [d for n, d in found if n >= key][:1] == ([i - at] if at >= 0 else [])


def test_regions(monkeypatch):
    data = (b"abcdefghij" * 400 + random.Random(6).randbytes(3000)) * 3
    whole = deflate.zlib_compress(data, deflate.Options(deflate.BEST, 2))
    monkeypatch.setattr(deflate, "REGION", 4096)
    cut = deflate.zlib_compress(data, deflate.Options(deflate.BEST, 2))
    assert zlib.decompress(cut) == data and len(cut) < len(whole) + 1500


def test_optimal_is_optimal():
    """Against the plain recursion over all matches, also where many segments are searched in lock-step."""
    data = bytes(random.Random(7).choices(b"abcd", k=1500))
    finder = deflate.Finder(data, deflate.Options())
    literal, distance = deflate.prices(deflate.greedy(finder), 0)
    cost = [0] * (len(data) + 1)
    for i in range(len(data) - 1, -1, -1):
        cost[i] = literal[data[i]] + cost[i + 1]
        for n, d in finder.at(i):
            c = deflate.distance_code(d)
            for k in range(3, n + 1):
                e = deflate.LENGTH_CODE[k]
                cost[i] = min(cost[i], literal[257 + e] + 1024 * (inflate.LENGTH_EXTRA[e] + inflate.DISTANCE_EXTRA[c]) + distance[c] + cost[i + k])
    price = lambda ts: sum((literal[257 + deflate.LENGTH_CODE[n]] + 1024 * inflate.LENGTH_EXTRA[deflate.LENGTH_CODE[n]] + distance[deflate.distance_code(d)] + 1024 * inflate.DISTANCE_EXTRA[deflate.distance_code(d)]) if d else literal[n] for n, d in ts)
    assert cost[0] <= price(deflate.optimal(finder, literal, distance)) <= cost[0] * 1.0005


def test_optimal_is_no_dearer_than_greedy():
    data = bytes(random.Random(3).choices(b"abcd", k=3000))
    finder = deflate.Finder(data, deflate.Options())
    first = deflate.greedy(finder)
    literal, distance = deflate.prices(first, 0)
    price = lambda ts: sum((literal[257 + deflate.LENGTH_CODE[n]] + 1024 * inflate.LENGTH_EXTRA[deflate.LENGTH_CODE[n]] + distance[deflate.distance_code(d)] + 1024 * inflate.DISTANCE_EXTRA[deflate.distance_code(d)]) if d else literal[n] for n, d in ts)
    assert price(deflate.optimal(finder, literal, distance)) <= price(first)


def test_distance_codes():
    for d in range(1, 32769):
        k = deflate.distance_code(d)
        assert inflate.DISTANCE_BASE[k] <= d < inflate.DISTANCE_BASE[k] + (1 << inflate.DISTANCE_EXTRA[k])


GOOD = zlib.compress(b"a" * 5000)


@pytest.mark.parametrize("stream,limit", [(b"", 10), (b"\x78", 10), (b"\x79\x01", 10), (b"\x78\x02", 10), (b"\x78\x20", 10), (GOOD, 1000), (GOOD[:-5], 5000), (GOOD[:-1] + bytes([GOOD[-1] ^ 1]), 5000), (b"\x78\x01\x07", 10), (b"\x78\x01\x01\1\0\0\0a", 10), (b"\x78\x01\xfd\xff\xff" + bytes(8), 10)])
def test_malformed(stream, limit):
    with pytest.raises(inflate.InflateError):
        inflate.inflate_zlib(stream, limit)


def test_tolerated():
    assert inflate.inflate_zlib(GOOD + bytes(5), 5000) == b"a" * 5000
    assert inflate.inflate_zlib(GOOD[:-4], 5000) == b"a" * 5000


def test_incomplete_code_is_read():
    # one distance code of two bits: not a full tree, but unambiguous
    assert inflate.Decoder([2, 0]).table == {(2, 0): 0}
    with pytest.raises(inflate.InflateError):
        inflate.Decoder([1, 1, 1])
