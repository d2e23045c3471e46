"""Scalar functions of the format as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixelweave.operators.inflate import DISTANCE_BASE, DISTANCE_EXTRA, LENGTH_BASE, LENGTH_EXTRA


def big_endian(data: Column, first: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes at a 1-based position."""
    return F.conv(F.hex(F.substring(data, first, size)), 16, 10).cast("bigint")


def to_big_endian(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"))


def swapped(data: Column, size: int) -> Column:
    """Bytes of a value in reverse order."""
    h = F.hex(data)
    return F.unhex(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]))


def chunk(kind: str, data: Column) -> Column:
    """A whole chunk: length, type, data, CRC."""
    body = F.concat(F.lit(kind).cast("binary"), data)
    return F.concat(to_big_endian(F.octet_length(data), 4), body, to_big_endian(F.crc32(body), 4))


def header(data: Column) -> dict[str, Column]:
    """The fields of IHDR."""
    return {n: big_endian(data, at, size) for n, at, size in (("width", 1, 4), ("height", 5, 4), ("bit_depth", 9, 1), ("color_type", 10, 1), ("method", 11, 1), ("filtering", 12, 1), ("interlace", 13, 1))}


def class_bits(kind: Column) -> dict[str, Column]:
    """Whether a chunk type is critical, public, safe to copy."""
    bit = lambda k: F.ascii(F.substring(kind, k, 1)).bitwiseAND(32) != 0
    return {"critical": ~bit(1), "public": ~bit(2), "safe_to_copy": bit(4)}


def trimmed_alpha(alpha: Column) -> Column:
    return F.unhex(F.regexp_replace(F.hex(alpha), "(FF)+$", ""))


def channels(color_type: Column) -> Column:
    return F.when(color_type.isin(0, 3), 1).when(color_type == 4, 2).when(color_type == 2, 3).when(color_type == 6, 4)


def scanline_bytes(width: Column, color_type: Column, bit_depth: Column) -> Column:
    return F.ceil(width * channels(color_type) * bit_depth / 8)


def paeth(a: Column, b: Column, c: Column) -> Column:
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def magnitude(b: Column) -> Column:
    return F.when(b > 127, 256 - b).otherwise(b)


def to_16_bits(v: Column, top: Column | int) -> Column:
    return F.floor(v * 65535 / top)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def rgba_key(r: Column, g: Column, b: Column, a: Column) -> Column:
    """One number for a colour; all wholly transparent ones are 0."""
    key = ((r.cast("bigint") * 256 + g) * 256 + b) * 256 + a
    return F.when(a == 0, F.lit(0).cast("bigint")).otherwise(key)


def _ladder(v: Column, base: tuple, values: list) -> Column:
    out = F.when(v < base[1], values[0])
    for k in range(1, len(base)):
        out = out.when(v < base[k + 1], values[k]) if k + 1 < len(base) else out.otherwise(values[k])
    return out


def length_code(n: Column) -> Column:
    return _ladder(n, LENGTH_BASE, [257 + k for k in range(29)])


def length_extra(n: Column) -> Column:
    return _ladder(n, LENGTH_BASE, list(LENGTH_EXTRA))


def distance_code(d: Column) -> Column:
    return _ladder(d, DISTANCE_BASE, list(range(30)))


def distance_extra(d: Column) -> Column:
    return _ladder(d, DISTANCE_BASE, list(DISTANCE_EXTRA))


def reversed_bits(value: Column, n: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(value.cast("bigint")), n, F.lit("0"))), 2, 10).cast("bigint")


def match_score(n: Column, d: Column) -> Column:
    return 256 * n - 32 * distance_extra(d)


def fixed_bits(symbol: Column) -> Column:
    return F.when(symbol < 144, 8).when(symbol < 256, 9).when(symbol < 280, 7).otherwise(8)


def zlib_header_ok(cmf: Column, flg: Column) -> Column:
    return ((cmf * 256 + flg) % 31 == 0) & (cmf.bitwiseAND(15) == 8)
