"""DEFLATE decoding: the library decoder for bulk, and an instrumented one that also tells blocks and tokens."""

from __future__ import annotations

import dataclasses
import zlib

# Fixed values of the format: first length and extra bits of length codes 257 on, first distance and extra bits of distance codes.
LENGTH_BASE = (3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258)
LENGTH_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 0)
DISTANCE_BASE = (1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577)
DISTANCE_EXTRA = (0, 0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13)
# Fixed values of the format: the order of the code-length code's lengths.
CODE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
FIXED_LENGTHS = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8


class InflateError(ValueError):
    pass


def _header(data: bytes) -> None:
    if len(data) < 2:
        raise InflateError("zlib stream is too short")
    cmf, flg = data[0], data[1]
    if cmf & 15 != 8 or cmf >> 4 > 7 or (cmf << 8 | flg) % 31:
        raise InflateError("bad zlib header")
    if flg & 32:
        raise InflateError("zlib preset dictionary")


def inflate_raw(data: bytes, limit: int) -> tuple[bytes, int]:
    """The bytes and how many input bytes they took. Raises on malformed input or more output than the limit."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error as e:
        # the library also refuses incomplete code sets; the instrumented decoder only refuses over-subscribed ones
        try:
            found = trace(data, limit)
        except InflateError:
            raise InflateError(str(e)) from None
        return found.data, found.used
    if len(out) > limit:
        raise InflateError("more output than allowed")
    if not d.eof:
        raise InflateError("stream ends early")
    return out, len(data) - len(d.unused_data)


def inflate_zlib(data: bytes, limit: int) -> bytes:
    """As inflate_raw, in a zlib wrapper. A missing checksum and trailing bytes are tolerated, a wrong checksum isn't."""
    _header(data)
    out, used = inflate_raw(data[2:], limit)
    tail = data[2 + used : 6 + used]
    if len(tail) == 4 and int.from_bytes(tail, "big") != zlib.adler32(out):
        raise InflateError("checksum mismatch")
    return out


@dataclasses.dataclass
class Trace:
    data: bytes
    used: int
    #: (kind, first output byte, bytes, first bit, bits); kind 0 stored, 1 fixed, 2 dynamic.
    blocks: list[tuple[int, int, int, int, int]]
    #: (block, literal or length, distance); distance 0 marks a literal.
    tokens: list[tuple[int, int, int]]


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self) -> int:
        """At least the next 57 bits, zeros beyond the end: enough for a length, a distance and the extra bits of both."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.end:
            raise InflateError("stream ends early")

    def take(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return value


class Decoder:
    """A canonical code by (length, code), read by what the next bits begin with; an over-subscribed one is refused, an incomplete one isn't."""

    def __init__(self, lengths: list[int]) -> None:
        room = sum(1 << (15 - n) for n in lengths if n)
        if room > 1 << 15:
            raise InflateError("over-subscribed code")
        longest = max(lengths, default=0)
        self.mask = (1 << longest) - 1
        self.table: dict[tuple[int, int], int] = {}
        self.begins = [(0, 0)] * (1 << longest)  # symbol and length by the next bits; length 0 for none
        of: list[list[int]] = [[] for _ in range(16)]
        for symbol, n in enumerate(lengths):
            of[n].append(symbol)
        code = 0
        for n in range(1, longest + 1):
            for symbol in of[n]:
                self.table[n, code] = symbol
                self.begins[int(format(code, f"0{n}b")[::-1], 2) :: 1 << n] = [(symbol, n)] * (1 << (longest - n))
                code += 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        symbol, n = self.begins[bits.peek() & self.mask]
        if not n:
            bits.skip(15)  # a stream that ends within the code ends early
            raise InflateError("invalid code")
        bits.skip(n)
        return symbol


_FIXED: list[Decoder] = []


def _fixed() -> list[Decoder]:
    if not _FIXED:
        _FIXED[:] = [Decoder(FIXED_LENGTHS), Decoder([5] * 30)]
    return _FIXED


def _dynamic(bits: _Bits) -> tuple[Decoder, Decoder]:
    literals, distances, codes = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    if literals > 286 or distances > 30:
        raise InflateError("too many codes")
    own = [0] * 19
    for k in range(codes):
        own[CODE_ORDER[k]] = bits.take(3)
    first, lengths = Decoder(own), []
    while len(lengths) < literals + distances:
        symbol = first.read(bits)
        if symbol < 16:
            lengths.append(symbol)
            continue
        if symbol == 16 and not lengths:
            raise InflateError("repeat of nothing")
        value, n = (lengths[-1], 3 + bits.take(2)) if symbol == 16 else (0, 3 + bits.take(3) if symbol == 17 else 11 + bits.take(7))
        lengths += [value] * n
    if len(lengths) > literals + distances:
        raise InflateError("repeat overflow")
    if not lengths[256]:
        raise InflateError("no end code")
    return Decoder(lengths[:literals]), Decoder(lengths[literals:])


def trace(data: bytes, limit: int) -> Trace:
    """Decode a raw stream and tell its blocks and tokens."""
    bits, out = _Bits(data), bytearray()
    blocks, tokens, last = [], [], False
    while not last:
        begin, begin_bit = len(out), bits.at
        last, kind = bool(bits.take(1)), bits.take(2)
        if kind == 3:
            raise InflateError("invalid block type")
        if kind == 0:
            bits.at = -(-bits.at // 8) * 8
            n = bits.take(16)
            if n ^ 0xFFFF != bits.take(16):
                raise InflateError("stored length mismatch")
            first = bits.at // 8
            if first + n > len(data):
                raise InflateError("stream ends early")
            out += data[first : first + n]
            tokens += [(len(blocks), v, 0) for v in data[first : first + n]]
            bits.at += 8 * n
        else:
            literal, distance = _fixed() if kind == 1 else _dynamic(bits)
            literals, mask, block = literal.begins, literal.mask, len(blocks)
            while True:
                ahead = bits.peek()
                symbol, n = literals[ahead & mask]
                if not n:
                    literal.read(bits)  # raises
                bits.skip(n)
                if symbol < 256:
                    out.append(symbol)
                    tokens.append((block, symbol, 0))
                elif symbol == 256:
                    break
                else:
                    if symbol > 285:
                        raise InflateError("invalid length code")
                    size = LENGTH_BASE[symbol - 257] + bits.take(LENGTH_EXTRA[symbol - 257])
                    code = distance.read(bits)
                    back = DISTANCE_BASE[code] + bits.take(DISTANCE_EXTRA[code])
                    if back > min(len(out), 32768):
                        raise InflateError("distance too far")
                    part = out[-back:] if back < size else out[len(out) - back : len(out) - back + size]
                    out += part if len(part) == size else (part * (size // back + 1))[:size]
                    tokens.append((block, size, back))
                if len(out) > limit:
                    raise InflateError("more output than allowed")
        if len(out) > limit:
            raise InflateError("more output than allowed")
        blocks.append((kind, begin, len(out) - begin, begin_bit, bits.at - begin_bit))
    return Trace(bytes(out), -(-bits.at // 8), blocks, tokens)
