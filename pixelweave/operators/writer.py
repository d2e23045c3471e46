"""PNG and APNG serialisation."""

from __future__ import annotations

import dataclasses
import struct
import zlib
from collections.abc import Callable

import numpy as np

from pixelweave import model
from pixelweave.model import GRAY, INDEXED, RGB, Frame, Image
from pixelweave.operators import deflate, filters

PIECE = 1 << 30


def best_zlib(data: bytes, options: deflate.Options | None = None) -> bytes:
    """The least of the library's encodings and the package's own, which is made if more than one pass is asked for or the library saves nothing.

    The library takes stored data where the fixed code would be a byte less; that can be all that a short stream saves.
    """
    options = options or deflate.Options()
    if options.level == deflate.STORE:
        return deflate.zlib_compress(data, options)
    tries = []
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FILTERED) if options.level >= deflate.BEST else (zlib.Z_DEFAULT_STRATEGY,):
        z = zlib.compressobj(min(9, options.level), zlib.DEFLATED, 15, 9, strategy)
        tries.append(z.compress(data) + z.flush())
    if options.passes > 1 or len(data) <= 65535 and min(map(len, tries)) >= len(data) + 11:  # a header, one stored block, a checksum
        tries.append(deflate.zlib_compress(data, options))
    return min(tries, key=len)


@dataclasses.dataclass
class WriteOptions:
    filters: np.ndarray | None = None  # none: level 2 decides
    deflate: deflate.Options = dataclasses.field(default_factory=deflate.Options)
    interlace: bool = False
    encode: Callable[[bytes, deflate.Options], bytes] = best_zlib


def chunk(kind: str, data: bytes) -> bytes:
    body = kind.encode() + data
    return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))


def _significant(image: Image) -> bytes | None:
    """sBIT for the image's own channels, from whichever layout it had; nothing if it can't be told."""
    old = image.single.get("sBIT", b"")
    if not 1 <= len(old) <= 4:
        return None
    deepest = 8 if image.color_type == INDEXED else image.bit_depth
    colour = old[:3] if len(old) >= 3 else old[:1]
    alpha = old[-1:] if len(old) in (2, 4) else b""
    wanted = 1 if image.color_type in (GRAY, model.GRAY_ALPHA) else 3
    colours = list(colour) if len(colour) == wanted == 3 else [max(colour)] * wanted
    alphas = list(alpha or b"\0") if model.has_alpha(image.color_type) else []
    if not max(colour) or 0 in alphas:
        return None
    return bytes(min(max(v, 1), deepest) for v in colours + alphas)


def _in_range(data: bytes, depth: int) -> bool:
    return depth == 16 or all(int.from_bytes(data[k : k + 2], "big") < 1 << depth for k in range(0, len(data), 2))


def sanitised(image: Image) -> Image:
    """Palette, alpha, tRNS, sBIT and bKGD made to fit the colour type, or dropped."""
    out = image.changed()
    if out.color_type in (GRAY, model.GRAY_ALPHA):
        out.palette = b""
    out.alpha_palette = out.alpha_palette[: len(out.palette) // 3] if out.color_type == INDEXED else b""
    key = out.single.get("tRNS")
    if key is not None and not (len(key) == {GRAY: 2, RGB: 6}.get(out.color_type) and _in_range(key, out.bit_depth)):
        del out.single["tRNS"]
    if "sBIT" in out.single:
        bits = _significant(out)
        if bits is None:
            del out.single["sBIT"]
        else:
            out.single["sBIT"] = bits
    back = out.single.get("bKGD")
    if back is not None:
        if out.color_type == INDEXED:
            fits = len(back) == 1 and back[0] < len(out.palette) // 3
        else:
            fits = len(back) == (2 if out.color_type in (GRAY, model.GRAY_ALPHA) else 6) and _in_range(back, out.bit_depth)
        if not fits:
            del out.single["bKGD"]
    return out


def filtered(image: Image, pixels: bytes, width: int, height: int, choice: np.ndarray | None, interlace: bool = False) -> bytes:
    bpp = image.stride
    if interlace:
        s = model.unpack(np.frombuffer(pixels, np.uint8).reshape(height, -1), width, model.CHANNELS[image.color_type], image.bit_depth)
        parts = []
        for x0, y0, dx, dy, w, h in model.passes(width, height):
            if w and h:
                rows = np.frombuffer(model.pack(s[y0::dy, x0::dx], image.bit_depth), np.uint8).reshape(h, -1)
                parts.append(filters.apply(rows, bpp, np.zeros(0, np.int64)))
        return b"".join(parts)
    rows = np.frombuffer(pixels, np.uint8).reshape(height, -1)
    return filters.apply(rows, bpp, filters.choose(rows, bpp, 2) if choice is None else choice)


def _frame_control(f: Frame, seq: int) -> bytes:
    return chunk("fcTL", struct.pack(">IIIIIHHBB", seq, f.width, f.height, f.x, f.y, f.delay_num, f.delay_den, f.dispose, f.blend))


def _pieces(kind: str, data: bytes) -> list[bytes]:
    return [chunk(kind, data[k : k + PIECE]) for k in range(0, max(1, len(data)), PIECE)]


def write(image: Image, options: WriteOptions | None = None, idat: bytes | None = None) -> bytes:
    """The file; ``idat`` gives an encoded stream of the image data that is at hand already."""
    options = options or WriteOptions()
    image = sanitised(image)
    one = image.single
    out = [model.SIGNATURE, chunk("IHDR", struct.pack(">IIBBBBB", image.width, image.height, image.bit_depth, image.color_type, 0, 0, int(options.interlace)))]
    colour = ["cICP", "gAMA", "cHRM", "iCCP" if "iCCP" in one else "sRGB", "sBIT"]
    out += [chunk(k, one[k]) for k in colour if k in one]
    zone = lambda z: [chunk(t, d) for t, d, own in image.other if own == z]
    out += zone(0)
    moving = image.animated and bool(image.frames)
    if moving:
        out.append(chunk("acTL", struct.pack(">II", len(image.frames), image.plays)))
    if image.color_type == INDEXED:
        out.append(chunk("PLTE", image.palette))
    trns = image.alpha_palette.rstrip(b"\xff") if image.color_type == INDEXED else one.get("tRNS", b"")
    if trns:
        out.append(chunk("tRNS", trns))
    out += [chunk(k, one[k]) for k in ("bKGD", "pHYs", "tIME") if k in one]
    out += [chunk(t, d) for t, d in image.text] + zone(1)
    if idat is None:
        idat = options.encode(filtered(image, image.pixels, image.width, image.height, options.filters, options.interlace), dataclasses.replace(options.deflate, row=image.row + 1))
    seq = 0
    frames = list(image.frames) if moving else []
    if frames and frames[0].from_idat:
        out.append(_frame_control(frames.pop(0), seq))
        seq += 1
    out += _pieces("IDAT", idat)
    for f in frames:
        out.append(_frame_control(f, seq))
        seq += 1
        data = options.encode(filtered(image, f.pixels, f.width, f.height, None), options.deflate)
        for k in range(0, max(1, len(data)), PIECE - 4):
            out.append(chunk("fdAT", struct.pack(">I", seq) + data[k : k + PIECE - 4]))
            seq += 1
    return b"".join([*out, *zone(2), chunk("IEND", b"")])
