"""Files: every legal type and depth, interlacing, animation, metadata, and malformed inputs rule by rule."""

import struct
import zlib

import numpy as np
import pytest

from pixelweave import model
from pixelweave.model import Frame, Image
from pixelweave.operators import filters, recolour, writer
from pixelweave.sources import png


def rgba_hash(w, h, alpha=True):
    i = np.arange(w * h)
    s = np.stack([i * 7, i * 13, i * 29, i * 31 if alpha else np.full_like(i, 255)], 1) & 255
    return Image(w, h, 8, model.RGBA, s.astype(np.uint8).tobytes())


def random_image(rng, w, h, color, depth):
    image = Image(w, h, depth, color, model.pack(rng.integers(0, 1 << depth, (h, w, model.CHANNELS[color])), depth))
    if color == model.INDEXED:
        image.palette = rng.integers(0, 256, 3 << depth, dtype=np.uint8).tobytes()
        image.alpha_palette = rng.integers(0, 256, 1 << depth, dtype=np.uint8).tobytes()
    return image


@pytest.mark.parametrize("color,depth", [(c, d) for c, ds in model.DEPTHS.items() for d in ds])
@pytest.mark.parametrize("interlace", [False, True])
def test_round_trip(color, depth, interlace):
    rng = np.random.default_rng(depth * 7 + color)
    for w, h in ((1, 1), (2, 4), (5, 3), (9, 7), (33, 2)):
        image = random_image(rng, w, h, color, depth)
        back = png.read(writer.write(image, writer.WriteOptions(interlace=interlace)))
        assert back.pixels == image.pixels and not back.warnings and back.interlaced == interlace
        assert recolour.equivalent(back, image) is None


@pytest.mark.parametrize("w", [1, 2, 3, 5, 9])
@pytest.mark.parametrize("h", [1, 4, 7])
def test_adam7_sizes(w, h):
    image = rgba_hash(w, h)
    assert png.read(writer.write(image, writer.WriteOptions(interlace=True))).pixels == image.pixels


@pytest.mark.parametrize("kind", range(5))
def test_filters_undo(kind):
    rng = np.random.default_rng(kind)
    for bpp in (1, 3, 4, 8):
        rows = rng.integers(0, 256, (6, 24), dtype=np.uint8)
        stream = filters.apply(rows, bpp, np.full(6, kind))
        assert (filters.undo(stream, 0, 6, 24, bpp) == rows).all()


def test_paeth_ties():
    cases = {(0, 0, 0): 0, (5, 5, 5): 5, (10, 0, 0): 10, (0, 10, 0): 10, (10, 20, 10): 20, (20, 10, 10): 20, (3, 3, 6): 3}
    for (a, b, c), want in cases.items():
        assert filters.paeth(a, b, c) == want


def chunks_of(*parts):
    return model.SIGNATURE + b"".join(writer.chunk(k, d) for k, d in parts)


RAW = b"".join(b"\0" + bytes(range(y * 12, y * 12 + 12)) for y in range(2))
IHDR = ("IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0))
IDAT = ("IDAT", zlib.compress(RAW))
END = ("IEND", b"")
FCTL = lambda seq, w=4, h=2, x=0, y=0, dispose=0: ("fcTL", struct.pack(">IIIIIHHBB", seq, w, h, x, y, 1, 10, dispose, 0))
ACTL = ("acTL", struct.pack(">II", 1, 0))


def broken_crc(kind, data):
    whole = bytearray(writer.chunk(kind, data))
    whole[-1] ^= 1
    return bytes(whole)


GOOD = chunks_of(IHDR, IDAT, END)
REJECTED = {
    "empty": b"",
    "signature": b"x" * 40,
    "long chunk": model.SIGNATURE + b"\xff" * 40,
    "chunk type": chunks_of(IHDR) + struct.pack(">I4sI", 0, b"ab1d", 0) + bytes(4),
    "cut in IDAT": GOOD[:-25],
    "critical CRC": model.SIGNATURE + broken_crc(*IHDR) + writer.chunk(*IDAT),
    "twice IHDR": chunks_of(IHDR, IHDR, IDAT, END),
    "short IHDR": chunks_of(("IHDR", IHDR[1][:12]), IDAT, END),
    "not first": chunks_of(("gAMA", b"\0\0\0\1"), IHDR, IDAT, END),
    "no IDAT": chunks_of(IHDR, END),
    "zero width": chunks_of(("IHDR", struct.pack(">IIBBBBB", 0, 2, 8, 2, 0, 0, 0)), IDAT, END),
    "depth": chunks_of(("IHDR", struct.pack(">IIBBBBB", 4, 2, 4, 2, 0, 0, 0)), IDAT, END),
    "too large": chunks_of(("IHDR", struct.pack(">IIBBBBB", 2**31 - 1, 2**31 - 1, 16, 6, 0, 0, 0)), IDAT, END),
    "no palette": chunks_of(("IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 3, 0, 0, 0)), IDAT, END),
    "bad palette": chunks_of(("IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 3, 0, 0, 0)), ("PLTE", b"1234"), IDAT, END),
    "twice PLTE": chunks_of(IHDR, ("PLTE", b"123"), ("PLTE", b"123"), IDAT, END),
    "unknown critical": chunks_of(IHDR, ("ABCD", b""), IDAT, END),
    "filter byte": chunks_of(IHDR, ("IDAT", zlib.compress(b"\7" + RAW[1:])), END),
    "short rows": chunks_of(IHDR, ("IDAT", zlib.compress(RAW[:-1])), END),
    "checksum": chunks_of(IHDR, ("IDAT", IDAT[1][:-1] + bytes([IDAT[1][-1] ^ 1])), END),
    "fcTL length": chunks_of(IHDR, ACTL, ("fcTL", b"123"), IDAT, END),
    "frame region": chunks_of(IHDR, ACTL, FCTL(0), IDAT, FCTL(1, 4, 2, 1), END),
    "first frame": chunks_of(IHDR, ACTL, FCTL(0, 2, 2), IDAT, END),
    "sequence": chunks_of(IHDR, ACTL, FCTL(1), IDAT, FCTL(1), END),
    "fdAT alone": chunks_of(IHDR, ACTL, IDAT, ("fdAT", b"\0\0\0\0x"), END),
}


@pytest.mark.parametrize("case", REJECTED)
def test_rejected(case):
    assert png.decode(REJECTED[case])["error"]


text = ("tEXt", b"Title\0x")
ACCEPTED = {
    "plain": (GOOD, 0),
    "no IEND": (chunks_of(IHDR, IDAT), 1),
    "cut after IDAT": (GOOD[:-12] + b"\0\0\0\7tEXtab\0\0", 1),
    "text CRC": (chunks_of(IHDR) + broken_crc(*text) + writer.chunk(*IDAT) + writer.chunk(*END), 1),
    "junk behind": (GOOD + b"junk", 0),
    "gray-like PLTE of truecolour": (chunks_of(IHDR, ("PLTE", b"123"), IDAT, END), 0),
    "odd PLTE of truecolour": (chunks_of(IHDR, ("PLTE", b"1234"), IDAT, END), 1),
    "split IDAT": (chunks_of(IHDR, ("IDAT", IDAT[1][:5]), text, ("IDAT", IDAT[1][5:]), END), 1),
    "gAMA length": (chunks_of(IHDR, ("gAMA", b"1"), IDAT, END), 1),
    "sRGB intent": (chunks_of(IHDR, ("sRGB", b"\4"), IDAT, END), 1),
    "iCCP": (chunks_of(IHDR, ("iCCP", b"abc"), IDAT, END), 1),
    "no keyword": (chunks_of(IHDR, ("tEXt", b"\0x"), IDAT, END), 1),
    "tRNS length": (chunks_of(IHDR, ("tRNS", b"12"), IDAT, END), 1),
    "late tRNS": (chunks_of(IHDR, IDAT, ("tRNS", b"123456"), END), 0),
    "stray frames": (chunks_of(IHDR, FCTL(0), IDAT, ("fdAT", b"\0\0\0\1x"), END), 0),
    "late acTL": (chunks_of(IHDR, IDAT, ACTL, END), 1),
    "acTL without frames": (chunks_of(IHDR, ACTL, IDAT, END), 0),
    "frame count": (chunks_of(IHDR, ("acTL", struct.pack(">II", 3, 0)), FCTL(0), IDAT, END), 1),
    "no checksum": (chunks_of(IHDR, ("IDAT", IDAT[1][:-4]), END), 0),
    "padded stream": (chunks_of(IHDR, ("IDAT", IDAT[1] + b"\0\0\0\0\0"), END), 0),
}


@pytest.mark.parametrize("case", ACCEPTED)
def test_accepted(case):
    content, warnings = ACCEPTED[case]
    image = png.read(content)
    assert len(image.warnings) == warnings and image.pixels == RAW[1:13] + RAW[14:]


def test_kept_and_dropped_chunks():
    image = png.read(chunks_of(IHDR, ("hIST", b"12"), ("eXIf", b"MM"), ("prVt", b"own"), ("prVT", b"unsafe"), text, ("tIME", b"1234567"), ("pHYs", b"123456789"), IDAT, ("zzZz", b"late"), END))
    assert [(t, z) for t, _, z in image.other] == [("eXIf", 0), ("prVt", 0), ("zzZz", 2)]
    back = png.read(writer.write(image))
    assert back.other == image.other and back.text == image.text and back.single == image.single


def test_short_palette_is_filled():
    stream = zlib.compress(b"\0\5\0")
    image = png.read(chunks_of(("IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)), ("PLTE", b"abc"), ("IDAT", stream), END))
    assert len(image.palette) == 18 and len(image.warnings) == 1


def test_animation():
    image = rgba_hash(8, 8)
    image.animated, image.plays = True, 3
    image.frames = [Frame(8, 8, delay_num=1, delay_den=10, from_idat=True)]
    image.frames += [Frame(4, 3, 2, k, 2, 10, 1, 1, pixels=rgba_hash(4, 3).pixels) for k in (1, 2)]
    back = png.read(writer.write(image))
    assert recolour.equivalent(back, image) is None and not back.warnings
    assert [f.sequence for f in back.frames] == [0, 1, 3]
    image.frames[1].delay_num = 9
    assert "timing" in recolour.equivalent(back, image)


def test_significant_bits_follow_the_format():
    image = rgba_hash(16, 16, alpha=False)
    image.single["sBIT"] = b"\x08\x08\x08\x08"
    assert len(png.read(writer.write(recolour.strip_opaque(image))).single["sBIT"]) == 3
    image.single["sBIT"] = b"\5\6\5\x08"
    gray = Image(8, 8, 8, model.GRAY, bytes(64), single={"sBIT": b"\5\6\5\x08"})
    assert png.read(writer.write(gray)).single["sBIT"] == b"\6"


def test_table_and_column(spark):
    df = spark.createDataFrame([("a", GOOD), ("b", b"no"), ("c", None)], "path string, content binary")
    got = {r["path"]: r["image"] for r in png.images(df).collect()}
    assert got["a"]["error"] is None and got["b"]["error"] and got["c"]["error"]
    assert [r["type"] for r in png.chunk_table(df, "path").orderBy("seq").collect()] == ["IHDR", "IDAT", "IEND"]
    assert model.from_row(got["a"].asDict(recursive=True)).pixels == RAW[1:13] + RAW[14:]
