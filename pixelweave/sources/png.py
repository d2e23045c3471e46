"""PNG and APNG decoding: chunk table, rules, and image rows.

Errors reject an image, warnings repair it. ``decode`` never raises: it gives the image or what is wrong with the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave import model
from pixelweave.model import GRAY, GRAY_ALPHA, INDEXED, RGB, Frame, Image
from pixelweave.operators import filters
from pixelweave.operators.inflate import InflateError, inflate_zlib


class Rejected(ValueError):
    """The file can't be decoded."""


class Chunk(NamedTuple):
    seq: int
    type: str
    data: bytes | None  # None: the file ends before it does
    crc: int | None
    crc_ok: bool

    @property
    def critical(self) -> bool:
        return not ord(self.type[0]) & 32

    @property
    def safe_to_copy(self) -> bool:
        return bool(ord(self.type[3]) & 32)


def chunks(content: bytes) -> Iterator[Chunk]:
    """All chunks up to the end of the file; stops after one that the file cuts short."""
    if len(content) < 20 or content[:8] != model.SIGNATURE:
        raise Rejected("not a PNG file")
    at, seq = 8, 0
    while at + 12 <= len(content):
        length, kind = struct.unpack_from(">I4s", content, at)
        if length > 0x7FFFFFFF:
            raise Rejected("chunk length over 2^31-1")
        if not kind.isalpha() or not kind.isascii():
            raise Rejected("invalid chunk type")
        if at + 12 + length > len(content):
            yield Chunk(seq, kind.decode(), None, None, False)
            return
        data = content[at + 8 : at + 8 + length]
        crc = int.from_bytes(content[at + 8 + length : at + 12 + length], "big")
        yield Chunk(seq, kind.decode(), data, crc, zlib.crc32(kind + data) == crc)
        at += 12 + length
        seq += 1


#: Ancillary chunks of fixed sizes, valid before the image data only: least and largest length.
SIZED = {"gAMA": (4, 4), "cHRM": (32, 32), "sRGB": (1, 1), "sBIT": (1, 4), "bKGD": (1, 6), "pHYs": (9, 9), "cICP": (4, 4)}
TEXTS = ("tEXt", "zTXt", "iTXt")
#: They depend on the palette's order, which re-encoding changes.
DROPPED = ("hIST", "sPLT")


class _Scan:
    """The rules over a file's chunks in order."""

    def __init__(self) -> None:
        self.image: Image | None = None
        self.idat: list[bytes] = []
        self.seen: set[str] = set()
        self.idat_over = False
        self.apng, self.expected, self.last_seq = False, 0, -1
        self.frame: Frame | None = None
        self.frame_data: list[bytes] = []
        self.frames: list[tuple[Frame, bytes]] = []

    def warn(self, text: str) -> None:
        self.image.warnings.append(text)

    def close_frame(self) -> None:
        if self.frame and (self.frame.from_idat or self.frame_data):
            self.frames.append((self.frame, b"".join(self.frame_data)))
        self.frame, self.frame_data = None, []

    def take(self, c: Chunk) -> bool:
        """Whether there may be more to read."""
        if c.data is None:
            if "IDAT" in self.seen and c.type not in ("IDAT", "fdAT"):
                self.warn(f"file ends in {c.type}")
                self.seen.add("IEND")
                self.close_frame()
                return False
            raise Rejected("file ends within a chunk")
        if not c.crc_ok:
            if c.critical:
                raise Rejected(f"bad CRC in {c.type}")
            if self.image is None:
                raise Rejected("first chunk isn't IHDR")
            self.warn(f"dropped {c.type} with bad CRC")
            return True
        if c.type == "IHDR":
            self.header(c)
            return True
        if self.image is None:
            raise Rejected("first chunk isn't IHDR")
        if "IDAT" in self.seen and c.type != "IDAT":
            self.idat_over = True
        rule = getattr(self, f"on_{c.type}", None)
        if rule:
            return rule(c) is not False
        if c.critical:
            raise Rejected(f"unknown critical chunk {c.type}")
        self.ancillary(c)
        return True

    def header(self, c: Chunk) -> None:
        if self.image is not None or len(c.data) != 13:
            raise Rejected("duplicate or invalid IHDR")
        width, height, depth, color, method, filtering, interlace = struct.unpack(">IIBBBBB", c.data)
        if not (0 < width <= 0x7FFFFFFF and 0 < height <= 0x7FFFFFFF) or not model.legal(color, depth) or method or filtering or interlace > 1:
            raise Rejected("invalid IHDR")
        if model.row_bytes(width, color, depth) * height > model.LARGEST_IMAGE:
            raise Rejected("image too large")
        self.image = Image(width, height, depth, color, b"", interlaced=bool(interlace))

    def on_acTL(self, c: Chunk) -> None:
        if len(c.data) != 8 or "IDAT" in self.seen:
            self.warn("ignored misplaced or invalid acTL")
            return
        self.apng = True
        self.expected, self.image.plays = struct.unpack(">II", c.data)

    def sequence(self, c: Chunk) -> int:
        seq = int.from_bytes(c.data[:4], "big")
        if seq <= self.last_seq:
            raise Rejected("animation sequence out of order")
        self.last_seq = seq
        return seq

    def on_fcTL(self, c: Chunk) -> None:
        if not self.apng:
            return
        if len(c.data) != 26:
            raise Rejected("invalid fcTL")
        self.close_frame()
        seq = self.sequence(c)
        width, height, x, y, num, den, dispose, blend = struct.unpack(">IIIIHHBB", c.data[4:])
        whole = (width, height, x, y) == (self.image.width, self.image.height, 0, 0)
        if not width or not height or x + width > self.image.width or y + height > self.image.height or dispose > 2 or blend > 1:
            raise Rejected("invalid frame region or operation")
        if "IDAT" not in self.seen and not whole:
            raise Rejected("first frame doesn't cover the image")
        self.frame = Frame(width, height, x, y, num, den, dispose, blend, seq, "IDAT" not in self.seen)

    def on_fdAT(self, c: Chunk) -> None:
        if not self.apng:
            return
        if self.frame is None or self.frame.from_idat or len(c.data) < 4:
            raise Rejected("fdAT without its fcTL")
        self.sequence(c)
        self.frame_data.append(c.data[4:])

    def on_PLTE(self, c: Chunk) -> None:
        if self.seen & {"PLTE", "IDAT"}:
            raise Rejected("duplicate or misplaced PLTE")
        if not c.data or len(c.data) % 3 or len(c.data) > 768:
            if self.image.color_type == INDEXED:
                raise Rejected("invalid PLTE")
            self.warn("ignored invalid PLTE")
        elif self.image.color_type in (GRAY, GRAY_ALPHA):
            self.warn("ignored PLTE of a gray image")
        else:
            self.seen.add("PLTE")
            if self.image.color_type == INDEXED:
                self.image.palette = c.data

    def on_IDAT(self, c: Chunk) -> None:
        if self.image.color_type == INDEXED and "PLTE" not in self.seen:
            raise Rejected("indexed image without PLTE")
        if self.idat_over:
            self.warn("image data isn't consecutive")
        self.seen.add("IDAT")
        self.idat.append(c.data)

    def on_IEND(self, c: Chunk) -> bool:
        self.seen.add("IEND")
        self.close_frame()
        return False

    def on_tRNS(self, c: Chunk) -> None:
        if "IDAT" in self.seen:
            return
        if self.image.color_type == INDEXED:
            entries = len(self.image.palette) // 3
            if len(c.data) > entries:
                self.warn("cut over-long tRNS")
            self.image.alpha_palette = c.data[:entries]
        elif len(c.data) == {GRAY: 2, RGB: 6}.get(self.image.color_type):
            self.image.single["tRNS"] = c.data
        else:
            self.warn("dropped invalid tRNS")

    def on_tIME(self, c: Chunk) -> None:
        if len(c.data) == 7:
            self.image.single["tIME"] = c.data
        else:
            self.warn("dropped invalid tIME")

    def ancillary(self, c: Chunk) -> None:
        if c.type in SIZED or c.type == "iCCP":
            if c.type == "iCCP":
                name = c.data.find(b"\0", 0, 80)
                good = 0 < name < len(c.data) - 2 and c.data[name + 1] == 0
            else:
                low, high = SIZED[c.type]
                good = low <= len(c.data) <= high and not (c.type == "sRGB" and c.data[0] > 3)
            if not good and (c.type in ("iCCP", "sRGB") or "IDAT" not in self.seen):
                self.warn(f"dropped invalid {c.type}")
            elif good and "IDAT" not in self.seen:
                self.image.single[c.type] = c.data
        elif c.type in TEXTS:
            if c.data.find(b"\0", 0, 80) > 0:
                self.image.text.append((c.type, c.data))
            else:
                self.warn(f"dropped {c.type} without a keyword")
        elif c.type not in DROPPED and (c.type == "eXIf" or c.safe_to_copy):
            self.image.other.append((c.type, c.data, 2 if "IDAT" in self.seen else int("PLTE" in self.seen)))

    def finish(self) -> Image:
        if self.image is None:
            raise Rejected("no IHDR")
        if "IDAT" not in self.seen:
            raise Rejected("no IDAT")
        if "IEND" not in self.seen:
            self.warn("no IEND")
            self.close_frame()
        image = self.image
        image.pixels = _rows(b"".join(self.idat), image, image.width, image.height, image.interlaced)
        if image.color_type == INDEXED:
            _fill_palette(image)
        if self.apng and self.frames:
            image.animated = True
            if self.expected != len(self.frames):
                self.warn("acTL frame count differs from the frames")
            for frame, data in self.frames:
                if not frame.from_idat:
                    frame.pixels = _rows(data, image, frame.width, frame.height, False)
                image.frames.append(frame)
        return image


def _rows(data: bytes, image: Image, width: int, height: int, interlaced: bool) -> bytes:
    """Inflate, undo filters and interlacing."""
    bpp, color, depth = image.stride, image.color_type, image.bit_depth
    size = lambda w, h: h * (model.row_bytes(w, color, depth) + 1) if w and h else 0
    need = sum(size(w, h) for *_, w, h in model.passes(width, height)) if interlaced else size(width, height)
    try:
        stream = inflate_zlib(data, need + 65536)
        if not interlaced:
            return filters.undo(stream, 0, height, model.row_bytes(width, color, depth), bpp).tobytes()
        channels, at = model.CHANNELS[color], 0
        whole = np.zeros((height, width, channels), np.int64)
        for x0, y0, dx, dy, w, h in model.passes(width, height):
            if w and h:
                rows = filters.undo(stream, at, h, model.row_bytes(w, color, depth), bpp)
                whole[y0::dy, x0::dx] = model.unpack(rows, w, channels, depth)
                at += size(w, h)
        return model.pack(whole, depth)
    except (InflateError, ValueError) as e:
        raise Rejected(str(e)) from None


def _fill_palette(image: Image) -> None:
    highest = int(image.samples().max())
    entries = len(image.palette) // 3
    if highest >= entries:
        image.warnings.append("filled up a short palette")
        image.palette += bytes(3 * (highest + 1 - entries))


def read(content: bytes) -> Image:
    """The image of a file; raises Rejected."""
    scan = _Scan()
    for c in chunks(content):
        if not scan.take(c):
            break
    return scan.finish()


def decode(content: bytes | None) -> dict:
    """A value of model.IMAGE_SCHEMA: the image, or only its error."""
    if not content:
        return model.to_row(None, "empty file")
    try:
        return model.to_row(read(content))
    except (Rejected, MemoryError) as e:
        return model.to_row(None, str(e) or type(e).__name__)


# --- Spark ------------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, modificationTime, length, content of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def arrow_struct(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(f"x {ddl}")["x"].dataType)


def decoded(content: Column) -> Column:
    """A struct of model.IMAGE_SCHEMA for each file; files that can't be decoded have an error."""
    kind = arrow_struct(model.IMAGE_SCHEMA)
    return F.arrow_udf(lambda c: pa.array([decode(v.as_py()) for v in c], kind), model.IMAGE_SCHEMA)(content)


def images(df: DataFrame) -> DataFrame:
    """Adds ``image`` to files with a ``content`` column."""
    return df.withColumn("image", decoded(F.col("content")))


def chunk_table(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, seq, type, length, data, crc, crc_ok): a row for each chunk; files without a signature give none."""

    def rows(c: pa.Array) -> pa.Array:
        out = []
        for v in c:
            own = []
            try:
                for k in chunks(v.as_py() or b""):
                    own.append({"seq": k.seq, "type": k.type, "length": None if k.data is None else len(k.data), "data": k.data, "crc": k.crc, "crc_ok": k.crc_ok})
            except Rejected:
                pass
            out.append(own)
        return pa.array(out, kind)

    ddl = "array<struct<seq:int,type:string,length:bigint,data:binary,crc:bigint,crc_ok:boolean>>"
    kind = arrow_struct(ddl)
    return df.select(key, F.explode(F.arrow_udf(rows, ddl)(F.col(content))).alias("c")).select(key, "c.*")
