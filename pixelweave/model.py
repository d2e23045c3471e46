"""The image record, format rules and Spark schemas that all modules share."""

from __future__ import annotations

import dataclasses
from dataclasses import field

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRAY, RGB, INDEXED, GRAY_ALPHA, RGBA = 0, 2, 3, 4, 6
# Fixed values of the format: channels and legal bit depths by colour type.
CHANNELS = {GRAY: 1, RGB: 3, INDEXED: 1, GRAY_ALPHA: 2, RGBA: 4}
DEPTHS = {GRAY: (1, 2, 4, 8, 16), RGB: (8, 16), INDEXED: (1, 2, 4, 8), GRAY_ALPHA: (8, 16), RGBA: (8, 16)}
# Fixed values of the format: first column, first row, column step, row step of the seven interlace passes.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
NONE, SUB, UP, AVERAGE, PAETH = range(5)
FILTERS = ("None", "Sub", "Up", "Average", "Paeth")
LARGEST_IMAGE = 1 << 32


def has_alpha(color_type: int) -> bool:
    return color_type in (GRAY_ALPHA, RGBA)


def row_bytes(width: int, color_type: int, bit_depth: int) -> int:
    return (width * CHANNELS[color_type] * bit_depth + 7) // 8


def stride(color_type: int, bit_depth: int) -> int:
    """Whole bytes from a sample to the same sample of the pixel before, at least 1."""
    return max(1, CHANNELS[color_type] * bit_depth // 8)


def legal(color_type: int, bit_depth: int) -> bool:
    return bit_depth in DEPTHS.get(color_type, ())


def passes(width: int, height: int) -> list[tuple[int, int, int, int, int, int]]:
    """(x0, y0, dx, dy, width, height) of each interlace pass, empty ones too."""
    out = []
    for x0, y0, dx, dy in ADAM7:
        out.append((x0, y0, dx, dy, max(0, -(-(width - x0) // dx)), max(0, -(-(height - y0) // dy))))
    return out


@dataclasses.dataclass
class Frame:
    width: int
    height: int
    x: int = 0
    y: int = 0
    delay_num: int = 0
    delay_den: int = 0
    dispose: int = 0
    blend: int = 0
    sequence: int = 0
    from_idat: bool = False
    pixels: bytes = b""


@dataclasses.dataclass
class Image:
    """One picture: packed rows without filters or interlacing, and what goes with it."""

    width: int
    height: int
    bit_depth: int
    color_type: int
    pixels: bytes
    interlaced: bool = False
    palette: bytes = b""
    alpha_palette: bytes = b""
    animated: bool = False
    plays: int = 0
    frames: list[Frame] = field(default_factory=list)
    #: Single chunks by name (tRNS of truecolour and gray among them), text chunks in order, others with their zone.
    single: dict[str, bytes] = field(default_factory=dict)
    text: list[tuple[str, bytes]] = field(default_factory=list)
    other: list[tuple[str, bytes, int]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def row(self) -> int:
        return row_bytes(self.width, self.color_type, self.bit_depth)

    @property
    def stride(self) -> int:
        return stride(self.color_type, self.bit_depth)

    @property
    def rows(self) -> np.ndarray:
        return np.frombuffer(self.pixels, np.uint8).reshape(self.height, self.row)

    def valid(self) -> bool:
        if not (self.width > 0 and self.height > 0 and legal(self.color_type, self.bit_depth)):
            return False
        if self.color_type == INDEXED and (not self.palette or len(self.palette) % 3 or len(self.palette) > 768):
            return False
        return len(self.pixels) == self.row * self.height

    def changed(self, **changes: object) -> Image:
        """A copy whose lists and maps are its own."""
        own = {"single": dict(self.single), "text": list(self.text), "other": list(self.other), "frames": list(self.frames), "warnings": list(self.warnings)}
        return dataclasses.replace(self, **{**own, **changes})

    def samples(self) -> np.ndarray:
        """height x width x channels, as integers."""
        return unpack(self.rows, self.width, CHANNELS[self.color_type], self.bit_depth)


def unpack(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples of packed rows, most significant bits first."""
    height = len(rows)
    if depth == 8:
        return rows[:, : width * channels].reshape(height, width, channels).astype(np.int64)
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").reshape(height, width, channels).astype(np.int64)
    bits = np.unpackbits(np.ascontiguousarray(rows), axis=1)[:, : width * channels * depth].reshape(height, width * channels, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).reshape(height, width, channels).astype(np.int64)


def pack(samples: np.ndarray, depth: int) -> bytes:
    """Packed rows of height x width x channels samples; padding bits are zero."""
    height = len(samples)
    flat = samples.reshape(height, -1)
    if depth == 8:
        return flat.astype(np.uint8).tobytes()
    if depth == 16:
        return flat.astype(">u2").tobytes()
    bits = (flat[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(height, -1).astype(np.uint8), axis=1).tobytes()


CHUNK_SCHEMA = "seq int, type string, length bigint, data binary, crc bigint, crc_ok boolean"
FRAME_SCHEMA = "struct<sequence:bigint,width:bigint,height:bigint,x:bigint,y:bigint,delay_num:int,delay_den:int,dispose:int,blend:int,from_idat:boolean,pixels:binary>"
IMAGE_SCHEMA = (
    "struct<width:bigint,height:bigint,bit_depth:int,color_type:int,interlaced:boolean,pixels:binary,palette:binary,alpha_palette:binary,"
    f"animated:boolean,plays:bigint,frames:array<{FRAME_SCHEMA}>,single:map<string,binary>,text:array<struct<type:string,data:binary>>,"
    "other:array<struct<type:string,data:binary,zone:int>>,warnings:array<string>,error:string>"
)


def to_row(image: Image | None, error: str | None = None) -> dict:
    """A value of IMAGE_SCHEMA."""
    if image is None:
        return {"error": error}
    out = {k: getattr(image, k) for k in ("width", "height", "bit_depth", "color_type", "interlaced", "pixels", "palette", "alpha_palette", "animated", "plays", "warnings")}
    out["frames"] = [dataclasses.asdict(f) for f in image.frames]
    out["single"] = list(image.single.items())
    out["text"] = [{"type": t, "data": d} for t, d in image.text]
    out["other"] = [{"type": t, "data": d, "zone": z} for t, d, z in image.other]
    return out | {"error": None}


def from_row(row: dict) -> Image:
    """The image of a value of IMAGE_SCHEMA that has no error."""
    own = {k: row[k] for k in ("width", "height", "bit_depth", "color_type", "interlaced", "pixels", "palette", "alpha_palette", "animated", "plays", "warnings")}
    single = row["single"]
    return Image(
        **own,
        frames=[Frame(**f) for f in row["frames"]],
        single=dict(single.items() if isinstance(single, dict) else single),
        text=[(t["type"], t["data"]) for t in row["text"]],
        other=[(o["type"], o["data"], o["zone"]) for o in row["other"]],
    )
