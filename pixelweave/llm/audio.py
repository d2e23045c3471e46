"""Audio columns: bytes kept as 8-bit PCM, and polyphase-resampled log-mel tensors with time spans read from them.

``store`` turns a payload into a WAV file (mono, unsigned 8 bit), ``features`` reads such files back. A feature row
holds the clip's voiced spans and the buffer of an Arrow column of fixed-shape tensors, TENSOR frames by bands each;
``read_tensors`` gives it as a table with each tensor's time span. Null payloads are stored as empty ones; every clip is padded
to a positive multiple of UNIT samples, so an empty text gives one unit of padding. A file that is no such WAV gives
null features. Equal payloads give equal rows; repeated rows stay repeated. Extra columns are left out; clips of any
length are read whole, in blocks; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import read, text_or_empty

UNIT = 576
RATE, TARGET = 12_000, 8_000
UP, DOWN = 2, 3
TAPS = 24  # of each phase
FRAME, HOP, FFT, BANDS = 200, 80, 256, 32
TENSOR = (16, BANDS)
BLOCK = 1 << 18  # samples that are resampled at once
FLOOR = 1e-6


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]))


def payload(text: str = "text") -> Column:
    """The UTF-8 bytes, then bytes 255 up to a positive multiple of UNIT."""
    raw = text_or_empty(text).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, UNIT).otherwise((UNIT - n % UNIT) % UNIT)
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), pad)))


def store(samples: Column) -> Column:
    """A WAV file of 8-bit samples."""
    n = F.octet_length(samples).cast("long")
    head = lambda s: F.lit(s).cast("binary")
    fixed = F.lit(bytes.fromhex("666d742010000000" "01000100" + RATE.to_bytes(4, "little").hex() + RATE.to_bytes(4, "little").hex() + "01000800"))
    return F.concat(head("RIFF"), _le32(n + 36), head("WAVE"), fixed, head("data"), _le32(n), samples)


def stored_samples(media: Column) -> Column:
    """What a file of ``store`` holds, read back by the length in its header."""
    le = F.hex(F.substring(media, 41, 4))
    n = F.conv(F.concat(*[F.substring(le, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.substring(media, F.lit(45), n)


@functools.cache
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Polyphase branches (UP x TAPS, in the order of a window), the frame window, the mel matrix (a row for each real and imaginary part)."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = UP * cut * np.sinc(cut * t) * np.hamming(n)
    branches = np.stack([h[p::UP][::-1] for p in range(UP)])
    hz = np.linspace(0, TARGET / 2, FFT // 2 + 1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(TARGET / 2), BANDS + 2) / 2595) - 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.clip(np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid)), 0, None)
    return branches.astype(np.float32), np.hanning(FRAME).astype(np.float32), np.repeat(bank.T, 2, axis=0).astype(np.float32)


def _windows(x: np.ndarray, first: int, count: int, length: int, step: int) -> np.ndarray:
    """A strided view of ``count`` windows of a contiguous vector."""
    return np.ndarray((count, length), x.dtype, x, first * x.itemsize, (step * x.itemsize, x.itemsize))


def resample(x: np.ndarray) -> np.ndarray:
    """UP/DOWN polyphase resampling: output k is branch (k*DOWN mod UP) applied at input (k*DOWN div UP)."""
    branches = _filters()[0]
    padded = np.zeros(len(x) + TAPS + DOWN, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(x)] = x
    total = -(-len(x) * UP // DOWN)
    out = np.empty(total, np.float32)
    for r in range(UP):
        count = -(-(total - r) // UP)
        for at in range(0, count, BLOCK):
            n = min(BLOCK, count - at)
            out[r + at * UP : r + (at + n) * UP : UP] = _windows(padded, r * DOWN // UP + at * DOWN, n, TAPS, DOWN) @ branches[r * DOWN % UP]
    return out


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapped frames' log-mel energies and their energy in dB."""
    _, window, bank = _filters()
    frames = max(1, -(-(len(y) - FRAME) // HOP) + 1)
    if (short := (frames - 1) * HOP + FRAME - len(y)) > 0:
        y = np.concatenate([y, np.zeros(short, np.float32)])
    mel, power = np.empty((frames, BANDS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, 2048):
        part = _windows(y, at * HOP, min(2048, frames - at), FRAME, HOP)
        spectrum = np.fft.rfft(part * window, FFT).view(np.float32)
        spectrum *= spectrum
        mel[at : at + 2048] = spectrum @ bank
        np.einsum("ij,ij->i", part, part, out=power[at : at + 2048])
    mel += FLOOR
    return np.log(mel, out=mel), 10 * np.log10(power / FRAME + FLOOR)


def segments(db: np.ndarray) -> np.ndarray:
    """Hysteresis: runs of frames above the low threshold that reach the high one; rows of first and last frame + 1.

    The thresholds follow the clip: its mean energy, and half a standard deviation more.
    """
    low = float(db.sum()) / len(db)
    high = low + 0.5 * max(0.0, float(db @ db) / len(db) - low * low) ** 0.5
    on = np.zeros(len(db) + 2, np.int8)
    on[1:-1] = db >= low
    edge = np.flatnonzero(on[1:] != on[:-1])
    reach = np.zeros(len(db) + 1, np.int64)
    np.cumsum(db >= high, out=reach[1:])
    first, last = edge[::2], edge[1::2]
    keep = reach[last] > reach[first]
    return np.stack([first[keep], last[keep]], 1)


def tensors(mel: np.ndarray) -> bytes:
    """The value buffer of an Arrow fixed-shape tensor column: TENSOR frames by bands each, the last one filled up with silence."""
    n = -(-len(mel) // TENSOR[0])
    full = np.full((n * TENSOR[0], BANDS), np.log(np.float32(FLOOR)), np.float16)
    full[: len(mel)] = mel
    return full.tobytes()


def read_tensors(buffer: bytes, frames: int) -> pa.Table:
    """start, end in seconds, and mel as Arrow fixed-shape tensors over the stored buffer, which isn't copied."""
    flat = pa.Array.from_buffers(pa.float16(), len(buffer) // 2, [None, pa.py_buffer(buffer)])
    storage = pa.FixedSizeListArray.from_arrays(flat, TENSOR[0] * BANDS)
    first = np.arange(len(storage)) * TENSOR[0]
    last = np.minimum(first + TENSOR[0], frames) - 1
    cells = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float16(), TENSOR), storage)
    return pa.table({"start": first * HOP / TARGET, "end": (last * HOP + FRAME) / TARGET, "mel": cells})


FEATURE = "struct<samples:bigint,frames:bigint,spans:array<struct<start:double,end:double>>,band_mean:array<double>,tensors:binary>"


def _one(media: bytes | None) -> dict | None:
    if media is None or len(media) < 44 or media[:4] != b"RIFF" or media[36:40] != b"data":
        return None
    n = min(int.from_bytes(media[40:44], "little"), len(media) - 44)
    mel, db = log_mel(resample(np.frombuffer(media, np.uint8, n, 44).astype(np.float32) - 128))
    spans = [{"start": a * HOP / TARGET, "end": ((b - 1) * HOP + FRAME) / TARGET} for a, b in segments(db).tolist()]
    mean = np.round(mel.sum(0, dtype=np.float64) / len(mel), 2)
    return {"samples": n, "frames": len(mel), "spans": spans, "band_mean": mean.tolist(), "tensors": tensors(mel)}


_ARROW = pa.struct([("samples", pa.int64()), ("frames", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))), ("band_mean", pa.list_(pa.float64())), ("tensors", pa.binary())])


def _features(media: pa.Array) -> pa.Array:
    return pa.array([_one(v.as_py()) for v in media], _ARROW)


def features(media: Column) -> Column:
    return F.arrow_udf(_features, FEATURE)(media)


def audio_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the stored clip ``media`` and its ``feature`` struct; other columns are left out, whatever their names."""
    return df.select(F.col(key), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), store(payload(text)).alias("media")).withColumn("feature", features(F.col("media")))


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = audio_columns(read(spark, sf_dir, "documents"))
    back = clips.withColumn("payload", stored_samples(F.col("media")))
    f = F.col("feature")
    digest = F.concat_ws(
        ";",
        F.concat(F.lit("samples="), f["samples"]),
        F.concat(F.lit("frames="), f["frames"]),
        F.concat(F.lit("spans="), F.size(f["spans"])),
        F.concat(F.lit("voiced="), F.round(F.aggregate(f["spans"], F.lit(0.0), lambda a, s: a + s["end"] - s["start"]), 3)),
        F.concat(F.lit("bands="), F.array_join(F.transform(f["band_mean"], lambda v: v.cast("string")), ",")),
        F.concat(F.lit("tensors="), F.substring(F.sha2(f["tensors"], 256), 1, 16)),
    )
    n = F.octet_length("payload")
    return back.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), n - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        digest.alias("feature"),
        f["frames"].alias("frames"),
        f["spans"].alias("spans"),
        f["tensors"].alias("tensors"),
    )

