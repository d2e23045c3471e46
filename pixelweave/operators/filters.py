"""Scanline filters and the ways to choose one for each row (array kernels; the relational forms are in plans.tiles)."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from pixelweave.model import AVERAGE, NONE, PAETH, SUB, UP


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and upper left the one nearest to left + up - upper left; ties go in that order."""
    a, b, c = (np.asarray(v, np.int64) for v in (a, b, c))
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _neighbours(rows: np.ndarray, bpp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp] if rows.shape[1] > bpp else 0
    up[1:] = rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:] = left[:-1]
    return left, up, corner


def residuals(rows: np.ndarray, bpp: int) -> np.ndarray:
    """5 x height x row bytes: every filter applied to every row; neighbours outside are 0."""
    x = rows.astype(np.int64)
    left, up, corner = _neighbours(x, bpp)
    out = np.empty((5, *rows.shape), np.uint8)
    for k, predicted in enumerate((0, left, up, (left + up) >> 1, paeth(left, up, corner))):
        out[k] = x - predicted
    return out


def apply(rows: np.ndarray, bpp: int, choice: np.ndarray) -> bytes:
    """The filtered stream: each row's filter, then its bytes; rows beyond the vector are unfiltered."""
    height = len(rows)
    picked = np.zeros(height, np.int64)
    picked[: min(height, len(choice))] = choice[:height]
    out = np.empty((height, rows.shape[1] + 1), np.uint8)
    out[:, 0] = picked
    out[:, 1:] = residuals(rows, bpp)[picked, np.arange(height)]
    return out.tobytes()


def _undo(kind: int, row: np.ndarray, before: np.ndarray, bpp: int) -> np.ndarray:
    if kind == NONE:
        return row
    if kind == UP:
        return row + before
    pad = -len(row) % bpp
    if kind == SUB:
        return np.cumsum(np.pad(row, (0, pad)).reshape(-1, bpp), 0, dtype=np.uint64).astype(np.uint8).ravel()[: len(row)]
    x, up, out = row.tolist(), before.tolist(), [0] * (len(row) + bpp)
    if kind == AVERAGE:
        for i, v in enumerate(x):
            out[i + bpp] = (v + ((out[i] + up[i]) >> 1)) & 255
    else:
        above = [0] * bpp + up
        for i, v in enumerate(x):
            a, b, c = out[i], up[i], above[i]
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - c - c)
            out[i + bpp] = (v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.array(out[bpp:], np.uint8)


def undo(stream: bytes, at: int, height: int, width: int, bpp: int) -> np.ndarray:
    """Rows of a filtered stream from ``at`` on; a ValueError names what is wrong."""
    need = height * (width + 1)
    if len(stream) - at < need:
        raise ValueError("image data is too short")
    rows = np.frombuffer(stream, np.uint8, need, at).reshape(height, width + 1)
    if need and rows[:, 0].max() > PAETH:
        raise ValueError("invalid filter type")
    out, before = np.empty((height, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(height):
        out[y] = before = _undo(int(rows[y, 0]), rows[y, 1:], before, bpp)
    return out


def magnitudes(found: np.ndarray) -> np.ndarray:
    """5 x height sums of residuals as signed magnitudes."""
    return np.minimum(found, (256 - found.astype(np.int64))).sum(2, dtype=np.int64)


def entropies(found: np.ndarray) -> np.ndarray:
    """5 x height Shannon entropies of the residual bytes, in bits a byte."""
    out = np.zeros(found.shape[:2])
    n = found.shape[2]
    for k in range(5):
        for y in range(found.shape[1]):
            p = np.bincount(found[k, y], minlength=256)
            p = p[p > 0] / n
            out[k, y] = -(p * np.log2(p)).sum()
    return np.round(out, 9)


def min_sum(rows: np.ndarray, bpp: int) -> np.ndarray:
    return magnitudes(residuals(rows, bpp)).argmin(0)


def least_entropy(rows: np.ndarray, bpp: int) -> np.ndarray:
    return entropies(residuals(rows, bpp)).argmin(0)


def fewest_long(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Per scanline the filter with the fewest residuals that take nine bits in the fixed code."""
    return (residuals(rows, bpp) >= 144).sum(axis=-1).argmin(axis=0)


def running_entropy(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Cross-entropy against a histogram of the rows chosen so far, less a credit for three-byte repeats; the histogram fades every 32 rows."""
    found = residuals(rows, bpp)
    seen = np.ones(256)
    before = np.zeros(found.shape[2], np.uint8)
    choice = []
    for y in range(len(rows)):
        costs = []
        for k in range(5):
            row = found[k, y]
            n = np.bincount(row, minlength=256)
            used = n > 0
            bits = -(n[used] * np.log2((seen[used] + n[used]) / (seen.sum() + len(row)))).sum()
            repeat = np.zeros(len(row), bool)
            for d in {1, bpp}:
                repeat[d:] |= _three(row[d:] == row[:-d])
            if y:
                repeat |= _three(row == before)
            costs.append(round(float(bits - 1.5 * repeat.sum()), 6))
        k = int(np.argmin(costs))
        choice.append(k)
        before = found[k, y]
        seen += np.bincount(before, minlength=256)
        if y % 32 == 31:
            seen = seen // 2 + 1
    return np.array(choice)


def _three(same: np.ndarray) -> np.ndarray:
    """Where three equal bytes in a row begin."""
    out = np.zeros(len(same), bool)
    if len(same) >= 3:
        out[:-2] = same[:-2] & same[1:-1] & same[2:]
    return out


def windowed_trial(rows: np.ndarray, bpp: int, size: Callable[[bytes], int] | None = None) -> np.ndarray:
    """Each filter tried with the rows chosen before it and two rows ahead; ties go to the lesser sum, then the lower filter."""
    size = size or (lambda data: len(zlib.compress(data, 1)))
    found = residuals(rows, bpp)
    sums = magnitudes(found)
    keep = min(32, max(4, 4096 // max(1, rows.shape[1])))
    history: list[bytes] = []
    choice = []
    for y in range(len(rows)):
        past = b"".join(history[-keep:])
        ahead = range(y, min(len(rows), y + 3))
        costs = [(size(past + b"".join(bytes([k]) + found[k, j].tobytes() for j in ahead)), int(sums[k, y]), k) for k in range(5)]
        k = min(costs)[2]
        choice.append(k)
        history.append(bytes([k]) + found[k, y].tobytes())
    return np.array(choice)


def viterbi(rows: np.ndarray, bpp: int, double: bool = False) -> np.ndarray:
    """The cheapest path through the filters: row sums plus a penalty for each change; ties go to the lower filter."""
    cost = magnitudes(residuals(rows, bpp))
    return cheapest_path(cost, max(16, rows.shape[1] // 2) * (2 if double else 1))


def cheapest_path(cost: np.ndarray, penalty: int) -> np.ndarray:
    """cost: states x steps."""
    total, links = cost[:, 0].astype(np.int64), []
    change = penalty * (1 - np.eye(len(cost), dtype=np.int64))
    for y in range(1, cost.shape[1]):
        step = total[:, None] + change
        links.append(step.argmin(0))
        total = step.min(0) + cost[:, y]
    path = [int(total.argmin())]
    for link in reversed(links):
        path.append(int(link[path[-1]]))
    return np.array(path[::-1])


#: Level to strategy; 3 and 4 are one strategy, and so are 5 and 6.
CANONICAL = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def choose(rows: np.ndarray, bpp: int, level: int) -> np.ndarray:
    """The filter vector of a level: 0 least sum, 1 running entropy, 2 least entropy, 3 and 4 trials, from 5 cheapest path (7: dearer changes)."""
    if not len(rows):
        return np.zeros(0, np.int64)
    way = {0: min_sum, 1: running_entropy, 2: least_entropy, 3: windowed_trial, 4: windowed_trial}.get(level)
    return way(rows, bpp) if way else viterbi(rows, bpp, level >= 7)
