"""Equivalent representations of an image: alpha, depth and colour reductions, palette order. Pixels stay the same."""

from __future__ import annotations

import dataclasses

import numpy as np

from pixelweave import model
from pixelweave.model import GRAY, GRAY_ALPHA, INDEXED, RGB, RGBA, Image


def canonical(image: Image, pixels: bytes | None = None, width: int = 0, height: int = 0) -> np.ndarray:
    """height x width x RGBA at 16 bits; wholly transparent pixels are zero."""
    width, height = width or image.width, height or image.height
    rows = np.frombuffer(image.pixels if pixels is None else pixels, np.uint8).reshape(height, -1)
    s = model.unpack(rows, width, model.CHANNELS[image.color_type], image.bit_depth)
    top = (1 << image.bit_depth) - 1
    out = np.full((height, width, 4), 65535, np.int64)
    if image.color_type == INDEXED:
        colours = np.zeros((256, 4), np.int64)
        colours[:, 3] = 255
        n = len(image.palette) // 3
        colours[:n, :3] = np.frombuffer(image.palette, np.uint8).reshape(-1, 3)
        colours[: len(image.alpha_palette), 3] = list(image.alpha_palette)
        out[:] = colours[s[:, :, 0]] * 257
    else:
        scaled = s * 65535 // top
        out[:, :, :3] = scaled[:, :, :3] if image.color_type in (RGB, RGBA) else scaled[:, :, :1]
        if model.has_alpha(image.color_type):
            out[:, :, 3] = scaled[:, :, -1]
        elif key := image.single.get("tRNS"):
            out[(s == np.frombuffer(key, ">u2")).all(2), 3] = 0
    out[out[:, :, 3] == 0] = 0
    return out


def equivalent(a: Image, b: Image) -> str | None:
    """Nothing if both look and play the same, else the first difference."""
    if (a.width, a.height) != (b.width, b.height):
        return "dimensions differ"
    if a.animated != b.animated or a.animated and (a.plays, len(a.frames)) != (b.plays, len(b.frames)):
        return "animation differs"
    if (at := _difference(canonical(a), canonical(b))) is not None:
        return f"pixel {at} differs"
    for k, (f, g) in enumerate(zip(a.frames, b.frames, strict=True) if a.animated else ()):
        same = ("width", "height", "x", "y", "delay_num", "delay_den", "dispose", "blend", "from_idat")
        if any(getattr(f, n) != getattr(g, n) for n in same):
            return f"frame {k} has another geometry, timing or operation"
        if not f.from_idat and _difference(canonical(a, f.pixels, f.width, f.height), canonical(b, g.pixels, g.width, g.height)) is not None:
            return f"frame {k} differs"
    return None


def _difference(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    bad = (a != b).any(2)
    if not bad.any():
        return None
    y, x = np.unravel_index(int(bad.argmax()), bad.shape)
    return int(x), int(y)


# --- alpha -------------------------------------------------------------------------------------------------------------


def zero_transparent(image: Image) -> Image:
    """Colour of invisible pixels or palette entries to black."""
    if image.color_type == INDEXED:
        palette = bytearray(image.palette)
        for k, a in enumerate(image.alpha_palette[: len(palette) // 3]):
            if a == 0:
                palette[3 * k : 3 * k + 3] = b"\0\0\0"
        return image.changed(palette=bytes(palette))
    if not model.has_alpha(image.color_type):
        return image
    s = image.samples()
    s[s[:, :, -1] == 0] = 0
    return image.changed(pixels=model.pack(s, image.bit_depth))


def strip_opaque(image: Image) -> Image:
    """Without an alpha channel that is opaque everywhere."""
    if not model.has_alpha(image.color_type):
        return image
    s = image.samples()
    if (s[:, :, -1] != (1 << image.bit_depth) - 1).any():
        return image
    return image.changed(color_type=image.color_type - 4, pixels=model.pack(s[:, :, :-1], image.bit_depth))


def least_unused(values: np.ndarray, top: int) -> int | None:
    """The least number up to ``top`` that isn't among sorted distinct values."""
    gap = np.flatnonzero(values != np.arange(len(values)))
    free = int(gap[0]) if len(gap) else len(values)
    return free if free <= top else None


def colour_key(image: Image) -> Image:
    """An alpha channel that is only on or off as a colour key: black if no visible pixel is, else the least unused colour."""
    gray = image.color_type == GRAY_ALPHA
    if not model.has_alpha(image.color_type) or image.bit_depth != 8 and not gray:
        return image
    s, top = image.samples(), (1 << image.bit_depth) - 1
    clear = s[:, :, -1] == 0
    if not clear.any() or (~clear & (s[:, :, -1] != top)).any():
        return image
    colour = s[:, :, 0] if gray else s[:, :, 0] << 16 | s[:, :, 1] << 8 | s[:, :, 2]
    key = least_unused(np.unique(colour[~clear]), top if gray else 0xFFFFFF)
    if key is None:
        return image
    parts = [key] if gray else [key >> 16, key >> 8 & 255, key & 255]
    out = s[:, :, :-1].copy()
    out[clear] = parts
    changed = image.changed(color_type=image.color_type - 4, pixels=model.pack(out, image.bit_depth))
    changed.single["tRNS"] = b"".join(p.to_bytes(2, "big") for p in parts)
    return changed


def _animated_alpha(image: Image) -> Image:
    """Animations: invisible pixels of the image and of every frame to black, and no alpha channel where all of them are opaque."""
    alone = [image.changed(animated=False, frames=[], width=f.width, height=f.height, pixels=f.pixels) for f in image.frames if not f.from_idat]
    parts = [zero_transparent(p) for p in (image.changed(animated=False, frames=[]), *alone)]
    if all(strip_opaque(p).color_type != p.color_type for p in parts):
        parts = [strip_opaque(p) for p in parts]
    rest = iter(parts[1:])
    frames = [f if f.from_idat else dataclasses.replace(f, pixels=next(rest).pixels) for f in image.frames]
    return parts[0].changed(animated=True, frames=frames)


def optimise_alpha(image: Image) -> Image:
    if image.animated:
        return _animated_alpha(image)
    image = strip_opaque(zero_transparent(image))
    return colour_key(image) if model.has_alpha(image.color_type) else image


# --- depth and colours ---------------------------------------------------------------------------------------------------


def _pairs_equal(data: bytes | None) -> bool:
    return data is None or all(data[k] == data[k + 1] for k in range(0, len(data) - 1, 2))


def sixteen_to_eight(image: Image) -> Image:
    """If high and low bytes are equal everywhere, in tRNS and bKGD too."""
    if image.bit_depth != 16 or image.color_type == INDEXED:
        return image
    pairs = np.frombuffer(image.pixels, np.uint8).reshape(-1, 2)
    marks = [image.single.get(k) for k in ("tRNS", "bKGD")]
    if (pairs[:, 0] != pairs[:, 1]).any() or not all(map(_pairs_equal, marks)):
        return image
    out = image.changed(bit_depth=8, pixels=pairs[:, 0].tobytes())
    for k in ("tRNS", "bKGD"):
        if k in out.single:
            out.single[k] = b"".join(b"\0" + out.single[k][i : i + 1] for i in range(0, len(out.single[k]), 2))
    return out


def colour_to_gray(image: Image) -> Image:
    """8-bit truecolour whose red, green and blue agree everywhere, in tRNS and bKGD too."""
    if image.color_type not in (RGB, RGBA) or image.bit_depth != 8:
        return image
    s = image.samples()
    marks = [image.single[k] for k in ("tRNS", "bKGD") if k in image.single]
    if (s[:, :, :3] != s[:, :, :1]).any() or any(len(m) != 6 or len({m[0:2], m[2:4], m[4:6]}) > 1 for m in marks):
        return image
    keep = [0, 3] if image.color_type == RGBA else [0]
    out = image.changed(color_type=image.color_type - 2, pixels=model.pack(s[:, :, keep], 8))
    for k in ("tRNS", "bKGD"):
        if k in out.single:
            out.single[k] = out.single[k][:2]
    return out


def gray_to_fewer_bits(image: Image) -> Image:
    """8-bit gray whose values are all multiples of 255, 85 or 17; not with tRNS, bKGD or sBIT."""
    if image.color_type != GRAY or image.bit_depth != 8 or {"tRNS", "bKGD", "sBIT"} & set(image.single):
        return image
    s = image.samples()
    for depth in (1, 2, 4):
        unit = 255 // ((1 << depth) - 1)
        if not (s % unit).any():
            return image.changed(bit_depth=depth, pixels=model.pack(s // unit, depth))
    return image


def _palette_depth(n: int) -> int:
    return 1 if n <= 2 else 2 if n <= 4 else 4 if n <= 16 else 8


def _classes(alpha: np.ndarray) -> np.ndarray:
    """Transparent, half transparent, opaque."""
    return np.where(alpha == 0, 0, np.where(alpha == 255, 2, 1))


def _split(colours: np.ndarray) -> tuple[bytes, bytes]:
    """A palette and its alpha, opaque entries at the end left out."""
    alpha = colours[:, 3]
    last = int(np.flatnonzero(alpha != 255).max(initial=-1)) + 1
    return colours[:, :3].astype(np.uint8).tobytes(), alpha[:last].astype(np.uint8).tobytes()


def _entries(image: Image) -> np.ndarray:
    n = len(image.palette) // 3
    out = np.full((n, 4), 255, np.int64)
    out[:, :3] = np.frombuffer(image.palette, np.uint8).reshape(-1, 3)
    out[: len(image.alpha_palette), 3] = list(image.alpha_palette)
    return out


def compact_palette(image: Image) -> Image:
    """Used entries only, equal ones merged, transparent before opaque in order of first use as entries; never deeper than before."""
    index = image.samples()
    colours = _entries(image)
    used = np.unique(index)
    background = image.single.get("bKGD")
    if background and len(background) == 1 and background[0] < len(colours):
        used = np.union1d(used, [background[0]])
    seen: dict[tuple, int] = {}
    to = np.zeros(256, np.int64)
    for k in used.tolist():
        colour = tuple(colours[k].tolist()) if colours[k][3] else (0, 0, 0, 0)
        to[k] = seen.setdefault(colour, len(seen))
    kept = np.array(list(seen), np.int64).reshape(-1, 4)
    order = np.argsort(_classes(kept[:, 3]), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    to = place[to]
    depth = min(image.bit_depth, _palette_depth(len(order)))
    palette, alpha = _split(kept[order])
    out = image.changed(palette=palette, alpha_palette=alpha, bit_depth=depth, pixels=model.pack(to[index], depth))
    if background and len(background) == 1:
        out.single["bKGD"] = bytes([to[background[0]]])
    return out


def colour_to_indexed(image: Image) -> Image:
    """8-bit truecolour of at most 256 colours, keyed ones transparent; not with bKGD or sBIT."""
    if image.color_type not in (RGB, RGBA) or image.bit_depth != 8 or {"bKGD", "sBIT"} & set(image.single):
        return image
    key = image.single.get("tRNS")
    if key and any(key[0::2]):
        return image
    s = image.samples().reshape(-1, model.CHANNELS[image.color_type])
    alpha = s[:, 3] if image.color_type == RGBA else np.full(len(s), 255)
    if key:
        alpha = np.where((s[:, :3] == list(key[1::2])).all(1), 0, alpha)
    packed = np.where(alpha == 0, 0, s[:, 0] << 24 | s[:, 1] << 16 | s[:, 2] << 8 | alpha)
    values, first, index = np.unique(packed, return_index=True, return_inverse=True)
    if len(values) > 256:
        return image
    order = np.lexsort((first, _classes(values & 255)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    chosen = values[order]
    palette, trns = _split(np.stack([chosen >> 24 & 255, chosen >> 16 & 255, chosen >> 8 & 255, chosen & 255], 1))
    depth = _palette_depth(len(values))
    out = image.changed(color_type=INDEXED, bit_depth=depth, palette=palette, alpha_palette=trns, pixels=model.pack(place[index].reshape(image.height, image.width, 1), depth))
    out.single.pop("tRNS", None)
    return out


def reduce_colours(image: Image) -> Image:
    """Depth first; then palette compaction, or gray, fewer bits, or a palette, whichever applies first."""
    if image.animated:
        return image
    image = sixteen_to_eight(image)
    if image.color_type == INDEXED:
        return compact_palette(image)
    image = colour_to_gray(image)
    fewer = gray_to_fewer_bits(image)
    return fewer if fewer is not image else colour_to_indexed(image)


# --- palette order ---------------------------------------------------------------------------------------------------------


def luminance(colours: np.ndarray) -> np.ndarray:
    return colours[:, :3] @ np.array([0.299, 0.587, 0.114])


def _reordered(image: Image, order: np.ndarray) -> Image:
    place = np.arange(256)
    place[order] = np.arange(len(order))
    palette, alpha = _split(_entries(image)[order])
    out = image.changed(palette=palette, alpha_palette=alpha, pixels=model.pack(place[image.samples()], image.bit_depth))
    if len(out.single.get("bKGD", b"")) == 1:
        out.single["bKGD"] = bytes([place[out.single["bKGD"][0]]])
    return out


def adjacency(index: np.ndarray, n: int) -> np.ndarray:
    """How often two entries are neighbours across or down; symmetric, without a diagonal, at most 65535."""
    out = np.zeros((n, n), np.int64)
    for a, b in ((index[:, :-1], index[:, 1:]), (index[:-1], index[1:])):
        np.add.at(out, (a.ravel(), b.ravel()), 1)
    out = out + out.T
    np.fill_diagonal(out, 0)
    return np.minimum(out, 65535)


def tour(members: list[int], distance: np.ndarray, first: int) -> list[int]:
    """Nearest neighbours from ``first`` on, then up to five rounds of two-opt exchanges."""
    left, path = set(members) - {first}, [first]
    while left:
        here = path[-1]
        path.append(min(left, key=lambda k: (distance[here, k], k)))
        left.remove(path[-1])
    for _ in range(5):
        better = False
        for i in range(1, len(path) - 1):
            for j in range(i + 1, len(path)):
                old = distance[path[i - 1], path[i]] + (distance[path[j], path[j + 1]] if j + 1 < len(path) else 0)
                new = distance[path[i - 1], path[j]] + (distance[path[i], path[j + 1]] if j + 1 < len(path) else 0)
                if new < old - 1e-9:
                    path[i : j + 1] = path[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return path


def sort_palette(image: Image) -> Image:
    """Below 8 bits by use and luminance, at 8 bits by a short tour through the colours; entries with alpha stay first."""
    if image.color_type != INDEXED or image.animated or not image.palette:
        return image
    colours = _entries(image)
    index = image.samples()[:, :, 0]
    n = len(colours)
    if int(index.max()) >= n:
        return image
    solid = colours[:, 3] == 255
    light = luminance(colours)
    if image.bit_depth < 8:
        count = np.bincount(index.ravel(), minlength=n)[:n]
        return _reordered(image, np.lexsort((np.arange(n), light, -count, solid)))
    apart = np.sqrt(((colours[:, None, :3] - colours[None, :, :3]) ** 2).sum(2)) / (1 + 8 * adjacency(index, n))
    order: list[int] = []
    for members in (np.flatnonzero(~solid), np.flatnonzero(solid)):
        if len(members):
            first = int(members[np.lexsort((members, light[members]))[0]])
            order += tour(members.tolist(), apart, first)
    return _reordered(image, np.array(order))


# --- metadata and statistics ------------------------------------------------------------------------------------------------


def strip_metadata(image: Image, keep_colour: bool = True) -> Image:
    gone = {"bKGD", "pHYs", "tIME", "sBIT"} | (set() if keep_colour else {"gAMA", "cHRM", "sRGB", "iCCP", "cICP"})
    return image.changed(single={k: v for k, v in image.single.items() if k not in gone}, text=[], other=[])


def overhead(image: Image) -> int:
    """Bytes of PLTE and tRNS chunks."""
    out = 12 + len(image.palette) if image.color_type == INDEXED else 0
    alpha = image.alpha_palette.rstrip(b"\xff") if image.color_type == INDEXED else image.single.get("tRNS", b"")
    return out + (12 + len(alpha) if alpha else 0)


def content(image: Image) -> dict[str, float]:
    """Entropies of up to four byte planes of the first 65536 pixels, mean vertical gradient, distinct colours of the first 4096 pixels."""
    channels = model.CHANNELS[image.color_type]
    s = image.samples().reshape(-1, channels)
    planes = (s >> 8 if image.bit_depth == 16 else s)[:65536]
    out: dict[str, float] = {}
    for k in range(4):
        p = np.bincount(planes[:, k], minlength=256) if k < channels else np.zeros(256)
        p = p[p > 0] / max(1, p.sum())
        out[f"entropy_{'rgba'[k]}"] = round(float(-(p * np.log2(p)).sum()), 6) if len(p) else 0.0
    grid = image.samples()[:, :, : min(3, channels)]
    steps = np.sqrt((np.diff(grid, axis=0) ** 2).sum(2))
    out["gradient"] = round(float(steps.mean()), 6) if steps.size else 0.0
    out["photo"] = float(out["gradient"] > 5.0)
    out["colours"] = float(len(np.unique(s[:4096], axis=0)))
    return out
