"""The search for the least encoding of an image, kernels and strategy table; plans.optimise lays it out over a cluster."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterable

import numpy as np

from pixelweave.model import GRAY_ALPHA, INDEXED, RGBA, Image
from pixelweave.operators import deflate, filters, recolour, writer
from pixelweave.operators.deflate import BEST, DEFAULT, FAST, ULTRA
from pixelweave.sources import png

LARGE, HUGE = 1 << 18, 1 << 20  # pixel bytes
#: Pixel bytes up to which a huge image gets five and three passes; what a file has besides its stream and a variant's own chunks.
FIVE, THREE = 2621440, 10485760
#: Pixel bytes up to which a code of its own may cost a stream more than it saves, so that uniform filters are tried from level 3 on (others: from 4),
#: at level 3 also those that suit the fixed code best: kind FIXED beside the uniform kinds.
SMALL, FIXED = 1024, 5
FRAME_BYTES = 57


@dataclasses.dataclass(frozen=True)
class Strategy:
    ordinal: int
    filter_level: int
    deflate_level: int
    passes: int
    alpha: bool
    reduce: bool
    sort: bool

    @property
    def name(self) -> str:
        steps = [n for n, on in (("alpha", self.alpha), ("reduce", self.reduce), ("sort", self.sort)) if on]
        return "+".join([f"filter{self.filter_level}", *steps])


def strategies(level: int) -> list[Strategy]:
    """In order of precedence. From 7 on six groups of filter levels share their recolouring steps."""
    if level <= 0:
        groups = [((0,), FAST, 1, (1, 0, 0))]
    elif level <= 3:
        groups = [((0,), DEFAULT, 1, (1, 0, 0)), ((1, 2), BEST, 1, (1, 0, 0))]
    elif level <= 6:
        groups = [((0, 1, 2, 3, 5), BEST, 2, (1, 0, 0)), ((2,), BEST, 2, (1, 0, 1))]
    else:
        k = 5 if level >= 9 else 3
        # Filter levels; then alpha, colour reduction, palette sort.
        table = (((0, 1, 2, 3, 4, 5, 7), (1, 0, 0)), ((0, 1, 2, 3, 5, 7), (0, 0, 0)), ((0, 1, 2, 3, 5), (1, 0, 1)), ((0, 1, 2, 3, 4, 5, 7), (1, 1, 0)), ((0, 1, 2, 3, 5, 7), (1, 1, 1)), ((0, 2, 3, 5), (0, 1, 1)))
        groups = [(levels, ULTRA, k, steps) for levels, steps in table]
    flat = [(f, d, k, *map(bool, steps)) for levels, d, k, steps in groups for f in levels]
    return [Strategy(n, *row) for n, row in enumerate(flat)]


def pruned(rows: Iterable[Strategy], pixel_bytes: int, animated: bool, entropy_r: float) -> list[Strategy]:
    """What isn't worth trying: recolouring of animations, dear filters for large images, all but cheap filters for noise."""
    rows = list(rows)
    kept = [s for s in rows if not (animated and (s.reduce or s.sort) or pixel_bytes >= LARGE and s.filter_level in (4, 7) or entropy_r > 7.5 and s.filter_level >= 3)]
    return kept or [dataclasses.replace(rows[0], filter_level=0, reduce=False, sort=False)]


def variant(image: Image, alpha: bool, reduce: bool, sort: bool) -> Image:
    image = recolour.optimise_alpha(image) if alpha else image
    if image.animated:
        return image
    image = recolour.reduce_colours(image) if reduce else image
    return recolour.sort_palette(image) if sort else image


def fingerprint(image: Image) -> str:
    """Of what the picture data are: type, depth, pixels, palette, alpha, colour key."""
    h = hashlib.sha256(f"{image.color_type}:{image.bit_depth}:".encode())
    for part in (image.pixels, image.palette, image.alpha_palette, image.single.get("tRNS", b"")):
        h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def uniform(height: int, kind: int) -> np.ndarray:
    return np.full(height, kind, np.int64)


def by_kind(image: Image, kind: int) -> np.ndarray:
    return filters.fewest_long(image.rows, image.stride) if kind == FIXED else uniform(image.height, kind)


def proxy_size(image: Image, choice: np.ndarray, level: int) -> int:
    """What one pass gives, with the chunks that the variant needs."""
    stream = writer.filtered(image, image.pixels, image.width, image.height, choice)
    return len(writer.best_zlib(stream, deflate.Options(min(level, BEST), 1, row=image.row + 1))) + recolour.overhead(image)


def passes_for(pixel_bytes: int, passes: int) -> int:
    """Fewer passes for larger images."""
    if pixel_bytes >= HUGE:
        return min(passes, 5 if pixel_bytes <= FIVE else 3 if pixel_bytes <= THREE else 2)
    return min(passes, 4) if pixel_bytes >= LARGE else passes


def level_for(pixel_bytes: int, level: int, deflate_level: int) -> int:
    """At the higher levels huge images are encoded as well as others."""
    return max(deflate_level, BEST) if pixel_bytes >= HUGE and level >= 7 else deflate_level


def encode(image: Image, choice: np.ndarray | None, level: int, passes: int) -> bytes:
    return writer.write(image, writer.WriteOptions(choice, deflate.Options(level, passes)))


def finalist(image: Image, choice: np.ndarray, level: int, passes: int, proxy: int | None = None) -> bytes:
    """A full encoding; where one pass (proxy: its size without FRAME_BYTES) was less, that one if it stays less as a file."""
    made = encode(image, choice, level, passes)
    if proxy is not None and (level != BEST or passes > 1) and proxy + FRAME_BYTES < len(made):
        made = min(made, encode(image, choice, BEST, 1), key=len)
    return made


def finalists(pixel_bytes: int) -> int:
    return 2 if pixel_bytes >= HUGE else 3 if pixel_bytes >= LARGE else 4


def verify(content: bytes, original: Image) -> str | None:
    """Nothing if the file decodes without a warning to an equivalent image, else why not."""
    try:
        back = png.read(content)
    except png.Rejected as e:
        return str(e)
    return f"decoder warns: {back.warnings[0]}" if back.warnings else recolour.equivalent(back, original)


@dataclasses.dataclass(frozen=True)
class CompressOptions:
    level: int = 9
    strip: bool = False
    keep_colour: bool = True
    multi: bool = True


@dataclasses.dataclass(frozen=True)
class Result:
    data: bytes
    strategy: str
    pixel_bytes: int


def safe(image: Image, options: CompressOptions) -> Result:
    """Nothing but a plain encoding."""
    own = recolour.strip_metadata(image, options.keep_colour) if options.strip else image
    data = encode(own, filters.choose(own.rows, own.stride, 0), DEFAULT, 1)
    if why := verify(data, image):
        raise ValueError(f"plain encoding failed: {why}")
    return Result(data, "safe", len(image.pixels))


def single(image: Image, options: CompressOptions) -> Result:
    """One variant and one filter level; from 5 on uniform filters are tried too."""
    own = recolour.strip_metadata(image, options.keep_colour) if options.strip else image
    level = options.level
    if not own.animated:
        own = recolour.optimise_alpha(own) if own.color_type in (INDEXED, GRAY_ALPHA, RGBA) else own
        own = recolour.reduce_colours(own) if level >= 7 else own
        own = recolour.sort_palette(own)
    chosen = 7 if level >= 7 else 5 if level >= 5 else 3 if level >= 3 else 2
    effort = (ULTRA, 3) if level >= 9 else (BEST, 2) if level >= 5 else (DEFAULT, 1)
    tries = [(encode(own, filters.choose(own.rows, own.stride, chosen), *effort), f"filter{chosen}")]
    if level >= 5:
        tries += [(encode(own, uniform(own.height, k), *effort), f"uniform{k}") for k in range(5)]
    data, name = min(tries, key=lambda t: len(t[0]))
    if why := verify(data, image):
        raise ValueError(why)
    return Result(data, name, len(image.pixels))


def multi(image: Image, options: CompressOptions) -> Result:
    """All strategies of a level: variants, filter vectors, one-pass sizes, full encodings of the best, the first that verifies."""
    own = recolour.strip_metadata(image, options.keep_colour) if options.strip else image
    size = len(image.pixels)
    table = pruned(strategies(options.level), size, image.animated, recolour.content(own)["entropy_r"])
    variants: dict[str, tuple[int, Image]] = {}
    jobs: dict[tuple[int, int], Strategy] = {}
    built: dict[tuple, str] = {}
    for s in table:
        steps = (s.alpha, s.reduce, s.sort)
        if steps not in built:
            made = variant(own, *steps)
            built[steps] = mark = fingerprint(made)
            variants.setdefault(mark, (len(variants), made))
        jobs.setdefault((variants[built[steps]][0], filters.CANONICAL.get(s.filter_level, 7)), s)
    images = {n: v for n, v in variants.values()}
    candidates: dict[tuple[int, bytes], tuple[int, np.ndarray, Strategy, str]] = {}
    for (n, _), s in jobs.items():
        choice = filters.choose(images[n].rows, images[n].stride, s.filter_level)
        candidates.setdefault((n, choice.astype(np.uint8).tobytes()), (n, choice, s, s.name))
    if options.level >= 4 or options.level == 3 and size <= SMALL:
        for n, made in images.items():
            for k in range(5 if options.level >= 4 else FIXED + 1):
                choice = by_kind(made, k)
                first = next(s for (v, _), s in jobs.items() if v == n)
                candidates.setdefault((n, choice.astype(np.uint8).tobytes()), (n, choice, first, "fixed" if k == FIXED else f"uniform{k}"))
    listed = list(candidates.values())
    sizes = [proxy_size(images[n], choice, s.deflate_level) for n, choice, s, _ in listed]
    ranked = sorted(range(len(listed)), key=lambda k: (sizes[k], k))
    top = ranked[: finalists(size)]
    if len({listed[k][0] for k in top}) == 1 and len(top) > 1:
        top[-1] = next((k for k in ranked if listed[k][0] != listed[top[0]][0]), top[-1])
    made = []
    for rank, k in enumerate(top):
        n, choice, s, name = listed[k]
        made.append((finalist(images[n], choice, level_for(size, options.level, s.deflate_level), passes_for(size, s.passes), sizes[k]), rank, name))
    for data, _, name in sorted(made, key=lambda m: (len(m[0]), m[1])):
        if not verify(data, image):
            return Result(data, name, size)
    raise ValueError("no encoding verifies")


def compress(image: Image, options: CompressOptions | None = None) -> Result:
    """By the options' mode; falls back to the plain encoding if nothing verifies."""
    options = options or CompressOptions()
    try:
        return (multi if options.multi and options.level > 0 else single)(image, options)
    except ValueError:
        return safe(image, options)


def keep_original(original: bytes, made: bytes) -> bytes:
    return made if len(made) < len(original) else original
