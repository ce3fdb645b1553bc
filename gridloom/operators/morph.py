"""Binary morphology.

A pixel is set if its value is not zero. Places outside the image hold ``border_value`` in
every iteration; masked-out pixels keep their value through all of them.

A small structure applied once scatters. A larger one, or several iterations, run on blocks, where
one exchange of borders serves as many iterations as its halo allows: the block shrinks by the
structure's reach each time. A full box works axis by axis by running extremes, others by one
shifted copy a cell. An image may be a block table; the result is one then.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import checks
from ..plans.blocks import MOST_PIXELS, Blocks, edge_for
from ..plans.image import Image
from ..plans.stencil import SCATTER_TAPS, reach, running_extreme, scatter


def _once(now: np.ndarray, shape: np.ndarray, taps: np.ndarray, low, high, erode: bool) -> np.ndarray:
    """One iteration inside a block, which loses its reach."""
    size = [s - lo - hi for s, lo, hi in zip(now.shape, low, high)]
    if shape.all():
        first = taps.min(axis=0)
        out = now[tuple(slice(lo + f, lo + f + n + s - 1) for lo, f, n, s in zip(low, first, size, shape.shape))]
        for k, s in enumerate(shape.shape):
            out = running_extreme(out, s, k, np.logical_and if erode else np.logical_or)
        return out
    out = np.full(size, erode)
    for tap in taps.tolist():
        place = now[tuple(slice(lo + t, lo + t + n) for lo, t, n in zip(low, tap, size))]
        (np.logical_and if erode else np.logical_or)(out, place, out=out)
    return out


def _on_blocks(image: Image | Blocks, shape: np.ndarray, taps: np.ndarray, rounds: int, border: bool, masked: bool, erode: bool) -> Blocks:
    """``rounds`` iterations; with a mask, values are 1 for a set pixel plus 2 for one that may change."""
    low, high = reach(taps)
    # As many iterations in one exchange as leave the halo within half of the largest block.
    most = max(1, int(MOST_PIXELS ** (1 / image.ndim)) // 4 // max(*low, *high, 1))
    full = image.shape

    def kernel(steps: int):
        def run(block, at):
            held = block.astype(np.int8)
            now, free = (held & 1).astype(bool), (held & 2).astype(bool)
            start = at - steps * np.array(low)
            for _ in range(steps):
                new = _once(now, shape, taps, low, high, erode)
                own = tuple(slice(lo, lo + n) for lo, n in zip(low, new.shape))
                if masked:
                    free = free[own]
                    new = np.where(free, new, now[own])
                now, start = new, start + low
                for k, n in enumerate(full):
                    place = np.arange(now.shape[k]) + start[k]
                    if (outside := (place < 0) | (place >= n)).any():
                        now = now.copy()
                        now[(*[slice(None)] * k, outside)] = border
            return now + 2.0 * free if masked else now

        return run

    blocks = image
    while rounds:
        steps = min(rounds, most)
        wide = [steps * v for v in low], [steps * v for v in high]
        if isinstance(blocks, Image):
            blocks = Blocks.from_image(blocks, edge_for(*wide))
        blocks = blocks.with_halo(*wide, "constant", kernel(steps), float(border), "int8" if masked else "bool")
        rounds -= steps
    return blocks


def _as_set(image: Image | Blocks) -> Image | Blocks:
    if isinstance(image, Blocks):
        return image.map(lambda x: x != 0, "bool")
    return image.with_df(image.df.select(*image.coords, (image.as_double() != 0).alias("value")), "bool")


def _steps(image: Image | Blocks, structure, iterations, mask, border_value, origin, brute_force, erode: bool) -> Image | Blocks:
    shape = checks.structure(image.ndim, structure)
    rounds = checks.iterations(iterations)
    origin = checks.origin(shape.shape, origin)
    border = checks.border_value(border_value)
    checks.brute_force(brute_force)
    centre = np.array([s // 2 for s in shape.shape]) + np.array(origin)
    # Erosion looks at i + k - centre, dilation at i - k + centre.
    taps = (np.argwhere(shape) - centre) * (1 if erode else -1)
    if mask is not None and not isinstance(mask, (bool, np.bool_, Image, Blocks)):
        raise TypeError("The mask must be an image or a Boolean.")
    if isinstance(mask, (Image, Blocks)) and mask.shape != image.shape:
        raise RuntimeError("The mask must have the image's shape.")
    if isinstance(mask, (bool, np.bool_)):
        if not mask:  # every pixel keeps its value
            return _as_set(image)
        mask = None
    if mask is not None:
        return _masked(image, mask, shape, taps, rounds, border, erode)
    if not len(taps):
        return image.map(lambda x: np.full(x.shape, erode), "bool") if isinstance(image, Blocks) else image.with_df(image.df.select(*image.coords, F.lit(erode).alias("value")), "bool")
    if isinstance(image, Blocks) or rounds > 1 or len(taps) > SCATTER_TAPS:
        made = _on_blocks(_as_set(image), shape, taps, rounds, border, False, erode)
        return made if isinstance(image, Blocks) else made.to_image()
    step = _as_set(image)
    step = step.with_value(F.col("value").cast("int"), "int32")
    merge = F.min if erode else F.max
    df = scatter(step, taps, np.zeros((len(taps), 1)), lambda v, w, tap: [merge(v).cast("int").alias("value")], "constant", float(border))
    return image.with_df(df.select(*image.coords, (F.col("value") != 0).alias("value")), "bool")


def _masked(image: Image | Blocks, mask: Image | Blocks, shape, taps, rounds: int, border: bool, erode: bool) -> Image | Blocks:
    if not len(taps):  # one cell that no structure has: a first iteration sets or clears what may change
        shape, taps, rounds = np.zeros(shape.shape, bool), np.zeros((0, image.ndim), int), 1
    pixels, held = _pixel_table(_as_set(image)), _pixel_table(_as_set(mask))
    both = pixels.df.select(*pixels.coords, F.col("value").cast("int").alias("own")).join(held.df.select(*held.coords, F.col("value").cast("int").alias("free")), pixels.coords)
    coded = Image(both.select(*pixels.coords, (F.col("own") + 2 * F.col("free")).alias("value")), image.shape, "int32")
    if not len(taps):
        made = Blocks.from_image(coded).map(lambda x: np.where(x >= 2, float(erode), x % 2), "bool")
    else:
        made = _on_blocks(coded, shape, taps, rounds, border, True, erode).map(lambda x: x % 2, "bool")
    return made if isinstance(image, Blocks) else made.to_image()


def _pixel_table(image: Image | Blocks) -> Image:
    return image.to_image() if isinstance(image, Blocks) else image


def binary_erosion(image: Image, structure=None, iterations=1, mask=None, border_value=0, origin=0, brute_force=False) -> Image:
    return _steps(image, structure, iterations, mask, border_value, origin, brute_force, True)


def binary_dilation(image: Image, structure=None, iterations=1, mask=None, border_value=0, origin=0, brute_force=False) -> Image:
    return _steps(image, structure, iterations, mask, border_value, origin, brute_force, False)


def binary_closing(image: Image, structure=None, iterations=1, origin=0, mask=None, border_value=0, brute_force=False) -> Image:
    """Dilation, then erosion, with the same arguments."""
    wide = binary_dilation(image, structure, iterations, mask, border_value, origin, brute_force)
    return binary_erosion(wide, structure, iterations, mask, border_value, origin, brute_force)


def binary_opening(image: Image, structure=None, iterations=1, origin=0, mask=None, border_value=0, brute_force=False) -> Image:
    """Erosion, then dilation, with the same arguments."""
    thin = binary_erosion(image, structure, iterations, mask, border_value, origin, brute_force)
    return binary_dilation(thin, structure, iterations, mask, border_value, origin, brute_force)
