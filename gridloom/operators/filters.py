"""Neighbourhood filters: linear, order-statistic, generic and local thresholds.

Every filter takes an image and returns one of the same shape and dtype; an integral result is
truncated towards zero once, at the end. Results don't depend on how the pixels are
partitioned: a boundary mode holds for the whole image. ``strategy`` is auto, scatter, tiles or, for
means and extremes of a full box, frames: windows of Spark, without Python.
Ranks other than the first and last, which no partial aggregation shortens, take tiles always.
An image may be a block table (``Blocks``); the result is one then, and filters one after the
other move the blocks' borders only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import prod

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.kernels import gaussian_1d, rank_of_percentile
from ..plans.blocks import Blocks
from ..plans.image import Image
from ..plans.stencil import SCATTER_TAPS, correlate_axis, frames, reach, running_extreme, scatter, sliding_rank, slides, tiles, windows

#: Neighbourhood cells that a tile's kernel copies at a time: 32 MB of doubles.
_STRIP_CELLS = 1 << 22
#: Cells above which windows of ranks may slide.
_SLIDING_CELLS = 100


def _offsets(mask: np.ndarray, origin: Sequence[int]) -> np.ndarray:
    """Offsets of a footprint's cells from its centre, in C order."""
    return np.argwhere(mask) - np.array([s // 2 for s in mask.shape]) - np.array(origin)


def _takes_scatter(image: Image | Blocks, strategy: str, taps: int) -> bool:
    if strategy not in ("auto", "scatter", "tiles", "frames"):
        raise ValueError(f"no such strategy: {strategy}")
    if isinstance(image, Blocks):
        return False
    return strategy == "scatter" or strategy == "auto" and taps <= SCATTER_TAPS


def _box(image: Image, size: Sequence[int], origin: Sequence[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Reach below and above of a neighbourhood; both at least zero, as the block needs its own place."""
    low = tuple(max(0, s // 2 + o) for s, o in zip(size, origin))
    high = tuple(max(0, s - 1 - s // 2 - o) for s, o in zip(size, origin))
    return low, high


def _skipped(size, origin, low) -> list[int]:
    """Places before a tile's first neighbourhood, which an origin may leave unused."""
    return [lo - (s // 2 + o) for s, o, lo in zip(size, origin, low)]


def _neighbourhoods(block: np.ndarray, size, origin, low) -> np.ndarray:
    """The neighbourhoods of a tile's own pixels."""
    return windows(block[tuple(slice(k, None) for k in _skipped(size, origin, low))], size)


def _by_strips(view: np.ndarray, mask: np.ndarray, array: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``array`` of the footprint cells of all neighbourhoods, copied a strip of bounded size at a time."""
    n = mask.ndim
    room, steps = max(1, _STRIP_CELLS // int(mask.sum())), []
    for s in reversed(view.shape[:n]):
        steps.append(min(s, room))
        room = max(1, room // s)
    out = np.empty(view.shape[:n])
    for at in np.ndindex(*[-(-s // k) for s, k in zip(view.shape, reversed(steps))]):
        strip = tuple(slice(a * k, (a + 1) * k) for a, k in zip(at, reversed(steps)))
        out[strip] = array(view[strip][..., mask])
    return out


def _done(image: Image | Blocks, df, value: Column | None = None) -> Image | Blocks:
    if isinstance(df, Blocks):
        return df
    return image.with_df(df.select(*image.coords, image.to_dtype(F.col("value") if value is None else value).alias("value")))


def _linear(image: Image, weights: np.ndarray, origin: Sequence[int], mode: str, cval: float, strategy: str) -> Image:
    """out[i] = sum w[k] in[i + k - size // 2 - origin]."""
    mode = checks.mode(mode)
    used = weights != 0
    if not used.any():
        return image.map(np.zeros_like) if isinstance(image, Blocks) else image.with_value(image.to_dtype(F.lit(0.0)))
    if _takes_scatter(image, strategy, int(used.sum())):
        taps = _offsets(used, origin)
        df = scatter(image, taps, weights[used][:, None], lambda v, w, _: [F.sum(v * w[0]).alias("value")], mode, cval)
        return _done(image, df)
    low, high = _box(image, weights.shape, origin)

    def kernel(block, at):
        own = [b - lo - hi for b, lo, hi in zip(block.shape, low, high)]
        out = np.zeros(own)
        for cell in np.argwhere(used):  # one cell at a time, so no neighbourhood is copied
            place = tuple(slice(int(c) + k, int(c) + k + s) for c, k, s in zip(cell, _skipped(weights.shape, origin, low), own))
            out += weights[tuple(cell)] * block[place]
        return out

    return _done(image, tiles(image, low, high, mode, kernel, cval))


def _weights(image: Image, weights) -> np.ndarray:
    weights = np.asarray(weights, float)
    if weights.ndim != image.ndim:
        raise RuntimeError("The weights must have the image's number of dimensions.")
    if weights.size == 0:
        raise RuntimeError("The weights must not be empty.")
    return weights


def correlate(image: Image, weights, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    weights = _weights(image, weights)
    return _linear(image, weights, checks.origin(weights.shape, origin), mode, cval, strategy)


def convolve(image: Image, weights, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    """out[i] = sum w[k] in[i - k + size // 2 + origin]: a correlation with the weights turned round."""
    weights = _weights(image, weights)
    origin = checks.origin(weights.shape, origin)
    turned = weights[tuple(slice(None, None, -1) for _ in weights.shape)]
    shifted = [-o - (s % 2 == 0) for s, o in zip(weights.shape, origin)]
    return _linear(image, turned, shifted, mode, cval, strategy)


Stack = list  # of (axis, weights, origin): correlations along single axes, one after the other


def _stacks(image: Image, stacks: list[Stack], mode: str, cval: float, strategy: str, merge_columns: Callable, merge_arrays: Callable) -> Image:
    """Several stacks of one-dimensional correlations, merged pixel by pixel."""
    mode, n = checks.mode(mode), image.ndim
    if _takes_scatter(image, strategy, max((prod(np.count_nonzero(w) for _, w, _ in stack) for stack in stacks), default=1)):
        made = _stacks_by_scatter(image, stacks, mode, cval, strategy, merge_columns)
        if made is not None:
            return made
    return _stacks_by_tiles(image, stacks, mode, cval, merge_arrays)


def _stacks_by_scatter(image: Image, stacks: list[Stack], mode: str, cval: float, strategy: str, merge_columns: Callable) -> Image | None:
    """All stacks in one pass over the products of their weights; None if these are too many or one pass isn't exact."""
    n = image.ndim
    combined: dict[tuple[int, ...], list[float]] = {}
    for j, stack in enumerate(stacks):
        product = {tuple([0] * n): 1.0}
        for axis, weights, origin in stack:
            start = -(len(weights) // 2) - origin
            product = {(*at[:axis], at[axis] + start + k, *at[axis + 1 :]): v * w for at, v in product.items() for k, w in enumerate(weights)}
        for at, v in product.items():
            combined.setdefault(at, [0.0] * len(stacks))[j] = v
    taps = sorted(at for at, w in combined.items() if any(w))
    # Each pass sees cval outside; in one pass over products that holds if a pass keeps constants or cval is zero.
    exact = mode != "constant" or cval == 0 or all(len(s) < 2 or all(abs(sum(w) - 1) < 1e-12 for _, w, _ in s) for s in stacks)
    if not taps:
        taps = [tuple([0] * n)]
        combined[taps[0]] = [0.0] * len(stacks)
    if _takes_scatter(image, strategy, len(taps)) and exact:
        df = scatter(image, np.array(taps), np.array([combined[t] for t in taps]), lambda v, w, _: [F.sum(v * x).alias(f"s{j}") for j, x in enumerate(w)], mode, cval)
        return _done(image, df, merge_columns([F.col(f"s{j}") for j in range(len(stacks))]))
    return None


def _stacks_by_tiles(image: Image, stacks: list[Stack], mode: str, cval: float, merge_arrays: Callable) -> Image:
    n = image.ndim
    low, high = [0] * n, [0] * n
    for stack in stacks:
        for axis, weights, origin in stack:
            low[axis] = max(low[axis], len(weights) // 2 + origin)
            high[axis] = max(high[axis], len(weights) - 1 - len(weights) // 2 - origin)
    shape = image.shape

    def kernel(block, at):
        made = []
        for stack in stacks:
            now, left = block, list(low)
            for axis, weights, origin in stack:
                if mode == "constant":
                    place = np.arange(now.shape[axis]) + at[axis] - left[axis]
                    outside = [slice(None)] * n
                    outside[axis] = (place < 0) | (place >= shape[axis])
                    now = now.copy()
                    now[tuple(outside)] = cval
                now = correlate_axis(now, weights, axis)
                left[axis] -= len(weights) // 2 + origin
            own = tuple(slice(lo, lo + b - low[k] - high[k]) for k, (lo, b) in enumerate(zip(left, block.shape)))
            made.append(now[own])
        return merge_arrays(made)

    return _done(image, tiles(image, low, high, mode, kernel, cval))


def _total(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _norm_columns(parts):
    return F.sqrt(_total([p * p for p in parts]))


def _norm_arrays(parts):
    return np.sqrt(_total([p * p for p in parts]))


def laplace(image: Image, mode: str = "reflect", cval: float = 0.0, strategy: str = "auto") -> Image:
    """Sum of second differences along all axes."""
    stacks = [[(k, [1.0, -2.0, 1.0], 0)] for k in range(image.ndim)]
    return _stacks(image, stacks, mode, cval, strategy, _total, _total)


def _edges(image: Image, axis: int, smooth: list[float], mode: str, cval: float, strategy: str) -> Image:
    axis = checks.axis(image.ndim, axis)
    stack = [(axis, [-1.0, 0.0, 1.0], 0), *[(k, smooth, 0) for k in range(image.ndim) if k != axis]]
    return _stacks(image, [stack], mode, cval, strategy, _total, _total)


def prewitt(image: Image, axis: int = -1, mode: str = "reflect", cval: float = 0.0, strategy: str = "auto") -> Image:
    return _edges(image, axis, [1.0, 1.0, 1.0], mode, cval, strategy)


def sobel(image: Image, axis: int = -1, mode: str = "reflect", cval: float = 0.0, strategy: str = "auto") -> Image:
    return _edges(image, axis, [1.0, 2.0, 1.0], mode, cval, strategy)


def _gaussian_stack(ndim: int, sigmas: Sequence[float], orders: Sequence[int], truncate: float) -> Stack:
    return [(k, gaussian_1d(s, o, truncate), 0) for k, (s, o) in enumerate(zip(sigmas, orders)) if s > 1e-15]


def gaussian_filter(image: Image, sigma, order=0, mode: str = "reflect", cval: float = 0.0, truncate: float = 4.0, strategy: str = "auto") -> Image:
    """A Gaussian, or its derivative of an order along each axis, applied axis by axis."""
    sigmas = checks.sigmas(image.ndim, sigma)
    orders = [int(order)] * image.ndim if np.isscalar(order) else [int(o) for o in order]
    return _stacks(image, [_gaussian_stack(image.ndim, sigmas, orders, truncate)], mode, cval, strategy, _total, _total)


def gaussian(image: Image, sigma, order=0, mode: str = "reflect", cval: float = 0.0, truncate: float = 4.0, strategy: str = "auto") -> Image:
    """The same as ``gaussian_filter``."""
    return gaussian_filter(image, sigma, order, mode, cval, truncate, strategy)


def _gaussian_each(image, sigma, order, mode, cval, truncate, strategy, columns, arrays):
    sigmas, n = checks.sigmas(image.ndim, sigma), image.ndim
    stacks = [_gaussian_stack(n, sigmas, [order if k == axis else 0 for k in range(n)], truncate) for axis in range(n)]
    return _stacks(image, stacks, mode, cval, strategy, columns, arrays)


def gaussian_gradient_magnitude(image: Image, sigma, mode: str = "reflect", cval: float = 0.0, truncate: float = 4.0, strategy: str = "auto") -> Image:
    return _gaussian_each(image, sigma, 1, mode, cval, truncate, strategy, _norm_columns, _norm_arrays)


def gaussian_laplace(image: Image, sigma, mode: str = "reflect", cval: float = 0.0, truncate: float = 4.0, strategy: str = "auto") -> Image:
    return _gaussian_each(image, sigma, 2, mode, cval, truncate, strategy, _total, _total)


def _passes(size: Sequence[int], origin: Sequence[int]) -> list[tuple[int, int, int]]:
    """A box as (axis, places below, places above) of each axis that it is longer than one along, or moved."""
    return [(k, s // 2 + o, s - 1 - s // 2 - o) for k, (s, o) in enumerate(zip(size, origin)) if s > 1 or o]


def uniform_filter(image: Image, size=3, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    """The mean of a box."""
    size = checks.size(image.ndim, size)
    origin = checks.origin(size, origin)
    if strategy == "frames" and isinstance(image, Image):
        return _done(image, frames(image, _passes(size, origin), F.avg, checks.mode(mode), cval))
    stack = [(k, np.full(s, 1.0 / s), o) for k, (s, o) in enumerate(zip(size, origin)) if s > 1]
    return _stacks(image, [stack], mode, cval, strategy, _total, _total)


def _ordered(image: Image, size, footprint, mode, cval, origin, strategy, column: Callable[[Column], Column] | None, array: Callable[[np.ndarray], np.ndarray], least: np.ufunc | None = None, rank: int | None = None) -> Image:
    """``column`` aggregates what can be combined before a shuffle; without it, tiles are taken. ``least`` works axis by axis on a full box, ``rank`` by windows that slide."""
    mask = checks.footprint(image.ndim, size, footprint)
    origin = checks.origin(mask.shape, origin)
    if not mask.any():
        raise RuntimeError("The footprint must have a cell that is set.")
    mode = checks.mode(mode)
    if strategy == "frames" and isinstance(image, Image) and least is not None and mask.all():
        return _done(image, frames(image, _passes(mask.shape, origin), column, mode, cval))
    if _takes_scatter(image, strategy, int(mask.sum())) and column is not None:
        taps = _offsets(mask, origin)
        return _done(image, scatter(image, taps, np.zeros((len(taps), 1)), lambda v, _, tap: [column(v).alias("value")], mode, cval))
    low, high = _box(image, mask.shape, origin)

    def kernel(block, at):
        view = _neighbourhoods(block, mask.shape, origin, low)
        own = tuple(slice(0, b - lo - hi) for b, lo, hi in zip(block.shape, low, high))
        if least is not None and mask.all():
            out = block[tuple(slice(k, None) for k in _skipped(mask.shape, origin, low))]
            for k, s in enumerate(mask.shape):
                out = running_extreme(out, s, k, least)
            return out[own]
        if rank is not None and mask.sum() > _SLIDING_CELLS:
            used = block[tuple(slice(k, k + n - lo - hi + m - 1) for k, n, lo, hi, m in zip(_skipped(mask.shape, origin, low), block.shape, low, high, mask.shape))]
            if slides(view[own].shape[: mask.ndim], mask, used.size):
                return sliding_rank(used, mask, rank)
        return _by_strips(view[own], mask, array)

    return _done(image, tiles(image, low, high, mode, kernel, cval))


def minimum_filter(image: Image, size=None, footprint=None, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    return _ordered(image, size, footprint, mode, cval, origin, strategy, F.min, lambda x: x.min(axis=-1), np.minimum)


def maximum_filter(image: Image, size=None, footprint=None, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    return _ordered(image, size, footprint, mode, cval, origin, strategy, F.max, lambda x: x.max(axis=-1), np.maximum)


def _ranked(image, rank_of: Callable[[int], int], size, footprint, mode, cval, origin, strategy) -> Image:
    cells = int(checks.footprint(image.ndim, size, footprint).sum())
    rank = rank_of(cells)
    if rank < 0:
        rank += cells
    if not 0 <= rank < cells:
        raise RuntimeError("The rank is not within the footprint.")
    if rank in (0, cells - 1):
        return (minimum_filter if rank == 0 else maximum_filter)(image, size, footprint, mode, cval, origin, strategy)
    return _ordered(image, size, footprint, mode, cval, origin, strategy, None, lambda x: np.partition(x, rank, axis=-1)[..., rank], rank=rank)


def median_filter(image: Image, size=None, footprint=None, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    """The element of rank cells // 2, never a mean of two."""
    return _ranked(image, lambda cells: cells // 2, size, footprint, mode, cval, origin, strategy)


def rank_filter(image: Image, rank: int, size=None, footprint=None, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    """The element of a rank; a negative one counts from the largest."""
    return _ranked(image, lambda cells: int(rank), size, footprint, mode, cval, origin, strategy)


def percentile_filter(image: Image, percentile: float, size=None, footprint=None, mode: str = "reflect", cval: float = 0.0, origin=0, strategy: str = "auto") -> Image:
    return _ranked(image, lambda cells: rank_of_percentile(cells, percentile), size, footprint, mode, cval, origin, strategy)


def generic_filter(image: Image, function: Callable, size=None, footprint=None, mode: str = "reflect", cval: float = 0.0, origin=0, extra_arguments=(), extra_keywords=None, native: bool = False, vectorized: bool = False) -> Image:
    """``function`` of every neighbourhood, flat and in C order, footprint cells only.

    A Python function gets an array of doubles and runs on tiles. With ``vectorized`` it gets many
    neighbourhoods at once, an array of (pixels, cells) of at most 32 MB, and returns a value for
    each. With ``native`` it gets an array<double> column and returns a column, and no Python runs
    on the executors.
    """
    more = dict(extra_keywords or {})
    if native:
        if isinstance(image, Blocks):
            raise TypeError("A native function needs a pixel table.")

        def column(v, tap):
            cells = F.array_sort(F.collect_list(F.struct(tap.alias("tap"), v.alias("v"))))
            return function(F.transform(cells, lambda c: c["v"]), *extra_arguments, **more)

        mask = checks.footprint(image.ndim, size, footprint)
        taps = _offsets(mask, checks.origin(mask.shape, origin))
        return _done(image, scatter(image, taps, np.zeros((len(taps), 1)), lambda v, _, tap: [column(v, tap).alias("value")], checks.mode(mode), cval))
    if vectorized:
        return _ordered(image, size, footprint, mode, cval, origin, "tiles", None, lambda x: np.asarray(function(x.reshape(-1, x.shape[-1]), *extra_arguments, **more), float).reshape(x.shape[:-1]))
    return _ordered(image, size, footprint, mode, cval, origin, "tiles", None, lambda x: np.apply_along_axis(lambda v: function(v, *extra_arguments, **more), -1, x))


def threshold_local(image: Image, block_size, method: str = "gaussian", offset: float = 0, mode: str = "reflect", param=None, cval: float = 0, strategy: str = "auto", vectorized: bool = False) -> Image:
    """A threshold for each pixel from its surroundings, less ``offset``, as doubles.

    The methods are generic (``param`` is the function, of many neighbourhoods at once if
    ``vectorized``), gaussian (``param`` is sigma, by
    default (block_size - 1) / 6), mean and median.
    """
    real = image.with_dtype("float64") if isinstance(image, Blocks) else image.with_value(image.as_double(), "float64")
    sizes = checks.size(image.ndim, block_size)
    if method == "generic":
        if not callable(param):
            raise ValueError("The generic method needs a function as param.")
        made = generic_filter(real, param, sizes, mode=mode, cval=cval, vectorized=vectorized)
    elif method == "gaussian":
        sigma = [(s - 1) / 6.0 for s in sizes] if param is None else param
        made = gaussian_filter(real, sigma, mode=mode, cval=cval, strategy=strategy)
    elif method == "mean":
        made = uniform_filter(real, sizes, mode=mode, cval=cval, strategy=strategy)
    elif method == "median":
        made = median_filter(real, sizes, mode=mode, cval=cval, strategy=strategy)
    else:
        raise ValueError(f"no such method: {method}")
    if isinstance(made, Blocks):
        return made.map(lambda x: x - float(offset)) if offset else made
    return made.with_value(F.col("value") - F.lit(float(offset)))
