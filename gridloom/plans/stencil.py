"""Neighbourhood operations on a pixel table, in one of four ways.

``scatter``: pixels are dealt to tiles that overlap by the neighbourhood's reach; there every pixel
sends its value to the places it is a neighbour of, and one aggregation gathers them. All of it is
Spark expressions, with one shuffle of little more than the image, and a task gathers a bounded
number of pixels. Best for small neighbourhoods.

``tiles``: pixels are dealt to square tiles that overlap by the neighbourhood's reach, and a
NumPy kernel works on each tile. One shuffle of little more than the image, where the reach is
small beside a tile. Best for larger neighbourhoods and for Python functions.

``frames``: a separable box as one window frame of Spark an axis, of bounded pieces of lines. No
Python, one shuffle an axis, and a pass over the frame for each pixel.

Blocks (see ``blocks``): where tiles would overlap by more than half, pixels are dealt once, to
larger blocks, which exchange their borders as arrays. A block table stays one over several
operations, which then move borders only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import HALO, Blocks, edge_for, halo_share
from .boundary import padded
from .image import Image

#: Neighbours up to which scatter is taken.
SCATTER_TAPS = 25
_TILE_PIXELS = 1 << 16
#: Tiles whose pixels one task gathers when it scatters.
_TASK_TILES = 4


def reach(taps: np.ndarray) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """How far offsets (rows of ``taps``) go below and above zero, by axis."""
    return tuple(int(v) for v in np.maximum(-taps.min(axis=0), 0)), tuple(int(v) for v in np.maximum(taps.max(axis=0), 0))


def scatter(image: Image, taps: np.ndarray, weights: np.ndarray, aggs: Callable[[Column, list[Column], Column], list[Column]], mode: str, cval: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """out[i] from in[i + tap] over all taps (integer rows) and their weights (a row for each tap).

    ``aggs`` makes named aggregates of a neighbour's value, its weights and its number. Columns
    in ``keep`` are those of the pixel itself; a tap of zero is added for them if there is none,
    with null as its value.
    """
    n = image.ndim
    low, high = reach(taps)
    rows = []
    centre = False
    for k, (tap, w) in enumerate(zip(taps.tolist(), np.atleast_2d(weights).tolist())):
        own = not any(tap)
        centre = centre or own
        rows.append((tap, w, k, own, True))
    if keep and not centre:
        rows.append(([0] * n, [0.0] * len(rows[0][1]), len(rows), True, False))
    structs = [F.struct(*[F.lit(u).cast("bigint").alias(f"u{k}") for k, u in enumerate(tap)], *[F.lit(float(x)).alias(f"w{j}") for j, x in enumerate(w)], F.lit(number).alias("tap"), F.lit(own).alias("own"), F.lit(use).alias("use")) for tap, w, number, own, use in rows]
    edge = tile_edge(n)
    dealt = _dealt(padded(image, low, high, mode, cval).select(*[f"v{k}" for k in range(n)], "value", *keep), image.shape, low, high, edge)
    number, tiles_held = F.lit(0).cast("bigint"), 1
    for k, size in enumerate(image.shape):
        count = -(-size // edge)
        number, tiles_held = number * F.lit(count).cast("bigint") + F.col(f"t{k}"), tiles_held * count
    tasks = max(1, -(-tiles_held // _TASK_TILES))
    # All that a pixel is made from is in its tile's task, so the aggregation needs no other exchange.
    dealt = dealt.withColumn("task", F.pmod(number, F.lit(tasks)).cast("int")).repartitionById(tasks, "task")
    spread = dealt.withColumn("t", F.explode(F.array(*structs)))
    spread = spread.select("task", *[F.col(f"t{k}") for k in range(n)], *[(F.col(f"v{k}") - F.col(f"t.u{k}")).alias(f"o{k}") for k in range(n)], *[F.col(f"v{k}") for k in range(n)], "value", "t", *keep)
    for k, size in enumerate(image.shape):
        first = F.col(f"t{k}") * edge
        spread = spread.filter((F.col(f"o{k}") >= first) & (F.col(f"o{k}") < F.least(first + edge, F.lit(size).cast("bigint"))))
    value = F.col("value") if all(r[4] for r in rows) else F.when(F.col("t.use"), F.col("value"))
    made = aggs(value, [F.col(f"t.w{j}") for j in range(len(rows[0][1]))], F.col("t.tap"))
    itself = F.col("t.own")
    for k in range(n):
        itself = itself & (F.col(f"v{k}") == F.col(f"o{k}"))
    kept = [F.max(F.when(itself, F.col(c))).alias(c) for c in keep]
    return spread.groupBy("task", *[F.col(f"o{k}").alias(f"d{k}") for k in range(n)]).agg(*made, *kept).drop("task")


#: Places of a line that one window partition holds beside its halo.
_PIECE = 4096


def frames(image: Image, passes: Sequence[tuple[int, int, int]], agg: Callable[[Column], Column], mode: str, cval: float = 0.0) -> DataFrame:
    """``agg`` of a box, axis by axis: of the values ``low`` below to ``high`` above along each ``axis``.

    Lines are cut into pieces that overlap by the frame, so a window's partition is bounded.
    """
    now = image.with_df(image.df.select(*image.coords, image.as_double().alias("value")), "float64")
    for axis, low, high in passes:
        reaches = [[abs(v) if k == axis else 0 for k in range(image.ndim)] for v in (min(-low, 0), max(high, 0))]
        lo, hi = reaches[0][axis], reaches[1][axis]
        line = padded(now, tuple(reaches[0]), tuple(reaches[1]), mode, cval).select(*[F.col(f"v{k}") for k in range(image.ndim)], "value")
        at, size = F.col(f"v{axis}"), image.shape[axis]
        last = F.lit((size - 1) // _PIECE).cast("bigint")
        first = F.greatest(F.lit(0).cast("bigint"), F.floor((at - hi) / _PIECE))
        upto = F.least(last, F.floor((at + lo) / _PIECE))
        line = line.withColumn("piece", F.explode(F.sequence(first, upto)))
        others = [f"v{k}" for k in range(image.ndim) if k != axis]
        made = agg(F.col("value")).over(Window.partitionBy(*others, "piece").orderBy(at).rowsBetween(-low, high))
        own = (at >= 0) & (at < size) & (F.floor(at / _PIECE) == F.col("piece"))
        done = line.withColumn("made", made).filter(own).select(*[F.col(f"v{k}").alias(f"d{k}") for k in range(image.ndim)], F.col("made").alias("value"))
        now = now.with_df(done)
    return now.df


def tile_edge(ndim: int) -> int:
    return max(8, int(round(_TILE_PIXELS ** (1 / ndim))))


def _dealt(spread: DataFrame, shape: Sequence[int], low: Sequence[int], high: Sequence[int], edge: int) -> DataFrame:
    """Places v0, ... with the numbers t0, ... of each tile of ``edge`` pixels a side that needs them."""
    for k, size in enumerate(shape):
        last = (size - 1) // edge
        first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col(f"v{k}") - high[k]) / edge))
        upto = F.least(F.lit(last).cast("bigint"), F.floor((F.col(f"v{k}") + low[k]) / edge))
        spread = spread.filter(first <= upto).withColumn(f"t{k}", F.explode(F.sequence(first, upto)))
    return spread


def tiles(image: Image | Blocks, low: Sequence[int], high: Sequence[int], mode: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], cval: float = 0.0, edge: int | None = None) -> DataFrame | Blocks:
    """Coordinates and a double value of ``kernel`` over tiles of ``edge`` pixels a side; of a block table, blocks.

    The kernel gets a tile extended by ``low`` and ``high``, with the place of its first pixel,
    and returns the tile. A group is one tile, so its size is bounded.
    """
    if isinstance(image, Blocks):
        return image.with_halo(low, high, mode, kernel, cval)
    n, shape = image.ndim, image.shape
    if edge is None and halo_share(tile_edge(n), low, high) > HALO:
        return Blocks.from_image(image, edge_for(low, high)).with_halo(low, high, mode, kernel, cval, "float64").pixels()
    edge = edge or tile_edge(n)
    low, high = tuple(low), tuple(high)
    spread = _dealt(padded(image, low, high, mode, cval).select(*[f"v{k}" for k in range(n)], "value"), shape, low, high, edge)

    def run(key, table):
        at = [int(k.as_py()) * edge for k in key]
        size = [min(edge, s - a) for a, s in zip(at, shape)]
        block = np.zeros([s + lo + hi for s, lo, hi in zip(size, low, high)])
        places = tuple(table.column(f"v{k}").to_numpy() - at[k] + low[k] for k in range(n))
        inside = np.logical_and.reduce([p < b for p, b in zip(places, block.shape)])
        block[tuple(p[inside] for p in places)] = table.column("value").to_numpy()[inside]
        out = np.asarray(kernel(block, np.array(at)), float)
        columns = {f"d{k}": pa.array((c + a).ravel(), pa.int64()) for k, (c, a) in enumerate(zip(np.indices(out.shape), at))}
        return pa.table(columns | {"value": pa.array(out.ravel())})

    schema = ", ".join(f"d{k} bigint" for k in range(n)) + ", value double"
    return spread.groupBy(*[f"t{k}" for k in range(n)]).applyInArrow(run, schema)


def windows(block: np.ndarray, size: Sequence[int]) -> np.ndarray:
    """All neighbourhoods of ``size`` in a block: shape (places..., size...)."""
    return np.lib.stride_tricks.sliding_window_view(block, tuple(size))


def _along(block: np.ndarray, axis: int, start: int, size: int) -> np.ndarray:
    return block[(*[slice(None)] * axis, slice(start, start + size))]


def correlate_axis(block: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along one axis, where neighbourhoods fit; a pass over the block a weight, or running sums where all are alike."""
    weights = np.asarray(weights, float)
    left = block.shape[axis] - len(weights) + 1
    if len(weights) > 8 and (weights == weights[0]).all() and np.isfinite(block).all():
        return box_sums(block, len(weights), axis) * weights[0]
    out = np.zeros((*block.shape[:axis], left, *block.shape[axis + 1 :]))
    for k in np.flatnonzero(weights).tolist():
        out += weights[k] * _along(block, axis, k, left)
    return out


def box_sums(block: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums of ``size`` values along an axis by running sums, whatever the size."""
    upto = np.cumsum(block, axis=axis)
    out = _along(upto, axis, size - 1, block.shape[axis] - size + 1).copy()
    _along(out, axis, 1, out.shape[axis])[...] -= _along(upto, axis, 0, out.shape[axis] - 1)
    return out


def running_extreme(block: np.ndarray, size: int, axis: int, least: np.ufunc) -> np.ndarray:
    """``least`` (minimum or maximum) of ``size`` values along an axis: three comparisons a value, whatever the size.

    The axis is cut into runs of ``size``; a window is the end of one run and the beginning of the next.
    """
    if size == 1:
        return block
    n = block.shape[axis]
    moved = np.moveaxis(block, axis, -1)
    runs = -(-n // size)
    whole = np.concatenate([moved, np.repeat(moved[..., -1:], runs * size - n, axis=-1)], axis=-1).reshape(*moved.shape[:-1], runs, size)
    upto = least.accumulate(whole, axis=-1).reshape(*moved.shape[:-1], runs * size)
    onward = least.accumulate(whole[..., ::-1], axis=-1)[..., ::-1].reshape(*moved.shape[:-1], runs * size)
    return np.moveaxis(least(onward[..., : n - size + 1], upto[..., size - 1 : n]), -1, axis)


#: Counters that a sliding window holds at a time (32 MB).
_COUNTERS = 1 << 24


def _sliding_rows(rows: int, distinct: int) -> tuple[int, int]:
    """How many rows of windows slide together, and the bins of either level of their counters."""
    bins = max(2, int(np.ceil(np.sqrt(distinct))))
    return max(1, min(rows, _COUNTERS // bins**2)), bins


def slides(places: tuple[int, ...], mask: np.ndarray, distinct: int) -> bool:
    """Whether windows that slide cost less than windows looked through one by one: a step of all
    rows costs its entering and leaving cells and two levels of bins, with some fixed time."""
    rows, length = int(np.prod(places[:-1])), places[-1]
    together, bins = _sliding_rows(rows, distinct)
    borders = 2 * int(np.count_nonzero(np.diff(np.pad(mask.astype(np.int8), [(0, 0)] * (mask.ndim - 1) + [(1, 1)]), axis=-1)))
    steps = length * -(-rows // together)
    return steps * (60e-6 + together * (20e-9 * borders + 6e-9 * bins)) < rows * length * 14e-9 * int(mask.sum())


def sliding_rank(block: np.ndarray, mask: np.ndarray, rank: int) -> np.ndarray:
    """The value of ``rank`` under the mask's cells, wherever the mask fits in the block.

    Windows slide along the last axis, many rows at once. Each holds counts of the ranks of the
    block's distinct values, on two levels; a step counts the cells that enter and leave, so a
    window of any width costs its borders.
    """
    places = tuple(b - m + 1 for b, m in zip(block.shape, mask.shape))
    values, codes = np.unique(block, return_inverse=True)
    codes = codes.reshape(block.shape).astype(np.int64)
    rows, length, width = int(np.prod(places[:-1])), places[-1], mask.shape[-1]
    together, bins = _sliding_rows(rows, len(values))
    # Cells of the mask by row, where runs of cells begin and end along the last axis.
    edge = np.diff(np.pad(mask.astype(np.int8), [(0, 0)] * (mask.ndim - 1) + [(1, 1)]), axis=-1).reshape(-1, width + 1)
    flat_mask = mask.reshape(-1, width)
    strides = np.array([int(np.prod(block.shape[k + 1 : -1])) for k in range(block.ndim - 1)], np.int64)
    shift = np.indices(mask.shape[:-1]).reshape(block.ndim - 1, -1).T @ strides if block.ndim > 1 else np.zeros(1, np.int64)
    at = np.indices(places[:-1]).reshape(block.ndim - 1, -1).T @ strides if block.ndim > 1 else np.zeros(1, np.int64)
    lines = codes.reshape(-1, block.shape[-1])
    enter, leave = np.argwhere(edge == -1), np.argwhere(edge == 1)
    out = np.empty((rows, length))
    for first in range(0, rows, together):
        own = at[first : first + together]
        n = len(own)
        fine, coarse = np.zeros(n * bins * bins, np.int32), np.zeros(n * bins, np.int32)
        base = np.arange(n, dtype=np.int64)

        def count(cells: np.ndarray, x: int, by: int):
            """Adds ``by`` for the codes under ``cells`` (mask row, column) of every row's window at x."""
            seen = lines[own[:, None] + shift[cells[:, 0]], x + cells[:, 1]]
            np.add.at(fine, (seen + base[:, None] * (bins * bins)).ravel(), np.int32(by))
            np.add.at(coarse, (seen // bins + base[:, None] * bins).ravel(), np.int32(by))

        count(np.argwhere(flat_mask), 0, 1)
        for x in range(length):
            if x:
                count(leave, x - 1, -1)
                count(enter, x - 1, 1)
            upto = np.cumsum(coarse.reshape(n, bins), axis=1)
            bin_of = (upto > rank).argmax(axis=1)
            before = np.where(bin_of > 0, upto[base, bin_of - 1], 0)
            within = np.cumsum(fine.reshape(n, bins, bins)[base, bin_of], axis=1)
            out[first : first + n, x] = values[bin_of * bins + (within > (rank - before)[:, None]).argmax(axis=1)]
    return out.reshape(places)
