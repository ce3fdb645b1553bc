"""Resampling with B-splines of order 0 to 5, and their prefilter.

An output point's coordinates are column expressions. Points are dealt, a row each, to the source
tiles they fall in, and NumPy samples a tile at the points that stream past it. The source is
filtered first to the box that the output can reach, and to the tiles that points touch; of an
image in folders of tiles (``read_tiles``) no other folder is opened.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..functions.kernels import prefilter_lines, prefilter_stretch, spline_depth, spline_start, spline_weights
from ..plans.blocks import Blocks, Tiling, edge_for
from ..plans.boundary import fold
from ..plans.image import Image, grid
from ..plans.scratch import materialize

MODES = ("constant", "nearest", "grid-constant")
#: Points of a tile's share, at least, and how many tiles at most can hold more than one share.
_SHARE, _MOST_HOT = 1 << 18, 10_000
#: Tiles or folders up to which they are named in a filter.
_FEW_TILES = 1000
#: Edge of the output tiles by which the points of a transform are shared out.
_OUTPUT_PIXELS = 1 << 18


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise NotImplementedError(f"Mode {mode} is not supported; it must be one of {', '.join(MODES)}.")


def _check_order(order: int) -> int:
    if not 0 <= order <= 5:
        raise RuntimeError("spline order not supported")
    return int(order)


def sample_block(block: np.ndarray, corner: Sequence[int], shape: Sequence[int], x: np.ndarray, order: int, mode: str, cval: float) -> np.ndarray:
    """The image's values at points ``x`` (a row each), from a block of it whose first pixel is ``corner``."""
    n, flat = block.ndim, block.ravel()
    places, weights, inside = [], [], []
    for k, size in enumerate(shape):
        first = np.floor(x[:, k] if order % 2 else x[:, k] + 0.5).astype(np.int64) - order // 2
        at = first[:, None] + np.arange(order + 1)
        weights.append(spline_weights(x[:, k, None] - at, order))
        inside.append((at >= 0) & (at < size))
        at = fold(at, size, "mirror" if mode == "constant" else "nearest") - corner[k]
        # A tap of a weight of zero may lie anywhere.
        places.append(np.clip(at, 0, block.shape[k] - 1))
    out = np.zeros(len(x))
    for taps in np.ndindex(*[order + 1] * n):
        w, at, within = np.ones(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for k, j in enumerate(taps):
            w, at, within = w * weights[k][:, j], at * block.shape[k] + places[k][:, j], within & inside[k][:, j]
        value = flat[at] if mode != "grid-constant" else np.where(within, flat[at], cval)
        out += np.where(w != 0, w * value, 0.0)
    return out


def _touched(image: Image, tiles: DataFrame, tiling: Tiling, halo: int) -> Image:
    """The image without the folders that no pixel of ``tiles`` lies in, where it has folders and the tiles are few."""
    edge = image.folder_edge
    if edge is None:
        return image
    numbers = [r[0] for r in tiles.select("tile").distinct().limit(_FEW_TILES + 1).collect()]
    if len(numbers) > _FEW_TILES:
        return image
    opened: set[tuple[int, ...]] = set()
    for number in numbers:
        spans = [range(max(0, a * tiling.edge - halo) // edge, min(s - 1, (a + 1) * tiling.edge - 1 + halo) // edge + 1) for a, s in zip(tiling.at(number), image.shape)]
        opened.update(product(*spans))
        if len(opened) > _FEW_TILES:
            return image
    chosen = F.lit(False)
    for folder in sorted(opened):
        here = F.lit(True)
        for k, t in enumerate(folder):
            here = here & (F.col(f"t{k}") == t)
        chosen = chosen | here
    return replace(image, df=image.df.filter(chosen))


def _tile_rows(image: Image, tiles: DataFrame, tiling: Tiling, halo: int) -> DataFrame:
    """(tile, pixels binary) of the tiles asked for, each with the image's pixels up to ``halo`` around it."""
    n, shape, edge = image.ndim, image.shape, tiling.edge
    rows = image.df.select(*image.coords, image.as_double().alias("value"))
    number = F.lit(0).cast("bigint")
    for k, count in enumerate(tiling.counts):
        first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col(f"d{k}") - halo) / edge))
        upto = F.least(F.lit(count - 1).cast("bigint"), F.floor((F.col(f"d{k}") + halo) / edge))
        rows = rows.withColumn(f"a{k}", F.explode(F.sequence(first, upto)))
        number = number * count + F.col(f"a{k}")
    asked = tiles.select("tile").distinct()
    rows = rows.select(number.alias("tile"), *image.coords, "value").join(asked, "tile", "left_semi")

    def run(key, table):
        at = tiling.at(key[0].as_py())
        corner = [max(0, a * edge - halo) for a in at]
        block = np.zeros([min(s, (a + 1) * edge + halo) - c for a, s, c in zip(at, shape, corner)])
        block[tuple(table.column(f"d{k}").to_numpy() - corner[k] for k in range(n))] = table.column("value").to_numpy()
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "pixels": pa.array([block.tobytes()], pa.binary())})

    return rows.groupBy("tile").applyInArrow(run, "tile bigint, pixels binary")


def _sample(image: Image, points: DataFrame, keys: Sequence[str], at: Sequence[Column], order: int, mode: str, cval: float, share: Column | None = None) -> DataFrame:
    """``points``'s keys and the image's value at coordinates ``at``, a double.

    constant: cval where any coordinate is outside [0, n - 1]; inside, samples past an edge
    mirror. nearest: coordinates and samples are clamped. grid-constant: a sample outside is
    cval.

    A point is one row, dealt to the source tile that its first sample lies in; a tile, with a
    small halo, is one row before its points, which stream past it. ``share`` tells into which of
    a tile's shares a point goes, each with a copy of the tile; without it, the points are counted
    and tiles of many are cut into shares.
    """
    n, shape, halo = image.ndim, image.shape, order + 1
    tiling = Tiling(image.shape, edge_for([halo] * n, [halo] * n))
    rows = points.select(*keys, *[a.cast("double").alias(f"x{k}") for k, a in enumerate(at)], *([share.cast("bigint").alias("share")] if share is not None else []))
    if mode == "nearest":
        rows = rows.withColumns({f"x{k}": F.greatest(F.lit(0.0), F.least(F.col(f"x{k}"), F.lit(float(size - 1)))) for k, size in enumerate(shape)})
    # Spark takes NaN for the largest number, so it is outside too.
    room, outside, tile = 0 if mode == "constant" else halo + 1, F.lit(False), F.lit(0).cast("bigint")
    for k, size in enumerate(shape):
        x = F.col(f"x{k}")
        outside = outside | (x < -room) | (x > size - 1 + room)
        first = F.greatest(F.lit(0).cast("bigint"), F.least(spline_start(x, order), F.lit(size - 1).cast("bigint")))
        tile = tile * tiling.counts[k] + F.floor(first / tiling.edge)
    away = rows.filter(outside).select(*keys, F.lit(float(cval)).alias("value"))
    inner = rows.filter(~outside).withColumn("tile", tile)
    if share is not None:
        shares = materialize(inner.select("tile", "share").distinct())
    else:
        held = materialize(inner.groupBy("tile").agg(F.count("*").alias("n")))
        total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
        most = max(_SHARE, total // _MOST_HOT)
        # At most _MOST_HOT tiles hold more than a share, by their sum.
        hot = held.filter(F.col("n") > most).select("tile", F.ceil(F.col("n") / most).alias("shares"))
        cut = F.pmod(F.xxhash64(*keys, *[f"x{k}" for k in range(n)], F.monotonically_increasing_id()), F.coalesce("shares", F.lit(1)))
        inner = inner.join(F.broadcast(hot), "tile", "left").withColumn("share", cut).drop("shares")
        shares = held.select("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / most) - 1)).alias("share"))
    source = _tile_rows(_touched(image, shares, tiling, halo), shares, tiling, halo)
    blocks = shares.join(source, "tile").select("tile", "share", "pixels")
    both = inner.withColumn("rank", F.lit(1)).unionByName(blocks.withColumn("rank", F.lit(0)), allowMissingColumns=True)
    names = [*keys, "value"]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keys), T.StructField("value", T.DoubleType())])

    def run(batches):
        known, block, corner = None, None, None
        for batch in batches:
            tile, share, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "share", "rank"))
            starts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (share[1:] != share[:-1]) | (rank[1:] != rank[:-1])]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)] if len(tile) else []):
                if rank[a] == 0:
                    known, place = (tile[a], share[a]), tiling.at(int(tile[a]))
                    corner = [max(0, c * tiling.edge - halo) for c in place]
                    block = np.frombuffer(batch.column("pixels")[a].as_buffer()).reshape([min(s, (c + 1) * tiling.edge + halo) - f for c, s, f in zip(place, shape, corner)])
                    continue
                if known != (tile[a], share[a]):
                    raise RuntimeError("A tile is missing that points lie in.")
                part = batch.slice(a, b - a)
                x = np.stack([part.column(f"x{k}").to_numpy() for k in range(n)], axis=1)
                value = sample_block(block, corner, shape, x, order, mode, cval)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(value)], names=names)

    dealt = both.repartition("tile", "share").sortWithinPartitions("tile", "share", "rank")
    return dealt.mapInArrow(run, schema).unionByName(away)


def _within(image: Image, low: np.ndarray, high: np.ndarray, order: int) -> Image:
    """The image's pixels that samples around coordinates in [low, high] can touch, mirrored ones included."""
    box = []
    for size, lo, hi in zip(image.shape, low, high):
        a, b = int(np.floor(lo)) - order - 1, int(np.ceil(hi)) + order + 1
        a, b = min(max(a, 0), size - 1), min(max(b, 0), size - 1)
        if b >= size - 1:
            a = min(a, max(0, size - 2 - order))
        if a <= 0:
            b = max(b, min(size - 1, order + 1))
        box.append((a, b + 1))
    return image.within(box)


def _coefficients(image: Image, low: np.ndarray, high: np.ndarray, order: int, mode: str | None) -> Image:
    """What samples around coordinates in [low, high] need of the image or, with ``mode``, of its spline
    coefficients, which need the image as far around as the filter remembers."""
    if mode is not None and order > 1:
        image = spline_filter(_within(image, low, high, order + spline_depth(order)), order, mode=mode)
    return _within(image, low, high, order)


def affine_transform(image: Image, matrix, offset=0.0, output_shape=None, order: int = 1, output_chunks=None, mode: str = "constant", cval: float = 0.0, prefilter: bool = False) -> Image:
    """out[o] = image at matrix @ o + offset.

    The matrix may be a scale for each axis, (n, n), or homogeneous: (n, n + 1) or (n + 1, n + 1),
    which brings its own offset. ``output_chunks`` only names a physical layout and is ignored.
    """
    n, order = image.ndim, _check_order(order)
    matrix, offset = np.asarray(matrix, float), np.asarray(offset, float).squeeze()
    if matrix.ndim not in (1, 2):
        raise RuntimeError("The matrix must have one or two dimensions.")
    if matrix.ndim == 2 and matrix.shape[1] == n + 1 and matrix.shape[0] in (n, n + 1):
        if matrix.shape[0] == n + 1 and not np.array_equal(matrix[n], [0] * n + [1]):
            raise ValueError("The last row of a homogeneous matrix must be zeros and a one.")
        matrix, offset = matrix[:n, :n], matrix[:n, n]
    elif matrix.shape[0] != n or matrix.ndim == 2 and matrix.shape[1] != n:
        raise RuntimeError("The matrix has the wrong shape.")
    offset = np.full(n, float(offset)) if offset.ndim == 0 else offset
    if offset.shape != (n,):
        raise RuntimeError("The offset must have one value for each dimension.")
    _check_mode(mode)
    if prefilter and order > 1:
        if mode != "constant":
            raise NotImplementedError(f"A prefilter is not supported with mode {mode}.")
    full = np.diag(matrix) if matrix.ndim == 1 else matrix
    shape = tuple(int(s) for s in (output_shape if output_shape is not None else image.shape))
    corners = np.array(np.meshgrid(*[[0, max(s - 1, 0)] for s in shape], indexing="ij")).reshape(len(shape), -1)
    reached = full @ corners + offset[:, None]
    source = _coefficients(image, reached.min(axis=1), reached.max(axis=1), order, mode if prefilter else None)
    points = grid(image.spark, shape)
    at = []
    for row, shift in zip(full, offset):
        x = F.lit(float(shift))
        for k, m in enumerate(row):
            if m:
                x = x + F.lit(float(m)) * F.col(f"d{k}")
        at.append(x)
    keys = [f"d{k}" for k in range(len(shape))]
    renamed = points.select(*[F.col(c).alias(f"p{k}") for k, c in enumerate(keys)], *[a.alias(f"a{k}") for k, a in enumerate(at)])
    edge, share = max(8, round(_OUTPUT_PIXELS ** (1 / n))), F.lit(0).cast("bigint")
    for k, s in enumerate(shape):
        share = share * -(-s // edge) + F.floor(F.col(f"p{k}") / edge)
    made = _sample(source, renamed, [f"p{k}" for k in range(len(shape))], [F.col(f"a{k}") for k in range(n)], order, mode, cval, share)
    out = made.select(*[F.col(f"p{k}").alias(c) for k, c in enumerate(keys)], _store(image, F.col("value")))
    return Image(out, shape, image.dtype)


def _store(image: Image, value: Column) -> Column:
    """Integral images round half away from zero when resampled."""
    if image.is_integral:
        return image.to_dtype(F.round(value)).alias("value")
    return value.cast("boolean" if image.dtype == "bool" else "float" if image.dtype == "float32" else "double").alias("value")


def rotate(image: Image, angle: float, axes: Sequence[int] = (1, 0), reshape: bool = True, output_chunks=None, **kwargs) -> Image:
    """Rotates by ``angle`` degrees in the plane of two axes, about its centre; the shape grows to fit if ``reshape``."""
    axes = checks.plane(image.ndim, axes)
    quarter, rest = divmod(angle, 90)
    unit = np.exp(1j * np.radians(rest)) if rest else 1 + 0j
    unit *= (1, 1j, -1, -1j)[int(quarter) % 4]  # whole quarter turns are exact
    turn, size = np.eye(image.ndim), np.array(image.shape)
    turn[np.ix_(axes, axes)] = [[unit.real, unit.imag], [-unit.imag, unit.real]]
    turn += 0.0  # no negative zeros
    # A turned box reaches as far as the sides' projections together.
    grown = np.floor(np.abs(turn) @ size + 0.5).astype(int) if reshape else size
    offset = (size - 1) / 2 - turn @ ((grown - 1) / 2)
    if image.is_complex:
        turned = _parts(image, lambda part: rotate(part, angle, axes, reshape, **kwargs))
        return replace(turned, shape=tuple(grown.tolist()), dtype=image.dtype)
    return affine_transform(image, turn, offset, tuple(grown.tolist()), **kwargs)


def map_coordinates(image: Image, coordinates, order: int = 3, mode: str = "constant", cval: float = 0.0, prefilter: bool = False) -> DataFrame:
    """(point_id, value) at arbitrary points.

    ``coordinates`` is a DataFrame (point_id, c0, ...) or an array (ndim, points), of which the
    image is filtered to the box it reaches.
    """
    order = _check_order(order)
    _check_mode(mode)
    n, box = image.ndim, None
    if not isinstance(coordinates, DataFrame):
        array = np.asarray(coordinates, float)
        if array.ndim != 2 or array.shape[0] != n:
            raise RuntimeError("The coordinates must have a row for each dimension.")
        if array.size and np.isfinite(array).all():
            box = array.min(axis=1), array.max(axis=1)
        coordinates = image.spark.createDataFrame(pa.table({"point_id": pa.array(np.arange(array.shape[1]))} | {f"c{k}": pa.array(a) for k, a in enumerate(array)}))
    if box is not None:
        image = _coefficients(image, *box, order, mode if prefilter else None)
    elif prefilter and order > 1:
        image = spline_filter(image, order, mode=mode)
    made = _sample(image, coordinates, ["point_id"], [F.col(f"c{k}") for k in range(n)], order, mode, cval)
    return made.select("point_id", _store(image, F.col("value")))


_BOUNDARY = {"mirror": "mirror", "constant": "mirror", "grid-constant": "mirror", "reflect": "reflect", "nearest": "reflect", "grid-mirror": "reflect", "grid-wrap": "wrap"}


def _check_filter(order, output, mode: str) -> int:
    if mode == "wrap":
        raise NotImplementedError("Mode wrap is not supported; use grid-wrap.")
    if mode not in _BOUNDARY:
        raise RuntimeError(f"boundary mode not supported: {mode}")
    try:
        if np.dtype(output).kind not in "fciu":
            raise TypeError("The output must be a numeric dtype.")
    except TypeError as e:
        raise TypeError("The output must be a dtype.") from e
    return _check_order(order)


def _parts(image: Image, run) -> Image:
    """A real operation on both parts of a complex image."""
    both = [run(Image(image.df.select(*image.coords, F.col(f"value.{p}").alias("value")), image.shape)).df.withColumnRenamed("value", p) for p in ("re", "im")]
    joined = both[0].join(both[1], image.coords)
    return image.with_df(joined.select(*image.coords, F.struct("re", "im").alias("value")), "complex128")


def _depths(depth, ndim: int, order: int) -> list[int]:
    """How far each axis's recursion looks: as far as doubles tell, or what ``depth`` says."""
    out = [depth] * ndim if depth is None or np.isscalar(depth) else list(depth)
    if len(out) != ndim or any(d is not None and (d != int(d) or d < 0) for d in out):
        raise ValueError("A depth is a whole number, zero or more, one for all axes or one for each.")
    return [spline_depth(order) if d is None else int(d) for d in out]


def _filtered(blocks: Blocks, order: int, axis: int, boundary: str, depth: int) -> Blocks:
    """Coefficients along one axis. A line within one block is filtered whole; one over several blocks
    goes on into its neighbours by ``depth``, and at an end by the samples that stand beyond it."""
    alone = blocks.tiling.counts[axis] == 1
    low = [0 if alone or k != axis else depth for k in range(blocks.ndim)]

    def kernel(block, at):
        lines = np.moveaxis(block, axis, -1)
        if alone:
            return np.moveaxis(prefilter_lines(lines, order, boundary), -1, axis)
        out = np.moveaxis(prefilter_stretch(lines, order), -1, axis)
        return out[tuple(slice(lo, n - lo) for lo, n in zip(low, out.shape))]

    return blocks.with_halo(low, low, boundary, kernel, dtype="float64")


def spline_filter1d(image: Image | Blocks, order: int = 3, axis: int = -1, output="float64", mode: str = "mirror", output_chunks=None, *, depth=None) -> Image | Blocks:
    """Spline coefficients along one axis.

    The filter is a recursion whose memory is a power of a pole, so a block needs ``depth`` samples
    on either side: by default as many as doubles can tell, which equals the filter of whole lines;
    fewer move less and are less exact. A line of any length runs in as many tasks as it has blocks.
    ``output_chunks`` names a physical layout and is ignored.
    """
    order = _check_filter(order, output, mode)
    if depth is not None and not np.isscalar(depth):
        raise ValueError("The depth must be a scalar.")
    return _spline(image, order, [checks.axis(image.ndim, axis)], output, mode, _depths(depth, image.ndim, order))


def spline_filter(image: Image | Blocks, order: int = 3, output="float64", mode: str = "mirror", output_chunks=None, *, depth=None) -> Image | Blocks:
    """Spline coefficients along all axes, one after the other; ``depth`` may be one for each. Between axes only borders move."""
    order = _check_filter(order, output, mode)
    return _spline(image, order, list(range(image.ndim)), output, mode, _depths(depth, image.ndim, order))


def _spline(image: Image | Blocks, order: int, axes: list[int], output, mode: str, depths: list[int]) -> Image | Blocks:
    dtype = np.dtype(output).name
    if isinstance(image, Image) and image.is_complex:
        return _parts(image, lambda part: _spline(part, order, axes, "float64", mode, depths)) if order > 1 else image
    if order < 2:
        if isinstance(image, Blocks):
            return image.with_dtype(dtype)
        return image.with_value(image.as_double() if dtype == "float64" else image.to_dtype(image.as_double(), dtype), dtype)
    blocks = image
    if isinstance(image, Image):
        blocks = Blocks.from_image(image, max(edge_for(*[[d if k == axis else 0 for k, d in enumerate(depths)]] * 2) for axis in axes))
    for axis in axes:
        blocks = _filtered(blocks, order, axis, _BOUNDARY[mode], depths[axis])
    if isinstance(image, Blocks):
        return blocks.with_dtype(dtype)
    out = blocks.to_image()
    return out if dtype == "float64" else out.with_value(out.to_dtype(F.col("value"), dtype), dtype)
