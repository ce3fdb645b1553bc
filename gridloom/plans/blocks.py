"""Block tables: an image as one row a block, kept between operations that exchange borders only.

Pixels are dealt to blocks once. A neighbourhood operation then sends each block's border strips to
the blocks that need them and leaves the blocks where they are: a block table is written bucketed by
block, so a later operation joins strips to it without moving it. What moves is the halo, some
``2 * reach / edge`` of the image an axis, and not a row for each pixel.

``edge_for`` picks the blocks' edge from the reach, so that the halo stays small beside the block
and a block fits a task. Boundary modes hold for the whole image: a strip may come from the other
end (wrap) or be a block's own pixels turned round (reflect, mirror).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boundary import fold
from .image import SPARK_TYPES, Image
from .scratch import scratch_dir

#: Pixels of a block: at least, where the reach is small, and at most (32 MB of doubles).
LEAST_PIXELS, MOST_PIXELS = 1 << 16, 1 << 22
#: The halo's share of a block up to which blocks needn't grow.
HALO = 0.5

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def halo_share(edge: int, low: Sequence[int], high: Sequence[int]) -> float:
    """Pixels that a block gets from others, beside its own."""
    return prod(1 + (lo + hi) / edge for lo, hi in zip(low, high)) - 1


def edge_for(low: Sequence[int], high: Sequence[int]) -> int:
    """The edge of blocks for a reach: the least one whose halo is a small share, within the bounds."""
    n = len(low)
    edge = max(8, round(LEAST_PIXELS ** (1 / n)))
    most = int(MOST_PIXELS ** (1 / n))
    while edge < most and halo_share(edge, low, high) > HALO:
        edge = min(most, edge + edge // 4)
    return edge


def _stored_as(dtype: str) -> Callable[[np.ndarray], np.ndarray]:
    """What a dtype keeps of doubles: an integral one truncates towards zero."""
    if dtype == "bool":
        return lambda x: np.asarray(x) != 0
    return np.trunc if dtype.startswith(("int", "uint")) else lambda x: x


@lru_cache(4096)
def sources(target: int, size: int, edge: int, low: int, high: int, mode: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Along one axis, what block ``target`` with its halo takes from each block: places in the
    extended block, and the places in the source block that stand there. Constant takes nothing
    from beyond the image."""
    first, upto = target * edge, min((target + 1) * edge, size)
    at = np.arange(first - low, upto + high)
    place = np.arange(len(at))
    if mode == "constant":
        inside = (at >= 0) & (at < size)
        at, place = at[inside], place[inside]
    at = fold(at, size, mode)
    return {int(b): (place[at // edge == b], at[at // edge == b] % edge) for b in np.unique(at // edge)}


def receivers(source: int, size: int, edge: int, low: int, high: int, mode: str) -> list[int]:
    """Along one axis, the blocks that take something from block ``source``, itself included."""
    last, near = (size - 1) // edge, max(low, high) // edge + 2
    around = {*range(source - near, source + near + 1), *range(near + 1), *range(last - near, last + 1)}
    return [t for t in sorted(around) if 0 <= t <= last and source in sources(t, size, edge, low, high, mode)]


@dataclass(frozen=True)
class Tiling:
    """How a box is cut into blocks of ``edge`` pixels a side, which are numbered in C order."""

    shape: tuple[int, ...]
    edge: int

    @property
    def counts(self) -> tuple[int, ...]:
        """Blocks along each axis."""
        return tuple(-(-s // self.edge) for s in self.shape)

    def at(self, number: int) -> list[int]:
        """A block's place among the blocks."""
        return [int(a) for a in np.unravel_index(number, self.counts)]

    def number(self, at: Sequence[int]) -> int:
        return int(np.ravel_multi_index(tuple(at), self.counts))

    def extent(self, at: Sequence[int]) -> list[int]:
        """The shape of the block at a place; the last ones of an axis may be shorter."""
        return [min(self.edge, s - a * self.edge) for a, s in zip(at, self.shape)]


@dataclass(frozen=True)
class Blocks:
    """A table (block bigint, pixels binary): doubles in C order, a row for each block.

    ``stored`` tells that ``df`` is a bucketed table, not a plan to be run.
    """

    df: DataFrame
    tiling: Tiling
    dtype: str
    stored: bool = False

    @property
    def shape(self) -> tuple[int, ...]:
        return self.tiling.shape

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def is_integral(self) -> bool:
        return self.dtype.startswith(("int", "uint"))

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @classmethod
    def from_image(cls, image: Image, edge: int | None = None, reach: int | Sequence[int] = 0) -> Blocks:
        """Deals an image's pixels to blocks, a row each; ``reach`` is how far later operations look."""
        if image.is_complex:
            raise TypeError("A block table holds real values.")
        n = image.ndim
        reach = [reach] * n if isinstance(reach, int) else list(reach)
        edge = edge or edge_for(reach, reach)
        tiling = Tiling(image.shape, edge)
        block, cell = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for k in range(n):
            d = F.col(f"d{k}")
            block = block * tiling.counts[k] + F.floor(d / edge)
            cell = cell * F.least(F.lit(edge).cast("bigint"), image.shape[k] - F.floor(d / edge) * edge) + d % edge
        rows = image.df.select(block.alias("block"), cell.cast("int").alias("cell"), image.as_double().alias("value"))

        def run(key, table):
            number = key[0].as_py()
            out = np.zeros(prod(tiling.extent(tiling.at(number))))
            out[table.column("cell").to_numpy()] = table.column("value").to_numpy()
            return pa.table({"block": pa.array([number], pa.int64()), "pixels": pa.array([out.tobytes()], pa.binary())})

        return cls(rows.groupBy("block").applyInArrow(run, "block bigint, pixels binary"), tiling, image.dtype)

    def kept(self) -> Blocks:
        """The table written to the shared folder in buckets by block, so that joins by block don't move it."""
        if self.stored:
            return self
        spark = self.spark
        buckets = max(1, min(prod(self.tiling.counts), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        name, path = f"gridloom_blocks_{uuid.uuid4().hex}", scratch_dir(spark)
        self.df.write.option("path", path).bucketBy(buckets, "block").saveAsTable(name)
        return replace(self, df=spark.table(name), stored=True)

    def strips(self, low: Sequence[int], high: Sequence[int], mode: str) -> DataFrame:
        """(block, source, strip): what every block must be sent by others."""
        tiling, low, high = self.tiling, tuple(low), tuple(high)
        shape, edge = tiling.shape, tiling.edge

        def run(batches):
            for batch in batches:
                for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = tiling.at(number)
                    pixels = np.frombuffer(raw).reshape(tiling.extent(at))
                    sent: list[tuple] = []
                    for target in product(*(receivers(a, s, edge, lo, hi, mode) for a, s, lo, hi in zip(at, shape, low, high))):
                        if list(target) != at:
                            places = [sources(t, s, edge, lo, hi, mode)[a][1] for t, a, s, lo, hi in zip(target, at, shape, low, high)]
                            sent.append((tiling.number(target), number, pixels[np.ix_(*places)].tobytes()))
                    columns = list(zip(*sent)) or [()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["block", "source", "strip"])

        return self.df.select("block", "pixels").mapInArrow(run, "block bigint, source bigint, strip binary")

    def with_halo(self, low: Sequence[int], high: Sequence[int], mode: str, kernel: Kernel, cval: float = 0.0, dtype: str | None = None) -> Blocks:
        """The blocks that ``kernel`` makes of every block extended by ``low`` and ``high``.

        The kernel gets the extended block and the place of the block's first pixel, and returns
        the block. Only strips move: the table is written first, if it isn't yet, as it is read for
        its strips and for its blocks.
        """
        own = self.kept()
        tiling, low, high, made = self.tiling, tuple(low), tuple(high), dtype or self.dtype
        shape, edge = tiling.shape, tiling.edge
        stored = _stored_as(made)

        def run(key, blocks, strips):
            number = key[0].as_py()
            if not blocks.num_rows:  # strips of a part of an image, to a block that isn't in it
                return pa.table({"block": pa.array([], pa.int64()), "pixels": pa.array([], pa.binary())})
            at = tiling.at(number)
            size = tiling.extent(at)
            block = np.full([s + lo + hi for s, lo, hi in zip(size, low, high)], float(cval))
            taken = [sources(a, s, edge, lo, hi, mode) for a, s, lo, hi in zip(at, shape, low, high)]
            parts = [(number, blocks.column("pixels")[0].as_buffer()), *zip(strips.column("source").to_pylist(), (s.as_buffer() for s in strips.column("strip")))]
            for source, raw in parts:
                where = [t[a] for t, a in zip(taken, tiling.at(source))]
                if source == number:
                    block[np.ix_(*(w[0] for w in where))] = np.frombuffer(raw).reshape(size)[np.ix_(*(w[1] for w in where))]
                else:
                    block[np.ix_(*(w[0] for w in where))] = np.frombuffer(raw).reshape([len(w[0]) for w in where])
            out = np.ascontiguousarray(stored(kernel(block, np.array(at) * edge)), float)
            return pa.table({"block": pa.array([number], pa.int64()), "pixels": pa.array([out.tobytes()], pa.binary())})

        if any(low) or any(high):
            made_df = own.df.groupBy("block").cogroup(own.strips(low, high, mode).groupBy("block")).applyInArrow(run, "block bigint, pixels binary")
        else:
            made_df = own._each(lambda pixels, at: stored(kernel(pixels, at)))
        return Blocks(made_df, tiling, made)

    def _each(self, kernel: Kernel) -> DataFrame:
        tiling = self.tiling

        def run(batches):
            for batch in batches:
                for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = tiling.at(number)
                    out = np.ascontiguousarray(kernel(np.frombuffer(raw).reshape(tiling.extent(at)), np.array(at) * tiling.edge), float)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "pixels": pa.array([out.tobytes()], pa.binary())})

        return self.df.mapInArrow(run, "block bigint, pixels binary")

    def map(self, kernel: Callable[[np.ndarray], np.ndarray], dtype: str | None = None) -> Blocks:
        """Blocks made of each block by itself; nothing moves."""
        stored = _stored_as(dtype or self.dtype)
        return replace(self, df=self._each(lambda pixels, at: stored(kernel(pixels))), dtype=dtype or self.dtype, stored=False)

    def with_dtype(self, dtype: str) -> Blocks:
        """The same values under another dtype, cut to it."""
        return replace(self, dtype=dtype) if dtype == "float64" else self.map(lambda x: x, dtype)

    def pixels(self) -> DataFrame:
        """(d0, ..., value double), a row for each pixel."""
        tiling, n = self.tiling, self.ndim

        def run(batches):
            for batch in batches:
                for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = tiling.at(number)
                    values = np.frombuffer(raw)
                    for k in range(0, len(values), LEAST_PIXELS):
                        places = np.unravel_index(np.arange(k, min(k + LEAST_PIXELS, len(values))), tiling.extent(at))
                        columns = [pa.array(p + a * tiling.edge, pa.int64()) for p, a in zip(places, at)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(values[k : k + LEAST_PIXELS])], names=[*(f"d{j}" for j in range(n)), "value"])

        return self.df.select("block", "pixels").mapInArrow(run, ", ".join(f"d{k} bigint" for k in range(n)) + ", value double")

    def to_image(self) -> Image:
        image = Image(self.pixels(), self.shape, self.dtype)
        if self.dtype == "bool":
            return image.with_value(F.col("value") != 0)
        return image if self.dtype == "float64" else image.with_value(F.col("value").cast(SPARK_TYPES[self.dtype]))
