"""An image as a dense table of pixels: d0, ..., d{n-1} bigint, value.

Every coordinate in the box has exactly one row. Shape and dtype are known on the driver, so
arguments are checked before any job starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark type of each dtype; Spark has no unsigned types, so the next wider one holds them.
SPARK_TYPES = {
    "bool": "boolean",
    "int8": "smallint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "uint8": "smallint",
    "uint16": "int",
    "uint32": "bigint",
    "uint64": "decimal(20,0)",
    "float32": "float",
    "float64": "double",
    "complex64": "struct<re: double, im: double>",
    "complex128": "struct<re: double, im: double>",
}

#: Pixels that a task joins or gathers, about.
_TASK_PIXELS = 1 << 18
#: Pixels of the grid that a task makes at most; a shuffle to many tasks holds them until it spills.
_GRID_PIXELS = 1 << 20


def tasks_for(shape: Sequence[int]) -> int:
    """Tasks over the pixels of a box, so that what each holds doesn't grow with the box."""
    return max(1, -(-prod(int(s) for s in shape) // _TASK_PIXELS))


def coords(ndim: int) -> list[str]:
    return [f"d{k}" for k in range(ndim)]


@dataclass(frozen=True)
class Image:
    """A pixel table with its shape and logical dtype; further columns (labels, a mask) may follow.

    ``folders`` is the edge of the tiles whose numbers the columns t0, ... hold, where the table is
    partitioned by them; see ``folder_edge``.
    """

    df: DataFrame
    shape: tuple[int, ...]
    dtype: str = "float64"
    folders: int | None = None

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def coords(self) -> list[str]:
        return coords(self.ndim)

    @property
    def is_integral(self) -> bool:
        return self.dtype.startswith(("int", "uint"))

    @property
    def is_complex(self) -> bool:
        return self.dtype.startswith("complex")

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def folder_edge(self) -> int | None:
        """The edge of the tiles that the table is partitioned by, as long as it has their columns."""
        return self.folders if self.folders and all(f"t{k}" in self.df.columns for k in range(self.ndim)) else None

    def within(self, box: Sequence[tuple[int, int]]) -> Image:
        """The pixels of a half-open box, in their own coordinates; folders outside it aren't opened."""
        df, edge = self.df, self.folder_edge
        for k, (low, high) in enumerate(box):
            if low <= 0 and high >= self.shape[k]:
                continue
            if edge:
                df = df.filter((F.col(f"t{k}") >= low // edge) & (F.col(f"t{k}") <= (high - 1) // edge))
            df = df.filter((F.col(f"d{k}") >= low) & (F.col(f"d{k}") <= high - 1))
        return replace(self, df=df)

    def with_df(self, df: DataFrame, dtype: str | None = None) -> Image:
        return replace(self, df=df, dtype=dtype or self.dtype)

    def with_value(self, value: Column, dtype: str | None = None) -> Image:
        """The image of an expression over the pixel table's columns, kept row by row."""
        return self.with_df(self.df.withColumn("value", value), dtype)

    def linear(self) -> Column:
        """Position in C order."""
        out = F.lit(0).cast("bigint")
        for name, size in zip(self.coords, self.shape):
            out = out * F.lit(size).cast("bigint") + F.col(name)
        return out

    def to_dtype(self, value: Column, dtype: str | None = None) -> Column:
        """``value`` as the dtype stores it; an integral one truncates towards zero."""
        dtype = dtype or self.dtype
        if dtype.startswith(("int", "uint")):
            whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
            return whole.cast(SPARK_TYPES[dtype])
        return value.cast(SPARK_TYPES[dtype])

    def as_double(self) -> Column:
        value = F.col("value")
        return value.cast("int").cast("double") if self.dtype == "bool" else value.cast("double")

    @classmethod
    def from_sparse(cls, df: DataFrame, shape: Sequence[int], fill=0, dtype: str = "float64", columns: Sequence[str] = ("value",)) -> Image:
        """Fills the box: missing coordinates get ``fill``, rows outside it are left out.

        The grid is one range whose numbers are taken apart, so no cross join is needed. It is joined
        in as many tasks as its pixels need.
        """
        shape = tuple(int(s) for s in shape)
        names = coords(len(shape))
        return cls(grid(df.sparkSession, shape).repartition(tasks_for(shape), *names).join(df.select(*[F.col(c).cast("bigint").alias(c) for c in names], *columns), names, "left").fillna(fill, list(columns)), shape, dtype)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray) -> Image:
        array = np.asarray(array)
        columns = {f"d{k}": pa.array(c.ravel(), pa.int64()) for k, c in enumerate(np.indices(array.shape))}
        name = array.dtype.name
        if name not in SPARK_TYPES:
            raise TypeError(f"no pixel type for dtype {name}")
        flat = array.ravel()
        if name.startswith("complex"):
            columns["value"] = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], names=["re", "im"])
        elif name == "uint64":
            columns["value"] = pa.array([int(v) for v in flat], pa.decimal128(20, 0))
        else:
            columns["value"] = pa.array(flat.astype({"uint8": "int16", "int8": "int16", "uint16": "int32", "uint32": "int64"}.get(name, name)))
        return cls(spark.createDataFrame(pa.table(columns)), tuple(array.shape), name)

    def to_numpy(self, column: str = "value") -> np.ndarray:
        """The whole image on the driver; for small images and tests."""
        table = self.df.select(*self.coords, column).toArrow()
        at = tuple(table.column(c).to_numpy() for c in self.coords)
        values = table.column(column)
        if pa.types.is_struct(values.type):
            flat = values.combine_chunks()
            data = flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()
        else:
            data = np.array(values.to_pylist())
        out = np.zeros(self.shape, self.dtype if column == "value" else data.dtype)
        out[at] = data
        return out


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """Every coordinate of a box."""
    digits = [F.expr(f"(id div {prod(shape[k + 1 :])}) % {shape[k]}").alias(f"d{k}") for k in range(len(shape))]
    pixels = prod(shape)
    return spark.range(0, pixels, 1, max(spark.sparkContext.defaultParallelism, -(-pixels // _GRID_PIXELS))).select(*digits)
