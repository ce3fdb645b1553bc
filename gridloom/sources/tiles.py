"""Images as Parquet, partitioned by tile, so that a box reads its tiles only."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.image import Image
from ..plans.stencil import tile_edge


def write_tiles(image: Image, path: str, edge: int | None = None) -> None:
    """Writes pixels in folders t0=.../t1=..., with shape, dtype and edge beside them."""
    edge = edge or tile_edge(image.ndim)
    names = [f"t{k}" for k in range(image.ndim)]
    placed = image.df.withColumns({t: F.floor(F.col(f"d{k}") / edge) for k, t in enumerate(names)})
    placed.repartition(*names).sortWithinPartitions(*names, *image.coords).write.partitionBy(*names).parquet(f"{path}/pixels")
    meta = json.dumps({"shape": image.shape, "dtype": image.dtype, "edge": edge})
    image.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")


def read_tiles(spark: SparkSession, path: str, box: Sequence[tuple[int, int]] | None = None) -> Image:
    """The image, or its pixels in a half-open box; its coordinates and shape stay the image's own.

    The table keeps its folders' columns, so that what needs a part of the image opens only that.
    """
    meta = json.loads(spark.read.text(f"{path}/meta").head()[0])
    shape, edge = tuple(meta["shape"]), meta["edge"]
    image = Image(spark.read.parquet(f"{path}/pixels"), shape, meta["dtype"], edge)
    return image.within(box) if box else image
