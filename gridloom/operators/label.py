"""Connected components of the non-zero pixels.

Pixels are dealt to tiles, and each tile joins its own with vectorised union by minimum. Only
pixels at tile borders, and at wrapped ends of the image, then look for neighbours in other
tiles; those links form a small graph that is contracted round by round. Labels are 1..n in the
order of each component's first pixel, so they don't depend on tiles or partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..plans.image import Image
from ..plans.scratch import materialize
from ..plans.spread import spread_lookup
from ..plans.stencil import tile_edge


def _forward(structure: np.ndarray) -> list[tuple[int, ...]]:
    """Half of a symmetric structure's offsets: each pair of neighbours is met once."""
    offsets = (np.argwhere(structure) - np.array(structure.shape) // 2).tolist()
    return [tuple(o) for o in offsets if tuple(o) > (0,) * structure.ndim]


def union_by_minimum(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n items' components under links a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every end of links (a, b): the least node of its component.

    A round moves every node to the neighbour, or itself, of the least hash, drawn anew, and
    contracts the links, of which about half a chain's nodes and all a star's leaves are gone. A
    node may gather many links, and a root many nodes, so lookups are salted.
    """
    rounds: list[DataFrame] = []
    edges = materialize(_ordered(links))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, other = (F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("up")) for c in ("a", "b"))
        up = materialize(both.groupBy("a").agg(F.min(other).alias("m")).select("a", F.least(own, F.col("m"))["up"].alias("up")))
        rounds.append(up)
        left = spread_lookup(edges, "a", up).select(F.col("up").alias("a"), "b")
        edges = materialize(_ordered(spread_lookup(left, "b", up.withColumnRenamed("a", "b")).select("a", F.col("up").alias("b"))))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    found = rounds[0].select(F.col("a").alias("node"), F.col("up").alias("root"))
    for up in rounds[1:]:
        step = spread_lookup(found, "root", up.withColumnRenamed("a", "root"), how="left").select("node", F.coalesce("up", "root").alias("root"))
        found = materialize(step)  # read twice, by the next round or below
    least = found.groupBy("root").agg(F.least(F.col("root"), F.min("node")).alias("least"))
    return spread_lookup(found, "root", least).select("node", F.col("least").alias("root"))


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def dense_index(values: DataFrame, column: str) -> DataFrame:
    """(column, number): distinct values numbered from 1 in ascending order.

    Values are dealt by ranges, so each range is numbered by itself; the window over ranges has
    as many rows as there are partitions.
    """
    dealt = materialize(values.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return dealt.withColumn("rank", rank).join(F.broadcast(before), "part").select(column, (F.col("before") + F.col("rank")).alias("number"))


def label(image: Image, structure=None, wrap_axes: Sequence[int] | None = None, edge: int | None = None) -> tuple[Image, DataFrame]:
    """The label image, and a one-row DataFrame (n) with the number of components.

    ``structure`` is symmetric, with three cells along each axis. Axes in ``wrap_axes`` are
    periodic.
    """
    n, shape = image.ndim, image.shape
    mask = checks.structure(n, structure)
    if any(s != 3 for s in mask.shape):
        raise RuntimeError("The structure must have three cells along each axis.")
    offsets = _forward(mask)
    wrapped = {checks.axis(n, a) for a in (wrap_axes or ())}
    edge = edge or tile_edge(n)
    on = image.df.filter(image.as_double() != 0).select(*image.coords, image.linear().alias("at"))
    tiles = [F.floor(F.col(c) / edge).alias(f"t{k}") for k, c in enumerate(image.coords)]

    def run(key, table):
        places = [table.column(c).to_numpy() - int(t.as_py()) * edge for c, t in zip(image_coords, key)]
        at = table.column("at").to_numpy()
        order = np.argsort(at)
        places, at = [p[order] for p in places], at[order]
        block = np.full([edge] * n, -1, np.int64)
        block[tuple(places)] = np.arange(len(at))
        a, b = [], []
        for o in offsets:
            here = block[tuple(slice(max(0, -s), edge - max(0, s)) for s in o)]
            there = block[tuple(slice(max(0, s), edge + min(0, s)) for s in o)]
            both = (here >= 0) & (there >= 0)
            a.append(here[both])
            b.append(there[both])
        root = union_by_minimum(len(at), np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int))
        columns = {c: pa.array(p + int(t.as_py()) * edge) for c, p, t in zip(image_coords, places, key)}
        return pa.table(columns | {"root": pa.array(at[root])})

    image_coords = image.coords
    local = materialize(on.select("*", *tiles).groupBy(*[f"t{k}" for k in range(n)]).applyInArrow(run, ", ".join(f"{c} bigint" for c in image_coords) + ", root bigint"))

    # Pixels at a tile's border, or at a wrapped end, and the places that may hold their neighbours.
    border = F.lit(False)
    for k, c in enumerate(image_coords):
        border = border | (F.pmod(F.col(c), F.lit(edge)) == 0) | (F.pmod(F.col(c), F.lit(edge)) == edge - 1)
        if k in wrapped:
            border = border | (F.col(c) == 0) | (F.col(c) == shape[k] - 1)
    rim = local.filter(border)
    shifts = F.array(*[F.struct(*[F.lit(s).cast("bigint").alias(f"s{k}") for k, s in enumerate(o)]) for o in offsets])
    moved = rim.withColumn("s", F.explode(shifts)) if offsets else rim.limit(0).withColumn("s", F.struct(*[F.lit(0).cast("bigint").alias(f"s{k}") for k in range(n)]))
    for k, c in enumerate(image_coords):
        to = F.col(c) + F.col(f"s.s{k}")
        moved = moved.withColumn(f"n{k}", F.pmod(to, F.lit(shape[k]).cast("bigint")) if k in wrapped else to)
        if k not in wrapped:
            moved = moved.filter((F.col(f"n{k}") >= 0) & (F.col(f"n{k}") < shape[k]))
    moved = moved.select(*[f"n{k}" for k in range(n)], F.col("root").alias("a"))
    links = moved.join(rim.select(*[F.col(c).alias(f"n{k}") for k, c in enumerate(image_coords)], F.col("root").alias("b")), [f"n{k}" for k in range(n)]).select("a", "b")
    merged = connected(links)
    # Pixels know the root within their tile, so no key of theirs has more of them than a tile, however far a component reaches.
    roots = local.select("root").distinct().join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    roots = materialize(roots.select("root", F.coalesce("top", "root").alias("top")))
    numbers = materialize(dense_index(roots, "top"))
    labelled = local.join(spread_lookup(roots, "top", numbers).select("root", "number"), "root").select(*image_coords, F.col("number").cast("int").alias("value"))
    out = image.df.select(*image_coords).join(labelled, image_coords, "left").select(*image_coords, F.coalesce("value", F.lit(0)).alias("value"))
    return image.with_df(out, "int32"), numbers.agg(F.coalesce(F.max("number"), F.lit(0)).cast("bigint").alias("n"))


def structure(ndim: int, connectivity: int) -> np.ndarray:
    """Neighbours that differ by one in at most ``connectivity`` coordinates."""
    cells = np.zeros([3] * ndim, bool)
    for o in product((-1, 0, 1), repeat=ndim):
        cells[tuple(v + 1 for v in o)] = np.abs(o).sum() <= connectivity
    return cells

