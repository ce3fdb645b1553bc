"""Boundary rules: which pixel stands at a place outside the image."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .image import Image


def fold(i: np.ndarray, n: int, mode: str) -> np.ndarray:
    """The positions in [0, n) that stand for positions ``i``; constant folds as nearest does."""
    i = np.asarray(i)
    if mode == "wrap":
        return i % n
    if mode == "reflect":
        i = i % (2 * n)
        return np.where(i >= n, 2 * n - 1 - i, i)
    if mode == "mirror":
        if n == 1:
            return np.zeros_like(i)
        i = i % (2 * n - 2)
        return np.where(i >= n, 2 * n - 2 - i, i)
    return np.clip(i, 0, n - 1)


def fold_column(i: Column, n: int, mode: str) -> Column:
    """``fold`` as an expression on a bigint column."""
    if mode == "wrap":
        return F.pmod(i, F.lit(n).cast("bigint"))
    if mode in ("reflect", "mirror") and n == 1:
        return F.lit(0).cast("bigint")
    if mode == "reflect":
        p = F.pmod(i, F.lit(2 * n).cast("bigint"))
        return F.when(p >= n, 2 * n - 1 - p).otherwise(p)
    if mode == "mirror":
        p = F.pmod(i, F.lit(2 * n - 2).cast("bigint"))
        return F.when(p >= n, 2 * n - 2 - p).otherwise(p)
    return F.greatest(F.lit(0).cast("bigint"), F.least(i, F.lit(n - 1).cast("bigint")))


def padded(image: Image, low: tuple[int, ...], high: tuple[int, ...], mode: str, cval: float = 0.0, value: Column | None = None) -> DataFrame:
    """Pixels with their places v0, ... in the image extended by ``low`` and ``high``.

    A pixel near a border also stands for the places outside that fold to it. With mode
    constant these hold ``cval``. The column ``value`` is a double; others are kept.
    """
    df = image.df.withColumn("value", image.as_double() if value is None else value)
    outside = F.lit(False)
    for k, (n, lo, hi) in enumerate(zip(image.shape, low, high)):
        d = F.col(f"d{k}")
        ghosts = defaultdict(list)
        places = np.concatenate([np.arange(-lo, 0), np.arange(n, n + hi)])
        for q, p in zip(places.tolist(), fold(places, n, mode).tolist()):
            ghosts[p].append(q)
        if not ghosts:
            df = df.withColumn(f"v{k}", d)
            continue
        table = F.create_map(*[x for p, qs in sorted(ghosts.items()) for x in (F.lit(p).cast("bigint"), F.array(*[F.lit(q).cast("bigint") for q in qs]))])
        edge = (d <= max((p for p in ghosts if p <= (n - 1) // 2), default=-1)) | (d >= min((p for p in ghosts if p > (n - 1) // 2), default=n))
        own = F.array(d)
        df = df.withColumn(f"v{k}", F.explode(F.when(edge, F.concat(own, F.coalesce(F.try_element_at(table, d), F.array().cast("array<bigint>")))).otherwise(own)))
        outside = outside | (F.col(f"v{k}") < 0) | (F.col(f"v{k}") >= n)
    if mode == "constant":
        df = df.withColumn("value", F.when(outside, F.lit(float(cval))).otherwise(F.col("value")))
    return df
