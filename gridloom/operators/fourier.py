"""Filters of a Fourier transform: each coefficient is multiplied by a factor of its frequency.

The input is a transform already. Every output pixel depends on its own row alone, so there is
no shuffle. With n >= 0 the image is the half of a real transform of length n along ``axis``.
"""

from __future__ import annotations

import numbers
from math import pi

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.image import Image


def _arguments(image: Image, value, n: int, axis: int) -> tuple[Image, list[float], int]:
    if isinstance(value, numbers.Number):
        value = [value] * image.ndim
    value = np.asarray(value)
    if np.iscomplexobj(value):
        raise TypeError("The argument must be real.")
    if value.shape != (image.ndim,):
        raise RuntimeError("The argument must have one value for each dimension.")
    axis = axis % image.ndim
    if n != -1 and image.shape[axis] != n // 2 + 1:
        raise NotImplementedError("The image's length along the axis must be n // 2 + 1.")
    if not image.is_complex and not image.dtype.startswith("float"):
        image = image.with_value(image.as_double(), "float64")
    return image, [float(v) for v in value], axis


def frequency(image: Image, k: int, n: int, axis: int) -> Column:
    """Cycles per sample of each pixel along axis k."""
    d, size = F.col(f"d{k}").cast("double"), image.shape[k]
    if k == axis and n > 0:
        return d / n
    return F.when(F.col(f"d{k}") < (size + 1) // 2, d).otherwise(d - size) / size


def _scaled(image: Image, factor: Column) -> Image:
    if image.is_complex:
        value = F.struct((F.col("value.re") * factor).alias("re"), (F.col("value.im") * factor).alias("im"))
    else:
        value = (F.col("value") * factor).cast("float" if image.dtype == "float32" else "double")
    return image.with_value(value)


def fourier_gaussian(image: Image, sigma, n: int = -1, axis: int = -1) -> Image:
    image, sigma, axis = _arguments(image, sigma, n, axis)
    exponent = F.lit(0.0)
    for k, s in enumerate(sigma):
        exponent = exponent - F.pow(2 * pi * frequency(image, k, n, axis), F.lit(2)) * (s * s / 2)
    return _scaled(image, F.exp(exponent))


def fourier_uniform(image: Image, size, n: int = -1, axis: int = -1) -> Image:
    image, size, axis = _arguments(image, size, n, axis)
    factor = F.lit(1.0)
    for k, s in enumerate(size):
        x = pi * s * frequency(image, k, n, axis)
        factor = factor * F.when(x == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(x), x))
    return _scaled(image, factor)


def fourier_shift(image: Image, shift, n: int = -1, axis: int = -1) -> Image:
    """Multiplies by exp(-2 pi i shift f); a real image becomes a complex one."""
    image, shift, axis = _arguments(image, shift, n, axis)
    angle = F.lit(0.0)
    for k, s in enumerate(shift):
        angle = angle - 2 * pi * s * frequency(image, k, n, axis)
    re, im = (F.col("value.re"), F.col("value.im")) if image.is_complex else (F.col("value").cast("double"), F.lit(0.0))
    cos, sin = F.cos(angle), F.sin(angle)
    value = F.struct((re * cos - im * sin).alias("re"), (re * sin + im * cos).alias("im"))
    return image.with_value(value, "complex64" if image.dtype in ("float32", "complex64") else "complex128")
