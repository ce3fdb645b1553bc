"""Weights of filters and splines."""

from __future__ import annotations

from math import ceil, comb, factorial, log, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_1d(sigma: float, order: int, truncate: float) -> np.ndarray:
    """Weights, for correlation, of a Gaussian or its derivative of some order."""
    radius = int(truncate * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    if order:
        # The derivative is a polynomial times the Gaussian: q becomes q' - q x / sigma^2.
        q = np.polynomial.Polynomial([1.0])
        for _ in range(order):
            q = q.deriv() - q * np.polynomial.Polynomial([0.0, 1 / sigma**2])
        w = w * q(x.astype(float))
    return w[::-1]


def rank_of_percentile(cells: int, percentile: float) -> int:
    if percentile < 0:
        percentile += 100
    if not 0 <= percentile <= 100:
        raise RuntimeError("invalid percentile")
    return cells - 1 if percentile == 100 else int(cells * percentile / 100.0)


def spline_start(x: Column, order: int) -> Column:
    """The first of the order + 1 samples that weigh in at x."""
    return F.floor(x if order % 2 else x + 0.5) - order // 2


def spline_weights(t: np.ndarray, order: int) -> np.ndarray:
    """The centred B-spline of an order at places ``t``."""
    if order == 0:
        return np.ones(t.shape)
    if order == 1:
        return np.maximum(0.0, 1 - np.abs(t))
    terms = ((-1) ** k * comb(order + 1, k) * np.maximum(0.0, t + ((order + 1) / 2 - k)) ** order for k in range(order + 2))
    return sum(terms) / factorial(order)


def poles(order: int) -> list[float]:
    """Poles of a spline prefilter."""
    if order == 2:
        return [sqrt(8) - 3]
    if order == 3:
        return [sqrt(3) - 2]
    if order == 4:
        return [sqrt(664 - sqrt(438976)) + sqrt(304) - 19, sqrt(664 + sqrt(438976)) - sqrt(304) - 19]
    if order == 5:
        return [sqrt(67.5 - sqrt(4436.25)) + sqrt(26.25) - 6.5, sqrt(67.5 + sqrt(4436.25)) - sqrt(26.25) - 6.5]
    raise RuntimeError("spline order not supported")


def prefilter_lines(lines: np.ndarray, order: int, boundary: str) -> np.ndarray:
    """Spline coefficients of samples along the last axis; ``boundary`` is mirror, reflect or wrap.

    Each pole is a causal and an anticausal recursion; their first values are sums over the
    whole periodic or mirrored line, so the result is exact.
    """
    c = np.array(lines, dtype=complex if np.iscomplexobj(lines) else float)
    n = c.shape[-1]
    if n == 1 or order < 2:
        return c
    for z in poles(order):
        c *= (1 - z) * (1 - 1 / z)
        if boundary == "mirror":
            k = np.arange(2 * n - 2)
            at = np.minimum(k, 2 * n - 2 - k)
            period = 2 * n - 2
        elif boundary == "reflect":
            k = np.arange(2 * n)
            at = np.where(k == 0, 0, np.where(k <= n, k - 1, 2 * n - k))
            period = 2 * n
        else:
            k = np.arange(n)
            at = -k % n
            period = n
        c[..., 0] = (c[..., at] * z**k).sum(axis=-1) / (1 - z**period)
        for i in range(1, n):
            c[..., i] += z * c[..., i - 1]
        if boundary == "mirror":
            c[..., -1] = z / (z * z - 1) * (c[..., -1] + z * c[..., -2])
        elif boundary == "reflect":
            c[..., -1] = z / (z - 1) * c[..., -1]
        else:
            k = np.arange(n)
            c[..., -1] = -z * (c[..., (n - 1 + k) % n] * z**k).sum(axis=-1) / (1 - z**n)
        for i in range(n - 2, -1, -1):
            c[..., i] = z * (c[..., i + 1] - c[..., i])
    return c


def spline_depth(order: int, tolerance: float = 1e-18) -> int:
    """How far a sample's weight in the coefficients goes: the largest pole's power below ``tolerance``."""
    return 0 if order < 2 else ceil(log(tolerance) / log(max(map(abs, poles(order)))))


def prefilter_stretch(samples: np.ndarray, order: int) -> np.ndarray:
    """Spline coefficients along the last axis of a stretch of a longer line; those ``spline_depth`` from its ends are right.

    Both recursions begin as if the stretch's end went on unchanged, which a pole's powers forget.
    A few long lines are cut into many that overlap, so that a step works on many values.
    """
    c = np.array(samples, float)
    n, depth, step = c.shape[-1], spline_depth(order), 512
    if c.size // n < 64 and n > 4 * (step + 2 * depth):
        parts = -(-(n - 2 * depth) // step)
        long = np.concatenate([c, np.repeat(c[..., -1:], parts * step + 2 * depth - n, axis=-1)], axis=-1)
        windows = np.lib.stride_tricks.sliding_window_view(long, step + 2 * depth, axis=-1)[..., ::step, :]
        inner = prefilter_stretch(windows, order)[..., depth : depth + step].reshape(*c.shape[:-1], parts * step)
        out = np.zeros(c.shape)
        out[..., depth : n - depth] = inner[..., : n - 2 * depth]
        return out
    lines = np.ascontiguousarray(np.moveaxis(c, -1, 0))
    for z in poles(order):
        lines *= (1 - z) * (1 - 1 / z)
        lines[0] /= 1 - z
        for k in range(1, n):
            lines[k] += z * lines[k - 1]
        lines[-1] *= z / (z - 1)
        for k in range(n - 2, -1, -1):
            lines[k] = z * (lines[k + 1] - lines[k])
    return np.moveaxis(lines, 0, -1)
