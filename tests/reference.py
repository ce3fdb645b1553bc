"""Brute-force NumPy versions, written from the definitions, that tests hold results against."""

from itertools import product

import numpy as np


def fold(i, n, mode):
    """Walks from i back into [0, n)."""
    while not 0 <= i < n:
        if mode == "nearest":
            i = 0 if i < 0 else n - 1
        elif mode == "wrap":
            i += n if i < 0 else -n
        elif mode == "reflect":
            i = -i - 1 if i < 0 else 2 * n - 1 - i
        elif mode == "mirror":
            i = 0 if n == 1 else -i if i < 0 else 2 * n - 2 - i
        else:
            return None
    return i


def at(a, place, mode, cval):
    out = [fold(i, n, mode) for i, n in zip(place, a.shape)]
    return cval if None in out else a[tuple(out)]


def neighbours(a, mask, origin, mode, cval):
    """For each pixel, in C order, the values under the footprint's set cells, in C order."""
    centre = [s // 2 + o for s, o in zip(mask.shape, origin)]
    cells = np.argwhere(mask)
    return [[at(a, [p + k - c for p, k, c in zip(place, cell, centre)], mode, cval) for cell in cells] for place in np.ndindex(*a.shape)]


def correlate(a, w, mode="reflect", cval=0.0, origin=None):
    ones = np.ones(w.shape, bool)
    near = neighbours(a, ones, origin or [0] * a.ndim, mode, cval)
    return (np.array(near) @ w.ravel()).reshape(a.shape)


def convolve(a, w, mode="reflect", cval=0.0, origin=None):
    """out[i] = sum w[k] in[i - k + size // 2 + origin]."""
    origin = origin or [0] * a.ndim
    out = np.zeros(a.shape)
    for place in np.ndindex(*a.shape):
        out[place] = sum(w[k] * at(a, [p - q + s // 2 + o for p, q, s, o in zip(place, k, w.shape, origin)], mode, cval) for k in np.ndindex(*w.shape))
    return out


def rank(a, mask, r, mode="reflect", cval=0.0, origin=None):
    return np.array([sorted(v)[r] for v in neighbours(a, mask, origin or [0] * a.ndim, mode, cval)]).reshape(a.shape)


def morph(a, s, erode, iterations=1, mask=None, border=0, origin=None):
    origin = origin or [0] * a.ndim
    now = a != 0
    for _ in range(iterations):
        new = np.zeros(a.shape, bool)
        for place in np.ndindex(*a.shape):
            seen = []
            for k in np.argwhere(s):
                if erode:
                    q = [p + i - n // 2 - o for p, i, n, o in zip(place, k, s.shape, origin)]
                else:
                    q = [p - i + n // 2 + o for p, i, n, o in zip(place, k, s.shape, origin)]
                inside = all(0 <= x < n for x, n in zip(q, a.shape))
                seen.append(now[tuple(q)] if inside else bool(border))
            new[place] = all(seen) if erode else any(seen)
        now = new if mask is None else np.where(mask, new, now)
    return now


def components(a, s, wrap=()):
    """Labels 1.. in C order of each component's first pixel, by flood fill."""
    out, n = np.zeros(a.shape, int), 0
    offsets = [o - 1 for o in np.argwhere(s)]
    for start in np.ndindex(*a.shape):
        if a[start] and not out[start]:
            n += 1
            out[start], waiting = n, [start]
            while waiting:
                p = waiting.pop()
                for o in offsets:
                    q = [int(i + d) for i, d in zip(p, o)]
                    q = tuple(i % m if k in wrap else i for k, (i, m) in enumerate(zip(q, a.shape)))
                    if all(0 <= i < m for i, m in zip(q, a.shape)) and a[q] and not out[q]:
                        out[q] = n
                        waiting.append(q)
    return out, n


def bspline(t, order):
    """The centred B-spline by its recursion."""
    if order == 0:
        return 1.0 if -0.5 <= t < 0.5 else 0.0
    return (((order + 1) / 2 + t) * bspline(t + 0.5, order - 1) + ((order + 1) / 2 - t) * bspline(t - 0.5, order - 1)) / order


def sample(a, x, order, mode="constant", cval=0.0):
    if mode == "constant" and any(v < 0 or v > n - 1 for v, n in zip(x, a.shape)):
        return cval
    if mode == "nearest":
        x = [min(max(v, 0), n - 1) for v, n in zip(x, a.shape)]
    axes = []
    for v in x:
        first = int(np.floor(v if order % 2 else v + 0.5)) - order // 2
        axes.append([(first + k, bspline(v - first - k, order) if order > 0 else 1.0) for k in range(order + 1)])
    how = {"constant": "mirror", "nearest": "nearest", "grid-constant": "constant"}[mode]
    return sum(np.prod([w for _, w in taps]) * at(a, [i for i, _ in taps], how, cval) for taps in product(*axes))
