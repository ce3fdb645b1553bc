"""Argument checks, made on the driver before any job."""

from __future__ import annotations

import numbers
import warnings
from collections.abc import Sequence

import numpy as np

FILTER_MODES = ("reflect", "mirror", "nearest", "wrap", "constant", "grid-mirror", "grid-wrap", "grid-constant")


def mode(name: str) -> str:
    if name not in FILTER_MODES:
        raise RuntimeError(f"boundary mode not supported: {name}")
    return {"grid-mirror": "reflect", "grid-wrap": "wrap", "grid-constant": "constant"}.get(name, name)


def _per_axis(value, ndim: int, what: str) -> np.ndarray:
    out = np.array([value] * ndim if isinstance(value, numbers.Number) else value)
    if out.ndim != 1:
        raise RuntimeError(f"The {what} must have only one dimension.")
    if len(out) != ndim:
        raise RuntimeError(f"The {what} must have one value for each dimension.")
    return out


def size(ndim, value) -> tuple[int, ...]:
    if not isinstance(ndim, numbers.Integral):
        raise TypeError("The number of dimensions must be integral.")
    out = _per_axis(value, ndim, "size")
    if not np.issubdtype(out.dtype, np.integer):
        raise TypeError("The size must be integral.")
    return tuple(int(v) for v in out)


def origin(sizes: Sequence[int], value=0) -> tuple[int, ...]:
    """Only the upper bound is checked: an origin below (size + 1) // 2."""
    out = _per_axis(value, len(sizes), "origin")
    if not np.issubdtype(out.dtype, np.integer):
        raise TypeError("The origin must be integral.")
    if not (out < (np.array(sizes) + 1) // 2).all():
        raise ValueError("The origin must lie within the footprint.")
    return tuple(int(v) for v in out)


def footprint(ndim: int, sizes=None, mask=None) -> np.ndarray:
    if (sizes is None) == (mask is None):
        raise RuntimeError("Give either a size or a footprint.")
    if mask is None:
        mask = np.ones(size(ndim, sizes), bool)
    if mask.ndim != ndim:
        raise RuntimeError("The footprint must have the image's number of dimensions.")
    if mask.size == 0:
        raise RuntimeError("The footprint must not be empty.")
    return mask != 0


def sigmas(ndim: int, value) -> tuple[float, ...]:
    out = _per_axis(value, ndim, "sigma")
    if np.iscomplexobj(out):
        raise TypeError("The sigma must be real.")
    return tuple(float(v) for v in out)


def axis(ndim: int, value: int) -> int:
    if not isinstance(value, numbers.Integral):
        raise ValueError("The axis must be integral.")
    if not -ndim <= value < ndim:
        raise ValueError("The axis is out of range.")
    return int(value) % ndim


def plane(ndim: int, axes) -> list[int]:
    """Two axes of an image, ascending and none negative."""
    pair = np.asarray(list(axes), float)
    if pair.shape != (2,) or (pair % 1).any():
        raise ValueError("A plane takes two integral axes.")
    pair = np.sort(np.where(pair < 0, pair + ndim, pair)).astype(int)
    if ndim < 2 or pair[0] < 0 or pair[1] >= ndim:
        raise ValueError("The plane does not lie in the image.")
    return pair.tolist()


def frames_a_batch(nframes, frames: int | None = None) -> int | None:
    """Frames decoded together: ``nframes``, or all of ``frames`` for -1; only checked without ``frames``."""
    if not isinstance(nframes, numbers.Integral) or nframes < -1 or nframes == 0:
        raise ValueError(f"nframes counts frames or is -1 for all of them, not {nframes!r}.")
    if frames is None:
        return None
    if nframes != -1 and (nframes > frames or frames % nframes):
        warnings.warn(f"Batches of {nframes} don't share out {frames} frames evenly.", RuntimeWarning, stacklevel=3)
    return int(frames if nframes == -1 else min(nframes, frames))


def structure(ndim: int, value=None) -> np.ndarray:
    """A structuring element; None is the cross of direct neighbours."""
    if value is None:
        return np.abs(np.indices([3] * ndim) - 1).sum(axis=0) <= 1
    if not hasattr(value, "ndim"):
        raise TypeError("The structure must be an array.")
    if value.ndim != ndim:
        raise RuntimeError("The structure must have the image's number of dimensions.")
    return np.asarray(value) != 0


def iterations(value) -> int:
    if not isinstance(value, numbers.Integral):
        raise TypeError("The iterations must be integral.")
    if value < 1:
        raise NotImplementedError("Iterating until nothing changes is not supported.")
    return int(value)


def border_value(value) -> bool:
    if not isinstance(value, numbers.Integral):
        raise TypeError("The border value must be integral.")
    return value != 0


def brute_force(value) -> None:
    if value is True:
        raise NotImplementedError("brute_force is not supported.")
    if value is not False:
        raise TypeError("brute_force must be a bool.")
