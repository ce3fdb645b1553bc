"""Byte ranges of files on any store that pyarrow reaches: shared folders, HDFS and object stores."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its place there; ``path`` is a URI as Spark lists it, or a plain path.

    A local file goes by its own name, as Spark's names aren't escaped.
    """
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def open_ranges(path: str) -> pa.NativeFile:
    """A file that is read by seeking."""
    store, place = store_of(path)
    return store.open_input_file(place)


def read_at(file: pa.NativeFile, at: int, size: int) -> bytes:
    """Exactly ``size`` bytes from ``at``."""
    data = file.read_at(size, at)
    if len(data) != size:
        raise EOFError(f"A file ends {size - len(data)} bytes before the end of a range.")
    return data
