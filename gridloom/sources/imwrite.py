"""Writing images as TIFF, by the tasks that have the frames.

A file is written under another name and then moved, so a task that is run again, or twice, leaves
one whole file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..plans.image import Image
from .imread import encode_tiff
from .ranges import open_ranges, store_of

#: Pixels of the frames that one task makes pages of, unless one frame has more.
_RUN_PIXELS = 1 << 20
#: Bytes of a file that are copied at a time.
_COPIED = 1 << 23


def _checked(image: Image) -> None:
    if image.ndim != 3 or image.is_complex or image.dtype == "bool":
        raise ValueError("Frames are planes of real numbers: an image of three dimensions.")


def _write(path: str, chunks: Iterable[bytes]) -> None:
    store, place = store_of(path)
    store.create_dir(place.rpartition("/")[0])
    part = f"{place}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(part, place)


def _page_tail(shape: tuple[int, int], dtype: np.dtype, number: int, count: int) -> bytes:
    """What follows the samples of a BigTIFF's page: its directory. Pages are alike, so each one's place follows from its number."""
    height, width = shape
    size = height * width * dtype.itemsize
    at = 16 + number * page_size(shape, dtype)
    tags = [(256, width), (257, height), (258, dtype.itemsize * 8), (259, 1), (262, 1), (273, at), (277, 1), (278, height), (279, size), (339, {"u": 1, "i": 2, "f": 3}[dtype.kind])]
    following = at + page_size(shape, dtype) + size if number + 1 < count else 0
    return struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", tag, 16, 1, value) for tag, value in tags) + struct.pack("<Q", following)


def page_size(shape: tuple[int, int], dtype: np.dtype) -> int:
    """Bytes of one page: samples, and a directory of ten tags."""
    return shape[0] * shape[1] * dtype.itemsize + 16 + 20 * 10


def big_tiff(frames: Iterable[np.ndarray], count: int, first: int = 0) -> Iterator[bytes]:
    """The pages from number ``first`` on of an uncompressed little-endian BigTIFF of ``count`` frames of one shape, piece by piece; before page 0 the file's head."""
    for number, frame in enumerate(frames, first):
        raw = np.ascontiguousarray(frame.astype(frame.dtype.newbyteorder("<"))).tobytes()
        if not number:
            yield struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + len(raw))
        yield raw + _page_tail(frame.shape, frame.dtype, number, count)


def write_frames(image: Image, folder: str) -> None:
    """A file for each frame, named by its number."""
    _checked(image)
    shape, dtype = image.shape[1:], image.dtype

    def run(key, table):
        frame = np.zeros(shape, dtype)
        frame[table.column("d1").to_numpy(), table.column("d2").to_numpy()] = np.array(table.column("value").to_pylist())
        _write(f"{folder}/{key[0].as_py()}.tif", [encode_tiff(frame[None])])
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int64())})

    image.df.select("d0", "d1", "d2", "value").groupBy("d0").applyInArrow(run, "frame bigint").write.format("noop").mode("overwrite").save()


def _run_frames(shape: tuple[int, int], dtype: str, number: int, upto: int, pieces: Iterable[tuple]) -> Iterator[np.ndarray]:
    """Frames ``number`` to ``upto`` from pixels (d0, d1, d2, value) sorted by d0; one frame is held at a time."""
    frame = np.zeros(shape, dtype)
    for d0, d1, d2, value in pieces:
        cuts = [0, *(np.flatnonzero(np.diff(d0)) + 1).tolist(), len(d0)]
        for a, b in zip(cuts, cuts[1:]):
            while number < d0[a]:
                yield frame
                number, frame = number + 1, np.zeros(shape, dtype)
            frame[d1[a:b], d2[a:b]] = value[a:b]
    while number < upto:
        yield frame
        number, frame = number + 1, np.zeros(shape, dtype)


def write_stack(image: Image, path: str) -> None:
    """One file of all frames.

    Each task makes the pages of a run of frames, of bounded size, as a file beside ``path``; as a
    file is one stream, a last task then joins these, in pieces of bounded size, and pixels don't
    pass through it.
    """
    _checked(image)
    if not image.shape[0]:
        raise ValueError("A stack has a frame at least.")
    count, shape, dtype = image.shape[0], image.shape[1:], image.dtype
    run = max(1, _RUN_PIXELS // max(1, prod(shape)))
    runs = -(-count // run)
    folder = f"{path}.{uuid.uuid4().hex}.runs"

    def pages(batches):
        def pieces():
            for batch in batches:
                if batch.num_rows:
                    d0, d1, d2 = (batch.column(c).to_numpy() for c in ("d0", "d1", "d2"))
                    yield d0, d1, d2, np.array(batch.column("value").to_pylist(), dtype)

        rows = pieces()
        first = next(rows, None)
        if first is None:
            return
        # A task has one run.
        number = int(first[0][0]) // run
        start, upto = number * run, min(count, (number + 1) * run)
        _write(f"{folder}/{number}", big_tiff(_run_frames(shape, dtype, start, upto, chain([first], rows)), count, start))
        yield pa.RecordBatch.from_pydict({"run": pa.array([number], pa.int64())})

    def whole():
        for number in range(runs):
            with open_ranges(f"{folder}/{number}") as file:
                while piece := file.read(_COPIED):
                    yield piece

    def join(batches):
        for batch in batches:
            if batch.num_rows:
                _write(path, whole())
            yield pa.RecordBatch.from_pydict({"frames": pa.array([count] * batch.num_rows, pa.int64())})

    def clear(batches):
        store, place = store_of(folder)
        for batch in batches:
            if batch.num_rows and store.get_file_info(place).type == fs.FileType.Directory:
                store.delete_dir(place)
            yield pa.RecordBatch.from_pydict({"frames": pa.array([count] * batch.num_rows, pa.int64())})

    rows = image.df.select("d0", "d1", "d2", "value").withColumn("run", F.floor(F.col("d0") / run).cast("int"))
    dealt = rows.repartitionById(runs, "run").drop("run").sortWithinPartitions("d0")
    dealt.mapInArrow(pages, "run bigint").write.format("noop").mode("overwrite").save()
    for last in (join, clear):
        image.spark.range(0, 1, 1, 1).mapInArrow(last, "frames bigint").write.format("noop").mode("overwrite").save()
