"""Reading image files: TIFF and NumPy arrays.

TIFF may be classic or BigTIFF, in strips or tiles, of one or many pages, plain or compressed
by deflate, LZW or PackBits, with or without the horizontal predictor. Axis 0 is the frame.

A file is never read whole: a page's directory and its pieces are byte ranges, wherever in the
file they lie. One file is a Spark data source (``FrameSource``), whose partitions are planned
from the directory of pages; several are a table of paths, numbered in natural order by Spark, so
the driver holds no list of them. Pixels are made by the task that reads them, and don't shuffle.
Ranges are read by pyarrow; on a store that only Spark reads, files come by its binaryFile source.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import islice
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import checks
from ..plans.image import SPARK_TYPES, Image
from ..plans.scratch import materialize
from .ranges import open_ranges

# TIFF field types as bytes and struct code; sample formats; numbers of tags.
_FIELDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 13: (4, "I"), 16: (8, "Q"), 18: (8, "Q")}
_FORMATS = {1: "u", 2: "i", 3: "f", 4: "u"}
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
_TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS, _FORMAT = 322, 323, 324, 325, 339
#: Tasks that one image is read in, at most.
_MOST_PARTITIONS = 10_000


def natural_key(name: str) -> list:
    """Sorts 9.tif before 10.tif."""
    return [int(p) if p.isdigit() else p for p in re.split(r"(\d+)", name)]


Read = Callable[[int, int], bytes]
"""Gives a file's bytes from a place on: ``read(at, size)``."""


def reader_of(data: bytes) -> Read:
    return lambda at, size: data[at : at + size]


def _unpacked(read: Read, layout: str, at: int) -> tuple:
    size = struct.calcsize(layout)
    data = read(at, size)
    if len(data) < size:
        raise ValueError("A TIFF file ends too early.")
    return struct.unpack(layout, data)


def _tiff_layout(read: Read) -> tuple[str, str, int]:
    """Byte order, the code of an offset, and the place of the first page's directory."""
    head = read(0, 16)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(end + "H", head, 2)[0] if end and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    code = "I" if version == 42 else "Q"
    return end, code, struct.unpack_from(end + code, head, 4 if code == "I" else 8)[0]


def _entries(read: Read, end: str, code: str, at: int) -> tuple[int, int, int]:
    """How many entries a directory has, where they begin, and how long one is."""
    count = _unpacked(read, end + ("H" if code == "I" else "Q"), at)[0]
    return (count, at + 2, 12) if code == "I" else (count, at + 8, 20)


def tiff_directory(read: Read) -> Iterator[int]:
    """Where each page's directory lies; each tells where the next one is."""
    end, code, at = _tiff_layout(read)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("A TIFF file's directories go in a circle.")
        seen.add(at)
        yield at
        count, first, size = _entries(read, end, code, at)
        at = _unpacked(read, end + code, first + size * count)[0]


def tiff_tags(read: Read, at: int) -> tuple[str, dict]:
    """The byte order and tags of the page whose directory is at ``at``."""
    end, code, _ = _tiff_layout(read)
    count, first, size = _entries(read, end, code, at)
    table, wide, tags = read(first, size * count), struct.calcsize(code), {}
    for place in range(0, size * count, size):
        tag, kind, n = struct.unpack_from(end + "HH" + code, table, place)
        if kind in _FIELDS:
            width, letter = _FIELDS[kind]
            value = place + 4 + wide
            if width * n <= wide:
                tags[tag] = struct.unpack_from(f"{end}{n}{letter}", table, value)
            else:
                tags[tag] = _unpacked(read, f"{end}{n}{letter}", struct.unpack_from(end + code, table, value)[0])
    return end, tags


def tiff_type(end: str, tags: dict) -> np.dtype:
    bits = tags.get(_BITS, (1,))
    if len(set(bits)) > 1 or bits[0] % 8:
        raise NotImplementedError("TIFF samples must be whole bytes of one width.")
    return np.dtype(f"{end}{_FORMATS[tags.get(_FORMAT, (1,))[0]]}{bits[0] // 8}")


def tiff_shape(tags: dict) -> tuple[int, ...]:
    samples = tags.get(_SAMPLES, (1,))[0]
    return (tags[_HEIGHT][0], tags[_WIDTH][0]) + ((samples,) if samples > 1 else ())


def tiff_pieces(read: Read, tags: dict) -> list[bytes]:
    """The undecoded strips or tiles of a page; without their sizes, they are read up to the next one or as long as they can be."""
    starts = tags.get(_TILE_OFFSETS) or tags[_OFFSETS]
    bound = 2 * tags[_HEIGHT][0] * tags[_WIDTH][0] * sum(tags.get(_BITS, (8,))) // 8 + 1024
    sizes = tags.get(_TILE_COUNTS) or tags.get(_COUNTS) or [bound] * len(starts)
    return [read(a, n) for a, n in zip(starts, sizes)]


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, widened one code early."""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    out, width, held, bits, last = [], 9, 0, 0, b""
    known = table[:]
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            known, width, last = table[:], 9, b""
            continue
        word = known[code] if code < len(known) else last + last[:1]
        out.append(word)
        if last:
            known.append(last + word[:1])
        last = word
        width = min(12, (len(known) + 1).bit_length())
    return b"".join(out)


_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def decode_page(end: str, tags: dict, pieces: list[bytes]) -> np.ndarray:
    """A page's samples as (height, width[, samples])."""
    packed = tags.get(_COMPRESSION, (1,))[0]
    if packed not in _UNPACK:
        raise NotImplementedError(f"TIFF compression {packed} is not supported.")
    dtype, height, width, samples = tiff_type(end, tags), tags[_HEIGHT][0], tags[_WIDTH][0], tags.get(_SAMPLES, (1,))[0]
    tiled, apart = _TILE_OFFSETS in tags, tags.get(_PLANAR, (1,))[0] == 2
    rows, columns = (tags[_TILE_HEIGHT][0], tags[_TILE_WIDTH][0]) if tiled else (min(tags.get(_ROWS, (height,))[0], height), width)
    planes, depth = (samples, 1) if apart else (1, samples)
    across, down = -(-width // columns), -(-height // rows)
    out = np.zeros((planes, height, width, depth), dtype.newbyteorder("="))
    for k, piece in enumerate(pieces):
        plane, y, x = k // (across * down), k // across % down * rows, k % across * columns
        high = rows if tiled else min(rows, height - y)
        block = np.frombuffer(_UNPACK[packed](piece), dtype, high * columns * depth).reshape(high, columns, depth).astype(out.dtype)
        if tags.get(_PREDICTOR, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        elif tags.get(_PREDICTOR, (1,))[0] != 1:
            raise NotImplementedError("Only the horizontal TIFF predictor is supported.")
        place = out[plane, y : y + high, x : x + columns]
        place[...] = block[: place.shape[0], : place.shape[1]]
    whole = np.moveaxis(out[..., 0], 0, -1) if apart else out[0]
    return whole if samples > 1 else whole[..., 0]


def decode_tiff(data: bytes) -> np.ndarray:
    """All pages, as (pages, height, width[, samples])."""
    read = reader_of(data)
    return np.stack([decode_page(end, tags, tiff_pieces(read, tags)) for end, tags in (tiff_tags(read, at) for at in tiff_directory(read))])


def encode_tiff(frames: np.ndarray) -> bytes:
    """An uncompressed little-endian TIFF with a page for each frame of (pages, height, width)."""
    out = bytearray(b"II*\x00" + struct.pack("<I", 8))
    kind = {"u": 1, "i": 2, "f": 3}[frames.dtype.kind]
    for k, frame in enumerate(frames):
        raw = np.ascontiguousarray(frame.astype(frame.dtype.newbyteorder("<"))).tobytes()
        tags = [(256, frame.shape[1]), (257, frame.shape[0]), (258, frame.dtype.itemsize * 8), (259, 1), (262, 1), (273, 0), (277, 1), (278, frame.shape[0]), (279, len(raw)), (339, kind)]
        start = len(out) + 2 + 12 * len(tags) + 4
        out += struct.pack("<H", len(tags))
        for tag, value in tags:
            out += struct.pack("<HHII", tag, 4, 1, start if tag == 273 else value)
        out += struct.pack("<I", start + len(raw) + len(raw) % 2 if k + 1 < len(frames) else 0)
        out += raw + b"\0" * (len(raw) % 2)
    return bytes(out)


def is_array(name: str) -> bool:
    return name.lower().endswith(".npy")


def _array_layout(read: Read) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether in Fortran's order, dtype, and where the values begin."""
    head = io.BytesIO(read(0, 1 << 16))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    return shape, fortran, dtype, head.tell()


def places_of(name: str, read: Read) -> Iterator[int]:
    """Where each frame of a file is: a page's directory, or a frame's number in an array."""
    if is_array(name):
        return iter(range(_array_layout(read)[0][0]))
    return tiff_directory(read)


def frame_at(name: str, read: Read, place: int) -> np.ndarray:
    """One frame, of which only its own ranges are read; of an array in Fortran's order, one range a value of the last axes."""
    if not is_array(name):
        end, tags = tiff_tags(read, place)
        return decode_page(end, tags, tiff_pieces(read, tags))
    shape, fortran, dtype, start = _array_layout(read)
    if fortran:
        step = shape[0] * dtype.itemsize
        values = b"".join(read(start + k * step + place * dtype.itemsize, dtype.itemsize) for k in range(prod(shape[1:])))
        return np.frombuffer(values, dtype).reshape(shape[:0:-1]).T.astype(dtype.newbyteorder("="))
    size = prod(shape[1:]) * dtype.itemsize
    return np.frombuffer(read(start + place * size, size), dtype).reshape(shape[1:]).astype(dtype.newbyteorder("="))


def described(name: str, read: Read) -> tuple[tuple[int, ...], str]:
    """The shape of a frame and the dtype of a file, from its head."""
    if is_array(name):
        shape, _, dtype, _ = _array_layout(read)
        return shape[1:], dtype.name
    end, tags = tiff_tags(read, next(tiff_directory(read)))
    return tiff_shape(tags), tiff_type(end, tags).name


def frames_of(name: str, data: bytes) -> Iterator[np.ndarray]:
    """All frames of a file that is held whole."""
    read = reader_of(data)
    return (frame_at(name, read, place) for place in places_of(name, read))


@contextmanager
def opened(path: str) -> Iterator[Read]:
    with open_ranges(path) as file:
        yield lambda at, size: file.read_at(size, at)


def _value_type(dtype: str) -> str:
    return {"uint8": "int16", "int8": "int16", "uint16": "int32", "uint32": "int64"}.get(dtype, dtype)


def pixels_of(first: Sequence[int], frames: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Rows (d0, ..., value) of frames and their numbers."""
    part = np.stack(list(frames))
    where = np.indices(part.shape)
    where[0] = np.array(list(first)).reshape(-1, *[1] * (part.ndim - 1))
    return pa.RecordBatch.from_arrays([*(pa.array(w.ravel(), pa.int64()) for w in where), pa.array(part.ravel().astype(_value_type(part.dtype.name)))], names=[*(f"d{k}" for k in range(part.ndim)), "value"])


def pixel_schema(ndim: int, dtype: str) -> str:
    return ", ".join(f"d{k} bigint" for k in range(ndim)) + f", value {SPARK_TYPES[dtype]}"


class Pages(InputPartition):
    """Frames of a file that a task reads: the number of the first and the place of each."""

    def __init__(self, first: int, places: list[int]):
        super().__init__((first, len(places)))
        self.first, self.places = first, places


class FrameReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[Pages]:
        """``step`` frames a partition, or more where there were more than _MOST_PARTITIONS."""
        with opened(self.path) as read:
            places = list(places_of(self.path, read))
        step = self.step * -(-len(places) // (self.step * _MOST_PARTITIONS)) if places else 1
        return [Pages(k, places[k : k + step]) for k in range(0, len(places), step)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as read:
            for k in range(0, len(partition.places), self.step):
                some = partition.places[k : k + self.step]
                yield pixels_of(range(partition.first + k, partition.first + k + len(some)), [frame_at(self.path, read, p) for p in some])


class FrameSource(DataSource):
    """One file of frames as pixels: ``spark.read.format("gridloom_frames").option("nframes", 4).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "gridloom_frames"

    def schema(self) -> str:
        with opened(self.options["path"]) as read:
            size, dtype = described(self.options["path"], read)
        return pixel_schema(1 + len(size), dtype)

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], max(1, int(self.options.get("nframes", "1"))))


def numbered(files: DataFrame) -> DataFrame:
    """(frame, path): paths numbered in natural order, by ranges, so that no task or driver holds them all."""
    runs = F.regexp_extract_all("path", F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 20, "0")).otherwise(r))
    ordered = materialize(files.select("path", padded.alias("key")).repartitionByRange("key", "path").sortWithinPartitions("key", "path").select("path", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    held = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # A row for each partition.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("part", before.alias("before"))
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("frame"), "path")


def _reachable(path: str) -> bool:
    """Whether ranges of a file can be read; else Spark alone reads its store."""
    try:
        with open_ranges(path) as file:
            return file.size() >= 0
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def imread(spark: SparkSession, fname: str, nframes: int = 1, *, arraytype: str = "numpy") -> Image:
    """Reads one file of frames, or the first frame of each of several files in natural order.

    ``nframes`` is the number of frames decoded into one Arrow batch, -1 for all, and what a task
    reads at least.
    """
    checks.frames_a_batch(nframes)
    if arraytype != "numpy":
        raise NotImplementedError("Only arrays in main memory are supported.")
    files = spark.read.format("binaryFile").load(str(fname))
    names = files.select("path")
    head = names.agg(F.count("*").alias("n"), F.min("path").alias("path")).head()
    if not head["n"]:
        raise FileNotFoundError(f"no image files at {fname}")
    several = head["n"] > 1
    order = numbered(names) if several else names.select(F.lit(0).cast("bigint").alias("frame"), "path")
    first = order.filter("frame = 0")

    def describe(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if not _reachable(path):
                    yield pa.RecordBatch.from_pydict({"path": [path], "frames": pa.array([None], pa.int64()), "size": pa.array([None], pa.list_(pa.int64())), "dtype": pa.array([None], pa.string())})
                    continue
                with opened(path) as read:
                    size, dtype = described(path, read)
                    frames = 1 if several else sum(1 for _ in places_of(path, read))
                yield pa.RecordBatch.from_pydict({"path": [path], "frames": [frames], "size": [list(size)], "dtype": [dtype]})

    told = first.select("path").mapInArrow(describe, "path string, frames bigint, size array<bigint>, dtype string").head()
    if told["frames"] is None:
        return _imread_whole(files, order, head["n"], nframes)
    shape, dtype = (head["n"] if several else told["frames"], *told["size"]), told["dtype"]
    step = checks.frames_a_batch(nframes, shape[0])
    if not several:
        spark.dataSource.register(FrameSource)
        return Image(spark.read.format(FrameSource.name()).option("nframes", step).load(told["path"]), shape, dtype)

    def run(batches):
        held: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            for frame, path in zip(*(c.to_pylist() for c in batch.columns)):
                if held and frame // step != held[0][0] // step:
                    yield pixels_of(*zip(*held))
                    held.clear()
                with opened(path) as read:
                    held.append((frame, frame_at(path, read, next(places_of(path, read)))))
        if held:
            yield pixels_of(*zip(*held))

    dealt = order.repartition(min(_MOST_PARTITIONS, -(-shape[0] // step)), F.floor(F.col("frame") / step)).sortWithinPartitions("frame")
    return Image(dealt.mapInArrow(run, pixel_schema(len(shape), dtype)), shape, dtype)


def _imread_whole(files: DataFrame, order: DataFrame, count: int, nframes: int) -> Image:
    """The same from a store that only Spark reads: a file comes as one row, and its task decodes it frame by frame."""
    several = count > 1

    def describe(batches):
        for batch in batches:
            for path, data in zip(*(c.to_pylist() for c in batch.columns)):
                read = reader_of(data)
                size, dtype = described(path, read)
                yield pa.RecordBatch.from_pydict({"frames": [sum(1 for _ in places_of(path, read))], "size": [list(size)], "dtype": [dtype]})

    found = files.select("path", "content").join(order, "path")
    told = found.filter("frame = 0").select("path", "content").mapInArrow(describe, "frames bigint, size array<bigint>, dtype string").head()
    shape, dtype = (count if several else told["frames"], *told["size"]), told["dtype"]
    checks.frames_a_batch(nframes, shape[0])

    def run(batches):
        for batch in batches:
            for frame, path, data in zip(*(c.to_pylist() for c in batch.columns)):
                for k, one in enumerate(islice(frames_of(path, data), 1 if several else None)):
                    yield pixels_of([frame + k], [one])

    return Image(found.select("frame", "path", "content").mapInArrow(run, pixel_schema(len(shape), dtype)), shape, dtype)
