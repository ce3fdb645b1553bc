import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Image, imread, read_tiles, write_tiles
from gridloom.plans.boundary import fold
from gridloom.sources.imread import FrameSource, decode_tiff, encode_tiff, frame_at, natural_key, numbered, reader_of, tiff_directory, unpack_bits, unpack_lzw
from gridloom.sources.imwrite import write_frames, write_stack
from gridloom.streaming.frames import frame_pixels, frame_statistics

from . import reference as ref


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32"])
@pytest.mark.parametrize("shape", [(1, 4, 3), (5, 4, 3)])
def test_tiff_round_trip(spark, tmp_path, dtype, shape):
    frames = np.random.default_rng(1).integers(0, 99, shape).astype(dtype)
    np.testing.assert_array_equal(decode_tiff(encode_tiff(frames)), frames)
    (tmp_path / "a.tif").write_bytes(encode_tiff(frames))
    image = imread(spark, str(tmp_path / "*.tif"), nframes=-1)
    assert image.shape == shape and image.dtype == dtype
    np.testing.assert_array_equal(image.to_numpy(), frames)


def lzw(data):
    """An encoder, to test the decoder with: clears before the table is full and widens one code early."""
    out, held = [], ""
    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""

    def put(code):
        out.append(format(code, f"0{width}b"))

    put(256)
    n = 258
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more], n = n, n + 1
        if n == 4095:
            put(256)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif n in (512, 1024, 2048):
            width += 1
        word = data[k : k + 1]
    if word:
        put(table[word])
        n += 1
        width += n in (512, 1024, 2048)
    put(257)
    held = "".join(out)
    held += "0" * (-len(held) % 8)
    return bytes(int(held[k : k + 8], 2) for k in range(0, len(held), 8))


def bits(data):
    """PackBits by runs of one byte and literals of up to three."""
    out, k = b"", 0
    while k < len(data):
        run = next((n for n in range(1, min(128, len(data) - k)) if data[k + n] != data[k]), min(128, len(data) - k))
        if run > 1:
            out, k = out + bytes([257 - run]) + data[k : k + 1], k + run
        else:
            part = data[k : k + 3]
            out, k = out + bytes([len(part) - 1]) + part, k + len(part)
    return out


def tiff(image, pack=bytes, compression=1, end="<", big=False, tile=None, rows=3, predictor=False, planar=False, counts=True, sample_format=True):
    """One page written the long way round: any layout that the reader takes."""
    image = image[..., None] if image.ndim == 2 else image
    h, w, samples = image.shape
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    pieces = []
    for plane in [image[..., s : s + 1] for s in range(samples)] if planar else [image]:
        for y in range(0, h, tile or rows):
            for x in range(0, w, tile or w):
                block = plane[y : y + (tile or rows), x : x + (tile or w)]
                if tile:
                    block = np.pad(block, [(0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)])
                if predictor:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                pieces.append(pack(block.astype(block.dtype.newbyteorder(end)).tobytes()))
    wide, code = (8, "Q") if big else (4, "I")
    body = bytearray((b"II" if end == "<" else b"MM") + (struct.pack(end + "HHHQ", 43, 8, 0, 0) if big else struct.pack(end + "HI", 42, 0)))
    starts = []
    for piece in pieces:
        starts.append(len(body))
        body += piece

    def outside(values, letter):
        at = len(body)
        body.extend(struct.pack(f"{end}{len(values)}{letter}", *values))
        return at

    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [image.dtype.itemsize * 8] * samples), (259, 3, [compression]), (277, 3, [samples]), (284, 3, [2 if planar else 1])]
    tags += [(317, 3, [2])] if predictor else []
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, starts), (325, 4, [len(p) for p in pieces])] if tile else [(278, 4, [rows]), (273, 4, starts)] + ([(279, 4, [len(p) for p in pieces])] if counts else [])
    tags += [(339, 3, [kind] * samples)] if sample_format else [(339, 3, [4] * samples)]
    entries = []
    for tag, field, values in sorted(tags):
        letter, size = {3: ("H", 2), 4: ("I", 4)}[field]
        if size * len(values) <= wide:
            value = struct.pack(f"{end}{len(values)}{letter}", *values).ljust(wide, b"\0")
        else:
            value = struct.pack(end + code, outside(values, letter))
        entries.append(struct.pack(end + "HH" + code, tag, field, len(values)) + value)
    at = len(body)
    body += struct.pack(end + ("Q" if big else "H"), len(entries)) + b"".join(entries) + struct.pack(end + code, 0)
    struct.pack_into(end + code, body, 8 if big else 4, at)
    return bytes(body)


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("layout", [{}, {"tile": 16}, {"rows": 40}])
@pytest.mark.parametrize("packed", [{}, {"pack": zlib.compress, "compression": 8}, {"pack": lzw, "compression": 5}, {"pack": bits, "compression": 32773}])
def test_tiff_layouts(end, big, layout, packed):
    rng = np.random.default_rng(3)
    for dtype, shape in (("uint8", (37, 29)), ("int16", (37, 29, 3)), ("float32", (5, 4)), ("uint16", (40, 33))):
        image = (rng.integers(0, 6, shape) if dtype != "float32" else rng.random(shape)).astype(dtype)
        for more in ({}, {"planar": True}, {"predictor": dtype != "float32"}):
            np.testing.assert_array_equal(decode_tiff(tiff(image, end=end, big=big, **layout, **packed, **more))[0], image)


def test_tiff_odd_tags():
    image = np.arange(12, dtype="uint8").reshape(3, 4)
    np.testing.assert_array_equal(decode_tiff(tiff(image, counts=False, sample_format=False))[0], image)
    with pytest.raises(NotImplementedError, match="compression 7"):
        decode_tiff(tiff(image, compression=7))
    with pytest.raises(ValueError):
        decode_tiff(b"plain text")
    long = np.random.default_rng(1).integers(0, 256, 60_000, dtype="uint8").tobytes() + b"ab" * 3000
    assert unpack_lzw(lzw(long)) == long and unpack_bits(bits(long[-7000:])) == long[-7000:]


def test_pages_are_read_by_their_tasks(spark, tmp_path):
    """Two pages a partition, and nothing shuffles."""
    frames = np.arange(7 * 6 * 5, dtype="int32").reshape(7, 6, 5)
    (tmp_path / "a.tif").write_bytes(encode_tiff(frames))
    with pytest.warns(RuntimeWarning):
        image = imread(spark, str(tmp_path / "a.tif"), nframes=2)
    np.testing.assert_array_equal(image.to_numpy(), frames)
    assert "Exchange" not in image.df._jdf.queryExecution().executedPlan().toString()
    parts = image.df.groupBy(F.spark_partition_id()).agg(F.min("d0"), F.max("d0")).collect()
    assert sorted(tuple(r)[1:] for r in parts) == [(0, 1), (2, 3), (4, 5), (6, 6)]


def test_a_task_reads_its_own_ranges(tmp_path):
    """A page's directory and pieces, and of the others' directories only their heads."""
    frames = np.arange(50 * 40 * 30, dtype="int32").reshape(50, 40, 30)
    data, seen = encode_tiff(frames), []

    def read(at, size):
        seen.append((at, size))
        return data[at : at + size]

    places = list(tiff_directory(read))
    assert len(places) == 50 and sum(n for _, n in seen) < 50 * 64
    seen.clear()
    np.testing.assert_array_equal(frame_at("a.tif", read, places[31]), frames[31])
    assert sum(n for _, n in seen) < 40 * 30 * 4 + 300


def test_a_file_of_many_gigabytes(spark, tmp_path):
    """A BigTIFF whose pages lie beyond four gigabytes, with holes between them, and a large array."""
    image = np.arange(20, dtype="uint16").reshape(4, 5)
    page = tiff(image, big=True, rows=2)
    with open(tmp_path / "big.tif", "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 5 << 30))
        for k in range(3):
            at = (5 + k) << 30
            f.seek(at)
            data = 100 * k + image
            tags = [(256, 4, 5), (257, 4, 4), (258, 3, 16), (259, 3, 1), (273, 16, at + 512), (277, 3, 1), (278, 4, 4), (279, 4, 40), (339, 3, 1)]
            f.write(struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", t, kind, 1, v) for t, kind, v in tags) + struct.pack("<Q", (6 + k) << 30 if k < 2 else 0))
            f.seek(at + 512)
            f.write(data.astype("<u2").tobytes())
    np.testing.assert_array_equal(imread(spark, str(tmp_path / "big.tif")).to_numpy(), np.stack([100 * k + image for k in range(3)]))
    assert decode_tiff(page).shape == (1, 4, 5)
    with pytest.raises(ValueError, match="circle"):
        list(tiff_directory(reader_of(struct.pack("<2sHIHI", b"II", 42, 8, 0, 8))))


def test_arrays_in_either_order(spark, tmp_path):
    a = np.arange(60, dtype=">i4").reshape(5, 4, 3)
    np.save(tmp_path / "c.npy", a)
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    for name in "cf":
        image = imread(spark, str(tmp_path / f"{name}.npy"))
        assert image.dtype == "int32"
        np.testing.assert_array_equal(image.to_numpy(), a)


def test_written_frames_and_stacks(spark, tmp_path):
    """By the tasks that have the frames, a file each or one BigTIFF of all; read back by ranges."""
    for dtype in ("uint8", "int32", "float64"):
        a = np.random.default_rng(9).integers(0, 200, (13, 4, 5)).astype(dtype)
        image = Image.from_numpy(spark, a)
        write_stack(image, f"{tmp_path}/{dtype}.tif")
        np.testing.assert_array_equal(decode_tiff((tmp_path / f"{dtype}.tif").read_bytes()), a)
        np.testing.assert_array_equal(imread(spark, f"{tmp_path}/{dtype}.tif").to_numpy(), a)
        write_frames(image, f"{tmp_path}/{dtype}")
        assert len(list((tmp_path / dtype).glob("*.tif"))) == 13
        np.testing.assert_array_equal(imread(spark, f"{tmp_path}/{dtype}/*.tif").to_numpy(), a)
    with pytest.raises(ValueError):
        write_stack(Image.from_numpy(spark, np.zeros(3)), f"{tmp_path}/x.tif")


def test_a_stack_is_made_by_many_tasks(spark, tmp_path, monkeypatch):
    """Pages are made by a task a run of frames, and the runs' files are gone afterwards."""
    from gridloom.sources import imwrite

    monkeypatch.setattr(imwrite, "_RUN_PIXELS", 3 * 20)
    a = np.random.default_rng(10).integers(0, 200, (11, 4, 5)).astype("int32")
    monkeypatch.setattr(imwrite, "_run_frames", lambda shape, dtype, number, upto, pieces, made=imwrite._run_frames: _noted(tmp_path, number, upto, made(shape, dtype, number, upto, pieces)))
    write_stack(Image.from_numpy(spark, a), f"{tmp_path}/stack.tif")
    sizes = sorted(tuple(int(n) for n in p.name.split("-")) for p in (tmp_path / "noted").iterdir())
    assert sizes == [(0, 3), (3, 6), (6, 9), (9, 11)]
    np.testing.assert_array_equal(decode_tiff((tmp_path / "stack.tif").read_bytes()), a)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["noted", "stack.tif"]


def _noted(folder, number, upto, frames):
    (folder / "noted").mkdir(exist_ok=True)
    (folder / "noted" / f"{number}-{upto}").touch()
    return frames


def test_the_data_source_by_itself(spark, tmp_path):
    frames = np.arange(24, dtype="uint8").reshape(4, 2, 3)
    (tmp_path / "a.tif").write_bytes(encode_tiff(frames))
    spark.dataSource.register(FrameSource)
    df = spark.read.format("gridloom_frames").option("nframes", 3).load(str(tmp_path / "a.tif"))
    assert df.schema.simpleString() == "struct<d0:bigint,d1:bigint,d2:bigint,value:smallint>" and df.rdd.getNumPartitions() == 2
    assert df.filter("d0 = 2").agg(F.sum("value")).head()[0] == frames[2].sum()


def test_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    """Files come as rows of binaryFile; the results are the same."""
    from gridloom.sources import imread as module

    monkeypatch.setattr(module, "_reachable", lambda path: False)
    frames = np.arange(24, dtype="uint8").reshape(4, 2, 3)
    for k in (9, 10):
        (tmp_path / f"{k}.tif").write_bytes(encode_tiff(frames + k))
    np.testing.assert_array_equal(imread(spark, str(tmp_path / "9.tif")).to_numpy(), frames + 9)
    np.testing.assert_array_equal(imread(spark, str(tmp_path / "*.tif")).to_numpy(), np.stack([frames[0] + 9, frames[0] + 10]))


def test_no_files(spark, tmp_path):
    with pytest.raises(Exception, match="no image files|PATH_NOT_FOUND"):
        imread(spark, str(tmp_path / "none*.tif"))


def test_natural_order(spark, tmp_path):
    for k in (10, 9):
        (tmp_path / f"{k}.tif").write_bytes(encode_tiff(np.full((2, 1, 1), k, "int16")))
    assert imread(spark, str(tmp_path / "*.tif")).to_numpy().tolist() == [[[9]], [[10]]]
    assert sorted(["a10", "a9", "a"], key=natural_key) == ["a", "a9", "a10"]


def test_paths_are_numbered_as_they_sort(spark):
    """Over several partitions, with numbers of any length and equal ones."""
    rng = np.random.default_rng(8)
    paths = [f"file:/x/{'ab'[k % 2]}{rng.integers(0, 10 ** rng.integers(1, 12))}-{k}.tif" for k in range(300)] + ["file:/x/a007-1.tif", "file:/x/a7-1.tif"]
    got = numbered(spark.createDataFrame([(p,) for p in paths], "path string").repartition(5)).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(len(paths)))
    assert [natural_key(r.path) for r in got] == sorted(map(natural_key, paths))


def test_numpy_files_and_nframes(spark, tmp_path):
    a = np.arange(24.0).reshape(4, 2, 3)
    np.save(tmp_path / "a.npy", a)
    path = str(tmp_path / "a.npy")
    np.testing.assert_array_equal(imread(spark, path, nframes=2).to_numpy(), a)
    with pytest.warns(RuntimeWarning):
        np.testing.assert_array_equal(imread(spark, path, nframes=3).to_numpy(), a)
    with pytest.warns(RuntimeWarning):
        imread(spark, path, nframes=10)
    for bad in (0, -2, 1.5):
        with pytest.raises(ValueError):
            imread(spark, path, nframes=bad)


def test_tiles_prune(spark, tmp_path):
    a = np.arange(600).reshape(20, 30)
    path = str(tmp_path / "t")
    write_tiles(Image.from_numpy(spark, a), path, edge=8)
    image = read_tiles(spark, path)
    assert image.shape == a.shape and image.dtype == "int64"
    np.testing.assert_array_equal(image.to_numpy(), a)
    part = read_tiles(spark, path, [(3, 6), (9, 14)])
    assert sorted(r[0] for r in part.df.select("value").collect()) == sorted(a[3:6, 9:14].ravel().tolist())
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t0" in plan and "GreaterThanOrEqual(d0,3)" in plan


def test_from_sparse_fills_the_box(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (2, 0, 6.0), (9, 9, 7.0)], "d0 int, d1 int, value double")
    got = Image.from_sparse(df, (3, 2)).to_numpy()
    np.testing.assert_array_equal(got, [[0, 5], [0, 0], [6, 0]])


@pytest.mark.parametrize("mode", ["reflect", "mirror", "nearest", "wrap"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_fold(mode, n):
    i = np.arange(-12, 17)
    assert fold(i, n, mode).tolist() == [ref.fold(int(k), n, mode) for k in i]


def test_uint64_and_unknown_dtypes(spark):
    a = np.array([0, 2**64 - 1], np.uint64)
    assert [int(r.value) for r in Image.from_numpy(spark, a).df.orderBy("d0").collect()] == [0, 2**64 - 1]
    with pytest.raises(TypeError):
        Image.from_numpy(spark, np.array(["a"]))


def test_streamed_frames(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    frames = np.arange(12.0).reshape(2, 2, 3).astype("float32")
    (folder / "a.tif").write_bytes(encode_tiff(frames))
    pixels = frame_pixels(spark, str(folder))
    query = frame_statistics(pixels).writeStream.format("memory").queryName("frames").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("frames").select("frame", "mean", F.col("area")).orderBy("frame").collect()
    assert [tuple(r) for r in got] == [(0, 2.5, 6), (1, 8.5, 6)]
