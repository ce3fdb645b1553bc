import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Blocks, Image, ndinterp
from gridloom.functions.kernels import prefilter_lines, prefilter_stretch, spline_depth
from gridloom.operators import interp

BOUNDARIES = {"mirror": "mirror", "nearest": "reflect", "grid-wrap": "wrap"}
RNG = np.random.default_rng(17)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("mode", BOUNDARIES)
def test_blocks_equal_whole_lines(spark, order, mode):
    """Blocks shorter than the filter's memory, so that a halo comes from several of them and from beyond the ends."""
    a = RNG.random((45, 31))
    want = prefilter_lines(prefilter_lines(a.T, order, BOUNDARIES[mode]).T, order, BOUNDARIES[mode])
    got = ndinterp.spline_filter(Blocks.from_image(Image.from_numpy(spark, a), 14), order, mode=mode)
    assert isinstance(got, Blocks)
    np.testing.assert_allclose(got.to_image().to_numpy(), want, atol=1e-12)
    one = ndinterp.spline_filter1d(Blocks.from_image(Image.from_numpy(spark, a), 14), order, 0, mode=mode)
    np.testing.assert_allclose(one.to_image().to_numpy(), prefilter_lines(a.T, order, BOUNDARIES[mode]).T, atol=1e-12)


def test_one_long_line_runs_in_many_tasks(spark):
    """Ten million samples; a hundred and more blocks, each equal to the filter of the whole line."""
    n = 10_000_000
    line = spark.range(n).select(F.col("id").alias("d0"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("value"))
    made = ndinterp.spline_filter1d(Image(line, (n,)), 3)
    samples = np.array(line.toArrow().sort_by("d0").column("value"))
    want = prefilter_lines(samples[None, :200_000], 3, "mirror")[0][:199_000]
    got = made.df.filter("d0 < 199000").toArrow().sort_by("d0").column("value").to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-9)
    parts = made.df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(parts) > 1 and sum(r["n"] for r in parts) == n and max(r["n"] for r in parts) < n


def test_depth_trades_exactness_for_locality(spark):
    a = RNG.random(200)
    want = prefilter_lines(a[None], 3, "mirror")[0]
    blocks = Blocks.from_image(Image.from_numpy(spark, a), 20)
    errors = [np.abs(ndinterp.spline_filter1d(blocks, 3, depth=d).to_image().to_numpy() - want).max() for d in (2, 6, 12, None)]
    assert errors == sorted(errors, reverse=True) and errors[0] > 1e-3 and errors[2] < 1e-5 and errors[3] < 1e-13
    strips = [sum(len(r.strip) for r in blocks.strips([d], [d], "mirror").collect()) for d in (2, 12)]
    assert strips[0] * 6 == strips[1]
    for bad in (-1, 2.5):
        with pytest.raises(ValueError):
            ndinterp.spline_filter(blocks, depth=bad)
    with pytest.raises(ValueError):
        ndinterp.spline_filter(blocks, depth=(3, 3))
    two = Image.from_numpy(spark, RNG.random((9, 8)))
    np.testing.assert_allclose(ndinterp.spline_filter(two, depth=(5, 50)).to_numpy(), ndinterp.spline_filter(two).to_numpy(), atol=1e-12)


def test_depths_of_the_poles():
    """As many samples as bring a pole's power below the tolerance."""
    assert [spline_depth(k, 1e-8) for k in range(2, 6)] == [11, 14, 19, 22] and spline_depth(1) == 0


@pytest.mark.parametrize("order", [2, 5])
def test_stretches_of_few_long_lines(order):
    a, depth = RNG.random((2, 5000)), spline_depth(order)
    want = prefilter_lines(a, order, "mirror")[:, depth:-depth]
    np.testing.assert_allclose(prefilter_stretch(a, order)[:, depth:-depth], want, atol=1e-12)


def test_a_prefilter_reads_only_around_its_points(spark, tmp_path):
    """Of a source in folders, with what the filter remembers around the box and no more."""
    from gridloom import read_tiles, write_tiles

    a = RNG.random((300, 260))
    write_tiles(Image.from_numpy(spark, a), str(tmp_path / "t"), edge=50)
    (tmp_path / "t" / "pixels" / "t0=0" / "t1=0" / "part-x.parquet").write_bytes(b"spoilt")
    whole = prefilter_lines(prefilter_lines(a.T, 3, "mirror").T, 3, "mirror")
    points = np.array([[171.25, 299.0, 240.5], [130.5, 180.0, 259.0]])
    source = read_tiles(spark, str(tmp_path / "t"))
    got = {r.point_id: r.value for r in ndinterp.map_coordinates(source, points, 3, prefilter=True).collect()}
    from . import reference

    assert np.allclose([got[k] for k in range(3)], [reference.sample(whole, p, 3) for p in points.T], atol=1e-9)
    out = ndinterp.affine_transform(source, np.eye(2), [200.5, 150.25], (4, 5), 3, prefilter=True).to_numpy()
    assert np.allclose(out, [[reference.sample(whole, (200.5 + i, 150.25 + j), 3) for j in range(5)] for i in range(4)], atol=1e-9)
    assert interp.spline_depth(3) < 50
