import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Image, ndinterp, read_tiles, write_tiles
from gridloom.operators import interp

from . import reference

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def vast(spark, tmp_path_factory):
    """A source of 10,000 pixels a side in folders of 200, of which three hold pixels and another one is spoilt."""
    path = tmp_path_factory.mktemp("vast") / "tiles"
    near = [(k, j, i) for c in (150, 395, 9000) for k in range(c, c + 10) for j in range(c, c + 10) for i in range(c, c + 10)]
    pixels = spark.createDataFrame([(*p, float(p[0] + 2 * p[1] - p[2])) for p in near], "d0 bigint, d1 bigint, d2 bigint, value double")
    write_tiles(Image(pixels, (10_000,) * 3), str(path), edge=200)
    spoilt = path / "pixels" / "t0=20" / "t1=20" / "t2=20"
    spoilt.mkdir(parents=True)
    (spoilt / "part-0.parquet").write_bytes(b"not a table")
    return read_tiles(spark, str(path))


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters: ")[1].split("], ")[0] for line in plan.splitlines() if "PartitionFilters" in line and "t0#" in line]


@pytest.mark.parametrize("as_table", [False, True])
def test_few_points_of_a_vast_source(spark, vast, as_table):
    """Only the folders that the points touch are opened, some across their borders."""
    at = np.array([[152.5, 398.25, 9001.0], [155.0, 401.5, 9002.75], [153.25, 400.0, 9004.5]])
    points = spark.createDataFrame([(k, *map(float, c)) for k, c in enumerate(at.T)], "point_id bigint, c0 double, c1 double, c2 double") if as_table else at
    began = time.time()
    found = ndinterp.map_coordinates(vast, points, order=1)
    got = {r.point_id: r.value for r in found.collect()}
    assert time.time() - began < 60
    assert np.allclose([got[k] for k in range(3)], at[0] + 2 * at[1] - at[2])
    assert any("t0#" in f and "t2#" in f for f in partition_filters(found))


def test_one_voxel_of_a_vast_source(vast):
    began = time.time()
    out = ndinterp.affine_transform(vast, np.eye(3), [397.5, 400.25, 399.0], (1, 1, 1), order=1)
    assert np.isclose(out.to_numpy()[0, 0, 0], 397.5 + 2 * 400.25 - 399)
    assert time.time() - began < 60
    assert any("t0#" in f for f in partition_filters(out.df))


def test_points_of_one_place_are_shared_out(spark, monkeypatch):
    """A third and more of the points in one tile: it is copied for several shares, and every point is answered."""
    monkeypatch.setattr(interp, "_SHARE", 50)
    a = RNG.random((40, 30))
    rows = [(k, 3.25, 4.5) if k % 2 else (k, float(x), float(y)) for k, (x, y) in enumerate(zip(RNG.uniform(-2, 41, 600), RNG.uniform(-2, 31, 600)))]
    points = spark.createDataFrame(rows, "point_id bigint, c0 double, c1 double").repartition(3)
    for mode in interp.MODES:
        got = {r.point_id: r.value for r in ndinterp.map_coordinates(Image.from_numpy(spark, a), points, 3, mode, 0.5).collect()}
        assert len(got) == len(rows)
        assert np.allclose([got[k] for k, *_ in rows], [reference.sample(a, c, 3, mode, 0.5) for _, *c in rows])


def test_points_shuffle_a_row_each(spark):
    """The exchange that deals points has as many rows as there are points and tiles."""
    a, points = RNG.random((20, 20, 20)), RNG.uniform(1, 18, (3, 500))
    found = ndinterp.map_coordinates(Image.from_numpy(spark, a), points, order=5)
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "i0" not in plan


def test_several_tiles_and_odd_coordinates(spark, monkeypatch):
    """Tile borders, places beyond the image, and coordinates that are no numbers."""
    monkeypatch.setattr(interp, "edge_for", lambda low, high: 8)
    a = RNG.random((21, 17))
    x = np.array([[7.5, 8.0, 7.99, 20.0, 0.0, -0.01, 20.4, np.nan, np.inf, -3.0, 15.5], [7.5, 8.0, 16.0, 16.0, 0.0, 5.0, 5.0, 5.0, 5.0, -3.0, 8.25]])
    for order in range(6):
        for mode in interp.MODES:
            got = {r.point_id: r.value for r in ndinterp.map_coordinates(Image.from_numpy(spark, a), x, order, mode, 0.25).collect()}
            for k in range(x.shape[1]):
                if np.isfinite(x[:, k]).all():
                    assert np.isclose(got[k], reference.sample(a, x[:, k], order, mode, 0.25)), (order, mode, k)
                elif mode != "nearest":
                    assert got[k] == 0.25
    turned = ndinterp.rotate(Image.from_numpy(spark, a), 90)
    assert np.allclose(turned.to_numpy(), np.rot90(a))


def test_an_image_without_points(spark):
    none = spark.createDataFrame([], "point_id bigint, c0 double, c1 double")
    image = Image.from_numpy(spark, np.ones((3, 3)))
    assert ndinterp.map_coordinates(image, none).count() == 0
    far = ndinterp.affine_transform(image, np.eye(2), [100, 100], (2, 2), cval=7)
    assert (far.to_numpy() == 7).all()
    assert image.df.filter(F.lit(True)).count() == 9
