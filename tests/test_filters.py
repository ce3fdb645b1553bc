import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import Image
from gridloom.functions.kernels import gaussian_1d
from gridloom.operators import filters as nf

from . import reference as ref

MODES = ["reflect", "mirror", "nearest", "wrap", "constant"]
SMALL = np.arange(35.0).reshape(5, 7) ** 2 % 23
DISC = (np.indices((5, 5)) - 2.0)[0] ** 2 + (np.indices((5, 5)) - 2.0)[1] ** 2 < 2.5**2


def both(spark, function, array, *args, **kwargs):
    """The result by either strategy; they must agree."""
    image = Image.from_numpy(spark, array)
    a = function(image, *args, strategy="scatter", **kwargs).to_numpy()
    b = function(image, *args, strategy="tiles", **kwargs).to_numpy()
    np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-9)
    return a


@pytest.mark.parametrize("mode", MODES)
def test_correlate_and_convolve_modes(spark, mode):
    w = np.array([[1.0, -2, 3], [0, 5, -1]])
    got = both(spark, nf.correlate, SMALL, w, mode=mode, cval=2.5, origin=(0, 1))
    np.testing.assert_allclose(got, ref.correlate(SMALL, w, mode, 2.5, [0, 1]))
    got = both(spark, nf.convolve, SMALL, w, mode=mode, cval=2.5, origin=(0, -1))
    np.testing.assert_allclose(got, ref.convolve(SMALL, w, mode, 2.5, [0, -1]))


@pytest.mark.parametrize("shape", [(1, 5), (5, 1), (2, 2), (8, 8)])
@pytest.mark.parametrize("mode", ["reflect", "wrap"])
def test_kernels_as_large_as_the_image(spark, shape, mode):
    got = both(spark, nf.convolve, SMALL, np.ones(shape), mode=mode)
    np.testing.assert_allclose(got, ref.convolve(SMALL, np.ones(shape), mode))


def test_integral_images_truncate_once(spark):
    a = np.arange(-10, 10).reshape(4, 5)
    got = nf.correlate(Image.from_numpy(spark, a), np.full((1, 3), 0.3))
    assert got.dtype == "int64"
    np.testing.assert_array_equal(got.to_numpy(), np.trunc(ref.correlate(a, np.full((1, 3), 0.3))))


@pytest.mark.parametrize("axis", [0, 1, -1])
@pytest.mark.parametrize("name, smooth", [("sobel", [1, 2, 1]), ("prewitt", [1, 1, 1])])
def test_edges(spark, axis, name, smooth):
    a = np.arange(60.0).reshape(3, 4, 5) ** 2 % 37
    w = np.ones((1, 1, 1))
    for k in range(3):
        one = np.array([-1.0, 0, 1] if k == axis % 3 else smooth).reshape([3 if j == k else 1 for j in range(3)])
        w = w * one
    np.testing.assert_allclose(both(spark, getattr(nf, name), a, axis=axis), ref.correlate(a, w))


def test_laplace(spark):
    w = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])
    np.testing.assert_allclose(both(spark, nf.laplace, SMALL), ref.correlate(SMALL, w))


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_gaussian_weights_are_derivatives(order):
    """Correlating x ** order with weights of that order gives order! in the middle."""
    w = gaussian_1d(2.0, order, 8.0)
    x = np.arange(len(w)) - len(w) // 2
    assert abs((w * x.astype(float) ** order).sum() - np.prod(range(1, order + 1))) < 1e-6


@pytest.mark.parametrize("mode", ["reflect", "constant"])
def test_gaussian_family(spark, mode):
    passes = [gaussian_1d(s, 0, 2.0) for s in (1.0, 0.7)]

    def one(a, axis, w):
        return ref.correlate(a, np.asarray(w).reshape([-1 if k == axis else 1 for k in range(2)]), mode, 1.5)

    plain = one(one(SMALL, 0, passes[0]), 1, passes[1])
    np.testing.assert_allclose(both(spark, nf.gaussian_filter, SMALL, (1.0, 0.7), mode=mode, cval=1.5, truncate=2.0), plain)
    np.testing.assert_allclose(both(spark, nf.gaussian, SMALL, (1.0, 0.7), mode=mode, cval=1.5, truncate=2.0), plain)
    first = [gaussian_1d(1.0, 1, 2.0), gaussian_1d(1.0, 0, 2.0)]
    slopes = [one(one(SMALL, 0, first[axis]), 1, first[1 - axis]) for axis in (0, 1)]
    np.testing.assert_allclose(both(spark, nf.gaussian_gradient_magnitude, SMALL, 1.0, mode=mode, cval=1.5, truncate=2.0), np.hypot(*slopes), atol=1e-9)
    second = [gaussian_1d(1.0, 2, 2.0), gaussian_1d(1.0, 0, 2.0)]
    bends = [one(one(SMALL, 0, second[axis]), 1, second[1 - axis]) for axis in (0, 1)]
    np.testing.assert_allclose(both(spark, nf.gaussian_laplace, SMALL, 1.0, mode=mode, cval=1.5, truncate=2.0), sum(bends), atol=1e-9)


def test_gaussian_without_sigma_is_identity(spark):
    np.testing.assert_allclose(nf.gaussian_filter(Image.from_numpy(spark, SMALL), 0).to_numpy(), SMALL)


@pytest.mark.parametrize("size, origin", [(3, 0), ((2, 3), (0, 1)), ((1, 5), 0), (4, -1)])
def test_uniform(spark, size, origin):
    s = (size, size) if np.isscalar(size) else size
    o = [origin, origin] if np.isscalar(origin) else list(origin)
    np.testing.assert_allclose(both(spark, nf.uniform_filter, SMALL, size, origin=origin), ref.correlate(SMALL, np.full(s, 1 / np.prod(s)), origin=o))


@pytest.mark.parametrize("mode", ["reflect", "constant"])
@pytest.mark.parametrize("mask, origin", [(np.ones((3, 3), bool), 0), (DISC, (1, -1)), (np.ones((2, 3), bool), (0, 1))])
def test_order_filters(spark, mask, origin, mode):
    o = [0, 0] if origin == 0 else list(origin)
    n = int(mask.sum())
    kw = {"footprint": mask, "origin": origin, "mode": mode, "cval": 7.0}
    for function, args, r in [(nf.minimum_filter, (), 0), (nf.maximum_filter, (), n - 1), (nf.median_filter, (), n // 2), (nf.rank_filter, (1,), 1), (nf.rank_filter, (-2,), n - 2), (nf.percentile_filter, (40,), int(n * 40 / 100)), (nf.percentile_filter, (100,), n - 1), (nf.percentile_filter, (-20,), int(n * 80 / 100))]:
        got = both(spark, function, SMALL, *args, **kw)
        np.testing.assert_array_equal(got, ref.rank(SMALL, mask, r, mode, 7.0, o), err_msg=function.__name__)


def test_generic_python_and_native(spark):
    mask = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])
    want = np.array([v[0] + 10 * v[-1] for v in ref.neighbours(SMALL, mask != 0, [0, 0], "reflect", 0)]).reshape(SMALL.shape)
    image = Image.from_numpy(spark, SMALL)
    np.testing.assert_allclose(nf.generic_filter(image, lambda v, k: v[0] + k * v[-1], footprint=mask, extra_keywords={"k": 10}).to_numpy(), want)
    np.testing.assert_allclose(nf.generic_filter(image, lambda v: v[0] + 10 * F.element_at(v, -1), footprint=mask, native=True).to_numpy(), want)


GOLDEN = np.array([[0, 0, 1, 3, 5], [0, 1, 4, 3, 4], [1, 2, 5, 4, 1], [2, 4, 5, 2, 1], [4, 5, 1, 0, 0]])
ABOVE_MEAN = ["....T", "..T.T", "..TT.", ".TT..", "TT..."]
ABOVE_MEDIAN = ["....T", "..T..", "..T..", "..TT.", ".T..."]
SUMS = [[1, 7, 16, 29, 37], [5, 14, 23, 30, 30], [13, 24, 30, 29, 21], [25, 29, 28, 19, 10], [34, 31, 23, 10, 4]]


@pytest.mark.parametrize("method, want", [("gaussian", ABOVE_MEAN), ("mean", ABOVE_MEAN), ("median", ABOVE_MEDIAN)])
@pytest.mark.parametrize("strategy", ["scatter", "tiles"])
def test_threshold_goldens(spark, method, want, strategy):
    got = nf.threshold_local(Image.from_numpy(spark, GOLDEN), 3, method, strategy=strategy).to_numpy()
    assert ["".join("T" if v else "." for v in row) for row in GOLDEN > got] == want


def test_threshold_generic_and_offset(spark):
    image = Image.from_numpy(spark, GOLDEN)
    np.testing.assert_array_equal(nf.threshold_local(image, 3, "generic", param=np.sum, offset=2).to_numpy(), np.array(SUMS) - 2)


@pytest.mark.parametrize(
    "call, error",
    [
        (lambda im: nf.threshold_local(im, 3, "generic", param=1), ValueError),
        (lambda im: nf.threshold_local(im, 3, "none"), ValueError),
        (lambda im: nf.median_filter(im), RuntimeError),
        (lambda im: nf.median_filter(im, 3, np.ones((3, 3))), RuntimeError),
        (lambda im: nf.median_filter(im, footprint=np.ones(3)), RuntimeError),
        (lambda im: nf.median_filter(im, 1.5), TypeError),
        (lambda im: nf.correlate(im, np.ones((3, 3)), origin=2), ValueError),
        (lambda im: nf.correlate(im, np.ones((3, 3)), origin=(1, 2, 3)), RuntimeError),
        (lambda im: nf.correlate(im, np.ones((3, 3)), origin=0.5), TypeError),
        (lambda im: nf.gaussian_filter(im, (1, 2, 3)), RuntimeError),
        (lambda im: nf.gaussian_filter(im, 1j), TypeError),
        (lambda im: nf.sobel(im, axis=2), ValueError),
        (lambda im: nf.laplace(im, mode="none"), RuntimeError),
    ],
)
def test_arguments(spark, call, error):
    with pytest.raises(error):
        call(Image.from_numpy(spark, SMALL))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data())
def test_strategies_agree(spark, data):
    shape = data.draw(st.tuples(st.integers(1, 6), st.integers(1, 6)))
    size = data.draw(st.tuples(st.integers(1, 4), st.integers(1, 4)))
    mode = data.draw(st.sampled_from(MODES))
    a = np.random.default_rng(data.draw(st.integers(0, 99))).integers(0, 9, shape).astype(float)
    w = np.arange(1.0, np.prod(size) + 1).reshape(size)
    np.testing.assert_allclose(both(spark, nf.correlate, a, w, mode=mode, cval=1.0), ref.correlate(a, w, mode, 1.0))


def test_large_neighbourhoods_plan_at_once_and_copy_strips(spark, monkeypatch):
    """No product of kernels on the driver, and the same results however small strips are."""
    empty = spark.range(0).selectExpr("id AS d0", "id AS d1", "id AS d2", "0D AS value")
    with monkeypatch.context() as held:
        held.setattr(nf, "_stacks_by_scatter", lambda *a: pytest.fail("the product was formed"))
        nf.uniform_filter(Image(empty, (500, 500, 500), "float64"), 151)
    a = np.random.default_rng(2).integers(0, 90, (23, 19)).astype(float)
    view, mask = np.lib.stride_tricks.sliding_window_view(a, (7, 5)), np.ones((7, 5), bool)
    whole = np.partition(view[..., mask], 3, axis=-1)[..., 3]
    for cells in (1, 100, 2000, 10**6):
        monkeypatch.setattr(nf, "_STRIP_CELLS", cells)
        np.testing.assert_array_equal(nf._by_strips(view, mask, lambda x: np.partition(x, 3, axis=-1)[..., 3]), whole)
    image = Image.from_numpy(spark, a)
    for name, least in (("minimum_filter", np.min), ("maximum_filter", np.max)):
        got = getattr(nf, name)(image, (7, 5), strategy="tiles", origin=(1, -1), mode="mirror").to_numpy()
        near = ref.neighbours(a, mask, [1, -1], "mirror", 0.0)
        np.testing.assert_array_equal(got, np.array([least(v) for v in near]).reshape(a.shape))


@pytest.mark.parametrize("mode", MODES)
def test_scatter_over_many_tiles(spark, monkeypatch, mode):
    """Tiles of 8 pixels a side, whose borders every neighbourhood crosses; a row for each pixel."""
    from gridloom.plans import stencil

    monkeypatch.setattr(stencil, "_TILE_PIXELS", 64)
    array = np.random.default_rng(3).integers(0, 50, (21, 17)).astype(float)
    image = Image.from_numpy(spark, array)
    w = np.array([[1.0, -2, 3], [0, 5, -1]])
    found = nf.correlate(image, w, mode=mode, cval=2.5, origin=(0, 1), strategy="scatter")
    assert found.df.count() == array.size
    np.testing.assert_allclose(found.to_numpy(), ref.correlate(array, w, mode, 2.5, [0, 1]))
    wide = nf.maximum_filter(image, (3, 7), mode=mode, cval=2.5, origin=(-1, 3), strategy="scatter")
    np.testing.assert_allclose(wide.to_numpy(), nf.maximum_filter(image, (3, 7), mode=mode, cval=2.5, origin=(-1, 3), strategy="tiles").to_numpy())


def test_scatter_gathers_a_bounded_number_of_pixels_in_a_task(spark):
    """Tasks grow with the image, whatever the shuffle partitions, and the pixels move once."""
    from gridloom.plans.image import grid

    shape = (1500, 1100)
    image = Image(grid(spark, shape).withColumn("value", F.col("d0") + F.col("d1")).withColumn("value", F.col("value").cast("double")), shape)
    found = nf.correlate(image, np.ones((3, 3)), strategy="scatter").df
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1500 * 1100 and max(sizes) <= 4 << 16
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
