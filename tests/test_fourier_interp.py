import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Image, read_tiles, write_tiles
from gridloom.functions.kernels import poles, prefilter_lines
from gridloom.operators import fourier as nf
from gridloom.operators import interp as ni

from . import reference as ref

RNG = np.random.default_rng(8)
REAL = RNG.random((6, 7))
COMPLEX = REAL + 1j * RNG.random((6, 7))


def grids(shape, axis=-1, n=-1):
    f = [np.fft.rfftfreq(n) if n > 0 and k == axis % len(shape) else np.fft.fftfreq(s) for k, s in enumerate(shape)]
    return np.meshgrid(*f, indexing="ij")


@pytest.mark.parametrize("array", [REAL, COMPLEX, np.arange(42).reshape(6, 7)])
@pytest.mark.parametrize("n, axis", [(-1, -1), (12, 1), (13, 1), (10, 0), (11, 0)])
def test_fourier(spark, array, n, axis):
    image, s = Image.from_numpy(spark, array), (1.5, -0.5)
    f = grids(array.shape, axis, n)
    gaussian = np.exp(-sum((v * 2 * np.pi * g) ** 2 / 2 for v, g in zip(s, f)))
    uniform = np.prod([np.sinc(v * g) for v, g in zip(s, f)], axis=0)
    shift = np.exp(-2j * np.pi * sum(v * g for v, g in zip(s, f)))
    np.testing.assert_allclose(nf.fourier_gaussian(image, s, n, axis).to_numpy(), array * gaussian, atol=1e-12)
    np.testing.assert_allclose(nf.fourier_uniform(image, s, n, axis).to_numpy(), array * uniform, atol=1e-12)
    np.testing.assert_allclose(nf.fourier_shift(image, s, n, axis).to_numpy(), array * shift, atol=1e-12)


def test_a_whole_shift_rolls(spark):
    spectrum = Image.from_numpy(spark, np.fft.fft2(REAL))
    moved = np.fft.ifft2(nf.fourier_shift(spectrum, (1, -2)).to_numpy()).real
    np.testing.assert_allclose(moved, np.roll(REAL, (1, -2), (0, 1)), atol=1e-12)


def test_fourier_has_no_shuffle(spark):
    plan = nf.fourier_gaussian(Image.from_numpy(spark, REAL), 1).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("value, n, error", [(1j, -1, TypeError), ((1, 2, 3), -1, RuntimeError), (1, 5, NotImplementedError)])
def test_fourier_arguments(spark, value, n, error):
    with pytest.raises(error):
        nf.fourier_gaussian(Image.from_numpy(spark, REAL), value, n)


def affine_reference(a, matrix, offset, shape, order, mode, cval):
    out = np.zeros(shape)
    for place in np.ndindex(*shape):
        out[place] = ref.sample(a, matrix @ np.array(place) + offset, order, mode, cval)
    return out


@pytest.mark.parametrize("order", range(6))
@pytest.mark.parametrize("mode", ["constant", "nearest", "grid-constant"])
def test_affine(spark, order, mode):
    matrix, offset = np.array([[0.9, 0.27], [-0.31, 1.13]]), np.array([0.41, -0.77])
    got = ni.affine_transform(Image.from_numpy(spark, REAL), matrix, offset, (5, 6), order, mode=mode, cval=1.5).to_numpy()
    np.testing.assert_allclose(got, affine_reference(REAL, matrix, offset, (5, 6), order, mode, 1.5), atol=1e-9)


def test_affine_forms_agree(spark):
    image = Image.from_numpy(spark, REAL)
    scale = ni.affine_transform(image, [0.5, 1.5], [0.2, 0.1]).to_numpy()
    np.testing.assert_allclose(ni.affine_transform(image, np.diag([0.5, 1.5]), [0.2, 0.1]).to_numpy(), scale)
    wide = np.array([[0.5, 0, 0.2], [0, 1.5, 0.1]])
    np.testing.assert_allclose(ni.affine_transform(image, wide, 99).to_numpy(), scale)
    np.testing.assert_allclose(ni.affine_transform(image, np.vstack([wide, [0, 0, 1]])).to_numpy(), scale)
    np.testing.assert_allclose(scale, affine_reference(REAL, np.diag([0.5, 1.5]), np.array([0.2, 0.1]), REAL.shape, 1, "constant", 0), atol=1e-12)


def test_affine_reads_only_what_it_reaches(spark, tmp_path):
    a = np.arange(400.0).reshape(20, 20)
    write_tiles(Image.from_numpy(spark, a), str(tmp_path / "t"), edge=8)
    out = ni.affine_transform(read_tiles(spark, str(tmp_path / "t")), np.eye(2), [3.25, 4.5], (4, 5))
    np.testing.assert_allclose(out.to_numpy(), affine_reference(a, np.eye(2), np.array([3.25, 4.5]), (4, 5), 1, "constant", 0))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d0,1)" in plan and "LessThanOrEqual(d0,9)" in plan


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_prefiltered_interpolation_returns_the_samples(spark, order):
    got = ni.affine_transform(Image.from_numpy(spark, REAL), np.eye(2), order=order, prefilter=True).to_numpy()
    np.testing.assert_allclose(got, REAL, atol=1e-9)


@pytest.mark.parametrize(
    "kw, error",
    [
        ({"matrix": np.eye(2), "mode": "reflect"}, NotImplementedError),
        ({"matrix": np.eye(2), "order": 3, "mode": "nearest", "prefilter": True}, NotImplementedError),
        ({"matrix": np.ones((3, 3))}, ValueError),
        ({"matrix": np.eye(4)}, RuntimeError),
        ({"matrix": np.eye(2), "order": 6}, RuntimeError),
    ],
)
def test_affine_arguments(spark, kw, error):
    with pytest.raises(error):
        ni.affine_transform(Image.from_numpy(spark, REAL), **kw)


@pytest.mark.parametrize("turns", [1, 2, 3, -1])
def test_quarter_turns(spark, turns):
    got = ni.rotate(Image.from_numpy(spark, REAL), 90 * turns).to_numpy()
    np.testing.assert_allclose(got, np.rot90(REAL, turns), atol=1e-12)


@pytest.mark.parametrize("reshape", [True, False])
@pytest.mark.parametrize("angle", [30, -200.5])
def test_rotate(spark, angle, reshape):
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    turn, plane = np.array([[c, s], [-s, c]]), np.array(REAL.shape)
    shape = plane
    if reshape:
        corners = turn @ np.array([[0, 0, 6, 6], [0, 7, 0, 7]])
        shape = (np.ptp(corners, axis=1) + 0.5).astype(int)
    offset = (plane - 1) / 2 - turn @ ((shape - 1) / 2)
    got = ni.rotate(Image.from_numpy(spark, REAL), angle, reshape=reshape).to_numpy()
    np.testing.assert_allclose(got, affine_reference(REAL, turn, offset, tuple(shape), 1, "constant", 0), atol=1e-9)


def test_rotate_complex_and_planes(spark):
    np.testing.assert_allclose(ni.rotate(Image.from_numpy(spark, COMPLEX), 90).to_numpy(), np.rot90(COMPLEX), atol=1e-12)
    cube = RNG.random((2, 3, 4))
    np.testing.assert_allclose(ni.rotate(Image.from_numpy(spark, cube), 90, axes=(0, 2)).to_numpy(), np.rot90(cube, 1, (0, 2)), atol=1e-12)


@pytest.mark.parametrize("axes", [(0,), (0.5, 1), (0, 2), (0, -3)])
def test_rotate_axes(spark, axes):
    with pytest.raises(ValueError):
        ni.rotate(Image.from_numpy(spark, REAL), 10, axes)


@pytest.mark.parametrize("order", [0, 1, 3])
@pytest.mark.parametrize("mode", ["constant", "nearest", "grid-constant"])
def test_map_coordinates(spark, order, mode):
    points = RNG.random((2, 12)) * 8 - 1
    got = dict(ni.map_coordinates(Image.from_numpy(spark, REAL), points, order, mode, 0.5).collect())
    want = [ref.sample(REAL, p, order, mode, 0.5) for p in points.T]
    np.testing.assert_allclose([got[k] for k in range(12)], want, atol=1e-9)


@pytest.mark.parametrize("mode", ["constant", "nearest", "grid-constant"])
def test_few_points_read_their_box_only(spark, mode):
    """Small boxes inside, at an end and outside of an image, whose other pixels aren't read."""
    a = RNG.random((40, 30))
    whole = Image.from_numpy(spark, a)
    for low in ([20, 11], [-0.9, 28.2], [38.6, 0.1], [44, -7]):
        points = RNG.random((2, 4)) * 0.8 + np.array(low)[:, None]
        found = ni.map_coordinates(whole, points, 3, mode, 0.5)
        np.testing.assert_allclose([v for _, v in sorted(found.collect())], [ref.sample(a, p, 3, mode, 0.5) for p in points.T], atol=1e-9)
        near = (np.abs(np.indices(a.shape) - np.clip(np.array(low), 0, [39, 29])[:, None, None]) < 8).all(axis=0)
        holed = Image.from_numpy(spark, np.where(near, a, np.nan))
        np.testing.assert_allclose([v for _, v in sorted(ni.map_coordinates(holed, points, 3, mode, 0.5).collect())], [v for _, v in sorted(found.collect())], atol=1e-9)


def test_map_coordinates_arguments(spark):
    image = Image.from_numpy(spark, REAL)
    with pytest.raises(NotImplementedError):
        ni.map_coordinates(image, np.zeros((2, 1)), mode="wrap")
    with pytest.raises(RuntimeError):
        ni.map_coordinates(image, np.zeros((3, 1)))


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("boundary, mode", [("mirror", "mirror"), ("reflect", "reflect"), ("wrap", "wrap")])
def test_prefilter_inverts_the_spline(order, boundary, mode):
    a = RNG.random(9)
    c = prefilter_lines(a[None], order, boundary)[0]
    back = [sum(ref.bspline(i - k, order) * ref.at(c, [k], mode, 0) for k in range(i - 4, i + 5)) for i in range(9)]
    np.testing.assert_allclose(back, a, atol=1e-12)
    assert all(-1 < z < 0 for z in poles(order))


@pytest.mark.parametrize("array", [REAL, COMPLEX])
def test_spline_filter(spark, array):
    want = prefilter_lines(prefilter_lines(array.T, 3, "mirror").T, 3, "mirror")
    np.testing.assert_allclose(ni.spline_filter(Image.from_numpy(spark, array)).to_numpy(), want, atol=1e-12)
    one = ni.spline_filter1d(Image.from_numpy(spark, array), 3, 0, mode="grid-wrap").to_numpy()
    np.testing.assert_allclose(one, prefilter_lines(array.T, 3, "wrap").T, atol=1e-12)


def test_spline_filter_low_orders_and_arguments(spark):
    image = Image.from_numpy(spark, REAL)
    np.testing.assert_allclose(ni.spline_filter(image, 1).to_numpy(), REAL)
    assert ni.spline_filter(image, output="float32").dtype == "float32"
    with pytest.raises(NotImplementedError):
        ni.spline_filter(image, mode="wrap")
    with pytest.raises(TypeError):
        ni.spline_filter(image, output="nothing")
    with pytest.raises(ValueError):
        ni.spline_filter1d(image, depth=(1, 2))
