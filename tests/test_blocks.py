from itertools import product

import numpy as np
import pytest

from gridloom import Blocks, Image, ndfilters, ndmorph
from gridloom.plans.blocks import edge_for, halo_share
from gridloom.plans.stencil import box_sums, running_extreme, sliding_rank, slides

from . import reference

PAD = {"reflect": "symmetric", "mirror": "reflect", "wrap": "wrap", "nearest": "edge", "constant": "constant"}


def padded(a, low, high, mode, cval):
    return np.pad(a, list(zip(low, high)), PAD[mode], **({"constant_values": cval} if mode == "constant" else {}))


def mixed(x, low, high):
    """Far corners and the centre of every neighbourhood, so that a strip in a wrong place shows."""
    size = [n - lo - hi for n, lo, hi in zip(x.shape, low, high)]
    out = np.zeros(size)
    for j, corner in enumerate(product((0, 1), repeat=x.ndim)):
        out += (j + 2) * x[tuple(slice(c * (lo + hi), c * (lo + hi) + n) for c, lo, hi, n in zip(corner, low, high, size))]
    return out + 11 * x[tuple(slice(lo, lo + n) for lo, n in zip(low, size))]


@pytest.mark.parametrize("mode", PAD)
def test_halo_is_the_padded_image(spark, mode):
    """Uneven blocks, reaches beyond a block and beyond the image, one to three dimensions."""
    rng = np.random.default_rng(1)
    for shape, edge, low, high in (((20,), 4, (9,), (25,)), ((13, 17), 5, (2, 7), (3, 1)), ((6, 7, 8), 3, (1, 2, 0), (4, 0, 1))):
        a = rng.random(shape)
        made = Blocks.from_image(Image.from_numpy(spark, a), edge).with_halo(low, high, mode, lambda x, at: mixed(x, low, high), 7.0)
        assert np.array_equal(made.to_image().to_numpy(), mixed(padded(a, low, high, mode, 7.0), low, high))


def test_blocks_hold_every_dtype(spark):
    for dtype in ("bool", "int16", "uint8", "uint64", "float32"):
        a = (np.arange(42).reshape(6, 7) % 5).astype(dtype)
        blocks = Blocks.from_image(Image.from_numpy(spark, a), 4)
        back = blocks.to_image()
        assert back.dtype == dtype and back.df.schema["value"].dataType == Image.from_numpy(spark, a).df.schema["value"].dataType
        assert np.array_equal(back.to_numpy(), a)
    halves = Blocks.from_image(Image.from_numpy(spark, np.arange(-6, 6).reshape(3, 4)), 2).map(lambda x: x / 2)
    assert np.array_equal(halves.to_image().to_numpy(), np.trunc(np.arange(-6, 6).reshape(3, 4) / 2))
    with pytest.raises(TypeError):
        Blocks.from_image(Image.from_numpy(spark, np.zeros((2, 2), complex)))


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line]


def test_filters_in_a_row_move_strips_only(spark):
    """The second filter's plan has one exchange, of what is cut out of the blocks."""
    a = np.random.default_rng(2).random((40, 36))
    blocks = Blocks.from_image(Image.from_numpy(spark, a), 16)
    once = ndfilters.gaussian_filter(blocks, 1.5).kept()
    twice = ndfilters.maximum_filter(once, 5)
    assert len(exchanges(twice.df)) == 1
    strips = sum(len(r.strip) for r in once.strips((2, 2), (2, 2), "reflect").collect())
    assert 0 < strips < 8 * a.size * 0.6
    assert len(exchanges(twice.map(np.sqrt).df)) == 1
    plain = ndfilters.maximum_filter(ndfilters.gaussian_filter(Image.from_numpy(spark, a), 1.5), 5)
    assert np.allclose(twice.to_image().to_numpy(), plain.to_numpy(), atol=1e-12)


def test_a_wide_reach_moves_little():
    """A halo of 20 in three dimensions: rows of pixels move once, and the strips are less than the image."""
    assert halo_share(edge_for((20,) * 3, (20,) * 3), (20,) * 3, (20,) * 3) < 1
    assert halo_share(edge_for((20, 20), (20, 20)), (20, 20), (20, 20)) < 0.5
    assert edge_for((75,) * 3, (75,) * 3) ** 3 <= 1 << 22


def test_wide_filters_of_volumes(spark):
    """Taken by blocks, as tiles would overlap by more than half."""
    a = np.random.default_rng(3).random((9, 14, 12))
    image = Image.from_numpy(spark, a)
    for mode in ("reflect", "constant"):
        found = ndfilters.uniform_filter(image, (9, 13, 11), mode=mode, cval=0.5, origin=(1, 0, -2)).to_numpy()
        want = a
        for axis, (n, o) in enumerate(zip((9, 13, 11), (1, 0, -2))):
            w = np.full([n if k == axis else 1 for k in range(3)], 1 / n)
            want = reference.correlate(want, w, mode, 0.5, [o if k == axis else 0 for k in range(3)])
        assert np.allclose(found, want, atol=1e-12)
    found = ndfilters.minimum_filter(image, (31, 1, 27), mode="mirror").to_numpy()
    assert np.array_equal(found, reference.rank(a, np.ones((31, 1, 27), bool), 0, "mirror"))


@pytest.mark.parametrize("name", ["median_filter", "generic_filter", "threshold_local", "correlate", "sobel", "gaussian_gradient_magnitude"])
def test_filters_of_blocks_equal_those_of_pixels(spark, name):
    a = np.random.default_rng(4).integers(0, 90, (19, 23)).astype(float)
    more = {"median_filter": (5,), "generic_filter": (np.ptp, 3), "threshold_local": (5, "mean", 2.5), "correlate": (np.arange(6.0).reshape(2, 3),), "sobel": (0,), "gaussian_gradient_magnitude": (1.2,)}[name]
    own = getattr(ndfilters, name)(Blocks.from_image(Image.from_numpy(spark, a), 8), *more)
    assert isinstance(own, Blocks)
    assert np.allclose(own.to_image().to_numpy(), getattr(ndfilters, name)(Image.from_numpy(spark, a), *more).to_numpy(), atol=1e-9)


def test_running_values_equal_windows():
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 50, (7, 23, 5)).astype(float)
    for axis in range(3):
        for size in range(1, a.shape[axis] + 1):
            view = np.lib.stride_tricks.sliding_window_view(a, size, axis)
            assert np.array_equal(running_extreme(a, size, axis, np.minimum), view.min(axis=-1))
            assert np.array_equal(running_extreme(a, size, axis, np.maximum), view.max(axis=-1))
            assert np.array_equal(box_sums(a, size, axis), view.sum(axis=-1))


def test_values_that_are_not_finite_stay_where_they_are(spark):
    a = np.ones((30, 4))
    a[3, 1] = np.nan
    found = ndfilters.uniform_filter(Image.from_numpy(spark, a), (11, 1), strategy="tiles").to_numpy()
    assert np.isnan(found).sum() == 9 and np.allclose(found[np.isfinite(found)], 1)


@pytest.mark.parametrize("erode", [True, False])
@pytest.mark.parametrize("masked", [False, True])
def test_many_iterations_in_one_exchange(spark, erode, masked):
    """With a mask, an origin and either border; of blocks and of pixels."""
    rng = np.random.default_rng(6)
    a = rng.random((17, 15)) < (0.9 if erode else 0.05)
    mask = rng.random(a.shape) < 0.8 if masked else None
    shape = np.array([[0, 1, 1], [1, 1, 0]])
    for border in (0, 1):
        want = reference.morph(a, shape, erode, 4, mask, border, [0, 1])
        image, free = Image.from_numpy(spark, a), None if mask is None else Image.from_numpy(spark, mask)
        run = ndmorph.binary_erosion if erode else ndmorph.binary_dilation
        made = run(image, shape, 4, free, border, (0, 1))
        assert np.array_equal(made.to_numpy(), want) and made.dtype == "bool"
        blocks = run(Blocks.from_image(image, 5), shape, 4, free, border, (0, 1))
        assert np.array_equal(blocks.to_image().to_numpy(), want)


def test_iterations_beyond_one_halo(spark, monkeypatch):
    """So many that they take several exchanges."""
    from gridloom.operators import morph

    monkeypatch.setattr(morph, "MOST_PIXELS", 1 << 8)
    a = np.zeros((30, 25), bool)
    a[4, 20] = True
    found = ndmorph.binary_dilation(Image.from_numpy(spark, a), iterations=11).to_numpy()
    assert np.array_equal(found, reference.morph(a, np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]]), False, 11))


def test_large_structures(spark):
    a = np.random.default_rng(7).random((21, 18)) < 0.04
    shapes = [np.ones((7, 6), bool), np.add.outer(np.arange(-4, 5) ** 2, np.arange(-4, 5) ** 2) < 18]
    for shape in shapes:
        image = Image.from_numpy(spark, a)
        assert np.array_equal(ndmorph.binary_dilation(image, shape).to_numpy(), reference.morph(a, shape, False))
        closed = reference.morph(reference.morph(a, shape, False), shape, True)
        assert np.array_equal(ndmorph.binary_closing(image, shape).to_numpy(), closed)


def test_sliding_ranks_equal_windows(monkeypatch):
    """One to three dimensions, ties, holes in the mask, values that are no numbers, few counters at a time."""
    from gridloom.plans import stencil

    rng = np.random.default_rng(8)
    for counters in (1 << 24, 300):
        monkeypatch.setattr(stencil, "_COUNTERS", counters)
        for shape, size in (((30, 40), (7, 9)), ((12, 13, 14), (3, 5, 4)), ((50,), (11,)), ((9, 9), (9, 9))):
            a = rng.integers(0, 30, shape).astype(float)
            a[tuple(s // 2 for s in shape)] = np.nan
            mask = rng.random(size) < 0.7
            view = np.lib.stride_tricks.sliding_window_view(a, size)[..., mask]
            for rank in (0, int(mask.sum()) // 2, int(mask.sum()) - 1):
                assert np.array_equal(sliding_rank(a, mask, rank), np.partition(view, rank, axis=-1)[..., rank], equal_nan=True)
    monkeypatch.undo()
    assert slides((256, 256), np.ones((51, 51)), 1 << 16) and not slides((256, 256), np.ones((3, 3)), 1 << 16)


@pytest.mark.parametrize("origin", [0, (3, -5)])
def test_wide_medians(spark, origin):
    a = np.random.default_rng(9).integers(0, 40, (40, 37)).astype(float)
    origins = [origin, origin] if origin == 0 else list(origin)
    found = ndfilters.median_filter(Image.from_numpy(spark, a), (13, 15), mode="mirror", origin=origin).to_numpy()
    assert np.array_equal(found, reference.rank(a, np.ones((13, 15), bool), 97, "mirror", origin=origins))


@pytest.mark.parametrize("mode", PAD)
def test_frames_of_spark_equal_tiles(spark, monkeypatch, mode):
    """Boxes as windows, in pieces shorter than a line; with origins that leave a pixel out of its own window."""
    from gridloom.plans import stencil

    monkeypatch.setattr(stencil, "_PIECE", 6)
    image = Image.from_numpy(spark, np.random.default_rng(10).integers(0, 99, (17, 14)).astype(float))
    for size, origin in (((5, 4), 0), ((15, 1), 0), ((3, 6), (1, 2)), ((4, 5), (-2, -2))):
        for run in (ndfilters.uniform_filter, ndfilters.minimum_filter, ndfilters.maximum_filter):
            made = run(image, size, mode=mode, cval=4.0, origin=origin, strategy="frames")
            assert "Arrow" not in made.df._jdf.queryExecution().executedPlan().toString()
            np.testing.assert_allclose(made.to_numpy(), run(image, size, mode=mode, cval=4.0, origin=origin, strategy="tiles").to_numpy(), atol=1e-9)
