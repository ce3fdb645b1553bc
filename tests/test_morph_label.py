import numpy as np
import pytest

from gridloom import Image, label, structure
from gridloom.operators import morph as mo
from gridloom.operators.label import union_by_minimum

from . import reference as ref

BITS = np.random.default_rng(4).random((7, 9)) < 0.6
MASK = np.zeros((7, 9), bool)
MASK[2:6, 2:8] = True
CROSS = structure(2, 1)


@pytest.mark.parametrize(
    "kw",
    [
        {},
        {"structure": np.ones((3, 3)), "border_value": 1},
        {"iterations": 2, "origin": (0, 1)},
        {"iterations": 2, "mask": MASK, "border_value": 1},
        {"structure": np.array([[1, 0], [1, 1], [0, 1]]), "origin": (-1, 0)},
        {"structure": np.array([[0, 0, 0], [0, 0, 0], [0, 1, 1]]), "mask": MASK},
    ],
)
def test_erosion_and_dilation(spark, kw):
    image = Image.from_numpy(spark, BITS)
    s = np.asarray(kw.get("structure", CROSS)) != 0
    given = dict(kw)
    if "mask" in kw:
        given["mask"] = Image.from_numpy(spark, MASK)
    args = {"iterations": kw.get("iterations", 1), "mask": kw.get("mask"), "border": kw.get("border_value", 0), "origin": kw.get("origin")}
    eroded, dilated = ref.morph(BITS, s, True, **args), ref.morph(BITS, s, False, **args)
    np.testing.assert_array_equal(mo.binary_erosion(image, **given).to_numpy(), eroded)
    np.testing.assert_array_equal(mo.binary_dilation(image, **given).to_numpy(), dilated)
    np.testing.assert_array_equal(mo.binary_opening(image, **given).to_numpy(), ref.morph(eroded, s, False, **args))
    np.testing.assert_array_equal(mo.binary_closing(image, **given).to_numpy(), ref.morph(dilated, s, True, **args))


def test_duality(spark):
    """The dilation of the complement is the complement of the erosion by the turned structure."""
    s = np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]])
    a = mo.binary_dilation(Image.from_numpy(spark, ~BITS), s, border_value=0).to_numpy()
    b = mo.binary_erosion(Image.from_numpy(spark, BITS), s[::-1, ::-1], border_value=1).to_numpy()
    np.testing.assert_array_equal(a, ~b)


@pytest.mark.parametrize(
    "kw, error",
    [
        ({"structure": np.ones(3)}, RuntimeError),
        ({"structure": 1}, TypeError),
        ({"iterations": 1.5}, TypeError),
        ({"iterations": 0}, NotImplementedError),
        ({"mask": 1}, TypeError),
        ({"border_value": 0.5}, TypeError),
        ({"brute_force": True}, NotImplementedError),
        ({"brute_force": 1}, TypeError),
        ({"origin": 2}, ValueError),
    ],
)
def test_arguments(spark, kw, error):
    with pytest.raises(error):
        mo.binary_erosion(Image.from_numpy(spark, BITS), **kw)


def test_boolean_masks(spark):
    image = Image.from_numpy(spark, BITS)
    np.testing.assert_array_equal(mo.binary_erosion(image, mask=True).to_numpy(), mo.binary_erosion(image).to_numpy())
    np.testing.assert_array_equal(mo.binary_dilation(image, mask=False, iterations=3).to_numpy(), BITS != 0)


def test_mask_of_another_shape(spark):
    with pytest.raises(RuntimeError):
        mo.binary_dilation(Image.from_numpy(spark, BITS), mask=Image.from_numpy(spark, MASK[1:]))


def labelled(spark, array, **kw):
    out, n = label(Image.from_numpy(spark, array), **kw)
    return out.to_numpy(), n.head()[0]


@pytest.mark.parametrize("connectivity", [1, 2])
@pytest.mark.parametrize("edge", [3, 8])
def test_label_2d(spark, connectivity, edge):
    a = np.random.default_rng(42).random((11, 13)) < 0.45
    s = structure(2, connectivity)
    want, n = ref.components(a, s)
    got, m = labelled(spark, a, structure=s, edge=edge)
    assert m == n
    np.testing.assert_array_equal(got, want)


def test_label_3d(spark):
    a = np.random.default_rng(42).random((6, 5, 7)) < 0.3
    want, n = ref.components(a, structure(3, 1))
    got, m = labelled(spark, a, edge=4)
    assert m == n
    np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("wrap", [(0,), (1,), (0, 1)])
@pytest.mark.parametrize("connectivity", [1, 2])
def test_label_wrap(spark, wrap, connectivity):
    a = np.random.default_rng(3).random((8, 7)) < 0.4
    s = structure(2, connectivity)
    want, n = ref.components(a, s, wrap)
    got, m = labelled(spark, a, structure=s, wrap_axes=wrap, edge=4)
    assert m == n
    np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("connectivity, n", [(2, 1), (1, 2)])
def test_opposite_corners(spark, connectivity, n):
    a = np.zeros((3, 5), int)
    a[0, 0] = a[2, 4] = 1
    assert labelled(spark, a, structure=structure(2, connectivity), wrap_axes=(0, 1))[1] == n


def test_nothing_to_label(spark):
    got, n = labelled(spark, np.zeros((3, 4), int))
    assert n == 0 and not got.any()


def test_a_long_snake(spark):
    """One component that winds through many tiles."""
    a = np.zeros((9, 12), int)
    a[::2] = 1
    a[1::4, -1] = a[3::4, 0] = 1
    got, n = labelled(spark, a, edge=3)
    assert n == 1
    np.testing.assert_array_equal(got, a)


def test_union_by_minimum():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    want = np.arange(60)
    while True:
        new = want.copy()
        np.minimum.at(new, a, want[b])
        np.minimum.at(new, b, want[a])
        if (new == want).all():
            break
        want = new
    np.testing.assert_array_equal(union_by_minimum(60, a, b), want)
