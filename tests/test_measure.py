import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Image
from gridloom.operators import measure as nm

RNG = np.random.default_rng(11)
IMAGE = RNG.random((15, 16))
LABELS = sum((IMAGE < t).astype(int) for t in (0.5, 0.25, 0.125, 0.0625))
INDEX = [1, 2, 3, 4, 100, 0]


@pytest.fixture(scope="module")
def images(spark):
    return Image.from_numpy(spark, IMAGE), Image.from_numpy(spark, LABELS)


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("pos").collect()]


def groups(index):
    if index is None:
        return [LABELS > 0]
    return [LABELS == k for k in index]


@pytest.mark.parametrize("index", [None, INDEX, [3], 2])
@pytest.mark.parametrize(
    "name, function, default",
    [
        ("mean", np.mean, np.nan),
        ("variance", np.var, np.nan),
        ("standard_deviation", np.std, np.nan),
        ("median", np.median, np.nan),
        ("sum_labels", np.sum, 0),
        ("minimum", np.min, 0),
        ("maximum", np.max, 0),
        ("area", len, 0),
    ],
)
def test_statistics(images, name, function, default, index):
    got = column(getattr(nm, name)(*images, index), name)
    asked = [index] if isinstance(index, int) else index
    want = [function(IMAGE[m]) if m.any() else default for m in groups(asked)]
    np.testing.assert_allclose(got, want)


def test_labels_as_a_column(spark, images):
    image = images[0].with_df(images[0].df.withColumn("lab", F.when(F.col("value") < 0.5, 1).otherwise(2)))
    np.testing.assert_allclose(column(nm.mean(image, "lab", [1, 2]), "mean"), [IMAGE[IMAGE < 0.5].mean(), IMAGE[IMAGE >= 0.5].mean()])


def test_without_labels_the_index_is_ignored(images):
    assert column(nm.area(images[0], None, [1, 2]), "area") == [240]
    np.testing.assert_allclose(column(nm.mean(images[0], None, [1, 2]), "mean"), [IMAGE.mean()])


def test_area_example(spark):
    labels = Image.from_numpy(spark, np.array([[1, 1, 0], [1, 0, 3], [0, 7, 0]]))
    assert column(nm.area(labels, labels, [0, 1, 2, 3]), "area") == [4, 3, 0, 1]
    assert column(nm.area(labels, labels), "area") == [5]
    assert column(nm.area(labels), "area") == [9]


def test_negative_labels(spark):
    labels = Image.from_numpy(spark, np.array([[-1, 1], [2, 0]]))
    assert column(nm.sum_labels(labels, labels), "sum_labels") == [3]
    assert column(nm.sum_labels(labels, labels, [-1]), "sum_labels") == [-1]


@pytest.mark.parametrize("index", [None, INDEX])
def test_positions(images, index):
    low, high = column(nm.minimum_position(*images, index), "pos0", "pos1"), column(nm.maximum_position(*images, index), "pos0", "pos1")
    both = nm.extrema(*images, index)
    for k, m in enumerate(groups(index)):
        if m.any():
            at = np.flatnonzero(m)
            assert low[k] == tuple(np.unravel_index(at[IMAGE.ravel()[at].argmin()], IMAGE.shape))
            assert high[k] == tuple(np.unravel_index(at[IMAGE.ravel()[at].argmax()], IMAGE.shape))
        else:
            assert low[k] == high[k] == (0, 0)
    assert column(both, "min_pos0", "min_pos1") == low and column(both, "max_pos0", "max_pos1") == high


def test_ties_take_the_first(spark):
    image = Image.from_numpy(spark, np.array([[1, 3, 3], [0, 0, 3]]))
    assert column(nm.maximum_position(image), "pos0", "pos1") == [(0, 1)]
    assert column(nm.minimum_position(image), "pos0", "pos1") == [(1, 0)]


def test_nan_spreads(spark):
    image = Image.from_numpy(spark, np.array([[1.0, np.nan], [0.0, np.nan]]))
    for name in ("minimum", "maximum", "median", "mean"):
        assert np.isnan(column(getattr(nm, name)(image), name)[0])
    assert column(nm.minimum_position(image), "pos0", "pos1") == column(nm.maximum_position(image), "pos0", "pos1") == [(0, 1)]


@pytest.mark.parametrize("dtype", ["bool", "int16", "uint8", "uint16", "uint32", "uint64", "int64", "float32", "float64"])
def test_center_of_mass_dtypes(spark, dtype):
    image = Image.from_numpy(spark, np.array([[1, 1], [0, 0]]).astype(dtype))
    assert column(nm.center_of_mass(image), "com0", "com1") == [(0.0, 0.5)]


def test_center_of_mass(images, spark):
    got = column(nm.center_of_mass(*images, INDEX), "com0", "com1")
    for g, m in zip(got, groups(INDEX)):
        want = [(IMAGE[m] * at[m]).sum() / IMAGE[m].sum() if m.any() else np.nan for at in np.indices(IMAGE.shape)]
        np.testing.assert_allclose(g, want)
    zero = column(nm.center_of_mass(Image.from_numpy(spark, np.array([1.0, -1.0]))), "com0")
    assert zero == [float("-inf")]


@pytest.mark.parametrize("bounds", [(0, 1, 5), (0.0, 1.9, 7.5)])
def test_histogram(images, bounds):
    low, high, bins = (int(b) for b in bounds)
    got = column(nm.histogram(images[0], *bounds, images[1], INDEX), "counts")
    want = [np.histogram(IMAGE[m], bins, (low, high))[0].tolist() if m.any() else None for m in groups(INDEX)]
    assert got == want


def test_histogram_edges(spark):
    values = np.concatenate([np.linspace(-1, 3, 41), np.arange(0, 21) * 0.1])
    got = column(nm.histogram(Image.from_numpy(spark, values), 0, 2, 20), "counts")
    assert got == [np.histogram(values, 20, (0, 2))[0].tolist()]


def test_labeled_comprehension(images):
    got = column(nm.labeled_comprehension(*images, INDEX, lambda v: v[-1] - v[0], "double", -1), "result")
    np.testing.assert_allclose(got, [IMAGE[m][-1] - IMAGE[m][0] if m.any() else -1 for m in groups(INDEX)])
    got = column(nm.labeled_comprehension(*images, INDEX, lambda v, at: int(at.sum()), "bigint", 0, pass_positions=True), "result")
    assert got == [int(np.flatnonzero(m).sum()) for m in groups(INDEX)]
    got = column(nm.labeled_comprehension(*images, [4, 9], np.sort, "array<double>", None), "result")
    assert got == [sorted(IMAGE[LABELS == 4]), None]


def test_index_of_more_dimensions_warns(images):
    with pytest.warns(FutureWarning):
        assert len(column(nm.mean(*images, [[1, 2], [3, 4]]), "mean")) == 4


def test_sum_is_deprecated(images):
    with pytest.warns(DeprecationWarning):
        nm.sum(*images)


def test_shapes_must_agree(spark, images):
    with pytest.raises(ValueError):
        nm.mean(images[0], Image.from_numpy(spark, np.zeros((3, 3), int)))


def boxes(labels):
    return {r[0]: tuple(r)[1:] for r in nm.find_objects(labels).collect()}


def test_find_objects(spark):
    a = np.zeros((5, 10), int)
    a[1:3, 0:2], a[3, 3:8], a[0:2, 7:10] = 111, 222, 333
    assert boxes(Image.from_numpy(spark, a)) == {111: (1, 3, 0, 2), 222: (3, 4, 3, 8), 333: (0, 2, 7, 10)}
    b = np.zeros((6, 6), int)
    b[1:3, 0:2], b[4, 3:6] = 111, 222
    b[0, 5] = -4
    assert boxes(Image.from_numpy(spark, b)) == {111: (1, 3, 0, 2), 222: (4, 5, 3, 6), -4: (0, 1, 5, 6)}
    with pytest.raises(ValueError):
        nm.find_objects(Image.from_numpy(spark, b.astype(float)))


def test_one_shuffle_and_no_python(images):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        image = images[0].with_df(images[0].df.withColumn("lab", F.lit(1)))
        plan = nm.mean(image, "lab", [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan


def test_index_as_a_table(spark):
    """Labels asked for by a DataFrame; a missing one gets the default."""
    a = np.arange(12.0).reshape(3, 4)
    labels = np.array([[1, 1, 2, 0], [2, 2, 7, 7], [0, 1, 7, 2]])
    image, label_image = Image.from_numpy(spark, a), Image.from_numpy(spark, labels)
    index = spark.createDataFrame([(3, 7), (1, 2), (0, 99)], "pos int, label int")
    rows = nm.sum_labels(image, label_image, index).orderBy("pos").collect()
    assert [(r.pos, r.label, r.sum_labels) for r in rows] == [(0, 99, 0.0), (1, 2, a[labels == 2].sum()), (3, 7, a[labels == 7].sum())]
    found = {r.label: r.mean for r in nm.mean(image, label_image, index.select("label")).collect()}
    assert found[7] == a[labels == 7].mean() and np.isnan(found[99])


def test_histogram_of_equal_bounds(spark):
    image = Image.from_numpy(spark, np.array([[1.0, 2.0], [1.4, 3.0]]))
    assert nm.histogram(image, 1, 1, 4).collect()[0].counts == np.histogram([1, 2, 1.4, 3], 4, (1, 1))[0].tolist()
    with pytest.raises(ValueError):
        nm.histogram(image, 2, 1, 4)


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 1001])
def test_median_over_many_ranges(spark, size):
    """Few and many distinct values, even and odd numbers, over more ranges than values."""
    rng = np.random.default_rng(size)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for a in (rng.integers(0, 4, (1, size)).astype(float), rng.normal(size=(1, size))):
            assert nm.median(Image.from_numpy(spark, a)).collect()[0].median == np.median(a)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
