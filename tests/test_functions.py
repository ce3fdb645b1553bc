import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Blocks, Image, ndfilters, ndmeasure

RNG = np.random.default_rng(23)
#: Count, sum and largest value, and where that is first.
STATS = ndmeasure.Mergeable(
    lambda: (0, 0.0, -np.inf, 1 << 62),
    lambda s, v, at: STATS.merge(s, (len(v), float(v.sum()), float(v.max()), int(at[v == v.max()].min()))),
    lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2]), min(x[3] for x in (a, b) if x[2] == max(a[2], b[2]))),
    lambda s: [float(s[0]), s[1], s[2], float(s[3])],
)


@pytest.mark.parametrize("dtype", ["float64", "int16", "uint64", "bool"])
def test_mergeable_equals_all_values_at_once(spark, dtype):
    a = RNG.integers(0, 2 if dtype == "bool" else 50, (23, 17)).astype(dtype)
    labels = RNG.integers(0, 6, a.shape)
    image = Image.from_numpy(spark, a)
    image = image.with_df(image.df.repartition(5))
    found = ndmeasure.labeled_comprehension(image, Image.from_numpy(spark, labels), [1, 3, 99, 1], STATS, "array<double>", None).collect()
    for r in found:
        own = a[labels == r.label].astype(float)
        if r.label == 99:
            assert r.result is None
        else:
            at = np.flatnonzero((labels == r.label).ravel() & (a.ravel() == own.max()))[0]
            assert np.allclose(r.result, [own.size, own.sum(), own.max(), at])
    whole = ndmeasure.labeled_comprehension(image, None, None, STATS, "array<double>", None).collect()
    assert len(whole) == 1 and np.allclose(whole[0].result[:3], [a.size, a.astype(float).sum(), a.max()])


def test_states_are_made_where_the_pixels_are(spark, monkeypatch):
    """Before the shuffle there are as many rows as tasks and labels, even where a task can't hold all labels."""
    a = RNG.random((40, 40))
    image = Image.from_numpy(spark, a)
    image = image.with_df(image.df.repartition(7))
    count = ndmeasure.Mergeable(lambda: 0, lambda s, v, at: s + len(v), lambda a, b: a + b)
    found = ndmeasure.labeled_comprehension(image, None, None, count, "bigint", 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("MapInArrow partial")
    assert found.head().result == a.size
    monkeypatch.setattr(ndmeasure, "_STATES", 2)
    labels = Image.from_numpy(spark, RNG.integers(1, 30, a.shape))
    assert sum(r.result for r in ndmeasure.labeled_comprehension(image, labels, list(range(1, 30)), count, "bigint", 0).collect()) == a.size


def test_native_aggregates(spark):
    a, labels = RNG.random((9, 8)), RNG.integers(0, 3, (9, 8))
    found = ndmeasure.labeled_comprehension(Image.from_numpy(spark, a), Image.from_numpy(spark, labels), [0, 2, 7], lambda v, at: F.max_by(at, v), "bigint", -1, pass_positions=True, native=True)
    got = {r.label: r.result for r in found.collect()}
    assert got == {k: int(np.where(labels == k, a, -1).argmax()) for k in (0, 2)} | {7: -1}
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_plain_functions_see_every_dtype(spark):
    for dtype in ("bool", "uint64", "float32"):
        a = RNG.integers(0, 2, (4, 5)).astype(dtype)
        got = ndmeasure.labeled_comprehension(Image.from_numpy(spark, a), None, None, lambda v, at: [float(x) for x in v], "array<double>", None, pass_positions=True).head().result
        assert got == a.astype(float).ravel().tolist()


@pytest.mark.parametrize("blocks", [False, True])
def test_vectorized_functions(spark, blocks):
    """The same values in far fewer calls; a footprint, an origin, further arguments."""
    a = RNG.random((30, 26))
    image = Image.from_numpy(spark, a)
    image = Blocks.from_image(image, 11) if blocks else image
    foot, calls = np.array([[1, 0, 1], [0, 1, 1]]), spark.sparkContext.accumulator(0)

    def spread(x, q, scale=1.0):
        calls.add(1)
        return scale * (np.quantile(x, q, axis=1) - x[:, 0])

    made = ndfilters.generic_filter(image, spread, footprint=foot, origin=(0, 1), mode="mirror", extra_arguments=(0.75,), extra_keywords={"scale": 2.0}, vectorized=True)
    plain = ndfilters.generic_filter(image, lambda x, q, scale: scale * (np.quantile(x, q) - x[0]), footprint=foot, origin=(0, 1), mode="mirror", extra_arguments=(0.75,), extra_keywords={"scale": 2.0})
    made, plain = (x.to_image() if blocks else x for x in (made, plain))
    np.testing.assert_allclose(made.to_numpy(), plain.to_numpy())
    assert 0 < calls.value * 10 < a.size


def test_histograms_of_many_bins(spark):
    """Edges are computed, so a plan doesn't grow with the bins."""
    a = np.concatenate([RNG.uniform(-3, 12, 4000), np.linspace(0, 10, 1001), [10.0, 0.0, np.nan]])
    found = ndmeasure.histogram(Image.from_numpy(spark, a), 0, 10, 100_000)
    assert found.head().counts == np.histogram(a[~np.isnan(a)], 100_000, (0, 10))[0].tolist()
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


@pytest.mark.parametrize("index", [[[1, 2, 3, 4]], [[1, 2], [3, 4]], [[[1], [2], [3], [4]]]])
def test_an_index_of_several_dimensions(spark, index):
    """Each row tells its place in the index."""
    a, labels = RNG.random((15, 16)), RNG.integers(0, 4, (15, 16))
    image, marked = Image.from_numpy(spark, a), Image.from_numpy(spark, labels)
    index = np.array(index)
    with pytest.warns(FutureWarning):
        found = ndmeasure.mean(image, marked, index).collect()
    out = np.zeros(index.shape)
    for r in found:
        at = tuple(r[f"i{k}"] for k in range(index.ndim))
        assert index[at] == r.label and np.ravel_multi_index(at, index.shape) == r.pos
        out[at] = r.mean
    want = [a[labels == k].mean() if (labels == k).any() else np.nan for k in index.ravel()]
    np.testing.assert_allclose(out.ravel(), want)
    with pytest.warns(FutureWarning):
        assert ndmeasure.maximum_position(image, marked, index).columns == ["pos", "label", *(f"i{k}" for k in range(index.ndim)), "pos0", "pos1"]
    assert ndmeasure.mean(image, marked, [1, 2]).columns == ["pos", "label", "mean"]


def test_thresholds_of_a_vectorized_function(spark):
    image = Image.from_numpy(spark, RNG.random((12, 9)))
    many = ndfilters.threshold_local(image, 3, "generic", param=lambda x: x.max(axis=1) / 2, offset=0.1, vectorized=True)
    one = ndfilters.threshold_local(image, 3, "generic", param=lambda x: x.max() / 2, offset=0.1)
    np.testing.assert_allclose(many.to_numpy(), one.to_numpy())
