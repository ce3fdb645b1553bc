"""Statistics of an image's pixels by label.

``label_image`` is an image of the same shape or the name of a column of the pixel table (which
needs no join). Without it every pixel counts and ``index`` is ignored; with it but without an
index all labels above zero count together; with an index there is a row for each of its labels,
in order, and a label without pixels gets the statistic's default. An index may also be a
DataFrame (label, and pos if wanted), which never passes through the driver. All labels asked for take
one aggregation: partial sums are combined before the shuffle.

Results are DataFrames (pos, label, ...): pos is the place in the flattened index, and label is
null where all pixels count together. For an index of several dimensions, i0, i1, ... are the
place in it. NaN values give NaN, as in NumPy.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.image import Image
from ..plans.scratch import materialize

_NAN = float("nan")


def _labelled(image: Image, label_image) -> DataFrame:
    if isinstance(label_image, str):
        return image.df.withColumn("label", F.col(label_image).cast("bigint"))
    if label_image.shape != image.shape:
        raise ValueError("The image and the labels must have the same shape.")
    if label_image.df is image.df:
        return image.df.withColumn("label", F.col("value").cast("bigint"))
    value = label_image.df.select(*image.coords, F.col("value").cast("bigint").alias("label"))
    return image.df.join(value, image.coords)


class _Asked(list):
    """The labels of an index, flattened, and the shape that it had."""

    def __init__(self, labels: np.ndarray):
        super().__init__(int(v) for v in labels.ravel())
        self.shape = labels.shape


def _wanted(image: Image, label_image, index) -> tuple[DataFrame, _Asked | DataFrame | None]:
    """Pixels with a label each, and the labels asked for (None: all pixels are one group)."""
    if label_image is None:
        return image.df.withColumn("label", F.lit(None).cast("bigint")), None
    df = _labelled(image, label_image)
    if index is None:
        return df.filter("label > 0").withColumn("label", F.lit(None).cast("bigint")), None
    if isinstance(index, DataFrame):
        asked = index.select(F.col("pos").cast("bigint").alias("pos") if "pos" in index.columns else F.col("label").cast("bigint").alias("pos"), F.col("label").cast("bigint").alias("label"))
        return df.join(asked.select("label").distinct(), "label", "left_semi"), asked
    labels = np.asarray(index)
    if labels.ndim > 1:
        warnings.warn("An index of more than one dimension is deprecated.", FutureWarning, stacklevel=4)
    flat = _Asked(labels)
    return df.filter(F.col("label").isin(sorted(set(flat)))), flat


def _answer(image: Image, grouped: DataFrame, flat: _Asked | DataFrame | None, defaults: dict[str, Column]) -> DataFrame:
    """A row for each label asked for. Without labels there is one group, the only one that is broadcast."""
    places: list[Column] = []
    spark, groups = image.spark, grouped.withColumnRenamed("label", "__label")
    if flat is None:
        out = spark.createDataFrame([(0, None)], "pos bigint, label bigint").join(F.broadcast(groups), F.lit(True), "left")
    else:
        asked = flat if isinstance(flat, DataFrame) else spark.createDataFrame(list(enumerate(flat)), "pos bigint, label bigint")
        out = asked.join(groups, F.col("label") == F.col("__label"), "left")
        if isinstance(flat, _Asked) and len(flat.shape) > 1:
            places = [F.expr(f"(pos div {prod(flat.shape[k + 1 :])}) % {size}").alias(f"i{k}") for k, size in enumerate(flat.shape)]
    filled = [F.when(F.col("__found").isNull(), d).otherwise(F.col(c)).alias(c) for c, d in defaults.items()]
    return out.select("pos", "label", *places, *filled)


def _measure(image: Image, label_image, index, defaults: dict[str, Column], aggs: Callable[[Image], list[Column]]) -> DataFrame:
    df, flat = _wanted(image, label_image, index)
    grouped = df.groupBy("label").agg(*aggs(image), F.count("*").alias("__found"))
    return _answer(image, grouped, flat, defaults)


def _nan_safe(image: Image, agg: Column) -> Column:
    """NaN if any value is: Spark takes NaN for the largest number."""
    if not image.dtype.startswith("float"):
        return agg
    return F.when(F.bool_or(F.isnan("value")), F.lit(_NAN)).otherwise(agg)


def _number(image: Image) -> Column:
    return F.col("value").cast("int") if image.dtype == "bool" else F.col("value")


def area(image: Image, label_image=None, index=None) -> DataFrame:
    """Number of pixels; without labels it follows from the shape and no job runs."""
    if label_image is None:
        return image.spark.createDataFrame([(0, None, prod(image.shape))], "pos bigint, label bigint, area bigint")
    return _measure(image, label_image, index, {"area": F.lit(0).cast("bigint")}, lambda _: [F.count("*").alias("area")])


def _double(name: str, default: float, of: Callable[[Column], Column]):
    def measured(image: Image, label_image=None, index=None) -> DataFrame:
        return _measure(image, label_image, index, {name: F.lit(default)}, lambda im: [of(im.as_double()).alias(name)])

    measured.__name__ = name
    return measured


mean = _double("mean", _NAN, F.avg)
mean.__doc__ = "Mean of the values; NaN for a label without pixels."
variance = _double("variance", _NAN, F.var_pop)
variance.__doc__ = "Population variance."
standard_deviation = _double("standard_deviation", _NAN, F.stddev_pop)
standard_deviation.__doc__ = "Population standard deviation."
sum_labels = _double("sum_labels", 0.0, F.sum)
sum_labels.__doc__ = "Sum of the values; zero for a label without pixels."


def median(image: Image, label_image=None, index=None) -> DataFrame:
    """Exact median, the mean of the two middle values of an even number.

    Values are counted by label and dealt by ranges of both, so no task holds all values of a
    label; only the ranges that hold a middle rank are looked through.
    """
    df, flat = _wanted(image, label_image, index)
    counts = df.groupBy("label", image.as_double().alias("v")).agg(F.count("*").alias("n"))
    dealt = materialize(counts.repartitionByRange("label", "v").withColumn("part", F.spark_partition_id()))
    ranges = dealt.groupBy("label", "part").agg(F.sum("n").alias("held"), F.bool_or(F.isnan("v")).alias("nan"))
    own = Window.partitionBy("label")
    before = F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("held").over(own)
    middle = ranges.select(F.col("label").alias("l"), F.col("part").alias("p"), "held", before.alias("before"), F.floor((total - 1) / 2).alias("low"), F.floor(total / 2).alias("high"), F.bool_or("nan").over(own).alias("nan"))
    middle = middle.filter("before <= high AND before + held > low")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("label", "part").orderBy("v"))
    ranked = dealt.join(middle, dealt["label"].eqNullSafe(middle["l"]) & (dealt["part"] == middle["p"])).withColumn("upto", upto)
    at = [F.max(F.when((F.col("upto") > F.col(k)) & (F.col("upto") - F.col("n") <= F.col(k)), F.col("v"))) for k in ("low", "high")]
    found = ranked.groupBy("label").agg(F.when(F.bool_or("nan"), F.lit(_NAN)).otherwise((at[0] + at[1]) / 2).alias("median"), F.lit(1).alias("__found"))
    return _answer(image, found, flat, {"median": F.lit(_NAN)})


def sum(image: Image, label_image=None, index=None) -> DataFrame:  # noqa: A001
    warnings.warn("sum is deprecated, use sum_labels.", DeprecationWarning, stacklevel=2)
    return sum_labels(image, label_image, index)


def minimum(image: Image, label_image=None, index=None) -> DataFrame:
    return _measure(image, label_image, index, {"minimum": F.lit(0)}, lambda im: [_nan_safe(im, F.min(_number(im))).alias("minimum")])


def maximum(image: Image, label_image=None, index=None) -> DataFrame:
    return _measure(image, label_image, index, {"maximum": F.lit(0)}, lambda im: [_nan_safe(im, F.max(_number(im))).alias("maximum")])


def _position(image: Image, largest: bool) -> list[Column]:
    """The first position in C order of the largest or smallest value; the first NaN, if any."""
    value = _number(image)
    isnan = F.isnan("value") if image.dtype.startswith("float") else F.lit(False)
    first = F.struct(*image.coords)
    if largest:  # NaN is the largest already
        return F.max_by(first, F.struct(value.alias("v"), (-image.linear()).alias("at")))
    return F.min_by(first, F.struct((~isnan).alias("ok"), value.alias("v"), image.linear().alias("at")))


def _positions(image: Image, position: Column, prefix: str) -> list[Column]:
    return [position[c].alias(f"{prefix}{k}") for k, c in enumerate(image.coords)]


def _zeros(image: Image, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{k}": F.lit(0).cast("bigint") for k in range(image.ndim)}


def minimum_position(image: Image, label_image=None, index=None) -> DataFrame:
    """pos0, ...: where the least value is first."""
    return _measure(image, label_image, index, _zeros(image, "pos"), lambda im: _positions(im, _position(im, False), "pos"))


def maximum_position(image: Image, label_image=None, index=None) -> DataFrame:
    """pos0, ...: where the largest value is first."""
    return _measure(image, label_image, index, _zeros(image, "pos"), lambda im: _positions(im, _position(im, True), "pos"))


def extrema(image: Image, label_image=None, index=None) -> DataFrame:
    """minimum, maximum, min_pos0, ..., max_pos0, ... in one aggregation."""
    defaults = {"minimum": F.lit(0), "maximum": F.lit(0)} | _zeros(image, "min_pos") | _zeros(image, "max_pos")

    def aggs(im: Image) -> list[Column]:
        both = [_nan_safe(im, f(_number(im))).alias(n) for f, n in ((F.min, "minimum"), (F.max, "maximum"))]
        return both + _positions(im, _position(im, False), "min_pos") + _positions(im, _position(im, True), "max_pos")

    return _measure(image, label_image, index, defaults, aggs)


def center_of_mass(image: Image, label_image=None, index=None) -> DataFrame:
    """com0, ...: the mean coordinates weighted by value; NaN or infinite where the values sum to zero."""

    def aggs(im: Image) -> list[Column]:
        mass = F.sum(im.as_double())
        out = []
        for k, c in enumerate(im.coords):
            moment = F.sum(im.as_double() * F.col(c))
            none = F.when(moment > 0, F.lit(float("inf"))).when(moment < 0, F.lit(float("-inf"))).otherwise(F.lit(_NAN))
            out.append(F.when(mass == 0, none).otherwise(F.try_divide(moment, mass)).alias(f"com{k}"))
        return out

    return _measure(image, label_image, index, {f"com{k}": F.lit(_NAN) for k in range(image.ndim)}, aggs)


def histogram(image: Image, min, max, bins, label_image=None, index=None) -> DataFrame:  # noqa: A002
    """counts array<bigint> of ``bins`` equal bins; null for a label without pixels.

    The bounds and the number of bins are cut to integers. The last bin holds its upper edge.
    Bounds that are equal are widened by a half on either side.
    """
    low, high, n = int(min), int(max), int(bins)
    if low > high or n < 1:
        raise ValueError("A histogram needs bounds that ascend and one bin at least.")
    if low == high:
        low, high = low - 0.5, high + 0.5
    df, flat = _wanted(image, label_image, index)
    v = image.as_double()
    k = F.least(F.floor((v - low) * F.lit(n / (high - low))), F.lit(n - 1)).cast("int")
    # Rounding may put a value just beside an edge in the wrong bin; the edges themselves decide.
    def edge(i: Column) -> Column:
        return F.lit(float(low)) + i * F.lit((high - low) / n)

    k = F.when(v < edge(k), k - 1).when((v >= edge(k + 1)) & (k < n - 1), k + 1).otherwise(k)
    inside = (v >= low) & (v <= high)
    counts = df.groupBy("label", F.when(inside, k).alias("bin")).agg(F.count("*").alias("n"))
    per_label = counts.groupBy("label").agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"), F.lit(1).alias("__found"))
    dense = per_label.select("label", "__found", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0).cast("bigint"))).alias("counts"))
    return _answer(image, dense, flat, {"counts": F.lit(None).cast("array<bigint>")})


@dataclass(frozen=True)
class Mergeable:
    """An aggregate of any kind, made of parts: ``update`` takes a state on by an array of values (and one
    of their linear positions), ``merge`` joins two states, ``finish`` gives the result.

    Values come in no order and in any number of arrays, so a state must not depend on it; states are
    pickled. Each task makes a state for each label that it meets, and only states shuffle.
    """

    start: Callable[[], object]
    update: Callable[[object, np.ndarray, np.ndarray], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], object] = lambda state: state


#: Labels whose states a task holds at a time.
_STATES = 100_000


def _plain(out):
    return out.item() if isinstance(out, np.generic) else out.tolist() if isinstance(out, np.ndarray) else out


def _merged(rows: DataFrame, whole: Mergeable, out_type: str, none: bool) -> DataFrame:
    def partial(batches):
        held: dict[int, object] = {}

        def told():
            batch = pa.RecordBatch.from_pydict({"label": pa.array(held, pa.int64()), "state": pa.array([pickle.dumps(s) for s in held.values()], pa.binary())})
            held.clear()
            return batch

        for batch in batches:
            label, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            value = _values(batch.column(2))
            order = np.argsort(label, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(label[order])) + 1).tolist(), len(order)] if len(order) else []
            for a, b in zip(cuts, cuts[1:]):
                own = order[a:b]
                key = int(label[own[0]])
                held[key] = whole.update(held[key] if key in held else whole.start(), value[own], at[own])
            if len(held) > _STATES:
                yield told()
        if held:
            yield told()

    def final(key, table):
        state = reduce(whole.merge, (pickle.loads(s.as_py()) for s in table.column("state")))
        return pa.table({"label": pa.array([None if none else key[0].as_py()], pa.int64()), "result": pa.array([_plain(whole.finish(state))]), "__found": pa.array([1], pa.int64())})

    states = rows.select("label", "at", "value").mapInArrow(partial, "label bigint, state binary")
    return states.groupBy("label").applyInArrow(final, f"label bigint, result {out_type}, __found bigint")


def _values(column: pa.Array) -> np.ndarray:
    """A column of numbers, Booleans or decimals as an array."""
    if pa.types.is_decimal(column.type) or pa.types.is_struct(column.type) or column.null_count:
        return np.array(column.to_pylist())
    return column.to_numpy(zero_copy_only=False)


def labeled_comprehension(image: Image, label_image, index, func: Callable | Mergeable, out_type: str, default, pass_positions: bool = False, native: bool = False) -> DataFrame:
    """``func`` of each label's values in C order (and their linear positions), as column result.

    ``out_type`` is a Spark type. A plain function needs all values of a label at once, so a label's
    pixels go to one task. A ``Mergeable`` is updated where the pixels are, and with ``native`` the
    function is given the value's column (and the position's) and returns an aggregate of Spark;
    both are combined before the shuffle, so no task holds a label.
    """
    df, flat = _wanted(image, label_image, index)
    none = flat is None
    missing = F.lit(default).cast(out_type) if not isinstance(default, Column) else default
    if native:
        made = func(F.col("value"), image.linear()) if pass_positions else func(F.col("value"))
        return _answer(image, df.groupBy("label").agg(made.cast(out_type).alias("result"), F.count("*").alias("__found")), flat, {"result": missing})
    rows = df.select(F.coalesce(F.col("label"), F.lit(0)).cast("bigint").alias("label"), image.linear().alias("at"), "value")
    if isinstance(func, Mergeable):
        return _answer(image, _merged(rows, func, out_type, none), flat, {"result": missing})

    def run(key, table):
        table = table.sort_by("at")
        values = _values(table.column("value").combine_chunks())
        out = func(values, table.column("at").to_numpy()) if pass_positions else func(values)
        return pa.table({"label": pa.array([None if none else key[0].as_py()], pa.int64()), "result": pa.array([_plain(out)]), "__found": pa.array([1], pa.int64())})

    made = rows.groupBy("label").applyInArrow(run, f"label bigint, result {out_type}, __found bigint")
    return _answer(image, made, flat, {"result": missing})


def find_objects(label_image: Image) -> DataFrame:
    """label, start0, stop0, ...: the bounding box of every label but zero, half open."""
    if not label_image.is_integral:
        raise ValueError("The labels must be of an integral dtype.")
    boxes: Sequence[Column] = [x for k, c in enumerate(label_image.coords) for x in (F.min(c).alias(f"start{k}"), (F.max(c) + 1).alias(f"stop{k}"))]
    return label_image.df.select(F.col("value").cast("bigint").alias("label"), *label_image.coords).filter("label != 0").groupBy("label").agg(*boxes)
