"""A query for every operator, over rasters made from the driver's tables.

``supplier_weeks`` has a row for each supplier and a column for each week, with the quantity
shipped; ``part_days`` counts lineitems by part and day of year, folded to a square whose pixels grow
with the table; ``supplier_lines`` is a volume of suppliers, line numbers and months.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, fourier, interp, measure, morph
from .operators.label import label
from .plans.blocks import Blocks
from .plans.image import Image, tasks_for
from .plans.scratch import scratch_dir
from .sources.imread import imread
from .sources.imwrite import write_frames, write_stack

WEEKS = 358
MONTHS = 84
LABELS = [*range(1, 17), 99]
ASYMMETRIC = [[1, 2, 0], [-1, 3, 1], [0, -2, 4]]
WIDE = [[1, -2, 3], [0, 4, -1]]
PLUS = [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
MATRIX, OFFSET = [[1, 0.25], [-0.25, 1]], [2, 8]
#: Tasks up to which Spark shuffles into a file each; for more, rows are held and sorted by task.
UNHELD_TASKS = 200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipped(spark: SparkSession, sf_dir: str, keys: list[Column], shape: tuple[int, ...]) -> Image:
    """The quantity shipped by pixel. There are about as many lineitems as pixels, so these are dealt
    by pixel as they are: sums made before would hold all the pixels of a file's part in one task.
    A shuffle to many tasks holds a file's part, too, so rows go to tasks by way of a few then."""
    names, tasks = [f"d{k}" for k in range(len(shape))], tasks_for(shape)
    rows = _table(spark, sf_dir, "lineitem")
    if tasks > UNHELD_TASKS:
        rows = rows.repartition(UNHELD_TASKS, "l_suppkey", "l_shipdate", "l_quantity")
    rows = rows.select(*keys, "l_quantity").repartition(tasks, *names)
    return Image.from_sparse(rows.groupBy(*names).agg(F.sum("l_quantity").alias("value")), shape)


def supplier_weeks(spark: SparkSession, sf_dir: str) -> Image:
    week = F.floor(F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")) / 7)
    keys = [F.col("l_suppkey").cast("bigint").alias("d0"), week.alias("d1")]
    return _shipped(spark, sf_dir, keys, (_table(spark, sf_dir, "supplier").count(), WEEKS))


def side(spark: SparkSession, sf_dir: str) -> int:
    """The side of a square of 100 pixels for each supplier."""
    return int(10 * _table(spark, sf_dir, "supplier").count() ** 0.5)


def part_days(spark: SparkSession, sf_dir: str) -> Image:
    n = side(spark, sf_dir)
    keys = [(F.col("l_partkey") % n).cast("bigint").alias("d0"), (F.dayofyear("l_shipdate") % n).cast("bigint").alias("d1")]
    counts = _table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").cast("double").alias("value"))
    return Image.from_sparse(counts, (n, n))


def supplier_lines(spark: SparkSession, sf_dir: str) -> Image:
    """A volume of suppliers, line numbers and months, with the quantity shipped."""
    month = 12 * (F.year("l_shipdate") - 1995) + F.month("l_shipdate") - 1
    keys = [F.col("l_suppkey").cast("bigint").alias("d0"), (F.col("l_linenumber") - 1).cast("bigint").alias("d1"), month.cast("bigint").alias("d2")]
    return _shipped(spark, sf_dir, keys, (_table(spark, sf_dir, "supplier").count(), 7, MONTHS))


def labelled(image: Image) -> Image:
    """The raster with a column ``lab``: sixteen groups of weeks among the pixels over 50."""
    return image.with_df(image.df.withColumn("lab", F.when(F.col("value") > 50, 1 + F.col("d1") % 16).otherwise(0)))


def _rounded(name: str) -> Column:
    c = F.col(name)
    return F.when(c.isNull() | F.isnan(c), F.lit(None)).otherwise(F.round(c, 6)).cast("double").alias(name)


def _pixels(image: Image, value: Column) -> DataFrame:
    return image.df.select(*image.coords, value.alias("r"))


def _exact(image: Image) -> DataFrame:
    return _pixels(image, F.col("value").cast("bigint"))


def _six(value: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.when(F.round(value, 6) == 0, F.lit(0.0)).otherwise(F.round(value, 6))


def _close(image: Image) -> DataFrame:
    return _pixels(image, _six(F.col("value")))


MEASURES = ("sum_labels", "mean", "median", "minimum", "maximum", "variance", "standard_deviation")


def _measured(name: str):
    def query(spark, sf_dir):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", DeprecationWarning)
            found = getattr(measure, name)(labelled(supplier_weeks(spark, sf_dir)), "lab", LABELS)
        column = "sum_labels" if name == "sum" else name
        return found.select("label", _rounded(column).alias("r"))

    return query


def measure_area(spark, sf_dir):
    return measure.area(labelled(supplier_weeks(spark, sf_dir)), "lab", LABELS).select("label", F.col("area").alias("r"))


def _position(name: str):
    def query(spark, sf_dir):
        return getattr(measure, name)(labelled(supplier_weeks(spark, sf_dir)), "lab", LABELS).select("label", "pos0", "pos1")

    return query


def measure_extrema(spark, sf_dir):
    found = measure.extrema(labelled(supplier_weeks(spark, sf_dir)), "lab", LABELS)
    return found.select("label", F.col("minimum").cast("bigint").alias("minimum"), F.col("maximum").cast("bigint").alias("maximum"), "min_pos0", "min_pos1", "max_pos0", "max_pos1")


def measure_center_of_mass(spark, sf_dir):
    return measure.center_of_mass(labelled(supplier_weeks(spark, sf_dir)), "lab", LABELS).select("label", _rounded("com0"), _rounded("com1"))


def measure_histogram(spark, sf_dir):
    found = measure.histogram(labelled(supplier_weeks(spark, sf_dir)), 0, 330, 11, "lab", LABELS)
    return found.select("label", F.posexplode("counts").alias("bin", "n")).select("label", F.col("bin").cast("bigint").alias("bin"), "n")


def measure_labeled_comprehension(spark, sf_dir):
    spread = measure.Mergeable(lambda: (np.inf, -np.inf), lambda s, v, _: (min(s[0], v.min()), max(s[1], v.max())), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: float(s[1] - s[0]))
    found = measure.labeled_comprehension(labelled(supplier_weeks(spark, sf_dir)), "lab", LABELS, spread, "double", -1.0)
    return found.select("label", F.col("result").cast("bigint").alias("r"))


def measure_find_objects(spark, sf_dir):
    image = labelled(supplier_weeks(spark, sf_dir))
    return measure.find_objects(image.with_df(image.df.select("d0", "d1", F.col("lab").alias("value")), "int64"))


def _components(wrap):
    def query(spark, sf_dir):
        image = supplier_weeks(spark, sf_dir)
        found, _ = label(image.with_value(F.col("value") > 90, "bool"), wrap_axes=wrap)
        return found.df.filter("value > 0").select("d0", "d1", F.col("value").cast("bigint").alias("label"))

    return query


def filter_correlate(spark, sf_dir):
    return _exact(filters.correlate(supplier_weeks(spark, sf_dir), ASYMMETRIC))


def filter_convolve(spark, sf_dir):
    return _exact(filters.convolve(supplier_weeks(spark, sf_dir), WIDE, origin=(0, 1)))


def filter_laplace(spark, sf_dir):
    return _exact(filters.laplace(supplier_weeks(spark, sf_dir)))


def filter_sobel(spark, sf_dir):
    return _exact(filters.sobel(supplier_weeks(spark, sf_dir), axis=0))


def filter_prewitt(spark, sf_dir):
    return _exact(filters.prewitt(supplier_weeks(spark, sf_dir), axis=1))


def filter_uniform(spark, sf_dir):
    return _close(filters.uniform_filter(supplier_weeks(spark, sf_dir), 3))


def filter_gaussian(spark, sf_dir):
    return _close(filters.gaussian(part_days(spark, sf_dir), 1, truncate=2))


def filter_gaussian_filter(spark, sf_dir):
    return _close(filters.gaussian_filter(part_days(spark, sf_dir), 1, order=(0, 1), truncate=2))


def filter_gaussian_gradient_magnitude(spark, sf_dir):
    return _close(filters.gaussian_gradient_magnitude(part_days(spark, sf_dir), 1, truncate=2))


def filter_gaussian_laplace(spark, sf_dir):
    return _close(filters.gaussian_laplace(part_days(spark, sf_dir), 1, truncate=2))


def filter_minimum(spark, sf_dir):
    return _exact(filters.minimum_filter(supplier_weeks(spark, sf_dir), 3))


def filter_maximum(spark, sf_dir):
    return _exact(filters.maximum_filter(supplier_weeks(spark, sf_dir), footprint=np.array(PLUS)))


def filter_median(spark, sf_dir):
    return _exact(filters.median_filter(supplier_weeks(spark, sf_dir), 3))


def filter_median_wide(spark, sf_dir):
    """A neighbourhood too large to scatter: runs on tiles."""
    return _exact(filters.median_filter(part_days(spark, sf_dir), 7))


def filter_median_sliding(spark, sf_dir):
    """Windows of 17 by 17 that slide."""
    return _exact(filters.median_filter(supplier_weeks(spark, sf_dir), 17))


def filter_rank(spark, sf_dir):
    return _exact(filters.rank_filter(supplier_weeks(spark, sf_dir), 1, footprint=np.array(PLUS)))


def filter_percentile(spark, sf_dir):
    return _exact(filters.percentile_filter(supplier_weeks(spark, sf_dir), 30, 3))


def filter_uniform_volume(spark, sf_dir):
    """A wide box in three dimensions: runs on blocks."""
    return _close(filters.uniform_filter(supplier_lines(spark, sf_dir), (21, 5, 41)))


def filter_uniform_frames(spark, sf_dir):
    """A box of 15 by 15 as windows of Spark, without Python."""
    return _close(filters.uniform_filter(supplier_weeks(spark, sf_dir), 15, strategy="frames"))


def filter_maximum_frames(spark, sf_dir):
    return _exact(filters.maximum_filter(supplier_weeks(spark, sf_dir), 15, strategy="frames"))


def filter_range_volume(spark, sf_dir):
    """Two wide filters in a row on a block table, and what lies between them."""
    blocks = Blocks.from_image(supplier_lines(spark, sf_dir), reach=(10, 1, 15)).kept()
    wide = filters.maximum_filter(blocks, (15, 3, 31), mode="wrap")
    return _exact(filters.minimum_filter(wide, (21, 1, 9), mode="nearest").to_image())


def filter_generic(spark, sf_dir):
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    return _exact(filters.generic_filter(supplier_weeks(spark, sf_dir), squares, 3, native=True))


def _above(method: str):
    def query(spark, sf_dir):
        image = supplier_weeks(spark, sf_dir)
        param = (lambda v: v.max() / 2) if method == "generic" else None
        limit = filters.threshold_local(image, 3, method, param=param).df.withColumnRenamed("value", "limit")
        both = image.df.join(limit, image.coords)
        return both.groupBy("d0").agg(F.sum((F.col("value") > F.round("limit", 6)).cast("bigint")).alias("n"))

    return query


def _morphed(name: str):
    def query(spark, sf_dir):
        image = supplier_weeks(spark, sf_dir)
        return _pixels(getattr(morph, f"binary_{name}")(image.with_value(F.col("value") > 40, "bool")), F.col("value").cast("int").cast("bigint"))

    return query


def morph_dilation_wide(spark, sf_dir):
    """A structure too large to scatter, with an origin."""
    image = supplier_weeks(spark, sf_dir)
    return _pixels(morph.binary_dilation(image.with_value(F.col("value") > 120, "bool"), np.ones((15, 9)), origin=(2, -1)), F.col("value").cast("int").cast("bigint"))


def morph_erosion_iterated(spark, sf_dir):
    """Twenty iterations in one exchange; outside the image is set."""
    image = supplier_weeks(spark, sf_dir)
    return _pixels(morph.binary_erosion(image.with_value(F.col("value") < 150, "bool"), iterations=20, border_value=1), F.col("value").cast("int").cast("bigint"))


def filter_generic_vectorized(spark, sf_dir):
    """A Python function of many neighbourhoods at once: the range of values over 25."""
    return _exact(filters.generic_filter(supplier_weeks(spark, sf_dir), lambda x: np.ptp(np.where(x > 25, x, 25), axis=1), 3, vectorized=True))


def fourier_gaussian(spark, sf_dir):
    return _close(fourier.fourier_gaussian(part_days(spark, sf_dir), 1))


def fourier_uniform(spark, sf_dir):
    return _close(fourier.fourier_uniform(part_days(spark, sf_dir), 2))


def fourier_shift(spark, sf_dir):
    found = fourier.fourier_shift(part_days(spark, sf_dir), (1.5, -2))
    return found.df.select("d0", "d1", _six(F.col("value.re")).alias("re"), _six(F.col("value.im")).alias("im"))


def interp_affine_transform(spark, sf_dir):
    return _close(interp.affine_transform(part_days(spark, sf_dir), MATRIX, OFFSET))


def interp_rotate(spark, sf_dir):
    return _exact(interp.rotate(part_days(spark, sf_dir), 90))


def interp_rotate_30(spark, sf_dir):
    return _close(interp.rotate(part_days(spark, sf_dir), 30))


def interp_affine_transform_cubic(spark, sf_dir):
    return _close(interp.affine_transform(part_days(spark, sf_dir), [[0.93, 0.237], [-0.211, 1.013]], [2.31, 7.93], order=3))


def interp_map_coordinates(spark, sf_dir):
    n = side(spark, sf_dir)
    points = _table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), ((F.col("event_id") % (4 * n)) * 0.25).alias("c0"), ((F.col("user_id") % (2 * n)) * 0.5).alias("c1"))
    found = interp.map_coordinates(part_days(spark, sf_dir), points, order=1)
    return found.select("point_id", _six(F.col("value")).alias("r"))


def interp_spline_filter(spark, sf_dir):
    return _close(interp.spline_filter(part_days(spark, sf_dir)))


def interp_spline_filter1d(spark, sf_dir):
    return _close(interp.spline_filter1d(part_days(spark, sf_dir), axis=0))


def io_imread(spark, sf_dir):
    """A file with a page for each supplier, written to the shared folder and read in batches of four pages."""
    path = f"{scratch_dir(spark)}/stack.tif"
    write_stack(supplier_lines(spark, sf_dir), path)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        found = imread(spark, path, nframes=4)
    return found.df.select(*found.coords, F.col("value").cast("bigint").alias("r"))


def io_imread_files(spark, sf_dir):
    """A file for each supplier, read in natural order."""
    folder = scratch_dir(spark)
    write_frames(supplier_lines(spark, sf_dir), folder)
    found = imread(spark, f"{folder}/*.tif")
    return found.df.select(*found.coords, F.col("value").cast("bigint").alias("r"))


QUERIES = (
    {f"measure_{n}": _measured(n) for n in (*MEASURES, "sum")}
    | {f"measure_{n}": _position(n) for n in ("minimum_position", "maximum_position")}
    | {f.__name__: f for f in (measure_area, measure_extrema, measure_center_of_mass, measure_histogram, measure_labeled_comprehension, measure_find_objects)}
    | {"measure_label": _components(None), "measure_label_wrap": _components([1])}
    | {f.__name__: f for f in (filter_correlate, filter_convolve, filter_laplace, filter_sobel, filter_prewitt, filter_uniform, filter_gaussian, filter_gaussian_filter, filter_gaussian_gradient_magnitude, filter_gaussian_laplace, filter_minimum, filter_maximum, filter_median, filter_median_wide, filter_median_sliding, filter_rank, filter_percentile, filter_generic, filter_generic_vectorized, filter_uniform_volume, filter_range_volume, filter_uniform_frames, filter_maximum_frames)}
    | {f"filter_threshold_local_{m}": _above(m) for m in ("gaussian", "mean", "median", "generic")}
    | {f"morph_{n}": _morphed(n) for n in ("erosion", "dilation", "opening", "closing")}
    | {f.__name__: f for f in (morph_dilation_wide, morph_erosion_iterated)}
    | {f.__name__: f for f in (fourier_gaussian, fourier_uniform, fourier_shift, interp_affine_transform, interp_affine_transform_cubic, interp_rotate, interp_rotate_30, interp_map_coordinates, interp_spline_filter, interp_spline_filter1d, io_imread, io_imread_files)}
)
