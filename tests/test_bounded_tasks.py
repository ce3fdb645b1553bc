"""The pixels that a task of a query holds don't grow with the image, whatever the shuffle partitions."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.plans import image, stencil
from gridloom.queries import QUERIES, WEEKS, supplier_weeks

SUPPLIERS = 200
PIXELS = SUPPLIERS * WEEKS
TILE, TASK = 1024, 4096
NAMES = (
    "filter_prewitt",
    "filter_laplace",
    "filter_sobel",
    "filter_convolve",
    "filter_maximum",
    "morph_closing",
    "morph_dilation",
    "morph_erosion",
    "morph_opening",
    "filter_minimum",
    "filter_threshold_local_gaussian",
    "filter_threshold_local_mean",
)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, rng, n = tmp_path_factory.mktemp("tables"), np.random.default_rng(5), 60_000
    days = np.datetime64("1995-01-02") + rng.integers(0, 7 * WEEKS, n)
    pq.write_table(pa.table({"s_suppkey": np.arange(SUPPLIERS)}), folder / "supplier.parquet")
    lines = {"l_suppkey": rng.integers(0, SUPPLIERS, n), "l_shipdate": pa.array(days.astype("datetime64[D]")), "l_quantity": rng.integers(1, 51, n).astype(float)}
    pq.write_table(pa.table(lines), folder / "lineitem.parquet")
    return str(folder)


def rows_by_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("name", NAMES)
def test_a_task_holds_a_bounded_number_of_pixels(spark, tables, monkeypatch, name):
    monkeypatch.setattr(stencil, "_TILE_PIXELS", TILE)
    monkeypatch.setattr(image, "_TASK_PIXELS", TASK, raising=False)
    joined, table = [], type(spark.range(1))
    group = table.groupBy
    # Local thresholds are counted by row of the image; what is counted is a row for each pixel.
    monkeypatch.setattr(table, "groupBy", lambda self, *by: (joined.append(self) if [b for b in by if isinstance(b, str)] == ["d0"] else None) or group(self, *by))
    found = QUERIES[name](spark, tables)
    sizes = rows_by_task(joined[0] if joined else found)
    assert sum(sizes) == PIXELS and max(sizes) <= 1.25 * TASK
    filled = rows_by_task(supplier_weeks(spark, tables).df)
    assert sum(filled) == PIXELS and max(filled) <= 1.25 * TASK


def test_a_task_makes_a_bounded_part_of_the_grid(spark, monkeypatch):
    monkeypatch.setattr(image, "_GRID_PIXELS", 1000, raising=False)
    sizes = rows_by_task(image.grid(spark, (100, 200)))
    assert sum(sizes) == 20_000 and max(sizes) <= 1000


def test_a_task_that_reads_shuffles_to_few_tasks(spark, tables, monkeypatch):
    monkeypatch.setattr(image, "_TASK_PIXELS", 256, raising=False)
    raster = supplier_weeks(spark, tables)
    plan = raster.df._jdf.queryExecution().executedPlan().toString()
    above = re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan[: plan.index("l_quantity", plan.index("FileScan parquet"))])
    assert image.tasks_for(raster.shape) > 200 and int(above[-1]) <= 200
    assert raster.df.agg(F.sum("value")).first()[0] == spark.read.parquet(f"{tables}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
