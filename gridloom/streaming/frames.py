"""Frames that arrive as files: decoded into pixels as they come, and measured frame by frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.imread import frames_of


def frame_pixels(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of (path, modified, frame, d0, d1, value double) from the files of a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(folder)

    def run(batches):
        for batch in batches:
            for path, time, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for k, frame in enumerate(frames_of(path, data)):
                    at = np.indices(frame.shape)
                    n = frame.size
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([time.as_py()] * n, batch.schema.field(1).type), pa.array(np.full(n, k, np.int64)), pa.array(at[0].ravel()), pa.array(at[1].ravel()), pa.array(frame.ravel().astype(float))], names=["path", "modified", "frame", "d0", "d1", "value"])

    return files.select("path", "modificationTime", "content").mapInArrow(run, "path string, modified timestamp, frame bigint, d0 bigint, d1 bigint, value double")


def frame_statistics(pixels: DataFrame, late: str = "1 hour") -> DataFrame:
    """Mean, extremes and area by file and frame; ``late`` bounds the state kept for late rows."""
    timed = pixels.withWatermark("modified", late)
    return timed.groupBy("path", "modified", "frame").agg(F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.count("*").alias("area"))
