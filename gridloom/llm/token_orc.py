"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on doc_id.

Documents are dealt by ranges of doc_id and sorted, so the files in order hold them in
ascending order, each stripe and row group covers a narrow range of ids, and a lookup by id
reads a few row groups only. Within a file a row has its place among the file's ids; a file's
own place is the sum over the files before it, of which there are as many as partitions.

Edge cases: a null or empty text has the end id only; rows with a null doc_id come first;
repeated doc_ids are ordered by text; other columns are not read; an empty table writes files
without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, scratch_dir, texts_of
from .words import memo_for

FILE_SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, stripe_bytes: int = 16 << 20, row_index_stride: int = 1000, memo_entries: int = 400_000) -> str:
    """Encodes every text and writes the ids as ORC to ``path``."""
    def run(batches):
        from pyspark import TaskContext

        memo, part, at = memo_for(tokenizer, memo_entries), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts = memo.encode(batch.column(1))
            flat = np.insert(ids, counts.cumsum(), np.uint32(end_id))
            counts = counts + 1
            ends = counts.cumsum()
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts), pa.array(counts), ids], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
            at += int(ends[-1]) if len(ends) else 0

    texts = texts_of(docs)
    dealt = texts.repartitionByRange(texts["doc_id"].asc_nulls_first()).sortWithinPartitions(texts["doc_id"].asc_nulls_first(), texts["text"])
    writer = map_batches(dealt, run, FILE_SCHEMA, keeps=True).write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_index_stride).option("orc.create.index", "true")
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd").orc(path)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    # One row for each file: the window over all of them is as long as the number of partitions.
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = files.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by the crc32 of its little-endian unsigned 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            raw = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
            ends = (4 * ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum()).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the predicate is pushed to stripes, row groups and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and digests what the files hold."""
    spark = docs.sparkSession
    return with_crc32(read_ids(spark, write_ids(docs, tokenizer, scratch_dir(spark), end_id)))
