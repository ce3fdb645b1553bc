"""What the text operators share: Arrow batches, columns kept apart, and the engine's scratch tables and salted lookups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_dir
from ..plans.spread import spread_lookup

__all__ = ["kept_by_worker", "keeps_columns", "let_go", "map_batches", "materialize", "met_in_tiles", "scratch_dir", "spread_lookup", "texts_of"]

#: Rows of one Arrow batch: texts are long, so a batch of the default 10,000 rows may not fit a worker.
BATCH_ROWS = 256
#: What this worker process keeps for further tasks of the same kind.
_KEPT: dict[tuple, object] = {}


def kept_by_worker(key: tuple, make: Callable[[], object]):
    """``make()``, once in a worker process: it stays for further tasks with the same ``key``, and for ``map_batches`` to let go."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Gives back what this worker process keeps: it outlives its tasks, and an executor's other tasks need the memory."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)  # what native libraries have freed stays with the process otherwise


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts.

    A task begins by letting go what an earlier one left in its worker (see ``kept_by_worker``), but for
    those that ``keeps`` says go on with it.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        if not keeps:
            let_go()
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return df.mapInArrow(run, schema)


def keeps_columns(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator that returns rows of ``docs`` as they are: inside it, all columns but doc_id and
    text have names that nothing of its own can have, so no name of the caller's clashes."""

    @wraps(fn)
    def kept(docs: DataFrame, *args, **kwargs) -> DataFrame:
        apart = docs.toDF(*[c if c in ("doc_id", "text") else f"__of_caller_{k}" for k, c in enumerate(docs.columns)])
        return fn(apart, *args, **kwargs).toDF(*docs.columns)

    return kept


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns are left unread."""
    return docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))


def met_in_tiles(members: DataFrame, group: str, key: str) -> DataFrame:
    """``members`` with ``tile`` = (group, p, q): every two members of a group share a tile.

    ``parts`` tells into how many a group is cut. A member lies in one part by the hash of ``key``
    and goes to the tiles of that part with each other one, so a tile holds two parts.
    """
    own = members.withColumn("__part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: (q != F.col("__part")) | (F.col("parts") == 1))
    met = own.withColumn("__other", F.explode(others))
    tile = F.struct(F.col(group).alias("at"), F.least("__part", "__other").alias("p"), F.greatest("__part", "__other").alias("q"))
    return met.withColumn("tile", tile).drop("__part", "__other", "parts")
