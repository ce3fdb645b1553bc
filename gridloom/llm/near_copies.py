"""Near copies: SimHash groups, verified by exact Jaccard, then the links that its grid can't reach.

Texts of equal shingle sets are one class. Fingerprints of 64 bits with ``bits`` (4 or fewer)
differing ones are joined by the grid over segment popcounts (see ``simhash``); the sets of each
group that these join are compared exactly, and only a Jaccard of ``threshold`` or more links.

A pair at 0.8 differs in about 10 of 64 bits, and no grid tells that many from chance. So that no
link is lost, classes that also share a band of MinHash are compared exactly too, but for the
bands whose classes SimHash has all joined: these need no comparison any more.

Edge cases: null and empty texts are one class; of a group the row with the least doc_id stays, one
without a doc_id only where no other is; repeated doc_ids are rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import keeps_columns, map_batches, materialize, spread_lookup
from .minhash import PERMUTATIONS, class_links, shingle_hashes, signature


def simhash_links(classes: DataFrame, threshold: float = 0.8, bits: int = 4) -> DataFrame:
    """Links (a, b) between rows (id, fp, hashes) with the same connected parts as all pairs of a
    Jaccard of ``threshold`` or more whose fingerprints a chain of at most ``bits`` bits a step joins."""
    prints = materialize(classes.select("fp").distinct())
    roots = simhash.connected(simhash.near_links(prints, bits))
    named = spread_lookup(classes.select("id", "fp"), "fp", roots, how="left").select("id", F.array(F.coalesce("root", "fp")).alias("bands"))
    return class_links(materialize(named).join(classes.select("id", "hashes"), "id"), threshold)


@keeps_columns
def deduplicate(docs: DataFrame, threshold: float = 0.8, words: int = 5, bits: int = 4, bands: int = 32) -> DataFrame:
    """One row of each group that links of shingle Jaccard ``threshold`` or more join, with its columns.

    A pair that SimHash doesn't join shares none of 32 bands of 4 with a chance of 5e-8 at 0.8.
    """
    rows = PERMUTATIONS // bands
    keyed = materialize(docs.withColumn("__near_row", F.monotonically_increasing_id()))

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prints = [simhash.fingerprint(t, words) for t in texts]
            hashes = [shingle_hashes(t, words) for t in texts]
            keys = [[xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in signature(h).reshape(bands, rows)] for h in hashes]
            columns = [
                pa.array([hashlib.sha256(h.tobytes()).digest() for h in hashes], pa.binary()),
                pa.array([p - (1 << 64) if p >> 63 else p for p in prints], pa.int64()),
                pa.array([h.tobytes() for h in hashes], pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "class", "fp", "hashes", "bands"])

    texts = keyed.select(F.col("__near_row").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = materialize(map_batches(texts, run, "row bigint, doc_id bigint, class binary, fp bigint, hashes binary, bands array<bigint>"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    chosen = materialize(signed.groupBy("class").agg(best).select(F.col("best.row").alias("id"), "best"))
    # Most rows are a class of their own, so their sets stay where they are.
    copies = materialize(signed.select("row").join(chosen.select(F.col("id").alias("row")), "row", "left_anti"))
    classes = signed.join(copies, "row", "left_anti").select(F.col("row").alias("id"), "fp", "hashes", "bands")
    by_simhash = materialize(simhash_links(classes, threshold, bits))
    joined = simhash.connected(by_simhash).select(F.col("fp").alias("id"), "root")
    rest = class_links(classes, threshold, groups=joined)
    roots = simhash.connected(by_simhash.unionByName(rest)).select(F.col("fp").alias("id"), "root")
    kept = chosen.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("__near_row"))
    dropped = materialize(keyed.select("__near_row").join(kept, "__near_row", "left_anti"))
    return keyed.join(dropped, "__near_row", "left_anti").select(*docs.columns)
