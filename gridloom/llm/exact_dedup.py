"""Exact deduplication in two passes, with DataFrame functions only.

Texts are equal when they are so after deletion of the six ASCII white-space characters. The
first pass sets, in a Bloom filter, the places that two or more hashes have hit; a text whose
places are all set may be repeated. The second pass tests every row against that filter, which
is broadcast and has a bounded size: other rows have no equal and pass straight through, and
only the possibly repeated ones shuffle to be compared by their SHA-256. A filter that is too
small for its input lets more rows shuffle; the result is exact all the same.

The filter's places are counted by partial aggregation, so two longs a row and no text move in
the first pass. Bitmaps built in each of P partitions and joined by OR would move two bytes a row
and partition (16 bits a row, as all partitions share the filter), which is more from about 20
partitions on.

Edge cases: a null text counts as empty, and all empty texts are equal; of equal texts the
longest stays, then the smallest doc_id, where a null doc_id counts as the largest; of rows
that repeat both, one stays; an empty table gives an empty result. Other columns may have any
name but those that begin with ``__dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeps_columns, materialize

_SPACE = " \t\n\v\f\r"
_BUCKET = 32768  # bits of one bitmap of bitmap_construct_agg


def text_sha256(text: Column) -> Column:
    """SHA-256 of a text without its white space, as lowercase hex digits."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), _SPACE, ""), 256)


def _places(sha: Column, bits: int) -> list[Column]:
    """A hash's two places in a filter of ``bits`` bits, from 1."""
    return [F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(bits).cast("bigint")) + 1 for k in (1, 2)]


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 28) -> int:
    """Bits of the filter: 32 MB at most, so that it can always be broadcast."""
    return min(max(_BUCKET, 1 << (max(rows, 1) * bits_per_row - 1).bit_length()), max_bits)


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """The places hit twice or more, as bitmaps: (__dedup_bucket, __dedup_map), ``bits`` in all."""
    place = F.explode(F.array(*_places(F.col("__dedup_sha"), bits)))
    twice = digests.select(place.alias("__dedup_place")).groupBy("__dedup_place").agg(F.count("*").alias("__dedup_hits")).filter("__dedup_hits > 1")
    return twice.groupBy(F.bitmap_bucket_number("__dedup_place").alias("__dedup_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__dedup_place")).alias("__dedup_map"))


def flag_repeats(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``__dedup_maybe``: whether both places of ``__dedup_sha`` are set."""
    for k, place in enumerate(_places(F.col("__dedup_sha"), bits)):
        rows = rows.withColumn(f"__dedup_p{k}", place)
        bucket, at = F.bitmap_bucket_number(f"__dedup_p{k}"), F.bitmap_bit_position(f"__dedup_p{k}")
        probe = F.broadcast(bitmaps.select(F.col("__dedup_bucket").alias(f"__dedup_b{k}"), F.col("__dedup_map").alias(f"__dedup_m{k}")))
        rows = rows.join(probe, bucket == F.col(f"__dedup_b{k}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(f"__dedup_m{k}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)) > 0, F.lit(False))
        rows = rows.withColumn(f"__dedup_is{k}", bit).drop(f"__dedup_p{k}", f"__dedup_b{k}", f"__dedup_m{k}")
    return rows.withColumn("__dedup_maybe", F.col("__dedup_is0") & F.col("__dedup_is1")).drop("__dedup_is0", "__dedup_is1")


def _rank() -> Column:
    """Greatest for the row that stays; ~doc_id reverses the order of ids without overflow."""
    return F.struct(F.col("__dedup_chars"), F.bitwise_not(F.col("doc_id")))


def _digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return materialize(docs.select(docs["doc_id"], F.length(text).cast("bigint").alias("__dedup_chars"), text_sha256(docs["text"]).alias("__dedup_sha"), F.monotonically_increasing_id().alias("__dedup_row")))


def decide(docs: DataFrame, salts: int = 256, bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """Every row's fate: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are read once, for their digests. A group that holds a large part of all rows is
    counted by partial aggregation and dealt over ``salts`` parts to tell its rows.
    """
    digests = _digests(docs)
    bits = filter_bits(digests.count(), bits_per_row, max_bits)
    flagged = flag_repeats(digests, materialize(repeat_filter(digests, bits)), bits)
    single = flagged.filter(~F.col("__dedup_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.col("__dedup_sha").alias("text_sha256"))
    maybe = flagged.filter("__dedup_maybe").select("doc_id", "__dedup_chars", "__dedup_sha", "__dedup_row", F.pmod(F.xxhash64("__dedup_row"), F.lit(salts)).alias("__dedup_salt"))
    best = F.max(F.struct(_rank().alias("rank"), F.bitwise_not(F.col("__dedup_row")).alias("row"), F.col("doc_id").alias("id"))).alias("__dedup_best")
    parts = maybe.groupBy("__dedup_sha", "__dedup_salt").agg(best, F.count("*").alias("__dedup_n"))
    groups = parts.groupBy("__dedup_sha").agg(F.max("__dedup_best").alias("__dedup_best"), F.sum("__dedup_n").alias("group_size"), F.collect_list("__dedup_salt").alias("__dedup_salts"))
    by_part = groups.select("__dedup_sha", F.col("__dedup_best.id").alias("keep_id"), F.bitwise_not(F.col("__dedup_best.row")).alias("__dedup_keep_row"), "group_size", F.explode("__dedup_salts").alias("__dedup_salt"))
    told = maybe.join(by_part, ["__dedup_sha", "__dedup_salt"]).select("doc_id", "keep_id", "group_size", (F.col("__dedup_row") == F.col("__dedup_keep_row")).alias("kept"), F.col("__dedup_sha").alias("text_sha256"))
    return single.unionByName(told)


@keeps_columns
def deduplicate(docs: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows without an equal don't shuffle."""
    digests = _digests(docs)
    bits = filter_bits(digests.count(), bits_per_row, max_bits)
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select("*", F.length(text).cast("bigint").alias("__dedup_chars"), text_sha256(docs["text"]).alias("__dedup_sha"))
    flagged = flag_repeats(keyed, materialize(repeat_filter(digests, bits)), bits)
    single = flagged.filter(~F.col("__dedup_maybe")).select(*docs.columns)
    # Rows that tie in length and doc_id are told apart by their text and then their other columns.
    plain = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    rank = F.struct(_rank(), F.coalesce("text", F.lit("")), F.xxhash64(F.lit(0), *plain))
    groups = flagged.filter("__dedup_maybe").groupBy("__dedup_sha").agg(F.max_by(F.struct(*docs.columns), rank).alias("__dedup_kept"))
    return single.unionByName(groups.select("__dedup_kept.*"))
