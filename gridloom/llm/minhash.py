"""Document fingerprints by MinHash: universal hash permutations over word shingles.

A shingle of five words is hashed to 32 bits, and each permutation x -> a * x + b modulo 2**32
with an odd a is a bijection of these. A fingerprint holds the least value under each, and the
share of equal places of two estimates the Jaccard similarity of their shingle sets.

Edge cases: a null text counts as empty; a text of fewer words than a shingle is one shingle,
an empty one the empty shingle, so equal texts always have equal fingerprints; null, repeated
and tied doc_ids are separate rows, ordered with nulls first and then by text; other columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keeps_columns, map_batches, materialize, met_in_tiles, spread_lookup, texts_of
from .simhash import connected

SHINGLE_WORDS = 5
PERMUTATIONS = 128
_BLOCK = 2048


def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, permutations, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, permutations, dtype=np.uint32)


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 32-bit hashes of a text's shingles."""
    tokens = text.encode().lower().split()
    shingles = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh32_digest, shingles)), ">u4").astype(np.uint32))


def signature(hashes: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The least value under each permutation, its upper 16 bits."""
    a, b = _coefficients(permutations)
    least = np.full(permutations, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK]
        for k in range(0, permutations, 16):  # the block's values stay in the cache
            values = a[k : k + 16, None] * block[None, :] + b[k : k + 16, None]
            np.minimum(least[k : k + 16], values.min(axis=1), out=least[k : k + 16])
    return (least >> np.uint32(16)).astype(np.uint16)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places; 16 kept bits agree by chance in 1 of 65,536 places."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _cuts_up_to(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``, looked up in two levels of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    group = F.size(F.filter(longs([g[0] for g in groups]), lambda c: c <= value))
    within = F.size(F.filter(F.element_at(F.array(*map(longs, groups)), group), lambda c: c <= value))
    return F.when(value < cuts[0], 0).otherwise((group - 1) * step + within)


def with_next(docs: DataFrame) -> tuple[DataFrame, str]:
    """Texts dealt by ranges of doc_id and sorted, each range with the first row of the next one.

    Rows are (doc_id, text, own); own is false for a row that only follows its range. The text
    that follows the last row of all, the first one's, is returned beside them. Ranges are cut
    at quantiles, and there are as many as shuffle partitions, so only as many ids as that are
    collected, and as many rows travel twice.
    """
    spark = docs.sparkSession
    texts = texts_of(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    cuts = sorted(set(texts.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).collect()[0]["cuts"] or []))
    ranged = texts.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(_cuts_up_to(F.col("doc_id"), cuts)))
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("least")
    firsts = [(r["range"], r["least"]["id"]) for r in ranged.select("doc_id", "range").groupBy("range").agg(least).orderBy("range").collect()]
    first = ""
    if firsts:
        first = texts.filter(F.col("doc_id").eqNullSafe(F.lit(firsts[0][1]).cast("bigint"))).agg(F.min("text")).collect()[0][0]
    rows = ranged.withColumn("own", F.lit(True))
    follows = [(b[1], a[0]) for a, b in zip(firsts, firsts[1:])]
    if follows:
        table = F.broadcast(spark.createDataFrame(follows, "__first bigint, range int"))
        heads = texts.join(table, texts["doc_id"] == table["__first"]).groupBy("doc_id", "range").agg(F.min("text").alias("text"))
        rows = rows.unionByName(heads.select("doc_id", "text", "range", F.lit(False).alias("own")))
    dealt = rows.repartitionById(len(cuts) + 1, "range")
    return dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("doc_id", "text", "own"), first


def fingerprints_beside_next(docs: DataFrame, words: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    A task holds two texts at a time beside its Arrow batch.
    """
    dealt, first = with_next(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def prints(text):
        return signature(shingle_hashes(text, words), permutations)

    def finish(doc, text, own_print, following, following_print):
        changed = edited(text, following)
        new = prints(changed)
        return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own_print), as_text(new), likeness(own_print, new), likeness(own_print, following_print)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names=names)

    def run(batches):
        held = None
        for batch in batches:
            rows = []
            for doc, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                own_print = prints(text)
                if held is not None:
                    rows.append(finish(*held, text, own_print))
                held = (doc, text, own_print) if own else None
            yield batch_of(rows)
        if held is not None:  # the last row of all
            yield batch_of([finish(*held, first, prints(first))])

    return map_batches(dealt, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 32, words: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS, block: int = 1000) -> DataFrame:
    """Links (a, b, jaccard) between classes of texts whose shingle Jaccard is ``threshold`` or more.

    Texts with equal shingle sets are one class, named by its least doc_id, so copies give no
    pairs. Classes that share a band of their signature are candidates, and the exact Jaccard of
    their shingle sets verifies each: a pair at 0.8 shares none of 32 bands of 4 with a chance of
    5e-8. A band's key that more than ``block`` classes share is dealt over parts: each class goes
    to one of them on the left and to all of them on the right, so every pair still meets. Rows
    with a null doc_id have no name and give no links.
    """
    rows = permutations // bands

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            keys = [[signature(h, permutations)[k * rows : (k + 1) * rows].tobytes().hex() for k in range(bands)] for h in hashes]
            sets = [hashlib.sha256(h.tobytes()).hexdigest() for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets), pa.array([h.astype(np.int64) for h in hashes], pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.string()))], names=["doc_id", "class", "hashes", "bands"])

    signed = map_batches(texts_of(docs), run, "doc_id bigint, class string, hashes array<bigint>, bands array<string>")
    classes = materialize(signed.filter("doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("id"), F.first("hashes").alias("hashes"), F.first("bands").alias("bands")))
    banded = classes.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("at"))
    shared = materialize(banded.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1").select("at", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    members = materialize(spread_lookup(banded, "at", shared))
    left = members.select("at", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("a"))
    right = members.select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"))
    pairs = left.join(right, ["at", "part"]).filter("a < b").select("a", "b").distinct()
    hashes = classes.select("id", "hashes")
    both = spread_lookup(pairs, "a", hashes.select(F.col("id").alias("a"), F.col("hashes").alias("ha")))
    both = spread_lookup(both, "b", hashes.select(F.col("id").alias("b"), F.col("hashes").alias("hb")))
    common = F.size(F.array_intersect("ha", "hb"))
    jaccard = common / (F.size("ha") + F.size("hb") - common)
    return both.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


class _Holders:
    """Which sets hold each value, for a part of the sets."""

    def __init__(self, own: list[np.ndarray], chosen: np.ndarray):
        values = np.concatenate([own[k] for k in chosen.tolist()]) if len(chosen) else np.zeros(0, np.int32)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.sets = np.repeat(chosen.astype(np.int32), [len(own[k]) for k in chosen.tolist()])[order]
        self.size = len(chosen)

    def common(self, own: np.ndarray, sets: int) -> np.ndarray:
        """How many of the values ``own`` each set holds."""
        first, last = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        sizes = last - first
        ends = sizes.cumsum()
        at = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.sets[at], minlength=sets)


def set_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that join sets as all pairs of Jaccard ``threshold`` or more would.

    Breadth first: a set that was reached is compared with those not reached yet that share a value
    with it, so a dense group is used up after a few rounds and unlike sets cost their values.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(at.astype(np.int32), sizes.cumsum()[:-1])
    left = np.ones(n, bool)
    left[0] = False
    links, frontier, holders = [], [0], _Holders(own, np.arange(1, n))
    while left.any():
        if not frontier:
            frontier = [int(np.argmax(left))]
            left[frontier[0]] = False
            continue
        if 2 * left.sum() < holders.size:
            holders = _Holders(own, np.flatnonzero(left))
        a = frontier.pop()
        common = holders.common(own[a], n)
        found = np.flatnonzero(left & (common >= threshold * (sizes + sizes[a] - common)) & (common > 0)).tolist()
        left[found] = False
        links += [(a, b) for b in found]
        frontier += found
    return links


def class_links(classes: DataFrame, threshold: float = 0.8, block: int = 1000, shingles: int = 1 << 21, groups: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between rows (id, hashes, bands) with the same connected parts as all pairs
    that share a band and have a Jaccard of ``threshold`` or more.

    Of band keys that hold the same rows one is taken. The rows of a key are compared in one
    task; a key of more than ``block`` rows, or of ``shingles`` in all, is dealt over parts, and each
    two parts meet in a task. ``groups`` (id, root) are rows joined already: the links found join
    the rest to these, and a key all of whose rows are in one group is left out.
    """
    size = F.octet_length("hashes") / 4
    known = [F.col("id").alias("group")] if groups is None else [F.coalesce("root", "id").alias("group")]
    own = classes if groups is None else classes.join(groups, "id", "left")
    sized = own.select("id", *known, size.cast("bigint").alias("size"), F.posexplode("bands").alias("band", "key")).select("id", "group", "size", F.xxhash64("band", "key").alias("at"))
    banded = classes.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("at"))
    digest = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    spans = [F.min("group").alias("first"), F.max("group").alias("last")]
    held = sized.groupBy("at").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("id").alias("least"), *spans, *digest).filter("n > 1 and first < last")
    once = held.groupBy("n", "size", "least", "x0", "x1").agg(F.min("at").alias("at"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.least(F.col("n"), F.ceil(F.col("size") / shingles)))
    shared = materialize(once.select("at", parts.cast("int").alias("parts")))
    dealt = met_in_tiles(spread_lookup(banded, "at", shared), "at", "id")
    tiles = dealt.select("id", "tile").join(classes.select("id", "hashes"), "id").select("tile", "id", "hashes")

    def run(batches):
        tile, ids, sets = None, [], []

        def links():
            found = [(ids[a], ids[b]) for a, b in set_links(sets, threshold)] if len(ids) > 1 else []
            columns = list(zip(*found)) or [()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            for key, doc, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if key != tile:
                    yield links()
                    tile, ids, sets = key, [], []
                ids.append(doc)
                sets.append(np.frombuffer(hashes, np.uint32))
        yield links()

    return map_batches(tiles.repartition("tile").sortWithinPartitions("tile"), run, "a bigint, b bigint")


@keeps_columns
def deduplicate(docs: DataFrame, threshold: float = 0.8, bands: int = 32, words: int = SHINGLE_WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """One row of each group that links of shingle Jaccard ``threshold`` or more join, with its columns.

    The row with the least doc_id stays (one without a doc_id only where no other is); rows are
    told apart by a key of their own. Candidates share one of ``bands`` bands, and each is
    verified by exact Jaccard: a pair at 0.8 shares none of 32 bands of 4 with a chance of 5e-8.
    """
    rows = permutations // bands
    keyed = materialize(docs.withColumn("__near_row", F.monotonically_increasing_id()))

    def run(batches):
        for batch in batches:
            hashes = [shingle_hashes(t, words) for t in batch.column(2).to_pylist()]
            prints = [signature(h, permutations).reshape(bands, rows) for h in hashes]
            keys = [[xxhash.xxh64_intdigest(band.tobytes()) - (1 << 63) for band in p] for p in prints]
            sets = [hashlib.sha256(h.tobytes()).digest() for h in hashes]
            columns = [pa.array(sets, pa.binary()), pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "class", "hashes", "bands"])

    texts = keyed.select(F.col("__near_row").alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = map_batches(texts, run, "row bigint, doc_id bigint, class binary, hashes binary, bands array<bigint>")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    classes = materialize(signed.groupBy("class").agg(best, F.first("hashes").alias("hashes"), F.first("bands").alias("bands")).select(F.col("best.row").alias("id"), "best", "hashes", "bands"))
    roots = connected(class_links(classes, threshold)).select(F.col("fp").alias("id"), "root")
    kept = classes.select("id", "best").join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("__near_row"))
    dropped = materialize(keyed.select("__near_row").join(kept, "__near_row", "left_anti"))
    return keyed.join(dropped, "__near_row", "left_anti").select(*docs.columns)
