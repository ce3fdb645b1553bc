"""Near-duplicates by SimHash; candidates come from a grid over segment popcounts.

A fingerprint's bits are cut into segments, and the counts of set bits in them form a vector.
Flipping one bit changes one count by one, so the Manhattan distance of two vectors is at most
the Hamming distance of the fingerprints. With 4 or fewer differing bits, one of the two halves
of the vectors is within distance 2; two points of the grid within distance 2 share a grid cell
within distance 1 of both. Each distinct fingerprint therefore goes to the cells within
distance 1 of its own, half by half, and candidates that meet in a cell are compared exactly.
In a cell, only links that join parts not yet joined are kept, so a group of copies gives as
many links as it has fingerprints and not all its pairs.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and is linked
like any other; equal fingerprints are one class; ``component_id`` is the smallest doc_id that
is not null (null if there is none); rows that repeat a doc_id are kept apart in ``components``
and count as one document in ``deduplicate``; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps_columns, map_batches, materialize, met_in_tiles, spread_lookup, texts_of

SEGMENT_BITS = 2
_HALF = 32
#: Fingerprints of one cell that are compared at a time.
_BLOCK = 1 << 14
#: Fingerprints of a cell up to which all its pairs are compared.
_SMALL = 16


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's shingles of ``words`` words, repeats included."""
    tokens = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(digests), 1 << 14):
        counts += np.unpackbits(digests[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(texts_of(docs), run, "doc_id bigint, fp bigint")


def popcount_embedding(half: np.ndarray, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """Set bits in each segment of 32-bit halves: an array (n, 32 / segment_bits)."""
    bits = np.unpackbits(half.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return bits.reshape(len(half), _HALF // segment_bits, segment_bits).sum(axis=2).astype(np.int64)


def grid_cells(fps: np.ndarray, segment_bits: int = SEGMENT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fp) for every cell within Manhattan distance 1 of each half's embedding.

    A cell's number is its vector as digits to the base segment_bits + 1, and the half.
    """
    base = segment_bits + 1
    cells, owners = [], []
    for which, half in enumerate((fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))):
        vector = popcount_embedding(half.astype(np.uint32), segment_bits)
        scale = base ** np.arange(vector.shape[1], dtype=np.int64)
        own = vector @ scale
        near = [(own, fps)]
        for j, s in enumerate(scale):
            for step, ok in ((s, vector[:, j] < segment_bits), (-s, vector[:, j] > 0)):
                near.append((own[ok] + step, fps[ok]))
        cells += [2 * c + which for c, _ in near]
        owners += [f for _, f in near]
    return np.concatenate(cells), np.concatenate(owners)


class _Forest:
    """Union-find over fingerprints; ``join`` tells whether two parts were still apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def cell_links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one cell as all its links within ``bits`` would.

    Breadth first: a fingerprint that was reached is compared with those not reached yet, so a
    dense group is used up after a few rounds.
    """
    links, rest = [], np.unique(fps)
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            hit = np.concatenate([np.bitwise_count(rest[k : k + _BLOCK] ^ at) <= bits for k in range(0, len(rest), _BLOCK)])
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                links += [(int(at), int(f)) for f in found]
                frontier += list(found)
    return links


def _links_of_sorted(batches, bits: int):
    """Links from (cell, fp) rows sorted by cell. Small cells, the most common, are compared all at once."""
    forest, held_cells, held_fps = _Forest(), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def emit(cells, fps):
        cut = np.flatnonzero(np.diff(cells)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(cells)]])
        sizes = ends - starts
        pairs = []
        small = np.repeat(sizes <= _SMALL, sizes)
        for lag in range(1, _SMALL):
            at = np.flatnonzero((cells[lag:] == cells[:-lag]) & small[lag:])
            if not len(at):
                break
            close = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= bits]
            pairs += zip(fps[close].tolist(), fps[close + lag].tolist())
        for a, b in zip(starts[sizes > _SMALL], ends[sizes > _SMALL]):
            pairs += cell_links(fps[a:b], bits)
        pairs = [p for p in pairs if p[0] != p[1] and forest.join(*p)]
        columns = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns[:, 0].copy()), pa.array(columns[:, 1].copy())], names=["a", "b"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(cells):
            continue
        waiting.append((cells, fps))
        if cells[-1] != waiting[0][0][0]:  # the last cell may go on in the next batch
            held_cells = np.concatenate([c for c, _ in waiting])
            held_fps = np.concatenate([f for _, f in waiting])
            last = int(np.searchsorted(held_cells, held_cells[-1]))
            yield emit(held_cells[:last], held_fps[:last])
            waiting = [(held_cells[last:], held_fps[last:])]
    if waiting:
        yield emit(np.concatenate([c for c, _ in waiting]), np.concatenate([f for _, f in waiting]))


def dealt_cells(distinct: DataFrame, block: int = 20_000) -> DataFrame:
    """(cell, fp) rows, where fingerprints within the grid's reach share a cell.

    A cell of more than ``block`` fingerprints is dealt over parts, and every two of these meet in
    a cell of their own, so that no task compares more than about two blocks. Such a cell's number
    is a hash; should it meet another, more fingerprints are compared and links stay exact.
    """

    def explode(batches):
        for batch in batches:
            cells, fps = grid_cells(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fps.view(np.int64))], names=["cell", "fp"])

    rows = map_batches(distinct.select("fp"), explode, "cell bigint, fp bigint")
    hot = materialize(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows
    met = met_in_tiles(spread_lookup(rows, "cell", hot), "cell", "fp")
    cold = rows.join(hot, "cell", "left_anti")
    return cold.select("cell", "fp").unionByName(met.select(F.xxhash64("tile").alias("cell"), "fp"))


def near_links(distinct: DataFrame, bits: int = 4, block: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that have the same connected
    parts as all pairs with at most ``bits`` (4 or fewer) differing bits."""
    if bits > 4:
        raise ValueError("the grid holds for 4 or fewer differing bits")
    dealt = dealt_cells(distinct, block).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(lambda batches: _links_of_sorted(batches, bits), "a bigint, b bigint")


def connected(links: DataFrame) -> DataFrame:
    """(fp, root) for every end of a link; two have the same root if links connect them.

    Each round moves every node to the neighbour (or itself) of the least hash, drawn anew for
    the round, and contracts the links; about half of a chain's nodes and all of a star's
    leaves go. Rounds are written to the shared folder, and lookups are salted, since a node may
    gather many links.
    """
    rounds: list[DataFrame] = []
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own, other = (F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("up")) for c in ("a", "b"))
        up = materialize(both.groupBy("a").agg(F.min(other).alias("m")).select("a", F.least(own, F.col("m"))["up"].alias("up")))
        rounds.append(up)
        moved = spread_lookup(edges, "a", up).select(F.col("up").alias("a"), "b")
        moved = spread_lookup(moved, "b", up.select(F.col("a").alias("b"), "up")).select("a", F.col("up").alias("b"))
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("fp"), F.col("a").alias("root")).limit(0)
    # A node that a round no longer holds has arrived.
    found = rounds[0].select(F.col("a").alias("fp"), F.col("up").alias("root"))
    for up in rounds[1:]:
        step = spread_lookup(found, "root", up.select(F.col("a").alias("root"), "up"), how="left")
        # Written out each time: a plan that reads the last step twice would double with every round.
        found = materialize(step.select("fp", F.coalesce("up", "root").alias("root")))
    return found


def components(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links reach, the row's own included."""
    rows = materialize(fingerprints(docs, words, seed))
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected(near_links(reps, bits))
    linked = spread_lookup(roots, "fp", reps)
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = spread_lookup(roots, "root", least).select("fp", "component_id")
    classes = reps.join(by_fp, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))
    return spread_lookup(rows, "fp", materialize(classes)).select("doc_id", "fp", "component_id")


@keeps_columns
def deduplicate(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component, with their columns.

    Rows with a null doc_id stay.
    """
    dropped = components(docs, words, bits).filter("doc_id != component_id").select(F.col("doc_id").alias("__near_drop"))
    return docs.join(dropped, docs["doc_id"] == dropped["__near_drop"], "left_anti")
