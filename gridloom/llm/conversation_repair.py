"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation is empty, or user and assistant in turn, from a user to an assistant, after
at most one system turn: role initials ``(s?(ua)+)?``. A turn is kept (0), given the role user or
assistant (2) or deleted (3, which a blank or repeated one must be); an empty turn is inserted (2);
a truncated turn that stays costs one more. Of the cheapest edits those stand whose initials (D, I,
K, R) are least.

The program runs over the retained turns: before each, the turns since the last one retained are
deleted, which prefix sums price, so the best for each role that may come last is a running
minimum; the pair of roles tells how many turns to insert. Strings of edits aren't held: of two
ways to the same turn neither's initials begin the other's, so their order is a rank among the
roles, carried along with the cost.

A conversation may hold any share of all rows. Rows are dealt and sorted by ranges, so a long one
lies over many partitions, and are cut into segments of ``SEGMENT`` rows at most. Each segment is
priced for every role that may come before it; these tables of 16 costs and ranks are combined
along a conversation, and each segment's edits follow from its own end. Texts shuffle twice: to be
sorted, and to their conversation, whose turns stream past their edits in bounded memory.

Edge cases: null roles and texts are one space; a null conv_id is a conversation of its own; null
turns come first, equal turns in the order of role and text; a role of any other initial can't be
kept; other columns are not read; no rows give no conversations, and an empty table an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, spread_lookup

SEGMENT = 4096
#: Costs of a new role, a deletion, an insertion, and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAULTS = ("", "truncated", "blank", "duplicate")
_INITIALS = "sua"
#: What may have come last: nothing, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_NO = 1 << 40
_WHITE = " \t\n\x0b\f\r"

EDIT_SCHEMA = "conv_id bigint, place bigint, edit string, turn bigint, fault string, role string, text string"
DIGEST_SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults made by crc32(conv_id:turn) % 20, nulls as one space:
    0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's."""

    def told(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    role = F.when(F.col("__fault") == 4, "user").otherwise(told("role"))
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("__fault") == 3, 2).otherwise(1)))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").withColumn("__fault", fault)
    return rows.filter("__fault != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


# --- the program -----------------------------------------------------------------------------


class Way(NamedTuple):
    """One way on: the role before, its cost and the initials of its edits."""

    before: int
    cost: int
    edits: str


def _ways(initial: int, fault: int) -> list[list[Way]]:
    """The ways on to each role that may come last, over a turn of an initial and a fault."""
    out: list[list[Way]] = [[Way(p, DELETE, "D")] for p in range(4)]
    if fault >= 2:
        return out
    stays = TRUNCATED if fault == 1 else 0
    if initial == SYSTEM:
        out[SYSTEM].append(Way(START, stays, "K"))
    for role in (USER, ASSISTANT):
        for p in range(4):
            missing = _NEXT[p] != role  # one insertion then makes it fit
            before, cost = "I" * missing, INSERT * missing + stays
            out[role].append(Way(p, cost, before + "K") if initial == role else Way(p, cost + REROLE, before + "R"))
    return out


#: By the letter that stands for a turn: its initial (none of s, u, a: 0) and its fault.
LETTERS = {chr(97 + 4 * initial + fault): _ways(initial, fault) for initial in range(4) for fault in range(4)}
#: What ends a conversation after each role.
_ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


class Front(NamedTuple):
    """For each role that may come last: the least cost, and the rank of its least initials among the roles'."""

    cost: tuple[int, ...]
    rank: tuple[int, ...]


def entered(state: int) -> Front:
    return Front(tuple(0 if s == state else _NO for s in range(4)), (0, 0, 0, 0))


def _ranked(keys: list[tuple]) -> tuple[int, ...]:
    order = sorted(range(4), key=keys.__getitem__)
    return tuple(order.index(s) for s in range(4))


def step(front: Front, letter: str) -> tuple[Front, list[Way]]:
    """The front after one more turn, and the way taken to each role."""
    cost, rank = front
    taken = [min(ways, key=lambda w: (cost[w.before] + w.cost, rank[w.before], w.edits)) for ways in LETTERS[letter]]
    return Front(tuple(min(cost[w.before] + w.cost, _NO) for w in taken), _ranked([(rank[w.before], w.edits) for w in taken])), taken


def priced(letters: str, entry: int) -> tuple[Front, list[list[Way]]]:
    """The front after a segment that is entered after a role, and the ways taken turn by turn."""
    front, ways = entered(entry), []
    for letter in letters:
        front, taken = step(front, letter)
        ways.append(taken)
    return front, ways


def edits_of(letters: str, entry: int, leave: int) -> list[str]:
    """The edits of each turn of a segment, from one role to another."""
    out, at = [], leave
    for taken in reversed(priced(letters, entry)[1]):
        out.append(taken[at].edits)
        at = taken[at].before
    return out[::-1]


def joined(front: Front, table: list[Front]) -> tuple[Front, list[int]]:
    """The front after a segment, by its own fronts for each entry, and the entry taken to each role."""
    taken = [min(range(4), key=lambda e: (front.cost[e] + table[e].cost[s], front.rank[e])) for s in range(4)]
    cost = tuple(min(front.cost[e] + table[e].cost[s], _NO) for s, e in enumerate(taken))
    return Front(cost, _ranked([(front.rank[e], table[e].rank[s]) for s, e in enumerate(taken)])), taken


def best_end(front: Front) -> int:
    return min(range(4), key=lambda s: (front.cost[s] + _ENDS[s][0], front.rank[s], _ENDS[s][1]))


# --- over Spark ------------------------------------------------------------------------------


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with ``pos``, which ascends along every conversation; equal rows may lie in several partitions."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")))


def _lettered(rows: DataFrame) -> DataFrame:
    """(pos, conv_id, letter): each row's initial and first fault."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    last = F.substring(F.rtrim(F.col("text"), F.lit(_WHITE)), -1, 1)
    said = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    held = rows.select("pos", "conv_id", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), last.isin(".", "!", "?").alias("ended"), said.alias("said"))
    spoken = held.filter(~F.col("blank")).select("said", "pos")
    shared = spoken.groupBy("said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").select("said", "first")
    again = spread_lookup(spoken, "said", shared).filter("pos > first").select("pos", F.lit(True).alias("again"))
    fault = F.when(F.col("blank"), 2).when(F.coalesce("again", F.lit(False)), 3).when(~F.col("ended"), 1).otherwise(0)
    initial = F.instr(F.lit(_INITIALS), F.col("initial")) * (F.length("initial") > 0).cast("int")
    return held.join(again, "pos", "left").select("pos", "conv_id", F.char(97 + 4 * initial + fault).alias("letter"))


def _segments(lettered: DataFrame) -> DataFrame:
    """(conv_id, first, letters, costs, ranks) of runs of a conversation in a partition of ``_ordered``."""

    def run(batches):
        part = conv = first = None
        held: list[str] = []
        fresh = False

        def told():
            if not held:
                return
            letters = "".join(held)
            table = [priced(letters, e)[0] if e == START or not fresh else Front((_NO,) * 4, (0,) * 4) for e in range(4)]
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "first": pa.array([first], pa.int64()), "letters": [letters], "costs": pa.array([[c for f in table for c in f.cost]], pa.list_(pa.int64())), "ranks": pa.array([[r for f in table for r in f.rank]], pa.list_(pa.int64()))})

        for batch in batches:
            for pos, own, letter, at in zip(*(c.to_pylist() for c in batch.columns)):
                if at != part or own != conv or len(held) == SEGMENT or not held:
                    yield from told()
                    # A conversation begins here unless it may go on from another partition or segment.
                    fresh = part == at and own != conv
                    part, conv, first, held = at, own, pos, []
                held.append(letter)
        yield from told()

    rows = lettered.withColumn("part", F.shiftright("pos", 33)).select("pos", "conv_id", "letter", "part")
    return materialize(map_batches(rows.repartition("part").sortWithinPartitions("pos"), run, "conv_id bigint, first bigint, letters string, costs array<bigint>, ranks array<bigint>"))


def _solved(segments: DataFrame) -> DataFrame:
    """(first, entry, leave, tail): each segment's roles before and at its end, and the initials of what ends a conversation."""

    def run(batches):
        conv, begun = None, False
        taken: list[tuple[int, list[int]]] = []
        front = entered(START)

        def told():
            if taken:
                leave = end = best_end(front)
                rows = []
                for first, entries in reversed(taken):
                    rows.append((first, entries[leave], leave, "" if rows else _ENDS[end][1]))
                    leave = entries[leave]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), pa.string()])], names=["first", "entry", "leave", "tail"])

        for batch in batches:
            for own, first, costs, ranks in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or own != conv:
                    yield from told()
                    conv, begun, taken, front = own, True, [], entered(START)
                front, entries = joined(front, [Front(tuple(costs[4 * e : 4 * e + 4]), tuple(ranks[4 * e : 4 * e + 4])) for e in range(4)])
                taken.append((first, entries))
        yield from told()

    rows = segments.select("conv_id", "first", "costs", "ranks")
    return map_batches(rows.repartition("conv_id").sortWithinPartitions("conv_id", "first"), run, "first bigint, entry int, leave int, tail string")


def _with_edits(turns: DataFrame) -> DataFrame:
    """Rows dealt by conversation and in its order, each segment's letters and edits before its rows."""
    ordered = _ordered(turns)
    segments = _segments(_lettered(ordered))

    def run(batches):
        for batch in batches:
            rows = []
            for conv, first, letters, entry, leave, tail in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((conv, first, letters, ",".join(edits_of(letters, entry, leave)) + tail))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, [pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["conv_id", "pos", "letters", "edits"])

    found = segments.select("conv_id", "first", "letters").join(_solved(segments), "first").select("conv_id", "first", "letters", "entry", "leave", "tail")
    edits = map_batches(found, run, "conv_id bigint, pos bigint, letters string, edits string").withColumn("rank", F.lit(0))
    both = ordered.withColumn("rank", F.lit(1)).unionByName(edits, allowMissingColumns=True)
    return both.select("conv_id", "pos", "rank", "letters", "edits", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "pos", "rank")


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, letter, edits of a row, its role and text), row by row."""
    letters, edits = iter(()), iter(())
    for batch in batches:
        for conv, _, rank, own, told, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if rank == 0:
                letters, edits = iter(own), iter(told.split(","))
            else:
                yield conv, turn, next(letters), next(edits), role, text


def _applied(edits: str, before: int, role: str, text: str) -> Iterator[tuple[str, str | None, str | None, int]]:
    """(edit, role, text, what came last) of every edit; of a deleted turn role and text are its own."""
    for edit in edits:
        if edit == "D":
            yield edit, role, text, before
        elif edit == "K":
            before = 1 + _INITIALS.index(role[0])
            yield edit, role, text, before
        else:
            before = _NEXT[before]
            yield edit, _ROLES[before], text if edit == "R" else "", before


def repair(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation in its order: see ``EDIT_SCHEMA``; the repaired turns are those
    that aren't deleted. ``turns`` has conv_id, turn, role and text."""

    def run(batches):
        conv, begun, rows, before, place = None, False, [], START, 0

        def batch_of():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names=[f.split()[0] for f in EDIT_SCHEMA.split(", ")])

        for own, turn, letter, edits, role, text in _edited(batches):
            if not begun or own != conv:
                conv, begun, before, place = own, True, START, 0
            for edit, said_by, said, before in _applied(edits, before, role, text):
                rows.append((own, place, edit, None if edit == "I" else turn, None if edit == "I" else FAULTS[(ord(letter) - 97) % 4], said_by, said))
                place += 1
            if len(rows) >= 256:
                yield batch_of()
                rows = []
        yield batch_of()

    return map_batches(_with_edits(turns), run, EDIT_SCHEMA)


class _Told:
    """What is told of one conversation, as its rows come by."""

    def __init__(self, conv: int | None):
        self.conv, self.before, self.initial, self.cost, self.illegal = conv, START, None, 0, 0
        self.faults, self.audit, self.digest, self.begun = [0] * 4, [], hashlib.sha256(), False
        self.least = self.last = None
        self.turns = 0

    def take(self, turn, letter, edits, role, text) -> None:
        fault = (ord(letter) - 97) % 4
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.audit.append(edits)
        for edit, said_by, said, self.before in _applied(edits, self.before, role, text):
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit] + (TRUNCATED if fault == 1 and edit in "KR" else 0)
            if edit != "D":
                self.digest.update(("\n" * self.begun + f"{said_by}:{said}").encode())
                self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return self.conv, gaps, self.faults[2], self.faults[3], self.faults[1], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def digest(turns: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cost and initials of its edits and a digest of what they leave; see ``DIGEST_SCHEMA``."""

    def run(batches):
        told, rows = None, []

        def batch_of():
            types = [*[pa.int64()] * 7, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names=[f.split()[0] for f in DIGEST_SCHEMA.split(", ")])

        for own, *row in _edited(batches):
            if told is None or own != told.conv:
                rows += [told.row()] if told else []
                told = _Told(own)
                if len(rows) >= 256:
                    yield batch_of()
                    rows = []
            told.take(*row)
        rows += [told.row()] if told else []
        yield batch_of()

    return map_batches(_with_edits(turns), run, DIGEST_SCHEMA)


def digest_all(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """``digest`` of ``turns`` for every conv_id of ``conversations``; one without turns has zeros and an empty repair."""
    found = digest(turns).withColumnRenamed("conv_id", "__conv")
    asked = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    joined = asked.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()])
