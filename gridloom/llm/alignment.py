"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

Both tokenizers' tokens are laid over the bytes of a text as arrays of owners (``np.repeat`` of the
tokens' numbers by their lengths). Where both owners change at once the text is cut into groups,
and consecutive distinct pairs of owners are the overlaps. All tokens of a group are linked with
one another; how many documents hold a pair of ids linked is counted over the corpus.

Texts are encoded once. A task writes, for each document, its distinct pairs of ids and how often
each is linked, and, for each block of documents, its distinct pairs and in how many of the
block's documents each is held. Only these block tables meet the corpus counts, a hot pair by
salts; the block's documents then stream past the block's counts. The only broadcast table has a
row for each id of one vocabulary.

Edge cases: a null or empty text, and one whose joined token bytes differ from a space and the
text, has no tokens and zeros; null, repeated and tied doc_ids are documents of their own; other
columns are not read; an empty table gives an empty result. A group's links are counted by its
distinct ids, a bounded part at a time, so a long group costs its distinct pairs.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, spread_lookup, texts_of
from .words import WordMemo

#: Documents of a block, and distinct pairs of its documents after which it is closed earlier.
BLOCK_DOCS, BLOCK_PAIRS = 2048, 1 << 21
#: Links that are spelled out at a time; a group of more is counted by its distinct ids.
_SPELLED, _PART = 4096, 1 << 21
_SPACE = "▁"
#: Where a cut before a space isn't sure.
_LOOSE = re.compile("\\s |▁| \\Z")
_LOADED: dict[str, ByteTokens | PieceTokens] = {}

DIGEST_SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_SIGNED = "block bigint, rank int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, keys binary, times binary"


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many runs, one after the other."""
    ends = sizes.cumsum()
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class ByteTokens:
    """Ids of a space and a text by a byte-level tokenizer, special strings as plain text, and each id's bytes."""

    def __init__(self, path: str):
        self.memo = WordMemo(path, limit=100_000)
        self.plain = type(self.memo.tokenizer).from_str(self.memo.tokenizer.to_str())
        self.plain.encode_special_tokens = True
        spelled = self.plain.get_vocab()
        # The characters that stand for bytes: printable ones for themselves, the others in order from 256.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
        self.bytes_of = [b""] * (max(spelled.values(), default=-1) + 1)
        for piece, k in spelled.items():
            self.bytes_of[k] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode(" " + text, add_special_tokens=False).ids, np.int64)


class PieceTokens:
    """Ids of a text by a SentencePiece model, which adds the space itself, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if sp.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        #: Whether a space begins a stretch of its own: it is a merging model (scores are ranks) in which no piece has the mark after another character.
        self.by_words = all(_SPACE not in p.lstrip(_SPACE) and sp.get_score(k) <= 0 and sp.get_score(k) == int(sp.get_score(k)) for k, p in enumerate(pieces))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text, num_threads=1), np.int64)


def tokens_of(path: str) -> ByteTokens | PieceTokens:
    """One for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokens(path) if path.endswith(".model") else ByteTokens(path)
    return _LOADED[path]


def owners(sizes: np.ndarray) -> np.ndarray:
    """The number of the token that each byte belongs to."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens of A and B, pair by pair along the bytes, and whether a group begins with each.

    ``a_sizes`` and ``b_sizes`` are the tokens' lengths in bytes, with equal sums. Tokens of no
    bytes overlap nothing.
    """
    a, b = owners(a_sizes), owners(b_sizes)
    if len(a) != len(b):
        raise ValueError("Both tokenizers must cover the same bytes.")
    if not len(a):
        return a, b, np.zeros(0, bool)
    a_new, b_new = a[1:] != a[:-1], b[1:] != b[:-1]
    at = np.flatnonzero(np.concatenate([[True], a_new | b_new]))
    cut = np.concatenate([[True], a_new & b_new])[at]
    return a[at], b[at], cut


def linked_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a * width + b) of linked pairs of ids in ascending order, and how many links each has.

    Groups are numbered in order, and each token has its group's number.
    """
    na, nb = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_start, b_start = na.cumsum() - na, nb.cumsum() - nb
    small = na * nb <= _SPELLED
    chosen = small[a_group]
    of = a_group[chosen]
    keys = np.repeat(a_ids[chosen].astype(np.int64), nb[of]) * width + b_ids[runs(b_start[of], nb[of])]
    parts = [np.unique(keys, return_counts=True)]
    for g in np.flatnonzero(~small).tolist():
        ua, ca = np.unique(a_ids[a_start[g] : a_start[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b_ids[b_start[g] : b_start[g] + nb[g]], return_counts=True)
        step = max(1, _PART // len(ub))
        for k in range(0, len(ua), step):
            part = ua[k : k + step, None].astype(np.int64) * width + ub[None, :]
            parts.append((part.ravel(), (ca[k : k + step, None] * cb[None, :]).ravel()))
    if len(parts) == 1:
        return parts[0]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, where, np.concatenate([t for _, t in parts]))
    return keys, times


class Aligned(NamedTuple):
    """A text's alignment; ``keys`` are its distinct pairs in ascending order, each linked ``times`` times."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    spelled: str
    keys: np.ndarray
    times: np.ndarray


NONE = Aligned(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


class Words:
    """Alignments of words, each with a space before it, by number."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.spelled: list[str] = []
        #: Tokens of A, of B, groups and links, and whether a word must be met in its text; one column a word.
        self.told = np.zeros((5, 1 << 12), np.int64)
        self.start = np.zeros(1 << 12, np.int64)
        self.keys, self.used = np.zeros(1 << 14, np.int64), 0

    def put(self, words: list[str], told: np.ndarray, spelled: list[str], keys: np.ndarray) -> None:
        at, n = len(self.spelled), len(words)
        while self.told.shape[1] < at + n:
            self.told, self.start = np.hstack([self.told, np.zeros_like(self.told)]), np.concatenate([self.start, np.zeros_like(self.start)])
        while len(self.keys) < self.used + len(keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        self.numbers.update(zip(words, range(at, at + n)))
        self.spelled += spelled
        self.told[:, at : at + n] = told
        self.start[at : at + n] = self.used + told[3].cumsum() - told[3]
        self.keys[self.used : self.used + len(keys)] = keys
        self.used += len(keys)


class Aligner:
    """Aligns the tokens of two tokenizers.

    Where both begin anew at a space between words, a word is aligned once and remembered; ``limit``
    bounds the words held. Other texts are encoded and aligned whole, as are those with special
    strings, with spaces beside white space, or with words whose bytes a tokenizer changes.
    """

    def __init__(self, a_path: str, b_path: str, limit: int = 250_000):
        self.a, self.b, self.limit = tokens_of(a_path), tokens_of(b_path), limit
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes_of], np.int64) for t in (self.a, self.b))
        self.width = len(self.b.bytes_of)
        #: Each id in decimal, followed by what ends it: a comma or a bar (A), a comma, a semicolon or a line end (B).
        self.names = [f"{k}{end}" for end in ",|" for k in range(len(self.a_size))] + [f"{k}{end}" for end in ",;\n" for k in range(self.width)]
        self.by_words = isinstance(self.a, ByteTokens) and isinstance(self.b, PieceTokens) and self.a.memo.kind == "bytes" and self.b.by_words
        self.words = Words()

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The group of each token of A and of B, and how many groups there are."""
        x, y, cut = overlaps(self.a_size[a], self.b_size[b])
        number = cut.cumsum() - 1
        a_group, b_group = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_group[x], b_group[y] = number, number
        return a_group, b_group, int(cut.sum())

    def spelled(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, groups: int, last: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every stretch; ``last`` are the places of the stretches' last B tokens."""
        na, nb = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        a_code, b_code = a.copy(), b + 2 * len(self.a_size)
        a_code[na.cumsum() - 1] += len(self.a_size)
        b_code[nb.cumsum() - 1] += self.width
        b_code[last] += self.width
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (nb.cumsum() - nb)[a_group]] = a_code
        order[np.arange(len(b)) + na.cumsum()[b_group]] = b_code
        names = self.names
        return "".join([names[k] for k in order.tolist()]).split("\n")[:-1]

    def whole(self, text: str) -> Aligned:
        """The alignment of a text that is encoded whole."""
        if not text:
            return NONE
        a, b, raw = self.a.encode(text), self.b.encode(text), (" " + text).encode()
        if not b"".join(map(self.a.bytes_of.__getitem__, a.tolist())) == raw == b"".join(map(self.b.bytes_of.__getitem__, b.tolist())):
            return NONE
        a_group, b_group, n = self.groups(a, b)
        keys, times = linked_pairs(a, b, a_group, b_group, n, self.width)
        return Aligned(len(a), len(b), n, int(times.sum()), self.spelled(a, b, a_group, b_group, n, np.array([len(b) - 1]))[0], keys, times)

    def _same(self, words: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> bool:
        """Whether the tokens of each word, of both kinds, are a space and the word: all bytes agree, and so do the words' ends."""
        spaced = [(" " + w).encode() for w in words]
        raw, ends = b"".join(spaced), np.fromiter(map(len, spaced), np.int64, len(spaced)).cumsum()
        for ids, counts, sizes, names in ((a, n_a, self.a_size, self.a.bytes_of), (b, n_b, self.b_size, self.b.bytes_of)):
            if not counts.all() or not np.array_equal(sizes[ids].cumsum()[counts.cumsum() - 1], ends) or b"".join([names[k] for k in ids.tolist()]) != raw:
                return False
        return True

    def _learn(self, words: list[str]) -> None:
        """Aligns words, all at once: the border between two of them cuts both tokenizers' tokens."""
        flat, n_a = self.a.memo.encode(pa.array([" " + w for w in words], pa.string()))
        a, b_ids = flat.astype(np.int64), self.b.processor.encode(words, num_threads=1)
        n_b = np.fromiter(map(len, b_ids), np.int64, len(b_ids))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(n_b.sum()))
        if not self._same(words, a, n_a, b, n_b):
            if len(words) > 1:  # those that a tokenizer changes are found by halves
                for half in (words[: len(words) // 2], words[len(words) // 2 :]):
                    self._learn(half)
                return
            self.words.put(words, np.array([[0], [0], [0], [0], [1]]), [""], np.zeros(0, np.int64))
            return
        a_group, b_group, groups = self.groups(a, b)
        last = n_b.cumsum() - 1
        spelled = self.spelled(a, b, a_group, b_group, groups, last)
        links = np.bincount(a_group, minlength=groups) * np.bincount(b_group, minlength=groups)
        upto = b_group[last]
        n_groups = np.diff(upto, prepend=-1)
        n_links = np.diff(links.cumsum()[upto], prepend=0)
        large = np.add.reduceat(links > _SPELLED, upto - n_groups + 1, dtype=np.int64)
        many = large > 0  # too long a group to spell out
        chosen = np.repeat(~many, n_a)
        b_size = np.bincount(b_group, minlength=groups)
        of = a_group[chosen]
        keys = np.repeat(a[chosen], b_size[of]) * self.width + b[runs((b_size.cumsum() - b_size)[of], b_size[of])]
        self.words.put(words, np.stack([n_a, n_b, n_groups, np.where(many, 0, n_links), many]), spelled, keys)

    def align(self, texts: list[str]) -> list[Aligned]:
        """The alignment of each text."""
        if not self.by_words:
            return [self.whole(t) for t in texts]
        if len(self.words.spelled) > self.limit or self.words.used > 16 * self.limit:
            self.words = Words()
        quick = [k for k, t in enumerate(texts) if t and t[0] != " " and not self.a.memo.specials.search(t) and not _LOOSE.search(t)]
        found: dict[int, Aligned] = {}
        if quick:
            split = pc.split_pattern(pa.array([texts[k] for k in quick], pa.string()), " ")
            distinct = split.flatten().dictionary_encode()
            words = distinct.dictionary.to_pylist()
            new = [w for w in words if w not in self.words.numbers]
            if new:
                self._learn(new)
            memo = self.words
            numbers = np.fromiter(map(memo.numbers.__getitem__, words), np.int64, len(words))[distinct.indices.to_numpy(zero_copy_only=False)]
            ends = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum().tolist()
            for k, start, end in zip(quick, [0, *ends], ends):
                own = numbers[start:end]
                n_a, n_b, n_groups, n_links, odd = memo.told[:, own].sum(axis=1).tolist()
                if not odd:
                    keys, times = np.unique(memo.keys[runs(memo.start[own], memo.told[3, own])], return_counts=True)
                    found[k] = Aligned(n_a, n_b, n_groups, n_links, ";".join([memo.spelled[w] for w in own.tolist()]), keys, times)
        return [found[k] if k in found else self.whole(t) for k, t in enumerate(texts)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _packed(keys: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as differences, which compress well, and their numbers."""
    return np.diff(keys, prepend=0).astype("<i8").tobytes(), times.astype("<u4").tobytes()


def _unpacked(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, "<i8").cumsum(), np.frombuffer(times, "<u4").astype(np.int64)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every document's alignment, a row each (rank 1), and every block's distinct pairs with the
    number of its documents that hold each (rank 0, before its documents); see ``_SIGNED``."""

    def run(batches):
        from pyspark import TaskContext

        own, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        docs_held = pairs_held = 0

        def told(rows):
            columns = list(zip(*rows)) or [()] * 10
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in _SIGNED.split(", ")])

        def closed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return (block, 0, None, None, None, None, None, None, *_packed(keys, n))

        for batch in batches:
            rows = []
            for doc, x in zip(batch.column(0).to_pylist(), own.align(batch.column(1).to_pylist())):
                digest = hashlib.sha256(x.spelled.encode()).hexdigest() if x.n_a else ""
                rows.append((block, 1, doc, x.n_a, x.n_b, x.n_groups, x.n_links, digest, *_packed(x.keys, x.times)))
                if not x.n_a:
                    continue
                held.append(x.keys)
                docs_held, pairs_held = docs_held + 1, pairs_held + len(x.keys)
                if docs_held >= BLOCK_DOCS or pairs_held >= BLOCK_PAIRS:
                    rows.append(closed())
                    block, held, docs_held, pairs_held = block + 1, [], 0, 0
            yield told(rows)
        if held:
            yield told([closed()])

    return map_batches(texts_of(docs), run, _SIGNED)


def pair_counts(signed: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(block, key, n) of all blocks' pairs, and (key, n, best): in how many documents a pair is
    held over the corpus, and whether that is the highest number of its A id."""

    def run(batches):
        for batch in batches:
            for block, keys, times in zip(*(c.to_pylist() for c in batch.columns)):
                keys, times = _unpacked(keys, times)
                for k in range(0, len(keys), 1 << 16):
                    part = keys[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(part), block)), "key": pa.array(part), "n": pa.array(times[k : k + (1 << 16)])})

    held = map_batches(signed.filter("rank = 0").select("block", "keys", "times"), run, "block bigint, key bigint, n bigint")
    counts = materialize(held.groupBy("key").agg(F.sum("n").alias("n")))
    a = F.expr(f"key div {width}")
    # A row for each id of A's vocabulary, so its size is bounded whatever the corpus.
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    best = counts.withColumn("a", a).join(F.broadcast(highest), "a").select("key", "n", (F.col("n") == F.col("highest")).alias("best"))
    return held.select("block", "key"), best


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """What every document's links are worth over the corpus; see ``DIGEST_SCHEMA``."""
    width = len(tokens_of(b_path).bytes_of)
    signed = materialize(align(docs, a_path, b_path))
    held, best = pair_counts(signed, width)
    found = spread_lookup(held, "key", best).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "n", "best"))).alias("pairs"))
    tables = found.select("block", F.lit(0).alias("rank"), *[F.col(f"pairs.{c}").alias(c) for c in ("key", "n", "best")])
    rows = signed.filter("rank = 1").unionByName(tables, allowMissingColumns=True)
    names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]

    def run(batches):
        known, pairs = None, ()
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("block", "rank")}
                block = row["block"].as_py()
                if row["rank"].as_py() == 0:
                    known = block
                    pairs = tuple(batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("key", "n", "best"))
                    continue
                doc, n_a, n_b, groups, links, sha, keys, times = (batch.column(c)[k].as_py() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"))
                n_best = count_sum = 0
                if keys:
                    if known != block:
                        raise RuntimeError("A block's counts are missing.")
                    keys, times = _unpacked(keys, times)
                    at = np.searchsorted(pairs[0], keys)
                    n_best, count_sum = int(times[pairs[2][at]].sum()), int((times * pairs[1][at]).sum())
                rows.append((doc, n_a, n_b, groups, links, n_best, count_sum, sha))
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 7, pa.string()])], names=names)

    return map_batches(rows.repartition("block").sortWithinPartitions("block", "rank"), run, DIGEST_SCHEMA)
