"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the beginnings and endings of longer ones, each
hashed to a number; a text has a term or not. The machine learns a weight and a vector for each
of the terms that are kept, so that terms weigh together (an insult beside the mention of a
group) and not only alone. Three quarters of those kept tell the labels apart best by themselves
on the training rows; the others are the frequent terms that gain most in a pair over its two
members, as a pair may tell what neither of them does.

Edge cases: a null or empty text has no term and the score of the bias alone; null, repeated
and tied doc_ids are scored row by row; without labelled rows of both classes every score is the
share of toxic labels (0.5 without any); other columns are not read by a score.
"""

from __future__ import annotations

import pickle
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of

#: The training sample's bound: labelled rows of each class, those with the least hash of doc_id.
TRAIN_ROWS = 5000
HASH_BITS = 22
KEPT_TERMS = 2048
#: Frequent terms whose pairs are looked at, and the rows that a pair must be in.
FREQUENT_TERMS = 4096
_LEAST_ROWS = 8
_EDGES = (4, 5, 6)
_PUNCTUATION = ".,;:!?\"'()[]#$%&*|"


def held_out() -> Column:
    """Rows that no label may be learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text and y of at most ``rows`` training documents of each class.

    The sample's ids are picked by a hash of doc_id from the labels alone; only they, a table of
    a fixed size, are broadcast to the documents.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~F.coalesce(held_out(), F.lit(True)))
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).groupBy("doc_id", "y").agg(F.lit(1)).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.select(F.col("doc_id").alias("__id"), "y")
    texts = texts_of(docs)
    return texts.join(F.broadcast(picked), texts["doc_id"] == picked["__id"]).select("text", "y")


class Terms:
    """Numbers of words' terms, as places among ``known`` (ascending) if given; with a bounded memo."""

    def __init__(self, known: np.ndarray | None = None, bits: int = HASH_BITS, limit: int = 60_000):
        self.mask, self.limit = (1 << bits) - 1, limit
        self.memo: dict[str, tuple[int, ...]] = {}
        self.place = None if known is None else {t: k for k, t in enumerate(known.tolist())}

    def of_word(self, word: str) -> tuple[int, ...]:
        if not word:
            return ()
        forms = [f"w{word}"]
        for n in _EDGES:
            if len(word) > n:
                forms += (f"b{word[:n]}", f"e{word[-n:]}")
        mask, place = self.mask, self.place
        found = {crc32(f.encode(errors="replace")) & mask for f in forms}
        return tuple(found if place is None else [place[t] for t in found if t in place])

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of every term of every text, each once, ascending. Texts may be null."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        if len(self.memo) > self.limit:
            self.memo.clear()
        get, of_word, memo, found = self.memo.get, self.of_word, self.memo, []
        for word in words.dictionary.to_numpy(zero_copy_only=False):
            word = word.lower().strip(_PUNCTUATION)
            if (terms := get(word)) is None:
                terms = of_word(word)
                if len(word) < 64:
                    memo[word] = terms
            found.append(terms)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        starts = sizes.cumsum() - sizes
        at = words.indices.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        has = sizes[at] > 0
        owner, at = owner[has], at[has]
        n = sizes[at]
        ends = n.cumsum()
        places = np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        pairs = np.sort((np.repeat(owner, n) << HASH_BITS) | flat[places])
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


class FactorizationMachine:
    """score = sigmoid(b + sum w_i + half (|sum v_i|^2 - sum |v_i|^2)) over the terms present."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.terms, self.bias, self.weights, self.vectors = np.asarray(terms, np.int64), bias, weights, vectors
        self.squares = (vectors**2).sum(axis=1)

    def score_places(self, owner: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
        """Scores of ``rows`` rows from (row, place among the terms), ascending and each once."""
        z = np.full(rows, self.bias)
        if len(owner):
            own, first = np.unique(owner, return_index=True)
            together = np.add.reduceat(self.vectors[place], first)
            z[own] += np.add.reduceat(self.weights[place], first) + 0.5 * ((together**2).sum(axis=1) - np.add.reduceat(self.squares[place], first))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, present: set[int]) -> float:
        """The score of one row of hashed terms."""
        place = np.flatnonzero(np.isin(self.terms, list(present)))
        return float(self.score_places(np.zeros(len(place), np.int64), place, 1)[0])


def _label_statistic(n: np.ndarray, n1: np.ndarray, rows: int, toxic: int) -> np.ndarray:
    """How far the toxic rows among ``n`` are from the share of all rows, in standard deviations."""
    share = toxic / rows
    return np.abs(n1 - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))


def _pair_gains(present: np.ndarray, y: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For each column of ``present`` (rows, terms; 0 or 1), how much more its best pair tells of the label than either member."""
    toxic, gains, block = present[y > 0], np.zeros(present.shape[1]), 512
    clean = present[y == 0]
    for a in range(0, present.shape[1], block):
        for b in range(a, present.shape[1], block):
            n1, n0 = (part[:, a : a + block].astype(np.float32).T @ part[:, b : b + block].astype(np.float32) for part in (toxic, clean))
            z = _label_statistic(n1 + n0, n1, len(y), len(toxic)) - np.maximum(alone[a : a + block, None], alone[None, b : b + block])
            z[n1 + n0 < _LEAST_ROWS] = 0
            if a == b:
                np.fill_diagonal(z, 0)
            gains[a : a + block] = np.maximum(gains[a : a + block], z.max(axis=1))
            gains[b : b + block] = np.maximum(gains[b : b + block], z.max(axis=0))
    return gains


def fit(rows: list[tuple[np.ndarray, int]], kept: int = KEPT_TERMS, frequent: int = FREQUENT_TERMS, factors: int = 8, epochs: int = 60, rate: float = 0.02, decay: float = 1e-2, seed: int = 7) -> FactorizationMachine:
    """Picks terms and fits the machine to (ascending term numbers, label) rows with Adam on mini-batches."""
    y = np.array([label for _, label in rows], np.float32)
    none = FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        none.bias = float(np.log(share / (1 - share)))
        return none
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    terms, at = np.unique(np.concatenate([np.asarray(t, np.int64) for t, _ in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(y)), [len(t) for t, _ in rows])
    n, toxic = np.bincount(at, minlength=len(terms)), np.bincount(at[y[owner] > 0], minlength=len(terms))
    alone = _label_statistic(n, toxic, len(y), n1)

    def dense(columns: np.ndarray) -> np.ndarray:
        place = np.full(len(terms), -1)
        place[columns] = np.arange(len(columns))
        found = np.zeros((len(y), len(columns)), np.uint8)
        own = place[at] >= 0
        found[owner[own], place[at[own]]] = 1
        return found

    best = np.argsort(-alone, kind="stable")[: kept - kept // 4]
    often = np.sort(np.argsort(-n, kind="stable")[:frequent])
    gains = np.zeros(len(terms))
    gains[often] = _pair_gains(dense(often), y, alone[often])
    gains[best] = -1
    best = np.sort(np.concatenate([best, np.argsort(-gains, kind="stable")[: kept // 4]])) if len(terms) > kept else np.arange(len(terms))
    x = dense(best)

    rng = np.random.default_rng(seed)
    b, w, v = np.zeros(1, np.float32), np.zeros(len(best), np.float32), rng.normal(0, 0.01, (len(best), factors)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (b, w, v)]
    balance = np.where(y > 0, 0.5 / n1, 0.5 / n0).astype(np.float32) * len(y)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 512):
            part = order[k : k + 512]
            xb = x[part].astype(np.float32)
            together = xb @ v
            squares = (v**2).sum(axis=1)
            raw = b + xb @ w + 0.5 * ((together**2).sum(axis=1) - xb @ squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * balance[part] / len(part)
            xe = xb.T * error
            grads = [error.sum(keepdims=True), xe.sum(axis=1) + decay * w, xe @ together - xe.sum(axis=1)[:, None] * v + decay * v]
            step += 1
            for p, g, (m, s) in zip((b, w, v), grads, state):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(terms[best], float(b[0]), w.astype(np.float64), v.astype(np.float64))


def _as_lists(owner: np.ndarray, terms: np.ndarray, rows: int) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(terms.astype(np.int32)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, kept: int = KEPT_TERMS, frequent: int = FREQUENT_TERMS) -> FactorizationMachine:
    """Fits the machine to a bounded sample of labelled documents.

    Terms are made and counted on the executors. The driver gets, for each sampled row, which of
    the terms that may be kept it has: those that tell most alone or are most frequent, of which
    there are ``kept`` and ``frequent`` at most, so its memory has a bound whatever texts hold.
    """

    def terms_of(batches):
        terms = Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_as_lists(*terms.of_texts(batch.column(0)), len(batch)), batch.column(1)], names=["terms", "y"])

    sample = materialize(map_batches(labelled_sample(docs, labels, "toxic", rows), terms_of, "terms array<int>, y int"))
    size, toxic = sample.agg(F.count("*"), F.sum("y")).collect()[0]
    if not size or toxic in (0, size):
        return fit([(np.zeros(0, np.int64), r["y"]) for r in sample.select("y").collect()], kept, frequent)
    counts = sample.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("n1"))
    share = toxic / size
    alone = F.abs(F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    counts = materialize(counts.withColumn("alone", alone))
    told, often = (counts.orderBy(F.desc(by), "term").limit(most).select("term") for by, most in (("alone", kept), ("n", frequent)))
    may = np.array(sorted({r["term"] for r in told.collect()} | {r["term"] for r in often.collect()}), np.int32)
    packed = docs.sparkSession.sparkContext.broadcast(may)

    def narrowed(batches):
        may = packed.value
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            known = np.isin(flat, may)
            yield pa.RecordBatch.from_arrays([_as_lists(owner[known], flat[known], len(batch)), batch.column(1)], names=["terms", "y"])

    found = map_batches(sample, narrowed, "terms array<int>, y int").select(F.col("y"), F.col("terms")).toArrow()
    lists = [(np.asarray(t.values), y.as_py()) for y, t in zip(found.column(0), found.column(1))]
    lists.sort(key=lambda row: (row[1], row[0].tobytes()))  # fits alike however rows were dealt
    return fit(lists, kept, frequent)


def _scores(packed, batches, column: int):
    """Each batch with the scores of its texts."""
    machine = pickle.loads(packed.value)
    terms = Terms(machine.terms)
    for batch in batches:
        yield batch, machine.score_places(*terms.of_texts(batch.column(column)), len(batch))


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id and score of every whole text. The machine has a fixed size."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))

    def run(batches):
        for batch, scores in _scores(packed, batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return map_batches(texts_of(docs), run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))
    at = docs.columns.index("text")

    def run(batches):
        for batch, scores in _scores(packed, batches, at):
            yield batch.filter(pa.array(scores < threshold))

    return map_batches(docs, run, docs.schema)
