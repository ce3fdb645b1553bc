"""Quality by a sparse ensemble of rules over text statistics.

Statistics of a text are Spark column expressions. On a bounded sample of labelled rows, small
trees are grown on reweighted rows; each path from a root to a node is a rule, a conjunction of
thresholds. A logistic regression with an L1 penalty weighs the rules, most of them with zero,
and those left are compiled into one Spark column expression, so that scoring needs no Python.

Edge cases: a null or empty text has statistics of zero and a score like any other; null,
repeated and tied doc_ids are scored row by row; without labelled rows of both classes every
score is the share of good labels (0.5 without any); other columns are not read by a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .toxicity import labelled_sample

#: The training sample's bound: labelled rows of each class.
TRAIN_ROWS = 4000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "#$%&*|<>{}[]\\^~_=+@"
_DIGITS = "0123456789"


def statistics(text: str = "text") -> dict[str, Column]:
    """Name and expression of each statistic of a whole text column, which is not null."""
    t = F.col(text)
    n = F.length(t)
    safe = F.greatest(n, F.lit(1))

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(t, chars, ""))) / safe

    words = F.split(t, "[ \\t\\n]+")
    lines = F.split(t, "\\n")
    return {
        "chars": F.log1p(n.cast("double")),
        "upper": share(_UPPER),
        "digits": share(_DIGITS),
        "marks": share(_MARKS),
        "bangs": share("!?"),
        "stops": share(".,;:"),
        "word_chars": n / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "lines": F.log1p(F.size(lines).cast("double")),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_chars": F.log1p(n / F.size(lines)),
    }


NAMES = ("chars", "upper", "digits", "marks", "bangs", "stops", "word_chars", "distinct_words", "lines", "distinct_lines", "line_chars")


@dataclass(frozen=True)
class Rule:
    """Holds where every (statistic, is above, threshold) does."""

    terms: tuple[tuple[str, bool, float], ...]

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        held = [x[name] > cut if above else x[name] <= cut for name, above, cut in self.terms]
        return np.logical_and.reduce(held)

    def column(self, stats: dict[str, Column]) -> Column:
        held = [stats[name] > F.lit(cut) if above else stats[name] <= F.lit(cut) for name, above, cut in self.terms]
        out = held[0]
        for h in held[1:]:
            out = out & h
        return out


def _best_cut(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, statistic, threshold) of the split that most lowers the squared error of ``residual``."""
    best = (1e-9, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, w = x[order, j], (residual * weight)[order].cumsum(), weight[order].cumsum()
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if len(at):
            gain = g[at] ** 2 / w[at] + (g[-1] - g[at]) ** 2 / (w[-1] - w[at]) - g[-1] ** 2 / w[-1]
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def _grow(x, residual, weight, rows, path, depth, least, rules, out, rate):
    """Grows one tree: adds each node's path to ``rules`` and its leaves' values to ``out``."""
    if path:
        rules.append(Rule(tuple(path)))
    if depth and len(rows) >= 2 * least:
        _, j, cut = _best_cut(x[rows], residual[rows], weight[rows], least)
        if j >= 0:
            for above in (False, True):
                side = rows[(x[rows, j] > cut) == above]
                _grow(x, residual, weight, side, [*path, (NAMES[j], above, cut)], depth - 1, least, rules, out, rate)
            return
    out[rows] += rate * (residual[rows] * weight[rows]).sum() / max(weight[rows].sum(), 1e-12) * 4


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, least: int = 10, seed: int = 3) -> list[Rule]:
    """Distinct paths of trees that are grown in turn on the residuals of those before."""
    rng, raw, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(trees):
        part = np.sort(rng.permutation(len(y))[: max(2 * least, len(y) // 2)])
        residual, step = y - 1 / (1 + np.exp(-raw)), np.zeros(len(y))
        found: list[Rule] = []
        _grow(x, residual, weight, part, [], depth, least, found, step, 0.5)
        rules += found
        # The leaves' values hold for rows outside the part as well.
        leaves = [r for r in found if not any(o != r and o.terms[: len(r.terms)] == r.terms for o in found)]
        columns = dict(zip(NAMES, x.T))
        for r in leaves:
            on = r.on(columns)
            inside = part[on[part]]
            if len(inside):
                raw[on] += step[inside[0]]
    return list(dict.fromkeys(rules))


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[Rule, float]]

    def score_column(self, stats: dict[str, Column]) -> Column:
        """The score as one Spark expression."""
        raw = F.lit(float(self.bias))
        for rule, weight in self.rules:
            raw = raw + F.when(rule.column(stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))

    def score_array(self, x: dict[str, np.ndarray]) -> np.ndarray:
        raw = self.bias + sum((w * r.on(x) for r, w in self.rules), np.zeros(len(next(iter(x.values())))))
        return 1 / (1 + np.exp(-raw))


def lasso_logistic(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 2e-3, steps: int = 800) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise logistic loss plus ``penalty`` times the weights' L1 norm (FISTA)."""
    weight = weight / weight.sum()
    b, w = 0.0, np.zeros(r.shape[1])
    vb, vw, t = b, w.copy(), 1.0
    rate = 4.0 / max((weight[:, None] * r).sum(axis=0).sum() + 1, 1)
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(vb + r @ vw))) - y)
        nb, nw = vb - rate * error.sum(), vw - rate * (r.T @ error)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, prior: float | None = None) -> RuleEnsemble:
    """Rules and weights for statistics ``x`` (columns as NAMES) and labels ``y``.

    ``prior`` is the share of label 1 that scores are to reflect (of the sample if None).
    """
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    columns = dict(zip(NAMES, x.T))
    on = np.array([r.on(columns) for r in rules], float).T.reshape(len(y), len(rules))
    share = y.mean() if prior is None else prior
    weight = np.where(y > 0, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    bias, w = lasso_logistic(on, y, weight)
    return RuleEnsemble(bias, [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleEnsemble:
    """Fits the ensemble to a bounded sample; both classes count alike, so 0.5 is the even point."""
    sample = labelled_sample(docs, labels, "quality", rows)
    found = sorted(sample.select("y", *[c.cast("double").alias(k) for k, c in statistics().items()]).collect())
    x = np.array([[r[k] for k in NAMES] for r in found], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["y"] for r in found], float), prior=0.5)


def score(docs: DataFrame, ensemble: RuleEnsemble) -> DataFrame:
    """doc_id and score of every whole text, by Spark expressions alone."""
    measured = texts_of(docs).select("doc_id", *[c.cast("double").alias(k) for k, c in statistics().items()])
    return measured.select("doc_id", ensemble.score_column({k: F.col(k) for k in NAMES}).alias("score"))
