"""Secret scans: fixed patterns, and formats learnt by grammar inference.

Labelled credentials are read into a prefix tree, whose states are merged where their
continuations are statistically compatible (a Hoeffding bound on the frequencies, tested down
the tree), which gives a probabilistic automaton. Candidates are the long unbroken tokens of a
text; each is scored by its likelihood under the automaton against that under a model of plain
characters, and those that gain enough are spans of kind ``format``.

Symbols of the automaton are characters of a literal prefix and classes after it, so that the
prefix of a format (and the separators in it) and its length are learnt, not its random part.

Credentials of several segments, or of no fixed length, have an automaton of their own, in which
states of any depth merge, so that loops are learnt. Besides a whole candidate, its parts between
separators are scored, as a credential may be glued to a name, a path or an address: from each
start that a format may have, one pass carries the likelihood along and takes the last end where it
is enough; starts within what was taken are passed over. A start is given up when it lies far below
what it must gain, or where an earlier one was in the same state with no less, so a token of any
length costs about its length.

Formats outside the list are found by their shape alone: one automaton is learnt from the classes
of all labelled credentials, prefix and all, another from those of plain tokens (words, names of
programs, hosts, numbers, dates), and a part that gains more over the second than nearly all plain
tokens of a further sample (the threshold is fitted to them) is a span too.

Edge cases: a null or empty text has no spans; offsets count code points and ends are
exclusive; null, repeated and tied doc_ids are scanned row by row; other columns are not read
by a scan and pass a redaction unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

#: Fixed patterns of the contract: kind, pattern, group that is measured, least length of it.
BASE = (
    ("assign", re.compile(r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = (*(k for k, *_ in BASE), "format")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api")

# Public credential formats, as (prefix, alphabet, length after the prefix).
FORMATS = (
    ("ghp_", "alnum", 36),
    ("gho_", "alnum", 36),
    ("github_pat_", "alnum", 82),
    ("glpat-", "alnum", 20),
    ("xoxb-", "digit", 12),
    ("xoxp-", "digit", 12),
    ("sk_live_", "alnum", 24),
    ("rk_live_", "alnum", 24),
    ("sk-", "alnum", 48),
    ("AIza", "alnum", 35),
    ("ASIA", "upper", 16),
    ("SG.", "alnum", 66),
    ("npm_", "alnum", 36),
    ("eyJ", "alnum", 60),
    ("hf_", "alnum", 34),
)
_ALPHABETS = {
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "digit": "0123456789",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
}
# Credentials of segments, as (prefix, ((alphabet, least, most length), ...), separator).
SEGMENTED = (
    ("xoxb-", (("digit", 10, 13), ("digit", 10, 13), ("alnum", 24, 24)), "-"),
    ("xoxp-", (("digit", 10, 13), ("digit", 10, 13), ("digit", 10, 13), ("lowhex", 32, 32)), "-"),
    ("xoxa-", (("digit", 10, 13), ("digit", 10, 13), ("digit", 10, 13), ("lowhex", 32, 32)), "-"),
    ("eyJ", (("url", 17, 120), ("url", 24, 400), ("url", 43, 342)), "."),
    ("SG.", (("url", 22, 22), ("url", 43, 43)), "."),
    ("github_pat_", (("alnum", 22, 22), ("alnum", 59, 59)), "_"),
    ("glpat-", (("url", 20, 20),), ""),
    ("AIza", (("url", 35, 35),), ""),
    ("sk-proj-", (("url", 40, 160),), ""),
    ("sk-ant-", (("url", 40, 110),), ""),
)
# Further ones, of which no shape is learnt, as hexadecimal digits are in names and sums too.
UNSHAPED = (
    ("key-", (("lowhex", 32, 32),), ""),
    ("shpat_", (("lowhex", 32, 32),), ""),
    ("dop_v1_", (("lowhex", 64, 64),), ""),
    ("ya29.", (("url", 60, 220),), ""),
)
_ALPHABETS |= {"url": _ALPHABETS["alnum"] + "-_", "lowhex": "0123456789abcdef"}
_SEPARATORS = "=/.+-_"
#: A start is given up when it lies so many nats below what a credential must gain.
_GIVEN_UP = 60.0
#: Characters of a start after which only states and classes decide what follows.
_SETTLED = 16
#: The least length of a credential known by its shape alone, and the parts that may be one.
_SHAPED = 20
#: The threshold lies by a margin (nats) above what this share of further plain tokens gains.
_PLAIN_BELOW = 0.998
_SHAPE_MARGIN = 4.0
_SHAPED_PART = re.compile(f"[A-Za-z0-9](?:[A-Za-z0-9_-]{{{_SHAPED - 2},}})[A-Za-z0-9]")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")


def labelled_credentials(each: int = 40, seed: int = 5) -> list[str]:
    """The training set: ``each`` made-up credentials of every public format."""
    rng = random.Random(seed)
    return [prefix + "".join(rng.choice(_ALPHABETS[kind]) for _ in range(length)) for prefix, kind, length in FORMATS for _ in range(each)]


def labelled_segmented(each: int = 200, seed: int = 6, formats=SEGMENTED) -> list[tuple[str, str]]:
    """Made-up credentials of segments, as (prefix, the rest)."""
    rng = random.Random(seed)

    def segment(kind, least, most):
        return "".join(rng.choice(_ALPHABETS[kind]) for _ in range(rng.randint(least, most)))

    return [(prefix, between.join(segment(*part) for part in parts)) for prefix, parts, between in formats for _ in range(each)]


def classes(rest: str) -> str:
    """Classes of the characters after a literal prefix."""
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in rest)


def symbols(token: str, prefix: int = 11) -> str:
    """The automaton's view of a token: its first characters as they are up to the last
    separator among them (or four if there is none), then classes of characters."""
    cut = max((token.rfind(c, 0, prefix) for c in "_-."), default=-1) + 1 or 4
    return token[:cut] + "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token[cut:])


def labelled_plain(count: int = 6000, seed: int = 9) -> list[str]:
    """Made-up tokens that are no credentials: words, names of programs, hosts, numbers, dates and identifiers."""
    rng = random.Random(seed)

    def word(least=2, most=12):
        return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(least, most) // 2 + 1))

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def number():
        return digits(rng.randint(1, 4))

    made = (
        lambda: rng.choice((str, str.capitalize, str.upper))(word(16, 40)),
        lambda: "".join(word(2, 9).capitalize() for _ in range(rng.randint(2, 6))),
        lambda: "".join(rng.choice((word(2, 9).capitalize(), word(2, 9).capitalize(), word(2, 6).upper())) for _ in range(rng.randint(2, 6))) + rng.choice(("", "", number())),
        lambda: word() + "".join(rng.choice((word(2, 9).capitalize(), word(2, 3).upper(), number())) for _ in range(rng.randint(1, 5))),
        lambda: rng.choice("_-").join(rng.choice((word, number))() for _ in range(rng.randint(2, 7))),
        lambda: "_".join(rng.choice((word().upper(), number())) for _ in range(rng.randint(2, 6))),
        lambda: "-".join(rng.choice((word().capitalize(), word(), number())) for _ in range(rng.randint(2, 6))),
        lambda: digits(rng.randint(16, 40)),
        lambda: "-".join(digits(n) for n in (4, 2, 2, rng.choice((2, 4, 6)), rng.choice((2, 4, 6)))),
        lambda: f"{digits(4)}{digits(2)}{digits(2)}T{digits(6)}Z-{word()}",
        lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 20, 32, 40, 64)))),
        lambda: word() + number() + "-" + word() + number(),
    )
    return [w for k in range(count) if len(w := made[k % len(made)]()) >= _SHAPED]


class Automaton:
    """A probabilistic automaton: ``moves[state][symbol] = (next, count)`` and ``ends[state]``."""

    def __init__(self):
        self.moves: list[dict[str, list]] = [{}]
        self.ends: list[int] = [0]
        self.seen: list[int] = [0]

    @classmethod
    def prefix_tree(cls, words: list[str]) -> Automaton:
        tree = cls()
        for word in words:
            state = 0
            tree.seen[0] += 1
            for c in word:
                if c not in tree.moves[state]:
                    tree.moves.append({})
                    tree.ends.append(0)
                    tree.seen.append(0)
                    tree.moves[state][c] = [len(tree.moves) - 1, 0]
                step = tree.moves[state][c]
                step[1] += 1
                state = step[0]
                tree.seen[state] += 1
            tree.ends[state] += 1
        return tree

    def _alike(self, a: int, b: int, bound: float) -> bool:
        """Whether the frequencies of a, b and all their common continuations agree."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            na, nb = self.seen[a], self.seen[b]
            if not na or not nb:
                continue
            limit = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > limit:
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                ca, cb = self.moves[a].get(c, (None, 0)), self.moves[b].get(c, (None, 0))
                if abs(ca[1] / na - cb[1] / nb) > limit:
                    return False
                if ca[0] is not None and cb[0] is not None and ca[0] != cb[0]:
                    waiting.append((ca[0], cb[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds state b, the root of a tree, to state a."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            for c, (to, count) in self.moves[b].items():
                if c in self.moves[a]:
                    self.moves[a][c][1] += count
                    waiting.append((self.moves[a][c][0], to))
                else:
                    self.moves[a][c] = [to, count]

    def states(self) -> set[int]:
        """The states that words can reach; merged ones are none of them."""
        found, waiting = {0}, [0]
        while waiting:
            for to, _ in self.moves[waiting.pop()].values():
                if to not in found:
                    found.add(to)
                    waiting.append(to)
        return found

    def compacted(self) -> Automaton:
        """Without the states that merging left behind."""
        left = sorted(self.states())
        number = {state: k for k, state in enumerate(left)}
        self.moves = [{c: [number[to], count] for c, (to, count) in self.moves[state].items()} for state in left]
        self.ends, self.seen = [self.ends[state] for state in left], [self.seen[state] for state in left]
        return self

    def merged(self, alpha: float = 0.05) -> Automaton:
        """Merges compatible states, red-blue: each blue state joins the first red one that is
        alike or turns red. Only states of the same depth merge, which keeps the lengths of
        formats."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, depth = [0], {0: 0}
        blue = sorted((to, 0, c) for c, (to, _) in self.moves[0].items())
        while blue:
            state, parent, c = blue.pop(0)
            depth[state] = depth[parent] + 1
            for r in red:
                if depth[r] == depth[state] and min(self.seen[r], self.seen[state]) and self._alike(r, state, bound):
                    self.moves[parent][c][0] = r
                    old = {x for x in self.moves[r]}
                    self._fold(r, state)
                    blue += [(self.moves[r][x][0], r, x) for x in sorted(self.moves[r].keys() - old)]
                    break
            else:
                red.append(state)
                blue += [(to, state, x) for x, (to, _) in sorted(self.moves[state].items())]
            blue.sort(key=lambda b: (depth[b[1]], b[0]))
        return self.compacted()

    def looped(self, alpha: float = 0.05) -> Automaton:
        """Merges compatible states of any depth, so that lengths which vary become loops."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            blue = [(-self.seen[to], to, p, c) for p in red for c, (to, _) in self.moves[p].items() if to not in red]
            if not blue:
                return self.compacted()
            _, state, parent, c = min(blue)
            for r in red[1:]:
                if self._alike(r, state, bound):
                    self.moves[parent][c][0] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)

    def log_likelihood(self, word: str, smooth: float = 0.02) -> float:
        """Log-probability of a word; a move never seen costs its smoothed share and stays put."""
        state, total = 0, 0.0
        for c in word:
            n = self.seen[state] + smooth * 64
            to, count = self.moves[state].get(c, (state, 0))
            total += math.log((count + smooth) / n)
            if not count and not self.moves[state]:
                total += math.log(smooth)
            state = to
        return total + math.log((self.ends[state] + smooth) / (self.seen[state] + smooth * 64))


class Compiled:
    """An automaton's moves with their log-probabilities, as ``log_likelihood`` has them."""

    def __init__(self, automaton: Automaton, smooth: float = 0.02):
        self.moves: list[dict[str, tuple[int, float]]] = []
        self.lost: list[float] = []
        self.ends: list[float] = []
        for moves, seen, ends in zip(automaton.moves, automaton.seen, automaton.ends):
            n = seen + smooth * 64
            self.moves.append({c: (to, math.log((count + smooth) / n)) for c, (to, count) in moves.items() if count})
            self.lost.append(math.log(smooth / n) + (0 if moves else math.log(smooth)))
            self.ends.append(math.log((ends + smooth) / n))


class Scanner:
    """Base patterns and the learnt formats."""

    def __init__(self, credentials: list[str] | None = None, gain: float = -0.5):
        words = [symbols(w) for w in (labelled_credentials() if credentials is None else credentials)]
        self.automaton = Automaton.prefix_tree(words).merged()
        self.gain = gain
        counts = Counter(c for w in words for c in w)
        total = sum(counts.values())
        self.background = {c: math.log((n + 1) / (total + 64)) for c, n in counts.items()}
        self.other = math.log(1 / (total + 64))
        #: Automata and plain characters of credentials of segments, by prefix.
        self.segmented: dict[str, tuple[Automaton, dict[str, float], int]] = {}
        rests: dict[str, list[str]] = {}
        for prefix, rest in labelled_segmented(formats=SEGMENTED + UNSHAPED) if credentials is None else ():
            rests.setdefault(prefix, []).append(classes(rest))
        least = {prefix: sum(n for _, n, _ in parts) + len(between) * (len(parts) - 1) for prefix, parts, between in SEGMENTED + UNSHAPED}
        for prefix, known in rests.items():
            counts = Counter(c for w in known for c in w)
            plain = {c: math.log(n / counts.total()) for c, n in counts.items()}
            self.segmented[prefix] = (Automaton.prefix_tree(known).looped(), plain, least[prefix])
        #: Automata of the shapes of credentials and of plain tokens, and what a part must gain by the first over the second.
        known = list(labelled_credentials()) + [prefix + rest for prefix, rest in labelled_segmented(40)] if credentials is None else list(credentials)
        self.shapes = Automaton.prefix_tree([classes(w) for w in known]).looped()
        self.plain_shapes = Automaton.prefix_tree([classes(w) for w in labelled_plain()]).looped()
        gains = sorted(map(self.shape_gain, labelled_plain(3000, seed=10)))
        self.least_shape = gains[int(_PLAIN_BELOW * len(gains))] + _SHAPE_MARGIN
        #: The first three characters of all credentials: no part that begins otherwise scores.
        self.heads = {w[:3] for w in words} | {p[:3] for p in self.segmented}
        self.compiled = Compiled(self.automaton)
        self.compiled_segmented = {prefix: (Compiled(automaton), plain, least) for prefix, (automaton, plain, least) in self.segmented.items()}

    def score(self, token: str) -> float:
        """Likelihood gained per character over plain characters. Credentials of known formats
        score above zero, and tokens without a known prefix far below minus one."""
        word = symbols(token)
        plain = sum(self.background.get(c, self.other) for c in word)
        return (self.automaton.log_likelihood(word) - plain) / max(len(word), 1)

    def segmented_score(self, token: str) -> float:
        """Likelihood gained per character by a token's own prefix and segments over plain characters."""
        best = -math.inf
        for prefix, (automaton, plain, least) in self.segmented.items():
            if token.startswith(prefix) and len(token) - len(prefix) >= least:
                word = classes(token[len(prefix) :])
                if plain.keys() >= set(word):
                    gain = automaton.log_likelihood(word) - sum(map(plain.get, word))
                    best = max(best, gain / len(word))
        return best

    def shape_gain(self, token: str) -> float:
        """Log-likelihood that a token's classes gain as a credential over a plain token."""
        word = classes(token)
        return self.shapes.log_likelihood(word, 0.5) - self.plain_shapes.log_likelihood(word, 0.5)

    def part_score(self, token: str) -> float:
        """The better of both scores; a character that no credential holds, such as a slash, is not made up for by being rare in plain text."""
        fixed = self.score(token) if self.background.keys() >= set(symbols(token)[4:]) else -math.inf
        return max(fixed, self.segmented_score(token))

    def _last_end(self, automaton: Compiled, letters, plain, least: int, token: str, start: int, seen: dict) -> int:
        """The last end of a part from ``start`` that gains enough, or 0.

        ``letters(k)`` is what the automaton reads at ``k`` of the token (None: no part goes on) and
        ``plain`` the log-probability of it in plain text. ``seen`` holds, by place and state, the
        most that a start which has gone by had over what it must gain.
        """
        moves, lost, ends, n = automaton.moves, automaton.lost, automaton.ends, len(token)
        state, over, found = 0, 0.0, 0
        for at in range(start, n + 1):
            length = at - start
            if length >= least and (at == n or token[at] in _SEPARATORS) and token[at - 1] not in ".=-" and over + ends[state] >= 0:
                found = at
            if at == n or (c := letters(at)) is None:
                break
            if length >= _SETTLED:
                if seen.get((at, state), -math.inf) >= over:
                    break
                seen[at, state] = over
            to, gain = moves[state].get(c) or (state, lost[state])
            state, over = to, over + gain - plain(c) - self.gain
            if over < -_GIVEN_UP:
                break
        return found

    def _format_end(self, token: str, kinds: str, start: int, seen: dict[str, dict]) -> int:
        """The last end of a part from ``start`` that scores by any automaton, or 0."""
        head = token[start : start + 11]
        cut = start + (max((head.rfind(c) for c in "_-."), default=-1) + 1 or 4)
        background, other = self.background, self.other

        def letters(at):
            c = token[at] if at < cut else kinds[at]
            return c if at < start + 4 or c in background else None

        end = self._last_end(self.compiled, letters, lambda c: background.get(c, other), 16, token, start, seen.setdefault("", {}))
        for prefix, (automaton, plain, least) in self.compiled_segmented.items():
            if token.startswith(prefix, start):
                rest = start + len(prefix)
                end = max(end, self._last_end(automaton, lambda at: kinds[at] if kinds[at] in plain else None, plain.__getitem__, max(least, 16 - len(prefix)), token, rest, seen.setdefault(prefix, {})))
        return end

    def parts(self, token: str, shapes: bool = True) -> list[tuple[int, int]]:
        """Where credentials lie in a candidate, from left to right: parts of known formats, each as long
        as it scores, and with ``shapes`` parts that have the shape of one."""
        kinds, n, at = classes(token), len(token), 0
        starts = [k for k in range(n - 15) if (k == 0 or token[k - 1] in _SEPARATORS) and token[k : k + 3] in self.heads]
        if len(token.rstrip(".=-")) >= 16 and 0 not in starts and self.part_score(token.rstrip(".=-")) >= self.gain:
            starts.insert(0, 0)
        taken: list[tuple[int, int]] = []
        seen: dict[str, dict] = {}
        for a in starts:
            if a >= at and (end := self._format_end(token, kinds, a, seen)):
                taken.append((a, end))
                at = end
        if not shapes:
            return taken
        found, rest = [], iter([*taken, (n, n)])
        start, end = next(rest)
        for m in _SHAPED_PART.finditer(token):
            while end <= m.start() and end < n:
                start, end = next(rest)
            if (m.end() <= start or end <= m.start()) and self.shape_gain(m.group()) >= self.least_shape:
                found.append(m.span())
        return sorted(taken + found)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns' matches."""
        found = []
        lower = text.lower() if not text.islower() else text
        for k, (kind, pattern, group, least) in enumerate(BASE):
            # A text without the pattern's fixed words has no match; letters that lower-case to these words outside ASCII only let a text through.
            if kind == "assign" and not any(w in lower for w in _WORDS) or kind == "access" and "AKIA" not in text:
                continue
            for m in (_HEX if kind == "hex" else pattern).finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), k, m.end()))
        return found

    def spans(self, text: str, shapes: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans, sorted by start and then kind. A part that lies within a base span adds none."""
        base = sorted(self.base(text))
        starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
        more = []
        for m in CANDIDATE.finditer(text):
            for a, b in self.parts(m.group(), shapes):
                a, b = m.start() + a, m.start() + b
                before = bisect_right(starts, a)
                if not before or furthest[before - 1] < b:
                    more.append((a, len(BASE), b))
        return base, sorted(base + more)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, the number of base matches by kind, a digest of the base spans, and all spans."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))

    def run(batches):
        own = pickle.loads(packed.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = own.spans(text)
                kinds = Counter(k for _, k, _ in base)
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(texts_of(docs), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, int]], mask: str = "<{}>") -> str:
    """``text`` with its spans replaced by their kind; spans that overlap are replaced as one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], mask.format(KINDS[k])]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, scanner: Scanner, shapes: bool = False) -> DataFrame:
    """``docs`` with the spans of text replaced; a column n_chars is set to the new length.

    Only fixed patterns and known formats are overwritten: a shape alone may be a checksum or a
    name, so it is reported by ``scan`` and replaced with ``shapes`` only.
    """
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        own = pickle.loads(packed.value)
        for batch in batches:
            texts, sizes = batch.column(at).to_pylist(), None if chars is None else batch.column(chars).to_pylist()
            for k, text in enumerate(texts):
                if text and (spans := own.spans(text, shapes)[1]):
                    texts[k] = redact_text(text, spans)
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array(sizes, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, docs.schema)
