"""Token ids of texts by way of their words, with the tokenizer library asked once for each word.

A text may be cut at a *sure* border: a place that no match of the pre-tokenizer spans, with
neither side's matches changed by the cut. Ids of the parts joined are then the ids of the text,
and as parts recur, a bounded memo answers most. Two pre-tokenizers are known, that of byte-level
BPE and that of lower-cased words; a file with any other is asked for whole texts. With letters L
(``_LETTERS``), marks X (printable ASCII but letters, the apostrophe and the space) and the white
space W of ASCII, sure borders are

- before white space that follows a character other than white space: all matches that hold white
  space begin with it, and none looks behind;
- between L and X: only a contraction, which begins with an apostrophe, joins them;
- in a run of W before L or X, before its last character, since a match of white space leaves that
  one over; and after it, if it is a line end or a tab and not a space, which no other match takes.

NFC, lower-casing and folding of white space act on either side of such a border alone. Special
strings hold no space, and a word that holds one is not cut further. A part that is an optional
space and letters is one match: its bytes go to the library's model at once. The other parts
go through the whole library, and every id comes from it.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept_by_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!-&(-@\\[-`{-~"
_WHITE = " \\n\\t\\r"
#: The parts between sure borders; the last choice goes on to the next white space.
_PARTS = re.compile(f" ?+[{_LETTERS}]++(?=[{_MARKS}{_WHITE}]|\\Z)| ?+[{_MARKS}]++(?=[{_LETTERS}{_WHITE}]|\\Z)|[{_WHITE}]+(?=[{_WHITE}][{_LETTERS}{_MARKS}])|[\\n\\t\\r](?=[{_LETTERS}{_MARKS}])|[\\s\\S]+?(?=(?<=\\S)[{_WHITE}]|\\Z)")
_LETTERS_ONLY = re.compile(f" ?[{_LETTERS}]+")
#: The parts of a text that holds a special string.
_SPACED = re.compile("[\\s\\S]+?(?=(?<=\\S) |\\Z)")

# The known pre-tokenizers and normalisers, as the library spells them.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_CLASSES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_LEVEL = [{"type": "Split", "pattern": {"Regex": _CLASSES}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pre_tokenizer_of(tokenizer) -> str | None:
    """``bytes`` or ``words`` where the borders above hold for a tokenizer, else None."""
    import json

    told = json.loads(tokenizer.to_str())
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]) or told["model"]["type"] != "BPE" or told["model"].get("dropout"):
        return None
    if told["normalizer"] is None and told["pre_tokenizer"] == _BYTE_LEVEL:
        return "bytes"
    if told["normalizer"] == {"type": "Sequence", "normalizers": _LOWER} and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _WORD_LEVEL}:
        return "words"
    return None


def memo_for(path: str, limit: int) -> "WordMemo":
    """A worker process's memo for a tokenizer file; it holds one at a time."""
    return kept_by_worker(("words", path, limit), lambda: WordMemo(path, limit))


def parts_of(text: str) -> list[str]:
    """``text`` cut at sure borders."""
    return _PARTS.findall(text)


def key_of(part: str) -> str:
    """The memo's name of a part: a part of one leading space goes without it, any other has a space added."""
    return part[1:] if part.startswith(" ") and " " not in part[1:] else " " + part


def part_of(key: str) -> str:
    return key[1:] if key.startswith(" ") else " " + key


class _Numbers(dict):
    """Numbers keys as they are first met, and notes new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many runs, one after the other."""
    ends = sizes.cumsum()
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Generation:
    """Numbered parts and their ids, one after the other in ``flat``."""

    def __init__(self):
        self.numbers = _Numbers()
        self.flat, self.used, self.chars = np.zeros(1 << 16, np.uint32), 0, 0
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        #: Whether a part is empty or ends with white space, so that no cut before a space may follow.
        self.loose = np.zeros(1 << 12, bool)

    def take_new(self) -> list[str]:
        """The parts numbered since the last call; room for them is made."""
        new, self.numbers.new = self.numbers.new, []
        self.chars += sum(map(len, new))
        while len(self.start) < len(self.numbers):
            self.start, self.size, self.loose = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.loose))
        return new

    def put(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + sizes.cumsum() - sizes
        self.size[numbers] = sizes
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.size[numbers]
        return sizes, self.flat[_ragged(self.start[numbers], sizes)]


class WordMemo:
    """Token ids of texts, as the library gives them for each whole text.

    ``limit`` bounds a generation's parts, and 32 times as much its characters (some 200 bytes a
    part in all); when one is full, it becomes the old one, from which parts are taken over as
    they are met again, and the one before goes.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer, self.limit = load_tokenizer(path), limit
        self.kind = pre_tokenizer_of(self.tokenizer)
        self.now, self.old = _Generation(), _Generation()
        added = list(self.tokenizer.get_added_tokens_decoder().items())
        self.specials = re.compile("|".join(re.escape(t.content) for _, t in added) or "(?!)", re.IGNORECASE)
        # A special token cuts its input before anything else sees it, so parts between two of them are encoded by themselves.
        marks = [(k, t.content) for k, t in added if t.special and not t.normalized]
        self.mark_id, self.mark = marks[0] if marks else (None, None)
        # What the model sees of a space and of each letter, as the library's byte level spells it.
        spelled = self._spell(" abc")
        self.space = spelled[: spelled.index("a")]
        self.bytes_of = {c: self._spell(chr(c)) for c in range(256) if re.fullmatch(f"[{_LETTERS}]", chr(c))}

    def _spell(self, part: str) -> str:
        """The one match of the pre-tokenizer that ``part`` is, as the model sees it."""
        if self.tokenizer.normalizer:
            part = self.tokenizer.normalizer.normalize_str(part)
        return "".join(m for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)) if self.kind else part

    def _encode(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, from one call of the library for all but those that hold a special string."""
        plain = [p for p in parts if not self.specials.search(p)] if self.mark else []
        made: dict[str, bytes] = {}
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            if len(cuts) == len(plain) - 1:
                raw = ids.tobytes()
                made = {p: raw[4 * a + 4 : 4 * b] for p, a, b in zip(plain, [-1, *cuts], [*cuts, len(ids)])}
        rest = [p for p in parts if p not in made] if len(made) < len(parts) else []
        if rest:
            made |= {p: array("I", e.ids).tobytes() for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))}
        return [made[p] for p in parts]

    def _known(self, keys: list[str]) -> list[str]:
        """Takes over what the old generation knows of ``keys``; returns the others."""
        old = self.old.numbers
        known = [k for k in keys if k in old] if old else []
        if known:
            self.now.put(self._numbers(known), *self.old.get(np.fromiter(map(old.get, known), np.int64, len(known))))
            keys = [k for k in keys if k not in old]
        return keys

    def _numbers(self, keys) -> np.ndarray:
        return np.fromiter(map(self.now.numbers.__getitem__, keys), np.int64, len(keys))

    def _learn(self) -> None:
        """Finds the ids of all parts that were noted as new."""
        now = self.now
        new = now.take_new()
        if not new:
            return
        if loose := [k for k in new if not k or k[-1].isspace() and k != " "]:
            now.loose[self._numbers(loose)] = True
        longer: list[str] = []
        cut: list[list[str]] = []
        plain: list[str] = []
        other: list[str] = []
        special, letters = self.specials.search, _LETTERS_ONLY.fullmatch
        for key in self._known(new):
            if letters(key):
                plain.append(key)
                continue
            part = part_of(key)
            if len(parts := [part] if special(part) else _PARTS.findall(part)) < 2:
                other.append(key)
            else:
                longer.append(key)
                cut.append([key_of(p) for p in parts])
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        subs = self._numbers(list(chain.from_iterable(cut)))
        for key in self._known(now.take_new()):
            (plain if letters(key) else other).append(key)
        tokenize, table, space = self.tokenizer.model.tokenize, self.bytes_of, self.space
        ids = [array("I", [t.id for t in tokenize(space + k.translate(table) if k[0] != " " else k[1:].translate(table))]).tobytes() for k in plain]
        ids += self._encode([part_of(k) for k in other])
        now.put(self._numbers(plain + other), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.uint32))
        if longer:
            sizes, flat = now.get(subs)
            now.put(self._numbers(longer), np.add.reduceat(sizes, counts.cumsum() - counts), flat)

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' parts, and how many each text has."""
        if len(self.now.numbers) > self.limit or self.now.chars > 32 * self.limit:
            self.old, self.now = self.now, _Generation()
        split = pc.split_pattern(texts, " ")
        counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten()
        ends = counts.cumsum()
        heads = words.take(pa.array(ends - counts)).to_numpy(zero_copy_only=False)
        distinct = words.dictionary_encode()
        numbers = self._numbers(distinct.dictionary.to_numpy(zero_copy_only=False))[distinct.indices.to_numpy(zero_copy_only=False)]
        numbers[ends - counts] = self._numbers([" " + w for w in heads])  # a head follows no space
        self._learn()
        loose = self.now.loose[numbers]
        loose[ends - 1] = False
        if loose.any():
            again = np.unique(np.searchsorted(ends, np.flatnonzero(loose), side="right")).tolist()
            own = {k: self._numbers([key_of(p) for p in self._cut(texts[k].as_py())]) for k in again}
            self._learn()
            numbers = np.concatenate([own[k] if k in own else numbers[b - n : b] for k, (b, n) in enumerate(zip(ends.tolist(), counts.tolist()))])
            counts[again] = [len(own[k]) for k in again]
        return numbers, counts

    def _cut(self, text: str) -> list[str]:
        return _SPACED.findall(text) if self.specials.search(text) else parts_of(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (of which none is null), one after the other, and how many each text has."""
        if self.kind is None or not len(texts):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        numbers, parts = self._parts(texts)
        sizes, ids = self.now.get(numbers)
        ends = np.concatenate([[0], sizes.cumsum()])[np.concatenate([[0], parts.cumsum()])]
        return ids, np.diff(ends)

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        if self.kind is None or not len(texts):
            return self.encode(texts)[1]
        numbers, parts = self._parts(texts)
        ends = np.concatenate([[0], self.now.size[numbers].cumsum()])[np.concatenate([[0], parts.cumsum()])]
        return np.diff(ends)

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(texts)
        raw, ends = ids.tobytes(), (4 * counts.cumsum()).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]
