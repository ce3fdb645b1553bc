"""SentencePiece encoding with the N best segmentations, and decoding.

The pieces that match a text form a lattice over its characters. A forward Viterbi pass gives
the best score from the start to every position; a backward A-star search from the end uses
these as its heuristic, which is exact, so paths leave the queue best first. Scores are scaled
to integers, so sums have no rounding and ties are ties.

The scores of a BPE model are minus the ranks of its merges, whose greatest sum is not the
model's encoding. There, every piece that is not one of the model's own encoding of its stretch
costs one more than all of that encoding, so the model's encoding is the best path and its score
the sum of its pieces' scores; others follow by what they change.

A place between two characters that stand side by side in no piece of the vocabulary is crossed
by no piece: the lattice falls apart there, for one before every word. The N best of the whole
follow exactly from its stretches: only the N - 1 whose second choice costs least can differ from
their best, and only these are searched. What a second choice costs comes from the Viterbi pass,
in a bounded memo as words recur. In a BPE model most stretches need none: a path with two pieces
or more that aren't the model's own loses more than all of the stretch's score, which bounds the
cost from below, and a single such piece must join three or more pieces of the model's own, as the
model joins any two that make a piece.

Edge cases: a null or empty text has no pieces, one segmentation and score zero; characters
outside the vocabulary become byte pieces at the unknown penalty; null, repeated and tied
doc_ids are encoded row by row; other columns are not read; an empty table gives an empty
result. Among equal scores the order is fixed by the search and so is the same in every run.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of

SPACE = "▁"
_SCALE = 1 << 16
_UNKNOWN_PENALTY = 10
_NONE = 1 << 62
_CHUNK = 1 << 16
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_LOADED: dict[tuple, "Lattice"] = {}


def raw_of(piece: int) -> bytes:
    return array("I", [piece]).tobytes()


class Lattice:
    """Segmentations of normalised text; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, model: str, n: int, limit: int = 250_000):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n, self.limit = n, limit
        self.trie: dict = {}
        self.scores: dict[str, int] = {}
        self.pairs: set[str] = set()
        #: Whether pieces are joined by merges, so that the best path has to be given.
        self.merges = all(sp.get_score(i) <= 0 and sp.get_score(i) == int(sp.get_score(i)) for i in range(sp.get_piece_size()))
        self.bytes_of: list[bytes] = []
        lowest = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            plain = not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
            self.bytes_of.append(bytes([int(piece[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else piece.replace(SPACE, " ").encode())
            if plain:
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                score = round(sp.get_score(i) * _SCALE)
                node[""] = (score, array("I", [i]).tobytes())
                self.scores[piece] = score
                lowest = min(lowest, score)
                self.pairs.update(a + b for a, b in zip(piece, piece[1:]))
        self.unknown = lowest - _UNKNOWN_PENALTY * _SCALE
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = sp.is_byte(self.byte_ids[0])
        self.unknown_id = sp.unk_id()
        self.words: dict[str, tuple[int, bytes, int | None]] = {}
        self.choices: dict[str, list[tuple[int, bytes]]] = {}
        # Whether no piece has the mark after another character.
        self.mark_leads = not any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        # Whether characters in longer pieces are pieces themselves, so that an unknown one is in no other piece.
        self.quick = self.merges and self.mark_leads and all(c in self.scores for p in self.pairs for c in p)
        if self.quick:
            self._tabulate()

    def _tabulate(self) -> None:
        """Tables by piece number, for what the lattice of a BPE model needs of whole texts."""
        sp, n = self.processor, self.processor.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        number = {p: k for k, p in enumerate(pieces) if p in self.scores}
        self.value = np.array([self.scores.get(p, self.unknown) for p in pieces], np.int64)
        for k, byte in enumerate(self.byte_ids):
            if self.has_bytes:  # an unknown character counts once, with its first byte
                self.value[byte] = 0 if 0x80 <= k < 0xC0 else self.unknown
        self.marked = np.array([p in number and p.startswith(SPACE) for p in pieces])
        self.blank = np.array([p in number and not p.strip(SPACE) for p in pieces])
        found = set()
        for piece in number:
            cuts = [(i, j) for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if piece[i:j] in number]
            for _, i in (c for c in cuts if c[0] == 0):
                for j in (b for a, b in cuts if a == i and piece[:b] not in number):
                    for k in (b for a, b in cuts if a == j and piece[i:b] not in number):
                        found.add((number[piece[:i]] * n + number[piece[i:j]]) * n + number[piece[j:k]])
        #: Three pieces that begin a piece when joined. The model joins any two that make one, so two of its own that stand side by side never do.
        self.joins = np.array(sorted(found), np.int64)
        #: What the second choice of a stretch of one piece costs, where known.
        self.gap_of = np.full(n, -1, np.int64)
        self.gaps: dict[bytes, int] = {}

    def _merged(self, stretch: str) -> list[str]:
        """The model's pieces of a normalised stretch: the best merge first, the leftmost of equal ones."""
        parts = list(stretch)
        score = self.scores.get
        queue = [(-v, k, k + 1, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (v := score(a + b)) is not None]
        heapq.heapify(queue)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        while queue:
            _, a, b, piece = heapq.heappop(queue)
            if not parts[a] or b >= len(parts) or after[a] != b or not parts[b] or parts[a] + parts[b] != piece:
                continue
            parts[a], parts[b], after[a] = piece, "", after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < len(parts) and (v := score(parts[x] + parts[y])) is not None:
                    heapq.heappush(queue, (-v, x, y, parts[x] + parts[y]))
        return [p for p in parts if p]

    def _own(self, stretch: str) -> tuple[list[int], int]:
        """Where the model's own piece from each place ends (-1: none starts there), and what any other piece costs."""
        ends, at, total = [-1] * len(stretch), 0, 0
        for piece in self._merged(stretch):
            value = self.scores.get(piece)
            total += self.unknown if value is None else value
            ends[at] = at + len(piece)
            at += len(piece)
        return ends, _SCALE - total

    def _edges(self, text: str) -> list[list[tuple[int, int, bytes]]]:
        """For each end position, the pieces that end there: (start, score, ids)."""
        ending: list[list] = [[] for _ in range(len(text) + 1)]
        for i, c in enumerate(text):
            node, j, single = self.trie, i, False
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    ending[j].append((i, *node[""]))
                    single = single or j == i + 1
            if not single:
                ending[i + 1].append((i, self.unknown, self._unknown_ids(c)))
        if self.merges:
            at = 0
            for stretch in self.stretches(text):
                own, cost = self._own(stretch)
                for j in range(at + 1, at + len(stretch) + 1):
                    ending[j] = [(i, s if own[i - at] == j - at else s - cost, ids) for i, s, ids in ending[j]]
                at += len(stretch)
        return ending

    def _unknown_ids(self, c: str) -> bytes:
        return array("I", [self.byte_ids[b] for b in c.encode()] if self.has_bytes else [self.unknown_id]).tobytes()

    def viterbi(self, text: str) -> tuple[int, bytes, int | None]:
        """The best segmentation's score and ids, and how much less the second best scores (None: there is one only)."""
        n, root, none = len(text), self.trie, -(1 << 90)
        own, cost = self._own(text) if self.merges else ([], 0)
        best, second, back = [0] + [none] * n, [none] * (n + 1), [None] * (n + 1)
        for i, c in enumerate(text):
            node, j, here, under, single = root, i, best[i] - cost, second[i] - cost, False
            to = own[i] if cost else -1
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                if (edge := node.get("")) is not None:
                    single = single or j == i + 1
                    gain = edge[0] + cost if j == to else edge[0]
                    value = here + gain
                    if value > best[j]:
                        second[j] = max(best[j], under + gain if second[i] > none else none)
                        best[j], back[j] = value, (i, edge[1])
                    elif value > second[j]:
                        second[j] = value
            if not single:
                gain = self.unknown + cost if to == i + 1 else self.unknown
                value = here + gain
                if value > best[i + 1]:
                    second[i + 1] = max(best[i + 1], under + gain if second[i] > none else none)
                    best[i + 1], back[i + 1] = value, (i, self._unknown_ids(c))
                elif value > second[i + 1]:
                    second[i + 1] = value
        ids, j = [], n
        while j:
            j, piece = back[j]
            ids.append(piece)
        return best[n], b"".join(reversed(ids)), best[n] - second[n] if second[n] > none else None

    def search(self, text: str, n: int) -> list[tuple[int, bytes]]:
        """The n best segmentations of ``text`` as (score, ids), best first."""
        ending = self._edges(text)
        best = [0] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            best[j] = max(best[i] + score for i, score, _ in ending[j])
        # Of equal estimates the one nearest to the start goes on, so ties don't widen the search.
        queue, order, found = [(-best[-1], len(text), 0, 0, None)], 0, []
        while queue and len(found) < n:
            _, j, _, score, path = heapq.heappop(queue)
            if j == 0:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                found.append((score, b"".join(ids)))
                continue
            for i, s, piece in ending[j]:
                order += 1
                heapq.heappush(queue, (-(score + s + best[i]), i, order, score + s, (piece, path)))
        return found

    def normalized(self, text: str) -> str:
        """What the model's normaliser makes of a text; spaces are the model's own mark."""
        return self.processor.normalize(text) if text else ""

    def stretches(self, text: str) -> list[str]:
        """Normalised text cut where no piece crosses: before words, or at any place that allows it."""
        if self.mark_leads:
            return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.pairs]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encode(self, text: str) -> list[tuple[int, bytes]]:
        """The n best segmentations of a whole text, as (score, ids)."""
        if self.quick:
            return self._encode_merged(text)
        text = self.normalized(text)
        if not text:
            return [(0, b"")]
        parts, words = self.stretches(text), self.words
        found = list(map(words.get, parts))
        if None in found:
            if len(words) > self.limit:
                words.clear()
            for k, (part, known) in enumerate(zip(parts, found)):
                if known is None:
                    if (known := words.get(part)) is None:
                        known = self.viterbi(part)
                        if len(part) < 64:
                            words[part] = known
                    found[k] = known
        scores, ids, gaps = zip(*found)
        total = sum(scores)
        if self.n == 1:
            return [(total, b"".join(ids))]
        loose = sorted(k for _, k in heapq.nsmallest(self.n - 1, [(g, k) for k, g in enumerate(gaps) if g is not None]))
        ends = np.cumsum([len(x) for x in ids])
        return self._combined(total, b"".join(ids), [(ends[k] - len(ids[k]), ends[k], parts[k]) for k in loose])

    def _combined(self, total: int, ids: bytes, loose: list[tuple[int, int, str]]) -> list[tuple[int, bytes]]:
        """The n best of a whole, whose best is ``ids``, from the choices of some stretches (start and end in ``ids``, text)."""
        options = [self._choices(part) for _, _, part in loose]
        best: list[tuple[int, tuple]] = [(0, ())]
        for choices in options:
            best = [(a + s - choices[0][0], (*path, c)) for a, path in best for c, (s, _) in enumerate(choices)]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[: self.n]
        out = []
        for change, path in best:
            made, at = [], 0
            for (a, b, _), choices, c in zip(loose, options, path):
                made += [ids[at:a], choices[c][1]]
                at = b
            out.append((total + change, b"".join([*made, ids[at:]])))
        return out

    def own_ids(self, text: str) -> np.ndarray:
        """The model's own encoding of a text. A huge one is cut at single spaces between ASCII
        letters, where the mark that the normaliser puts first stands for the space."""
        if len(text) <= _CHUNK:
            return np.array(self.processor.encode(text), np.int32)
        parts, at = [], 0
        while len(text) - at > _CHUNK and (m := _CUT.search(text, at + _CHUNK // 2)):
            parts.append(text[at : m.start()])
            at = m.end()
        return np.concatenate([np.array(p, np.int32) for p in self.processor.encode([*parts, text[at:]], num_threads=1)])

    def _encode_merged(self, text: str) -> list[tuple[int, bytes]]:
        """``encode`` for a BPE model."""
        ids = self.own_ids(text)
        if not len(ids):
            return [(0, b"")]
        first = self.marked[ids]
        first[1:] &= ~self.blank[ids[:-1]]
        first[0] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(ids))
        totals = np.add.reduceat(self.value[ids], starts)
        total, raw = int(totals.sum()), ids.astype("<u4").tobytes()
        if self.n == 1:
            return [(total, raw)]
        # What a second choice costs at least; exactly for stretches of one piece.
        least = 2 * _SCALE - totals
        if len(self.joins) and len(ids) > 2:
            wide = ids.astype(np.int64)
            keys = (wide[:-2] * len(self.value) + wide[1:-1]) * len(self.value) + wide[2:]
            near = self.joins[np.minimum(np.searchsorted(self.joins, keys), len(self.joins) - 1)] == keys
            near &= ~(first[1:-1] | first[2:])
            if near.any():
                least[np.searchsorted(starts, np.flatnonzero(near), side="right") - 1] = _SCALE
        alone = ends - starts == 1
        single = ids[starts[alone]]
        for k in np.unique(single[self.gap_of[single] < 0]).tolist():
            self.gap_of[k] = self._gap(raw_of(k))
        least[alone] = self.gap_of[single]
        n = self.n - 1
        exact = alone.copy()
        while True:
            bound = np.partition(least[exact], n - 1)[n - 1] if exact.sum() >= n else _NONE
            todo = np.flatnonzero(~exact & (least <= bound))
            if not len(todo):
                break
            if len(todo) > 4 * n:  # those of the least bounds first, as they may lower the bound
                todo = todo[np.argpartition(least[todo], 4 * n)[: 4 * n]]
            for k in todo.tolist():
                least[k] = self._gap(raw[4 * starts[k] : 4 * ends[k]])
            exact[todo] = True
        order = np.flatnonzero(exact & (least <= bound) & (least < _NONE))
        loose = sorted(order[np.argsort(least[order], kind="stable")[:n]].tolist())
        return self._combined(total, raw, [(4 * starts[k], 4 * ends[k], self.text_of(raw[4 * starts[k] : 4 * ends[k]])) for k in loose])

    def text_of(self, ids: bytes) -> str:
        """The normalised stretch that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode().replace(" ", SPACE)

    def _gap(self, ids: bytes) -> int:
        """What the second choice of a stretch costs."""
        if (gap := self.gaps.get(ids)) is None:
            gap = self.viterbi(self.text_of(ids))[2]
            gap = _NONE if gap is None else gap
            if len(ids) < 256:
                if len(self.gaps) > self.limit:
                    self.gaps.clear()
                self.gaps[ids] = gap
        return gap

    def _choices(self, part: str) -> list[tuple[int, bytes]]:
        """The n best of a stretch; words recur among those whose second choice costs least."""
        if (known := self.choices.get(part)) is None:
            known = self.search(part, self.n)
            if len(part) < 64:
                if len(self.choices) > self.limit // 8:
                    self.choices.clear()
                self.choices[part] = known
        return known

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for; the mark that the normaliser puts first is dropped."""
        text = b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def lattice_for(model: str, n: int) -> Lattice:
    if (model, n) not in _LOADED:
        _LOADED[model, n] = Lattice(model, n)
    return _LOADED[model, n]


def encode_nbest(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """doc_id and nbest: an array of (score, ids), the n best segmentations of every whole text."""

    def run(batches):
        lattice = lattice_for(model, n)
        for batch in batches:
            found = [[{"score": s / _SCALE, "ids": array("I", ids).tolist()} for s, ids in lattice.encode(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))])))], names=["doc_id", "nbest"])

    return map_batches(texts_of(docs), run, "doc_id bigint, nbest array<struct<score: double, ids: array<int>>>")


def digest_nbest(docs: DataFrame, model: str, n: int = 4) -> DataFrame:
    """What ``encode_nbest`` gives and decoding makes of it, digested where it is made.

    doc_id; n_pieces, ids_crc32 and score of the best segmentation; nbest_scores and
    nbest_crc32, joined by commas; decoded_sha256 and whether every segmentation decodes to the
    text.
    """
    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, score double, nbest_scores string, nbest_crc32 string, decoded_sha256 string, lossless boolean"

    def run(batches):
        lattice = lattice_for(model, n)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                nbest = lattice.encode(text)
                score, ids = nbest[0]
                decoded = lattice.decode(ids)
                sums = [zlib.crc32(x) for _, x in nbest]
                rows.append((len(ids) // 4, sums[0], score / _SCALE, ",".join(f"{s / _SCALE:.4f}" for s, _ in nbest), ",".join(map(str, sums)), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_pieces", "ids_crc32", "score", "nbest_scores", "nbest_crc32", "decoded_sha256", "lossless"])

    return map_batches(texts_of(docs), run, schema)
