"""Sum-of-squares packing of token sequences into windows of a fixed size.

Each partition packs its own documents as they come. A document longer than a window gives
full windows and a rest; the rest goes to the fill level that least raises the sum of the
squared counts of partially filled windows, which keeps all levels in supply so that most
rests soon meet one that fills their window. When a partition ends, the few windows still open
are cut anew: their ids fill whole windows, and what is left over is cut into powers of two,
which need no padding.

Edge cases: a null or empty text is one piece that holds the end id only; null, repeated or
tied doc_ids are packed as separate documents; other columns are not read; an empty table gives
an empty result. A retried task reads the same rows and gives the same sequences.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .words import memo_for

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_SHIFT = 33  # sequences of one partition


class SumOfSquaresPacker:
    """Places pieces (doc_id, start, ids as bytes, doc_tokens) into windows of ``size`` ids.

    ``level[g]`` is the number of open windows that hold g ids. ``max_open`` bounds the open
    windows, and so the memory: beyond it, all are cut anew as at the end of a partition.
    """

    def __init__(self, size: int, first_id: int, max_open: int = 1024):
        self.size, self.next_id, self.max_open = size, first_id, max_open
        self.level = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.rows: list[tuple] = []

    def _close(self, window: list[tuple]) -> None:
        at = 0
        for doc, start, ids, tokens in window:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        tokens, width = len(ids) // 4, 4 * self.size
        full = tokens // self.size
        for k in range(full):
            self._close([(doc, k * self.size, ids[k * width : (k + 1) * width], tokens)])
        if rest := ids[full * width :]:
            self._place((doc, full * self.size, rest, tokens))

    def _place(self, piece: tuple) -> None:
        s = len(piece[2]) // 4
        n = self.level
        # Change of the sum of squares when the piece goes from level g to level g + s; level 0 is a new window.
        after = n[s:].copy()
        after[-1] = 0  # a full window is closed and counts no more
        change = 2 * after + 1 - 2 * n[: self.size - s + 1] + 1
        change[-1] -= 1
        change[0] = 2 * n[s] + 1
        change[1:][n[1 : self.size - s + 1] == 0] = np.iinfo(np.int64).max
        g = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.open[g].pop() if g else []
        if g:
            n[g] -= 1
        window.append(piece)
        if g + s == self.size:
            self._close(window)
        else:
            n[g + s] += 1
            self.open.setdefault(g + s, []).append(window)
            if n[1:].sum() > self.max_open:
                self.recut(last=False)

    def recut(self, last: bool = True) -> None:
        """Cuts all open windows into full ones; the rest stays open or, at last, becomes powers of two."""
        pieces = [p for g in sorted(self.open, reverse=True) for w in self.open[g] for p in w]
        if not pieces:
            return
        self.open.clear()
        self.level[:] = 0
        target, window, filled = self.size, [], 0
        left = sum(len(p[2]) // 4 for p in pieces)

        def next_target() -> int:
            return self.size if left >= self.size or not last else 1 << (left.bit_length() - 1)

        target = next_target()
        for doc, start, ids, tokens in pieces:
            while ids:
                take = min(target - filled, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], tokens))
                ids, start, filled, left = ids[4 * take :], start + take, filled + take, left - take
                if filled == target:
                    self._close(window)
                    window, filled = [], 0
                    target = next_target() if left else self.size
        if window:
            self.open[filled] = [window]
            self.level[filled] = 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, max_open: int = 1024, memo_entries: int = 400_000) -> DataFrame:
    """One row for each piece: where its document's ids lie in which sequence.

    ``sequence_id`` is unique over all partitions; offsets within one have no gaps.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches):
        from pyspark import TaskContext

        memo = memo_for(tokenizer, memo_entries)
        packer = SumOfSquaresPacker(size, TaskContext.get().partitionId() << _SHIFT, max_open)

        def out():
            columns = list(zip(*packer.take())) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), memo.ids(batch.column(1))):
                packer.add(doc, ids + end)
            yield out()
        packer.recut()
        yield out()

    return map_batches(texts_of(docs), run, SCHEMA, keeps=True)
