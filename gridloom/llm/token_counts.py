"""Token counts; huge texts are encoded in overlapping chunks that are spliced where they provably agree.

Edge cases: a null text is empty and has no bytes and no tokens; null, repeated or tied
doc_ids pass through, one output row for each input row; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_batches, texts_of
from .words import memo_for

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def stable_cuts(text: str, low: int, high: int) -> list[int]:
    """Places p in (low, high) where every encoding of text around p has a token boundary.

    There text[p] is a space and text[p - 1] is no white space (see ``words``).
    """
    found, p = [], text.find(" ", max(low + 1, 1), high)
    while p >= 0:
        if not text[p - 1].isspace():
            found.append(p)
        p = text.find(" ", p + 1, high)
    return found


def tokens_before(encoding, p: int) -> int | None:
    """The number of tokens that lie before the space at offset p, or None if a token spans p.

    The character after the space tells the first token that lies beyond; the offsets of that
    token and of the one before it must not cross p.
    """
    k = encoding.char_to_token(p + 1)
    if k is None or encoding.token_to_chars(k)[0] < p:
        return None
    if k and encoding.token_to_chars(k - 1)[1] > p:
        return None
    return k


def count_by_resync(text: str, tokenizer, chunk: int, overlap: int) -> int:
    """Tokens of ``text`` from overlapping chunks of about ``chunk`` characters.

    Each chunk is encoded with offsets. Two neighbours are spliced at a stable cut inside
    their overlap that both encodings have as a boundary: the left one counts up to it, the
    right one from it. Where the overlap has none, it is widened, twofold each time; when it
    holds all of the left chunk that still counts, that chunk is lengthened instead.
    """

    def encode(low: int, high: int):
        return tokenizer.encode(text[low:high], add_special_tokens=False)

    # The left chunk is text[low:high]; its tokens count from the first one that lies at or after ``cut``.
    n, total, low, high, cut, first = len(text), 0, 0, min(chunk, len(text)), 0, 0
    left = encode(low, high)
    while high < n:
        reach = overlap
        while True:
            start = max(cut, high - reach)
            stop = min(n, start + reach + chunk)
            right = encode(start, stop)
            spliced = None
            for p in reversed(stable_cuts(text, start, high - 1)):
                a, b = tokens_before(left, p - low), tokens_before(right, p - start)
                if a is not None and b is not None:
                    spliced = p, a, b
                    break
            if spliced:
                break
            if start <= cut:
                low, high, first = cut, min(n, high + reach), 0
                left = encode(low, high)
                if high == n:
                    return total + len(left)
            reach *= 2
        p, a, b = spliced
        total += a - first
        left, low, high, cut, first = right, start, stop, p, b
    return total + len(left) - first


def count_tokens(docs: DataFrame, tokenizer: str, chunk_chars: int = 8192, overlap_chars: int = 512, memo_entries: int = 400_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every whole text.

    Texts over two chunks are counted by ``count_by_resync``, so one task never encodes a huge
    text at once; others through the word memo. Both equal the library's own count. A file whose
    pre-tokenizer is not known to allow cuts is asked for whole texts.
    """

    def run(batches):
        memo = memo_for(tokenizer, memo_entries)
        for batch in batches:
            texts = batch.column(1)
            huge = pc.greater(pc.utf8_length(texts), 2 * chunk_chars) if memo.kind else pa.array([False] * len(texts), pa.bool_())
            counts = np.zeros(len(texts), np.int64)
            at = huge.to_numpy(zero_copy_only=False)
            counts[~at] = memo.count(texts.filter(pc.invert(huge)))
            counts[at] = [count_by_resync(t, memo.tokenizer, chunk_chars, overlap_chars) for t in texts.filter(huge).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return map_batches(texts_of(docs), run, SCHEMA, keeps=True)
