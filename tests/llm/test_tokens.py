import json
import random
import zlib
from array import array

import public_tokenizers
import pyarrow as pa
import pytest

from gridloom.llm import packing, token_counts, token_orc
from gridloom.llm.common import map_batches, scratch_dir
from gridloom.llm.words import WordMemo, key_of, load_tokenizer, part_of, parts_of

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def own(path, texts):
    """The library's ids of whole texts."""
    return [e.ids for e in load_tokenizer(path).encode_batch(texts, add_special_tokens=False)]


#: Characters that tempt a cut: white space of all sorts, contractions in both cases, letters at the edge of Latin-1, marks that compose.
LETTERS = [
    list(" \n\t  abAB's 1é.,<|endoftext|> 　ﬁ́Σ\u0000"),
    [*" \n\t\r\x0b\x0c\x1c\x85᠎​ ab'sSLldtªº µß.,%12½²éàÿŸÖ×÷¨´¸́ͅıİſK", "'ll", "'LL", "'S", " a", " .", "<|endoftext|>", "<|EndOfText|>"],
    [*" \n'aZ09_-`{~!", "don't", "'RE", "we're", " \n", "\n\n"],
]


def noise(n, seed=1, letters=LETTERS[0]):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + ["<|endoftext|> a", "a <|startoftext|>  b<|endoftext|>", " ", "a  b", "", "e ́ b"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("limit", [400_000, 40])
@pytest.mark.parametrize("letters", LETTERS)
def test_memo_equals_the_library(path, limit, letters):
    texts = noise(2500, letters=letters) + ["5 µm wide", "about 10 µs", "a 20 ºC day", "the ªb", "º'd", "µ'll"]
    memo, got, counts = WordMemo(path, limit), [], []
    for at in range(0, len(texts), 50):
        got += memo.ids(pa.array(texts[at : at + 50]))
        counts += memo.count(pa.array(texts[at : at + 50])).tolist()
    assert memo.kind and got == [array("I", ids).tobytes() for ids in own(path, texts)]
    assert counts == [len(ids) // 4 for ids in got]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memo_on_documents(path, texts):
    texts = list(texts.values())
    assert WordMemo(path).ids(pa.array(texts)) == [array("I", ids).tobytes() for ids in own(path, texts)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_letters_and_marks_are_sure_anywhere(path):
    """Every letter beside every mark and digit, in words, gives the ids of the whole text."""
    safe = [chr(c) for c in range(33, 256) if chr(c).isprintable()]
    texts = [f"{a}{b} x{a}{b}y {b}{a}{b}\n{a}{a}{b}\n\n{a}" for a in safe for b in safe[::3]]
    assert WordMemo(path).ids(pa.array(texts)) == [array("I", ids).tobytes() for ids in own(path, texts)]


def test_unknown_pre_tokenizers_get_whole_texts(tmp_path):
    told = json.loads(load_tokenizer(BYTES).to_str())
    told["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    texts, path = noise(200), str(tmp_path / "t.json")
    memo = WordMemo(path)
    assert memo.kind is None and memo.ids(pa.array(texts)) == [array("I", ids).tobytes() for ids in own(path, texts)]


def test_memo_is_bounded_by_characters():
    memo = WordMemo(BYTES, 100)
    for k in range(30):
        memo.ids(pa.array([f"{k}" + "字" * 2000 for _ in range(3)]))
        assert memo.now.chars < 3200 + 2100


def test_parts_join_to_the_text():
    for letters in LETTERS:
        for t in noise(300, letters=letters):
            assert "".join(parts_of(t)) == t
            assert all(part_of(key_of(p)) == p for p in parts_of(t))


@pytest.mark.parametrize("chunk, overlap", [(40, 6), (15, 1), (300, 64)])
def test_resync_equals_the_library(chunk, overlap):
    tokenizer = load_tokenizer(BYTES)
    texts = noise(400, 2) + ["".join(noise(60, 3)), "y" * 900 + " z " + "q" * 500, "\n" * 700, " " * 700, "a" + " " * 500 + "b"]
    for text, ids in zip(texts, own(BYTES, texts)):
        assert token_counts.count_by_resync(text, tokenizer, chunk, overlap) == len(ids)


def test_counts(spark, odd, empty, documents, texts):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(documents, BYTES, chunk_chars=500, overlap_chars=40).collect()}
    assert got == {k: (len(t.encode()), len(i)) for (k, t), i in zip(texts.items(), own(BYTES, list(texts.values())))}
    rows = token_counts.count_tokens(odd, BYTES).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (7, 9)} == {0}
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def check_packing(rows, ids_of, size=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, pieces in by_doc.items():
        ids, at = ids_of[doc], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing(documents, texts, odd, empty):
    ids = {k: i + [1] for k, i in zip(texts, own(BYTES, list(texts.values())))}
    assert check_packing(packing.pack(documents.repartition(3), BYTES).collect(), ids) == 0
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    known = {r.doc_id: r.text or "" for r in unique.collect()}
    assert check_packing(packing.pack(unique, BYTES).collect(), {k: i + [1] for k, i in zip(known, own(BYTES, list(known.values())))}) == 0
    rows = packing.pack(odd, BYTES).collect()
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * rows[[r.doc_id for r in rows].index(5)].doc_tokens
    assert [r.length for r in rows if r.doc_id in (7, 9)] == [1, 1]
    assert packing.pack(empty, BYTES).count() == 0


@pytest.mark.parametrize("max_open", [1024, 3])
def test_sum_of_squares(max_open):
    """Each placement has the least sum of squares of all levels; windows are never overfull."""
    rng, packer = random.Random(4), packing.SumOfSquaresPacker(32, 0, max_open)
    for doc in range(400):
        n = rng.choice([3, 5, 8, 13, 20, 40])
        before, rest = packer.level.copy(), n % 32
        packer.add(doc, array("I", range(n)).tobytes())
        after = packer.level
        if max_open == 1024 and rest:
            costs = [(before[:32] ** 2).sum() + change for g in range(33 - rest) if g == 0 or before[g] for change in [(0 if g == 0 else 1 - 2 * before[g]) + (0 if g + rest == 32 else 1 + 2 * before[g + rest])]]
            assert (after[:32] ** 2).sum() == min(costs)
        assert after.sum() <= max_open
    packer.recut()
    rows = packer.take()
    totals = {}
    for _, _, length, _, _, sequence, offset in rows:
        assert offset == totals.get(sequence, 0)
        totals[sequence] = offset + length
    assert all(t == 32 or t & (t - 1) == 0 for t in totals.values())
    assert sum(totals.values()) == sum(r[2] for r in rows)


def test_orc_round_trip(spark, documents, texts, odd, empty):
    got = token_orc.round_trip(documents, WORDS).orderBy("doc_id").collect()
    at = 0
    for r, (doc, ids) in zip(got, zip(sorted(texts), own(WORDS, [texts[k] for k in sorted(texts)]))):
        ids = ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)
    assert len(got) == len(texts)
    rows = token_orc.round_trip(odd, WORDS).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7, 8, 9, 11, 12]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert token_orc.round_trip(empty, WORDS).count() == 0


def test_orc_lookup_prunes(spark, documents):
    path = token_orc.write_ids(documents, WORDS, scratch_dir(spark))
    found = token_orc.lookup(spark, path, [17])
    assert [r.doc_id for r in found.collect()] == [17]
    assert "PushedFilters: [In(doc_id" in (plan := found._jdf.queryExecution().toString()) or "EqualTo(doc_id,17)" in plan


def test_orc_files_have_stripes_and_row_indexes(spark, tmp_path):
    """Small stripes and strides, in the files themselves, and every stripe's streams of row indexes and Bloom filters."""
    from pyarrow import orc

    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["alpha", "beta", f"n{rng.random()}"]) for _ in range(40))) for k in range(12_000)], "doc_id bigint, text string").coalesce(1)
    path = token_orc.write_ids(docs, WORDS, f"file://{tmp_path}/ids", stripe_bytes=1 << 16, row_index_stride=1000)
    files = [orc.ORCFile(f) for f in sorted((tmp_path / "ids").glob("*.orc"))]
    assert sum(f.nrows for f in files) == 12_000 and sum(f.nstripes for f in files) > len(files)
    assert all(f.row_index_stride == 1000 and str(f.compression).upper().endswith("ZSTD") for f in files)
    found = token_orc.lookup(spark, path, [7, 11_999]).collect()
    assert sorted(r.doc_id for r in found) == [7, 11_999]
    java, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in (tmp_path / "ids").glob("*.orc"):
        reader = java.org.apache.orc.OrcFile.createReader(java.org.apache.hadoop.fs.Path(f"file:{file}"), java.org.apache.orc.OrcFile.readerOptions(conf))
        rows, column = reader.rows(), reader.getSchema().findSubtype("doc_id").getId()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            streams = [footer.getStreams(k) for k in range(footer.getStreamsCount())]
            assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= {x.getKind().toString() for x in streams if x.getColumn() == column}


def test_workers_let_go_of_the_memo(documents):
    """Workers outlive their tasks: the memo of a packing must not stay in them while other operators run."""

    def held(batches):
        import gc

        memos = sum(type(o).__name__ == "WordMemo" for o in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([memos] * len(batch), pa.int64())], names=["n"])

    docs = documents.repartition(8).select("doc_id", "text")
    packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["n"] for r in map_batches(docs, held, "n bigint", keeps=True).collect()} == {1}
    assert {r["n"] for r in map_batches(docs, held, "n bigint").collect()} == {0}
