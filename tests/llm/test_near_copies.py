"""The pipeline's near_dedup stage: SimHash groups, verified, and the links beyond its grid."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import minhash, near_copies, simhash


def _texts():
    """Pairs of long texts of which one word was changed, and texts on their own."""
    rng, rows = np.random.default_rng(4), []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 2000)]
        rows.append((2 * k, " ".join(words)))
        if k % 2:
            words[int(rng.integers(0, 2000))] = "other"
            rows.append((2 * k + 1, " ".join(words)))
    return rows


def _classes(spark, rows):
    out = []
    for doc, text in rows:
        h, p = minhash.shingle_hashes(text, 5), simhash.fingerprint(text, 5)
        bands = [hash(b.tobytes()) for b in minhash.signature(h).reshape(32, 4)]
        out.append((doc, p - (1 << 64) if p >> 63 else p, bytearray(h.tobytes()), bands))
    return spark.createDataFrame(out, "id bigint, fp bigint, hashes binary, bands array<bigint>")


def test_the_stage_goes_by_simhash(spark, monkeypatch):
    """The grid's links are asked for, of fingerprints of all the stage's texts."""
    asked, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda distinct, bits=4, block=20_000: asked.append((distinct.count(), bits)) or links(distinct, bits, block))
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [2 * k for k in range(40)]
    assert asked == [(len({simhash.fingerprint(t, 5) for _, t in rows}), 4)]


def test_simhash_links_are_verified(spark):
    """Pairs within 4 bits are linked if their Jaccard is 0.8 or more, and only then."""
    rows = _texts()
    classes = _classes(spark, rows)
    want = {(2 * k, 2 * k + 1) for k in range(1, 40, 2) if bin(simhash.fingerprint(dict(rows)[2 * k], 5) ^ simhash.fingerprint(dict(rows)[2 * k + 1], 5)).count("1") <= 4}
    assert len(want) > 10
    assert {(min(a, b), max(a, b)) for a, b in near_copies.simhash_links(classes).collect()} == want
    alike = classes.withColumn("fp", F.lit(7).cast("bigint"))
    assert {(min(a, b), max(a, b)) for a, b in near_copies.simhash_links(alike).collect()} == {(2 * k, 2 * k + 1) for k in range(1, 40, 2)}


def test_groups_that_are_joined_are_not_compared_again(spark):
    classes = _classes(spark, _texts())
    found = near_copies.simhash_links(classes)
    joined = simhash.connected(found).select(F.col("fp").alias("id"), "root")
    every = {(min(a, b), max(a, b)) for a, b in minhash.class_links(classes).collect()}
    rest = {(min(a, b), max(a, b)) for a, b in minhash.class_links(classes, groups=joined).collect()}
    assert rest == every - {(min(a, b), max(a, b)) for a, b in found.collect()}
