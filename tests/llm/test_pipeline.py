import corpus_pipeline
from gridloom.llm import packing, secret_scan


def test_stages(spark, sf, documents, odd, empty):
    """Each stage keeps the columns of documents and works on what its predecessor kept."""
    docs = documents
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf))
        assert docs.columns == documents.columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] >= counts[3] == counts[4] > 0
    scanner = secret_scan.Scanner()
    assert not any(scanner.spans(r.text)[0] for r in docs.collect())
    packed = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert packing.SCHEMA.startswith("doc_id")


def test_stages_take_odd_rows(spark, sf, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf))
        assert docs.count() >= 0
