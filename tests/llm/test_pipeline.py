"""The pipeline's stages against brute force, and its contract."""

from collections import Counter

import corpus_pipeline
from strandlake.llm.common import stage
from tests.llm.test_documents import brute_classes, brute_hits, brute_lines, brute_stats


def test_stages_by_brute_force(spark, small_documents):
    docs = spark.read.parquet(f"{small_documents}/documents.parquet")
    columns = docs.columns
    before = docs.collect()

    kept = stage(corpus_pipeline.quality_rules(spark, docs, small_documents), "t")
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    failed = {r.doc_id for r in before if (s := brute_stats(r.text))[0] < 10 or 100 * s[4] > 20 * s[0]}
    assert not ids & failed
    noisy = {r.doc_id for r in before if brute_stats(r.text)[2] > 0.3 * brute_stats(r.text)[0]}
    assert not ids & noisy and len(ids) >= 0.95 * len({r.doc_id for r in before} - failed - noisy)

    was = kept.collect()
    cut = stage(corpus_pipeline.line_dedup(spark, kept, small_documents), "t")
    gone = {(k, n) for k, n, *_ in brute_lines([(r.doc_id, r.text, None) for r in was], least=20, equal=True)}
    want = {r.doc_id: "\n".join(x for n, x in enumerate(r.text.split("\n")) if (r.doc_id, n) not in gone) for r in was}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == columns

    one = stage(corpus_pipeline.near_duplicates(spark, cut, small_documents), "t")
    classes = brute_classes([(r.doc_id, r.text) for r in cut.collect()])
    assert {r.doc_id for r in one.collect()} == {c for _, c, _ in classes} and one.columns == columns

    clean = stage(corpus_pipeline.decontamination(spark, one, small_documents), "t")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small_documents}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in one.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {h[0] for h in hits if not h[5]} and clean.columns == columns

    pieces = corpus_pipeline.packing(spark, clean, small_documents).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}
    run = corpus_pipeline.run(spark, small_documents).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in run) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_awkward_rows_pass_through(spark, tricky, empty, rows, small_documents):
    for docs in (tricky, empty):
        for name, step in corpus_pipeline.STAGES:
            out = stage(step(spark, docs, small_documents), "t")
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
        if docs.limit(1).count() == 0:
            assert out.count() == 0
        else:  # the texts that are left, whole
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
            assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
