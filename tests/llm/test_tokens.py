"""Tokenizer engine, sorted tables, length histogram and packing."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandlake.llm.lengths import at_limits, context_answers, length_histogram, length_quantile
from strandlake.llm.packing import Cutter, best_cuts, pack_documents
from strandlake.llm.sstable import key_of, lookup, read_sstables, write_sstables
from strandlake.llm.tokens import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_chunks_equal_whole_texts(name, rows):
    encode, reference = Encoder(public_tokenizers.path(name)), whole(name)
    texts = [r[1] for r in rows]
    ids, offsets = encode.encode(pa.array(texts, pa.string()), end=1)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*reference(t), 1]
    assert encode.lengths(pa.array(texts, pa.string())).tolist() == [len(reference(t)) for t in texts]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'sZé 　 \n\t\r\x0b\x1c.!9ß́<|>")), max_size=25), max_size=4))
def test_chunks_equal_whole_texts_on_odd_space(name, texts):
    if name not in ENCODERS:
        ENCODERS[name] = (Encoder(public_tokenizers.path(name)), whole(name))
    encode, reference = ENCODERS[name]
    ids, offsets = encode.encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(offsets[:-1], offsets[1:], strict=True)] == [reference(t) for t in texts]


ENCODERS: dict = {}


def test_small_cache_starts_anew():
    encode, reference = Encoder(public_tokenizers.path(FILES[0]), cache=3), whole(FILES[0])
    for text in ("a b c d e f", "g a b", "h i j k l m"):
        ids, _ = encode.encode(pa.array([text]))
        assert ids.tolist() == reference(text)


def test_sorted_tables_round_trip(spark, tricky, rows):
    reference = whole(FILES[0])
    manifest = write_sstables(tricky, public_tokenizers.path(FILES[0]), end_id=1, shard_tokens=2000)
    got = [r.asDict() for r in read_sstables(manifest).collect()]
    want = sorted(((r[0], [*reference(r[1]), 1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [k for k, _ in want]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        assert len(r["ids"]) == 4 * r["n_tokens"]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((k, np.array(i, "<u4").tobytes()) for k, i in want)
    assert manifest.count() > 1
    found = lookup(manifest, [2, 5, None, 999])
    assert len(found[2]) == 3 and found[999] == []
    assert found[5][0].tolist() == next(i for k, i in want if k == 5)


def test_key_order_is_numeric():
    ids = [None, -(1 << 63), -5, -1, 0, 1, 300, (1 << 63) - 1]
    assert sorted(ids, key=key_of) == ids


def test_empty_tables(spark, empty):
    path = public_tokenizers.path(FILES[0])
    assert read_sstables(write_sstables(empty, path)).collect() == []
    assert context_answers(length_histogram(empty, path)).collect() == []
    assert pack_documents(empty, path).collect() == []


def test_length_answers(spark, tricky, rows):
    reference = whole(FILES[1])
    answers = context_answers(length_histogram(tricky, public_tokenizers.path(FILES[1]))).cache()
    sizes = sorted(len(reference(r[1])) for r in rows)
    got = {r.n_tokens: r for r in answers.collect()}
    assert sorted(got) == sorted(set(sizes))
    for limit, r in got.items():
        assert r.n_docs == sizes.count(limit)
        assert r.docs_longer == sum(s > limit for s in sizes)
        assert r.tokens_longer == sum(s for s in sizes if s > limit)
        assert r.kept_tokens == sum(min(s, limit) for s in sizes)
        assert r.lost_tokens == sum(max(0, s - limit) for s in sizes)
        assert abs(r.quantile - sum(s <= limit for s in sizes) / len(sizes)) < 1e-12
    for r in at_limits(answers, [0, 7, 100, 10**7]).collect():
        assert r.kept_tokens == sum(min(s, r.n_tokens) for s in sizes)
        assert r.docs_at_most == sum(s <= r.n_tokens for s in sizes)
    assert length_quantile(answers, 0.5) == sizes[(len(sizes) + 1) // 2 - 1]


def test_pieces_cover_every_id(spark, tricky, rows):
    reference = whole(FILES[1])
    pieces = [r.asDict() for r in pack_documents(tricky, public_tokenizers.path(FILES[1]), length=64, end_id=0).collect()]
    seqs: dict = {}
    for p in pieces:
        assert p["length"] > 0 and len(p["ids"]) == 4 * p["length"]
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    total = sum(p["length"] for p in pieces)
    assert padding < 0.15 * total  # windows are only two grid steps long here
    want = Counter((r[0], np.array([*reference(r[1]), 0], "<u4").tobytes()) for r in rows)
    got: Counter = Counter()
    open_: dict = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        k = p["doc_id"]
        if p["start"] == 0:
            open_[k] = b""
        open_[k] += bytes(p["ids"])
        if len(open_[k]) == 4 * p["doc_tokens"]:
            got[k, open_.pop(k)] += 1
    assert got == want and not open_


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 5)), min_size=1, max_size=24))
def test_cuts_are_optimal(steps):
    at = np.cumsum([s for s, _ in steps])
    cost = np.array([c for _, c in steps])
    length = 16

    def price(cuts):
        pay, before = 0.0, 0
        for c in cuts:
            n = c - before
            assert n <= length
            pay += (0 if n & (n - 1) == 0 else length - n) + dict(zip(at.tolist(), cost.tolist(), strict=True))[c]
            before = c
        return pay

    best = {0: 0.0}
    place = [0, *at.tolist()]
    for j in range(1, len(place)):
        options = [best[place[i]] + (0 if (n := place[j] - place[i]) & (n - 1) == 0 else length - n) + cost[j - 1] for i in range(j) if place[j] - place[i] <= length]
        best[place[j]] = min(options)
    cuts = best_cuts(at, cost, length).tolist()
    assert cuts[-1] == place[-1]
    assert abs(price(cuts) - best[place[-1]]) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 5)), min_size=1, max_size=60), st.integers(1, 7), st.floats(0, 40))
def test_stream_of_cut_points_equals_one_program(steps, batch, sequence_cost):
    """Settled windows leave batch by batch; the total is that of the program over all points at once."""
    at = np.cumsum([s for s, _ in steps])
    cost = np.array([c for _, c in steps])
    length = 16

    def price(cuts):
        pay, before = 0.0, 0
        for c in cuts:
            n = c - before
            assert 0 < n <= length
            pay += sequence_cost + (0 if n & (n - 1) == 0 else length - n) + cost[np.searchsorted(at, c)]
            before = c
        return pay

    whole = best_cuts(at, cost, length, sequence_cost).tolist()
    cutter, cuts = Cutter(length, sequence_cost), []
    for i in range(0, len(at), batch):
        cutter.extend(at[i : i + batch], cost[i : i + batch])
        cuts += cutter.settled()
    cuts += cutter.finish()
    assert cuts[-1] == at[-1] and abs(price(cuts) - price(whole)) < 1e-6


@pytest.mark.parametrize("slice_bytes", [1, 4000, 16 << 20])
def test_sequences_are_full(spark, slice_bytes):
    """At least 98 % of the sequences' room is used, however small the batches; no batch ends a sequence early."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in range(3000)]
    rows = [(i, " ".join(str(w) + ("." if rng.random() < 0.08 else "") for w in rng.choice(words, int(rng.integers(1, 700))))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        pieces = pack_documents(docs, public_tokenizers.path(FILES[1]), slice_bytes=slice_bytes).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = sum(r.length for r in pieces)
    assert total == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert -(-total // 1024) >= 0.98 * len({r.sequence_id for r in pieces})


def test_a_text_longer_than_a_batch(spark):
    """Texts of 20 MB and more pass every reader of batches whole: encoded, stored, packed and archived."""
    import hashlib

    text = " ".join(f"w{i % 5000}" for i in range(3_600_000))
    docs = spark.createDataFrame([(1, "before"), (2, text), (3, "behind")], "doc_id long, text string")
    assert len(text) > 16 << 20
    tokenizer = public_tokenizers.path(FILES[1])
    pieces = sorted((r.doc_id, r.start, r.length, r.doc_tokens) for r in pack_documents(docs, tokenizer).drop("ids").collect())
    long = [p for p in pieces if p[0] == 2]
    assert sum(p[2] for p in long) == long[0][3] and [p[1] for p in long] == np.cumsum([0, *(p[2] for p in long[:-1])]).tolist()
    stored = {r.doc_id: r.n_tokens for r in read_sstables(write_sstables(docs, public_tokenizers.path(FILES[0]))).drop("ids").collect()}
    assert stored.keys() == {1, 2, 3} and stored[2] > 3_600_000
    from strandlake.llm.warc import read_archives, resolve_revisits, write_archives

    pages = spark.createDataFrame([(1, "u", text, "x", "y"), (2, "u", text, "x", "y"), (3, "u", "", "x", "y")], "page_id long, url string, html string, digest string, first string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in resolve_revisits(read_archives(write_archives(pages))).collect()}
    assert got[1] == (len(text), hashlib.sha1(text.encode()).hexdigest(), "revisit", 2) and got[2][2:] == ("response", None) and got[3][0] == 0


def test_queries_agree_on_small_table(spark, small_documents):
    from strandlake.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small_documents}/documents.parquet").collect()
    for name, file, end in (("op1_sstable", FILES[0], 1), ("op8_packing", FILES[1], 0)):
        reference = whole(file)
        got = QUERIES[name](spark, small_documents).collect()
        if name == "op1_sstable":
            want = {d.doc_id: np.array([*reference(d.text), end], "<u4").tobytes() for d in docs}
            assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {k: (len(v) // 4, zlib.crc32(v)) for k, v in want.items()}
        else:
            want = {d.doc_id: np.array([*reference(d.text), end], "<u4") for d in docs}
            assert sum(r.length for r in got) == sum(map(len, want.values()))
            for r in got:
                assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
