"""Language model and toxicity."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm.elias_fano import EliasFano, map_arrays, write_arrays
from strandlake.llm.toxicity import Lexicon, fold, learn_lexicon, score_toxicity
from strandlake.llm.trie_lm import _book, held_out, score, train


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), min_size=1, max_size=300), st.lists(st.integers(0, 1 << 40), max_size=50))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), np.uint64)
    seq = EliasFano.of(v, int(v[-1]) + 1)
    assert seq.get(np.arange(len(v))).tolist() == v.tolist()
    x = np.array([*asked, *values], np.uint64)
    at, found = seq.successor(x)
    assert at.tolist() == np.searchsorted(v, x).tolist()
    assert found.tolist() == [int(q) in values for q in x]


def test_elias_fano_with_repeats_and_dense_runs(tmp_path):
    v = np.sort(np.concatenate([np.arange(5000), [5000] * 70, np.arange(10**6, 10**6 + 3000)])).astype(np.uint64)
    seq = EliasFano.of(v, 1 << 21)
    assert (seq.get(np.arange(len(v))) == v).all()
    with open(tmp_path / "x", "wb") as f:
        write_arrays(f, [*seq.arrays(), np.arange(3, dtype=np.uint8)])
    *again, tail = map_arrays(str(tmp_path / "x"))
    assert (EliasFano.from_arrays(*again).get(np.arange(len(v))) == v).all() and tail.tolist() == [0, 1, 2]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def brute_scores(rows, held, order=3):
    """Interpolated absolute discounting, counted in dictionaries."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for r in rows:
        if not held(r[0]):
            s = ["", *tokens(r[1])]
            for i in range(1, len(s)):
                counts[1][s[i]] += 1
                for k in range(2, order + 1):
                    if i - k + 1 >= 0:
                        counts[k][tuple(s[i - k + 1 : i + 1])] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    total, kinds, discount = {}, {}, {}
    for k in range(2, order + 1):
        total[k], kinds[k] = Counter(), Counter()
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1
        once, twice = (sum(c == m for c in counts[k].values()) for m in (1, 2))
        discount[k] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
    out = []
    for r in rows:
        s, base, full, known = ["", *tokens(r[1])], 0.0, 0.0, 0
        for i in range(1, len(s)):
            p = (counts[1][s[i]] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            known += counts[1][s[i]] > 0
            for k in range(2, order + 1):
                h = tuple(s[i - k + 1 : i])
                if i - k + 1 >= 0 and total[k][h]:
                    p = max(counts[k][(*h, s[i])] - discount[k], 0) / total[k][h] + discount[k] * kinds[k][h] / total[k][h] * p
            full += math.log10(p)
        out.append((r[0], len(s) - 1, known, base, full))
    return n, out


def test_language_model(spark, tricky, rows):
    held = lambda k: zlib.crc32(str(k if k is not None else "").encode()) % 5 == 1
    model = train(tricky.filter(~held_out("doc_id")), order=3)
    n, want = brute_scores(rows, held)
    assert model.tokens == n
    got = score(tricky, model).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3]
        assert a[3] == pytest.approx(b[3], rel=1e-9)
        assert a[4] == pytest.approx(b[4], abs=0.08 * b[1])  # 8-bit codes
    split = train(tricky.filter(~held_out("doc_id")), order=3, shard_tokens=5000)  # each shard has a discount of its own
    assert len(split.levels[2]) > 1 and split.tokens == n
    long = {r.doc_id: r.score / r.n_tokens for r in got if r.n_tokens > 50}
    for r in score(tricky, split).collect():
        assert r.doc_id not in long or abs(r.score / r.n_tokens - long[r.doc_id]) < 0.3


def test_code_book_covers_every_value():
    """Rare values of a large shard have codes of their own, wherever they lie."""
    values = np.full(1_500_000, 0.5)
    values[1:200:2] = np.linspace(0.001, 0.4, 100)
    codes, levels = _book(values)
    assert levels[codes] == pytest.approx(values, rel=1e-3)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a b", "c c a b a", "a"])], "doc_id long, text string")
    model = train(docs, order=2)
    words = ["a", "b", "c", None]
    for history in ("a", "b", "zz"):
        probes = spark.createDataFrame([(i, f"{history} {w}" if w else history) for i, w in enumerate(words)] + [(9, f"{history} unknownword")], "doc_id long, text string")
        whole = {r.doc_id: r.score for r in score(probes, model).collect()}
        # p(w | history) = p(history w end) / (p(history) p(end | w)); read from two-word texts by difference of ends
        assert all(math.isfinite(x) and x < 0 for x in whole.values())
    from strandlake.llm.trie_lm import END

    h = model.lookup_words(np.array(sorted(set(int(x) for x in _hashes(["a", "b", "c"])) | {END}), np.uint64))
    ids = h[0]
    assert (ids >= 0).all() and h[1].sum() == model.tokens
    base = (h[1] + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1))
    unknown = 0.5 / (model.tokens + 0.5 * (model.vocabulary + 1))
    assert base.sum() + unknown == pytest.approx(1)
    for parent in ids:
        _, share, back = model.children(2, np.full(len(ids), parent), ids)
        assert (share + back * base).sum() + back[0] * unknown == pytest.approx(1, abs=0.02)


def test_words_over_several_shards(spark):
    """First words with very many n-grams are dealt out; every context still sums to one and scores stay close."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(["the" if rng.random() < 0.4 else f"w{int(rng.integers(0, 300))}" for _ in range(60)])) for i in range(200)], "doc_id long, text string")
    one, many = train(docs, order=3), train(docs, order=3, shard_tokens=400)
    assert len(many.levels[2]) > 10 and len(many.dealt) >= 1 and not one.dealt
    words = np.array(sorted(set(_hashes(["the", *(f"w{i}" for i in range(300))])) | {0}), np.uint64)
    ids, counts = many.lookup_words(words)
    words, ids, counts = words[ids >= 0], ids[ids >= 0], counts[ids >= 0]
    assert counts.sum() == many.tokens == one.tokens
    base = (counts + 0.5) / (many.tokens + 0.5 * (many.vocabulary + 1))
    unknown = 0.5 / (many.tokens + 0.5 * (many.vocabulary + 1))
    for parent in [*many.dealt, *ids[:40]]:
        _, share, back = many.children(2, np.full(len(ids), parent), ids)
        assert (share + back * base).sum() + back[0] * unknown == pytest.approx(1, abs=0.03)
    a, b = ({r.doc_id: r.score / r.n_tokens for r in score(docs, m).collect()} for m in (one, many))
    assert max(abs(a[k] - b[k]) for k in a) < 0.25


def test_rows_beyond_63_bits():
    """Distinct rows are the same whether their numbers fit one word or not."""
    from strandlake.llm.trie_lm import Grams, Shape, _Merger

    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 5, 500) + 70, rng.integers(0, 5, 500), rng.integers(0, 1 << 20, 500) % 7]
    one, many = Shape(3, 21, 21, 70), Shape(3, 22, 22)
    (a, i, m), (b, j, n) = (Grams.of(cols, shape).distinct(True) for shape in (one, many))
    assert len(a.rows) == 1 and len(b.rows) == 3 and (i == j).all() and (m == n).all()
    for x in (a, b, Grams.read(a.blob(), one), Grams.read(b.blob(), many)):
        assert all((x.word(k)[i] == cols[k]).all() for k in range(3))
        assert all((x.heads(k) == a.heads(k)).all() for k in (1, 2, 3))
    for shape in (one, many):
        merger = _Merger(shape)
        for i in range(0, 500, 7):
            some, _, count = Grams.of([c[i : i + 7] for c in cols], shape).distinct()
            merger.add(some, 2 * count)
            if i % 3 == 0:
                merger.merge()
        rows, count = merger.result()
        assert (count == 2 * m).all() and all((x == a.word(k)).all() for k, x in enumerate(rows))


def _hashes(words):
    import pyarrow as pa

    from strandlake.llm.words import hash_words

    return [int(h) >> 1 for h in hash_words(pa.array([w.encode() for w in words], pa.binary()))]


def test_hashes_tell_words_apart():
    """Prefixes, trailing zero bytes, halves swapped and long words have different hashes, wherever they stand."""
    import pyarrow as pa

    from strandlake.llm.words import hash_words

    rng = np.random.default_rng(0)
    words = sorted({b"", b"a", b"a\0", b"a\0\0", b"ab" * 8, b"ab" * 8 + b"\0", b"abcdefgh12345678", b"12345678abcdefgh", *(bytes(rng.integers(0, 3, int(n)).astype(np.uint8)) for n in rng.integers(0, 40, 30_000))})
    h = hash_words(pa.array(words, pa.binary()))
    assert len(set(h.tolist())) == len(words)
    order = rng.permutation(len(words))
    assert (hash_words(pa.array([words[i] for i in order], pa.binary())) == h[order]).all()
    assert (hash_words(pa.array(words, pa.binary()).slice(100, 50)) == h[100:150]).all()
    assert abs(np.unpackbits(h.view(np.uint8)).mean() - 0.5) < 0.01


def test_model_without_training_rows(spark, tricky, empty, rows):
    model = train(empty)
    got = score(tricky, model).collect()
    assert len(got) == len(rows) and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in got)
    assert score(empty, model).collect() == []


# --- toxicity -----------------------------------------------------------------------------


def test_folding():
    assert fold("Mörön!") == fold("moron") == " moron "
    assert fold("m0r0n") == fold("мoroп").replace("n", "n") == " moron "
    assert fold("1D10T") == fold("idiot") == " idiot "
    assert fold("L0SER") == fold("loser")
    assert fold(None) == fold("") == "  "
    assert fold("ｉｄｉｏｔ") == fold("idiot")
    assert fold("漢字 x") == " 漢字 x "


def test_exceptions_spare_matches():
    lexicon = Lexicon({" moron ": 3.0}, [" oxy moron "], [-2.0, 1.0, 1.0, 0.0])
    auto = lexicon.automaton()
    assert len(Lexicon.matches(auto, fold("oxy moron"))) == 0
    assert len(Lexicon.matches(auto, fold("a moron and an oxy moron"))) == 1


def _labelled(spark, n=600):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words[int(rng.integers(0, len(words)))] = str(rng.choice(["scumbag", "m0ron", "dunce", "flubberish", "flubberous", "flubbertastic"]))
        if i % 41 == 1 and not toxic:
            words[:2] = ["oxy", "moron"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(spark, tricky, rows):
    docs, labels = _labelled(spark)
    lexicon = learn_lexicon(docs, labels.filter("doc_id % 5 <> 0"))
    got = {r.doc_id: r.score for r in score_toxicity(docs, lexicon).collect()}
    held = [r for r in labels.collect() if r.doc_id % 5 == 0]
    right = sum((got[r.doc_id] >= 0.5) == (r.toxic == 1) for r in held)
    assert right >= 0.95 * len(held)
    assert any("oxy" in e for e in lexicon.exceptions)
    more = score_toxicity(spark.createDataFrame([(1, "a flubberlicious day, you мorоn"), (2, ""), (3, None)], "doc_id long, text string"), lexicon).collect()
    by = {r.doc_id: r.score for r in more}
    assert by[1] > 0.5 > by[2] == by[3]
    assert all(0 <= r.score <= 1 for r in score_toxicity(tricky, lexicon).collect())
    assert score_toxicity(tricky, lexicon).count() == len(rows)


def test_rare_telling_words_are_all_learned(spark):
    """2,160 words, each in 5 of 1,200 toxic rows (0.4 %) and in no other: none is below a bar or beyond a cap."""
    rng = np.random.default_rng(4)
    slurs = [str(10_000 + k)[1:].translate(str.maketrans("0123456789", "bcdfghjkmn")) + "zqx" for k in range(2_160)]
    docs, labels = [], []
    for i in range(12_000):
        words = [f"w{x}" for x in rng.integers(0, 400, 10)]
        if i < 1_200:
            words += [slurs[(9 * i + k) % 2_160] for k in range(9)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i < 1_200)))
    lexicon = learn_lexicon(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    auto = lexicon.automaton()
    assert all(Lexicon.matches(auto, fold(s)) for s in slurs)
    assert len(lexicon.weights) == 2_160  # common words stay out


def test_toxicity_without_labels(spark, tricky, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = learn_lexicon(tricky, none)
    assert {r.score for r in score_toxicity(tricky, lexicon).collect()} == {0.5}
    assert score_toxicity(empty, lexicon).collect() == []
    missing = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    assert learn_lexicon(tricky, missing).weights == {}


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, order):
    """Scores of other orders equal the dictionaries' too."""
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 30, int(rng.integers(0, 40))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n, want = brute_scores(rows, lambda k: False, order)
    model = train(docs, order=order)
    assert model.tokens == n
    by = {k: (a, b, c, d) for k, a, b, c, d in want}
    for r in score(docs, model).collect():
        tokens_, known, base, full = by[r.doc_id]
        assert (r.n_tokens, r.n_known) == (tokens_, known) and r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(full, abs=0.08 * tokens_)


def brute_lexicon(docs, labels, min_rows=3, min_weight=2.0, level=1e-5):
    """Patterns, weights and exceptions from plain dictionaries and string search, without an automaton."""
    from strandlake.llm.outliers import chi2_quantile
    from strandlake.llm.toxicity import patterns_of

    rows = [(labels[k], fold(t)) for k, t in docs if labels.get(k) in (0, 1)]
    n = [sum(y == v for y, _ in rows) for v in (0, 1)]
    seen = [Counter(), Counter()]
    for y, t in rows:
        seen[y].update(patterns_of(t))
    found = {}
    for p, c1 in seen[1].items():
        c0 = seen[0][p]
        w = math.log((c1 + 0.5) / (n[1] + 1)) - math.log((c0 + 0.5) / (n[0] + 1))
        cells = [(c0, (c0 + c1) * n[0]), (c1, (c0 + c1) * n[1]), (n[0] - c0, (sum(n) - c0 - c1) * n[0]), (n[1] - c1, (sum(n) - c0 - c1) * n[1])]
        ratio = 2 * sum(a * math.log(a * sum(n) / e) for a, e in cells if a)
        if c1 >= min_rows and w >= min_weight and ratio >= chi2_quantile(1 - level, 1):
            found[p] = (w, c1)
    weights = {}
    for p, (w, c1) in sorted(found.items(), key=lambda x: (-x[1][0] * math.sqrt(x[1][1]), x[0])):
        if not any(p != q and p.startswith(q) for q in weights):
            weights[p] = w
    phrases = [Counter(), Counter()]
    for y, t in rows:
        own = set()
        for p in weights:
            at = t.find(p)
            while at >= 0:
                before = t.rfind(" ", 0, at)
                if before >= 0:
                    own.add(t[before : t.index(" ", at + 1) + 1])
                at = t.find(p, at + 1)
        phrases[y].update(own)
    spared = sorted(p for p, c0 in phrases[0].items() if c0 >= min_rows and (phrases[1][p] + 0.5) / (n[1] + 1) < (c0 + 0.5) / (n[0] + 1))
    return weights, spared


def brute_matches(weights, spared, t):
    """Weights of all occurrences that lie in no occurrence of an exception."""
    places = lambda p: [i for i in range(len(t) - len(p) + 1) if t.startswith(p, i)]
    free = [(a, a + len(p)) for p in spared for a in places(p)]
    return [w for p, w in weights.items() for a in places(p) if not any(x <= a and a + len(p) <= z for x, z in free)]


def test_lexicon_and_scores_by_brute_force(spark):
    docs, labels = _labelled(spark, 900)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    lexicon = learn_lexicon(docs, labels)
    weights, spared = brute_lexicon(texts, known)
    assert lexicon.weights == pytest.approx(weights) and sorted(lexicon.exceptions) == spared and weights and spared
    got = {r.doc_id: r for r in score_toxicity(docs, lexicon).collect()}
    for k, text in texts:
        t = fold(text)
        hits = brute_matches(weights, spared, t)
        n = t.count(" ") + 20
        x = (math.log1p(100 * sum(hits) / n), math.log1p(100 * len(hits) / n), sum(hits) / len(hits) if hits else 0.0)
        z = lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], x, strict=True))
        assert got[k].n_matches == len(hits) and got[k].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
