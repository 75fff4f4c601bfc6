"""WARC, decontamination, quality rules, line dedup, near duplicates: brute force on awkward rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm.common import text_hash, without_rows
from strandlake.llm.components import connected_components
from strandlake.llm.decontaminate import build_index, contaminated, find_contamination, find_near
from strandlake.llm.forest import near_duplicates, one_of_each_class, prefix_length
from strandlake.llm.linededup import drop_lines, find_first_lines
from strandlake.llm.outliers import chi2_cdf, chi2_quantile, quality_verdicts, robust_distances
from strandlake.llm.warc import read_archives, resolve_revisits, write_archives


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- WARC ---------------------------------------------------------------------------------


def test_warc_roles(spark):
    big, other = "é" * 600, "z" * 1000
    pages = [(1, "http://a/ b\n", big, "x"), (2, None, big, "x"), (3, "u", big, "x"), (4, "u", "tiny", "x"), (5, "u", "tiny", "x"), (6, "u", None, "x"), (7, "u", other, "x"), (7, "u", other, "x"), (None, "u", other, "x"), (8, "u", "y" * 999, "x"), (9, "u", "y" * 999, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    got = resolve_revisits(read_archives(write_archives(df))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for k, _, h, _ in pages:
        raw = (h or "").encode()
        role, refers = "response", None
        if h == big and k != 3:
            role, refers = "revisit", 3
        if h == other and k is None:
            role, refers = "revisit", 7
        want.append([k, len(raw), hashlib.sha1(raw).hexdigest(), role, refers])
    want[7][3:] = ["revisit", 7]
    assert Counter(tuple(r) for r in got) == Counter(map(tuple, want))


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert resolve_revisits(read_archives(write_archives(df))).collect() == []


# --- decontamination ----------------------------------------------------------------------

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, window=13):
    grams = defaultdict(set)
    for name, text in items:
        w = LETTERS.findall(fold(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add(name or "")
    out = []
    for key, text in docs:
        w, hit, names = LETTERS.findall(fold(text)), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (found := grams.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        out.append((key, len(w), len(hit), len(names), tuple(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


def test_contamination_is_exact(spark, tricky, rows, empty):
    long = LETTERS.findall(fold(rows[5][1]))
    items = [("7", " ".join(long[100:130])), ("10", " ".join(long[110:125]).upper()), (None, rows[1][1]), ("e", ""), ("n", None), ("s", "ONE"), ("s2", "the of"), ("no", "never seen " * 9), ("7", rows[2][1])]
    benchmark = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id string, text string, doc_id string")
    index = build_index(tricky)
    found = find_contamination(index, benchmark).withColumn("c", contaminated())
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.c) for r in found.collect())
    assert got == brute_hits([(r[0], r[1]) for r in rows], items)
    for r in found.collect():
        assert sum(s.length for s in r.spans) == r.n_hit
    assert find_contamination(build_index(empty), benchmark).collect() == []
    none = find_contamination(index, benchmark.limit(0)).collect()
    assert len(none) == len(rows) and all(r.n_hit == 0 for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "alpha " + "x " * 9 + "beta gamma")], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.length) for r in find_near(build_index(docs), ["alpha beta gamma"], 6).collect()}
    assert got == {(1, 0, 6), (2, 0, 3)}


# --- quality rules ------------------------------------------------------------------------


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, tricky, rows, empty):
    got = quality_verdicts(tricky).collect()
    stat = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert stat == Counter((r[0], *brute_stats(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert r.kept or r.base_failed  # too few documents for an estimate: nothing else goes
    assert quality_verdicts(empty).collect() == []


def test_outliers_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(20, 200))]
        bad = i % 3 == 0  # a third of the group
        rows.append((i, " ".join(f"{w}$$#" if bad else w for w in words), "en", "hot" if i % 10 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality_verdicts(docs).collect()}
    assert all(got[i] == (i % 3 != 0) for i in range(900))
    again = {r.doc_id: r.kept for r in quality_verdicts(docs.repartition(7)).collect()}
    assert again == got


def test_repeats_far_beyond_those_of_the_group_go(spark):
    """Repeated lines and repeated windows reject alone, although most of the group has none; small shares stay."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for i in range(400):
        words = [str(n).translate(str.maketrans("0123456789", "abcdefghij")) for n in rng.integers(10_000, 1_000_000, 500)]
        kind = i % 20
        if kind == 3:  # words in repeated windows: 16 % or 2 %
            n = 40 if i < 40 else 5
            words[300 : 300 + n] = words[100 : 100 + n]
        lines = [" ".join(words[4 * k : 4 * k + 4]) for k in range(125)]
        for k in range({0: 55, 1: 45, 2: 5}[kind] if i < 40 and kind < 2 or kind == 2 else 0):  # 44 %, 36 % or 4 % repeated lines
            lines[2 * k + 2] = lines[0]  # between lines of their own: no window of five words repeats
        rows.append((i, "\n".join(lines), "en", "s"))
        want[i] = not (i < 40 and kind in (0, 1, 3))
    got = quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in got)
    assert {r.n_dup_lines for r in got} >= {0, 5, 45, 55} and {r.n_repeat_words for r in got} == {0, 10, 80}
    assert {r.doc_id: r.kept for r in got} == want


def test_concentration_goes_on_until_settled(spark):
    """The centre of a skewed group is that of the steps carried on to the end; steps that the bound cuts off are an error."""
    x = np.round(np.random.default_rng(8).exponential(1.0, 6000) ** 2, 6)

    def end(centre):
        for _ in range(500):
            centre = x[np.argsort(np.abs(x - centre))[:3000]].mean()
        half = x[np.argsort(np.abs(x - centre))[:3000]]
        return half.var(), centre

    best = min(end(np.median(x)), end(x.mean()))[1]
    rows = spark.createDataFrame([("a", True, float(v), 0.0, 0.0, 0.0) for v in x], "g string, fit boolean, x0 double, x1 double, x2 double, x3 double")
    with pytest.raises(RuntimeError, match="settle"):
        robust_distances(rows, bound=1)
    got = {r.x0: r.distance2 for r in robust_distances(rows).collect()}
    factor = 0.5 / chi2_cdf(chi2_quantile(0.5, 4), 6)
    scale = math.sqrt(factor * x[np.argsort(np.abs(x - best))[:3000]].var())
    inside = x[np.abs(x - best) <= scale * math.sqrt(chi2_quantile(0.975, 4))]
    assert min(got, key=got.get) == pytest.approx(inside.mean(), rel=0.02)


def numpy_mcd(x, floors, least, cut=0.975):
    """Reweighted minimum covariance determinant: the same starts, plain sorted concentration steps."""
    n, p = x.shape
    h = math.ceil(n * 0.5)
    raised = lambda s: s + np.diag(np.maximum(np.diag(s) + least, floors**2) - np.diag(s))
    factor = lambda q: q / chi2_cdf(chi2_quantile(q, p), p + 2)
    d2 = lambda m, s: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(s), x - m)
    mad = 1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)
    best = None
    for m, s in [(np.median(x, 0), raised(np.zeros((p, p)))), (np.median(x, 0), raised(np.diag(mad**2))), (x.mean(0), raised(np.cov(x.T, bias=True)))]:
        was = np.inf
        for _ in range(200):
            near = x[np.argsort(d2(m, s), kind="stable")[:h]]
            m, s = near.mean(0), raised(factor(0.5) * np.cov(near.T, bias=True))
            if np.linalg.slogdet(s)[1] >= was - 1e-9:
                break
            was = np.linalg.slogdet(s)[1]
        if best is None or was < best[0]:
            best = (was, m, s)
    near = x[d2(*best[1:]) <= chi2_quantile(cut, p)]
    return d2(near.mean(0), raised(factor(cut) * np.cov(near.T, bias=True)))


def test_minimum_determinant_matches_numpy(spark):
    """Distances equal those of a plain numpy estimate with sorted distances, for a contaminated group of correlated values."""
    from strandlake.llm.outliers import CUT, LEAST, LIMITS

    rng = np.random.default_rng(5)
    mix = np.array([[0.3, 0, 0, 0], [0.05, 0.04, 0, 0], [0.02, 0.05, 0.09, 0], [0.03, 0.02, 0.04, 0.1]])
    x = rng.normal(size=(3000, 4)) @ mix.T
    x[:600] += [1.5, 0.2, 0.5, 0.6]
    most = np.array([v / math.sqrt(chi2_quantile(CUT, 4)) for v in LIMITS])
    off = np.array([np.median((d := np.abs(x[:, k] - np.median(x[:, k])))[d > 1e-3]) for k in range(4)])
    floors = np.minimum(np.maximum(1.4826 * off, LEAST * most), most)
    want = numpy_mcd(x, floors, (LEAST * most) ** 2 * chi2_quantile(CUT, 4) / chi2_quantile(CUT, 4))
    rows = spark.createDataFrame([("g", True, i, *map(float, v)) for i, v in enumerate(x)], "g string, fit boolean, i int, x0 double, x1 double, x2 double, x3 double")
    got = np.zeros(3000)
    for r in robust_distances(rows).collect():
        got[r.i] = r.distance2
    assert np.abs(np.sqrt(got) - np.sqrt(want)).max() < 0.05 * np.sqrt(want).max()
    assert np.corrcoef(np.argsort(np.argsort(got)), np.argsort(np.argsort(want)))[0, 1] > 0.999
    cut = chi2_quantile(CUT, 4)
    assert ((got > cut) == (want > cut)).mean() > 0.999 and (got[:600] > cut).mean() > 0.9


def test_chi_squared():
    assert chi2_cdf(chi2_quantile(0.975, 4), 4) == pytest.approx(0.975)
    assert chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert chi2_quantile(0.9999, 4) == pytest.approx(23.5127, abs=1e-3)


# --- line dedup ---------------------------------------------------------------------------


def within_one(a, b):
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return None
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return 1 if (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]) else None


def brute_lines(rows, least=20, equal=False):
    """With ``equal`` lines under ``least`` code points are compared too, for equality alone; blank ones never."""
    lines = [((k is not None, k or 0, n), k, hash_, n, x) for k, text, hash_ in rows if text is not None for n, x in enumerate(text.split("\n")) if (len(x) >= least or equal) and re.search(r"[^\x20\x09-\x0D]", x)]
    same = lambda a, b: a == b if min(len(a), len(b)) < least else within_one(a, b) is not None
    out = Counter()
    for place, k, h, n, x in lines:
        best = min((p[0] for p in lines if p[0] < place and same(p[4], x)), default=None)
        if best is not None:
            edits = 0 if any(p[0] == best and p[4] == x for p in lines) else 1
            out[k, n, best[1] if best[0] else None, best[2], edits] += 1
    return out


def test_lines_within_one_edit(spark, tricky, rows):
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    made = [base, base[:5] + base[6:], base[:40] + "X" + base[41:], base + "!", "Z" + base, base[::-1], base[:10] + base[11] + base[10] + base[12:], "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaa", "short", "short", "ünïcödé line with twenty and more", "ünïcödé line wïth twenty and more"]
    docs = [(i, x if i % 2 else f"{x}\nand another line number {i // 3} in here") for i, x in enumerate(made)]
    docs += [(3, docs[3][1]), (None, base), (None, None), (40, ""), (41, "\n".join(made))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.edits) for r in find_first_lines(df).collect())
    assert got == brute_lines([(k, t, None) for k, t in docs])
    awkward = Counter((r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.edits) for r in find_first_lines(tricky).collect())
    assert awkward == brute_lines([(r[0], r[1], None) for r in rows if len(r[1] or "") < 20_000 or "\n" in r[1]])


def test_short_lines_equal_to_an_earlier_one(spark):
    """With ``equal_chars`` short lines are compared for equality, and only for that; blank ones stay."""
    docs = spark.createDataFrame([(1, "短い行です\nyes\n\n  \nfirst line of twenty chars"), (2, "yes\n短い行です\nyez\n\n  \nfirst line of twenty charz")], "doc_id long, text string")
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no, r.edits) for r in find_first_lines(docs, equal_chars=1).collect()}
    assert got == {(2, 0, 1, 1, 0), (2, 1, 1, 0, 0), (2, 5, 1, 4, 1)}
    assert {(r.doc_id, r.line_no) for r in find_first_lines(docs).collect()} == {(2, 5)}


def brute_bound(lines, bound):
    """(line number, earliest line within the bound, distance) by the plain edit distance."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    out = set()
    for n, x in enumerate(lines):
        for m, y in enumerate(lines[:n]):
            if abs(len(x) - len(y)) <= bound and (d := distance(x, y)) <= bound:
                out.add((n, m, d))
                break
    return out


@pytest.mark.parametrize("bound", [0, 1, 2])
def test_lines_within_any_bound(spark, bound):
    rng = np.random.default_rng(21)
    lines = []
    for _ in range(14):
        base = "".join(rng.choice(list("abc"), 11))
        lines.append(base)
        for _ in range(4):
            x = list(base)
            for _ in range(int(rng.integers(1, 4))):
                k, how = int(rng.integers(0, len(x))), int(rng.integers(0, 3))
                x[k : k + (how != 1)] = [] if how == 0 else ["d"]
            lines.append("".join(x))
    order = rng.permutation(len(lines))
    lines = [lines[k] for k in order]
    docs = spark.createDataFrame([(7, "\n".join(lines[:30])), (9, "\n".join(lines[30:]))], "doc_id long, text string")
    got = {(r.line_no + (30 if r.doc_id == 9 else 0), r.first_line_no + (30 if r.first_doc_id == 9 else 0), r.edits) for r in find_first_lines(docs, min_chars=5, edits=bound).collect()}
    assert got == brute_bound(lines, bound)


def test_lines_are_cut(spark, tricky, rows, empty):
    df = spark.createDataFrame([(1, "first line of twenty chars\nkeep", 9, "x"), (2, "a\nfirst line of twenty charz\nb", 9, "y"), (3, "first line of twenty chars", 9, "z"), (4, None, None, None)], "doc_id long, text string, n_chars long, __gone2 string")
    got = {r.doc_id: (r.text, r.n_chars) for r in drop_lines(df, find_first_lines(df)).collect()}
    assert got == {1: ("first line of twenty chars\nkeep", 9), 2: ("a\nb", 3), 3: ("", 0), 4: (None, None)}
    out = drop_lines(tricky, find_first_lines(tricky))
    assert out.columns == tricky.columns and out.count() == len(rows)
    assert drop_lines(empty, find_first_lines(empty)).count() == 0


# --- near duplicates ----------------------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows, s=0.8):
    sets = [shingle_set(t) for _, t in rows]
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = len(sets[i] & sets[j])
            if same or (both and both >= s * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(n):
        least[find(i)].append(rows[i][0])
    return Counter((rows[i][0], min((x for x in least[find(i)] if x is not None), default=None), links[i]) for i in range(n))


def test_classes_and_links(spark, tricky, rows):
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(tricky).collect())
    assert got == brute_classes([(r[0], r[1]) for r in rows])


def test_chain_and_large_group(spark):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):  # a drifting chain: links between neighbours, one class
        words = list(words)
        words[int(rng.integers(0, len(words)))] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"{rows[0][1]} {'tail' * (i % 3)}") for i in range(40)]
    rows += [(500 + i, " ".join(f"u{x}" for x in rng.integers(0, 5000, 80))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs).collect())
    assert got == brute_classes(rows)


def test_rows_behind_many_leaders_meet():
    """Behind 2,000 unlike rows, two rows that agree in four fifths of their signature are tied to each other or to one leader."""
    import strandlake.llm.forest as forest

    rng = np.random.default_rng(4)
    run, width = forest._Run(b"k", 160), 160
    base = rng.integers(0, 1 << 16, (2000, width)).astype(np.uint16)
    for n in range(2000):
        assert run.add(n, base[n]) == []
    for far in (0, 40, 60, 64):  # the first agrees with leader 7 in 1, 0.75, ... of the places
        a = base[7].copy()
        a[:far] = rng.integers(0, 1 << 16, far)
        b = a.copy()
        b[-32:] = rng.integers(0, 1 << 16, 32)
        x, y = set(run.add(5000 + far, a)) | {5000 + far}, set(run.add(6000 + far, b)) | {6000 + far}
        assert x & y


def test_lengths_reach_the_target_and_leave_crowded_prefixes():
    import strandlake.llm.forest as forest

    rng = np.random.default_rng(6)
    crowded = np.concatenate([np.zeros((1, 20), np.int64), rng.integers(0, 8, (50, 20)), np.full((1, 20), 8), np.where(np.arange(20) < 15, 7, 0)[None, :]])
    lengths = forest.shortened(crowded, 8, 0.8, 0.999)
    assert (1 - np.prod(1 - 0.8**lengths, axis=1) >= 0.999 - 1e-12).all()
    assert set(lengths[0]) <= {5, 6} and set(lengths[-2]) <= {5, 6}
    assert (lengths[-1][:15] >= 7).all() and (lengths[-1][15:] <= 3).all()  # the five free trees are shortened further instead
    one_longer = lengths[0].copy()
    one_longer[np.argmin(one_longer)] += 1
    assert 1 - np.prod(1 - 0.8**one_longer) < 0.999  # no further than needed


def test_trie_scan_by_brute_force():
    import strandlake.llm.forest as forest

    rng = np.random.default_rng(9)
    labels = rng.integers(0, 3, (400, 5)).astype(np.uint16)
    trees = rng.integers(0, 2, 400)
    order = np.lexsort([*labels.T[::-1], trees])
    labels, trees = labels[order], trees[order]
    matched, crowded = forest.scan_trie(trees, labels, 10)
    for i in range(400):
        sizes = [sum(trees[j] == trees[i] and (labels[j][:k] == labels[i][:k]).all() for j in range(400)) for k in range(1, 6)]
        assert crowded[i] == max([k for k, n in enumerate(sizes, 1) if n > 10], default=0)
        assert matched[i] >= max([k for k, n in enumerate(sizes, 1) if n > 1], default=0)


@pytest.mark.parametrize("crowd", [2, 12])
def test_crowded_prefixes_lose_no_link(spark, crowd):
    """Pages with a common frame crowd the short prefixes; near copies among them are all found."""
    rng = np.random.default_rng(12)
    frame = [f"f{x}" for x in range(120)]
    rows = []
    for i in range(150):
        own = [f"o{x}" for x in rng.integers(0, 10**6, 90)]
        rows.append((i, " ".join(frame + own)))
        if i % 5 == 0:
            own[int(rng.integers(0, 90))] = "changed"
            rows.append((1000 + i, " ".join(frame + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs, crowd=crowd).collect())
    assert got == brute_classes(rows)


def test_whole_numbers_decide_at_the_threshold(spark):
    """Sets of 100,000 shingles just below and just at 0.8, where 32-bit arithmetic would err."""
    n = 100_000
    base = [f"w{i}" for i in range(n + 4)]
    other = lambda k: [*base[: n + 4 - k], *(f"x{i}" for i in range(k))]
    # k changed words at the end change k shingles: common n - k, union n + k
    at = n // 9  # (n - k) / (n + k) >= 0.8 up to k = n / 9
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other(at))), (3, " ".join(f"y{w}" for w in base)), (4, " ".join(f"y{w}" for w in other(at + 1)))], "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_blocks_of_a_split_class(spark, monkeypatch):
    import strandlake.llm.forest as forest

    monkeypatch.setattr(forest, "CHUNK", 7)
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(i, f"{text} t{i}") for i in range(40)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, 0, 39) for i in range(40))


def test_one_stays(spark, tricky, rows, empty):
    out = one_of_each_class(tricky)
    assert out.columns == tricky.columns
    classes = {(r.doc_id, r.text_hash): r.class_key for r in near_duplicates(tricky).collect()}
    kept = out.select("doc_id", text_hash(out.text).alias("h")).collect()
    assert Counter(classes[r.doc_id, r.h] for r in kept) == Counter(set(classes.values()))
    assert one_of_each_class(empty).count() == 0 and near_duplicates(empty).count() == 0


def test_prefix_is_the_longest_that_reaches_the_target():
    k = prefix_length(0.8, 20, 6, 0.999)
    assert 1 - (1 - 0.8**k) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_are_named_by_identifier_and_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    gone = df.filter("text = 'a'").select("doc_id", text_hash(df.text).alias("text_hash"))
    assert Counter((r.doc_id, r.text) for r in without_rows(df, gone).collect()) == Counter([(1, "b"), (None, None)])
