"""Operator 9: toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, accents, look-alike letters of other scripts and digits that
stand for letters become one spelling; all else separates words.  The lexicon - whole words
and word beginnings - is learned from labelled rows: patterns that are significantly more frequent
in toxic rows (log-likelihood ratio of the exact counts), weighted by their log odds against the
others; neither candidates nor lexicon nor exceptions are capped.  Phrases of a pattern with the word
before it that labelled rows show to be harmless become exceptions; matches inside them do
not count.  The matched weight and the number of matches, both normalised by length, and the mean weight of a
match go through a logistic curve.

All counts cover every labelled row handed in.  Only the curve (a handful of numbers) is
fitted on a bounded sample: the ``sample_rows`` rows with the least hashes of their identifiers.

Special cases: null and empty texts match nothing and get the curve's least score; without
toxic (or without other) rows the lexicon is empty and the score is the smoothed share of
toxic rows; rows without a label are not learned from; repeated rows count each; a null
identifier hashes as the empty string; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ship, slices, small, stage
from strandlake.llm.outliers import chi2_quantile

#: Letters of other scripts that look like a Latin letter.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "г": "r", "п": "n", "и": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ħ": "h",
}
#: Digits and signs that stand for a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_ASCII = bytearray(b" " * 256)
for _c in range(48, 58):
    _ASCII[_c] = _c
for _c in range(97, 123):
    _ASCII[_c] = _ASCII[_c - 32] = _c
for _a, _b in DIGITS.items():
    _ASCII[ord(_a)] = ord(_b)
_ASCII[ord("l")] = _ASCII[ord("L")] = ord("i")  # l, i and 1 are one letter
_ASCII = bytes(_ASCII)

_folded: dict[str, str] = {}


def _fold_char(c: str) -> str:
    if c not in _folded:
        low = c.lower()
        plain = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", LOOK_ALIKES.get(low, low)) if not unicodedata.combining(x))
        _folded[c] = "".join(x.encode().translate(_ASCII).decode() if x.isascii() else x if x.isalnum() else " " for x in plain)
    return _folded[c]


def fold(text: str | None) -> str:
    """The folded words of a text, between single blanks, one blank at either end."""
    text = text or ""
    if not text.isascii():
        for c in {c for c in set(text) if not c.isascii()}:
            text = text.replace(c, _fold_char(c))
    if text.isascii():
        text = text.encode().translate(_ASCII).decode()
    else:
        text = "".join(chr(_ASCII[ord(c)]) if c.isascii() else c for c in text)
    return f" {' '.join(text.split())} "


def patterns_of(folded: str) -> set[str]:
    """Whole words (`` word ``) and word beginnings (`` begin``) of 4 to 6 letters."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for n in (4, 5, 6):
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Lexicon:
    """Weighted patterns, exception phrases and the curve; as large as the significant vocabulary."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])
    prior: float = 0.5

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for p in self.exceptions:
            found.add_word(p, (len(p), None))
        if len(found):
            found.make_automaton()
        return found

    @staticmethod
    def matches(automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches outside exceptions."""
        hits, spared = [], []
        if not len(automaton):
            return hits
        for end, (size, w) in automaton.iter(folded):
            (spared if w is None else hits).append((end + 1 - size, end + 1, w))
        if not spared:
            return hits
        return [h for h in hits if not any(a <= h[0] and h[1] <= z for a, z, _ in spared)]

    def features(self, automaton, folded: str) -> tuple[float, float, float]:
        """Weight and matches for 100 words, on a log scale, and the mean weight of a match: nothing grows with the length alone."""
        hits = self.matches(automaton, folded)
        words = folded.count(" ") + 20
        total = sum(h[2] for h in hits)
        return math.log1p(100 * total / words), math.log1p(100 * len(hits) / words), total / len(hits) if hits else 0.0

    def score(self, x: tuple[float, float, float]) -> float:
        if not self.weights:
            return self.prior
        z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str, folds: int = 5, fold_no: int = 0) -> Column:
    """The crc32 of the identifier as text, modulo ``folds``, is ``fold_no``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold_no


def _counts(rows: DataFrame, patterns) -> DataFrame:
    """Numbers of toxic (``c1``) and other (``c0``) rows for each string that ``patterns(folded)`` yields."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = patterns()
        for batch in slices(batches, "t"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(find(t))
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"p": pa.array(keys, pa.string()), "c0": pa.array([seen[0][k] for k in keys], pa.int64()), "c1": pa.array([seen[1][k] for k in keys], pa.int64())})

    return rows.select("y", "t").mapInArrow(count, "p string, c0 long, c1 long").groupBy("p").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _likelihood_ratio(n0: int, n1: int) -> Column:
    """Log-likelihood ratio (chi-squared with one degree) of a pattern's rows ``c0``, ``c1`` among ``n0``, ``n1``."""
    c0, c1, n = F.col("c0"), F.col("c1"), n0 + n1
    cells = [(c0, (c0 + c1) * (n0 / n)), (c1, (c0 + c1) * (n1 / n)), (n0 - c0, (n - c0 - c1) * (n0 / n)), (n1 - c1, (n - c0 - c1) * (n1 / n))]
    return 2 * sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))


def learn_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", min_rows: int = 3, min_weight: float = 2.0, significance: float = 1e-5, sample_rows: int = 20_000) -> Lexicon:
    """Learns patterns, exceptions and curve from the rows of ``labels`` (already without held-out rows).

    ``min_rows``: least number of toxic rows with a pattern, and of other rows with an exception,
    however large the input; ``min_weight``: least log odds; ``significance``: level of the
    log-likelihood ratio test (without other rows, five toxic rows are enough if a tenth are toxic).
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(small(known), "i")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fold(t) for t in batch.column(2).to_pylist()], pa.string())], names=["h", "y", "t"])

    rows = stage(rows.select(F.xxhash64("i").alias("h"), "y", "t").mapInArrow(folded, "h long, y int, t string"), "toxic-labelled")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    prior = (n1 + 0.5) / (n0 + n1 + 1)
    if not n0 or not n1:
        return Lexicon({}, prior=prior)
    telling = _counts(rows, lambda: patterns_of).filter(F.col("c1") >= min_rows)
    weight = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    telling = telling.withColumn("w", weight).filter((F.col("w") >= min_weight) & (_likelihood_ratio(n0, n1) >= chi2_quantile(1 - significance, 1)))
    weights: dict[str, float] = {}
    for r in sorted(telling.collect(), key=lambda r: (-r.w * math.sqrt(r.c1), r.p)):
        if not any(r.p[:k] in weights for k in range(2, len(r.p) + 1)):  # a blank leads every pattern, so one inside another is its beginning
            weights[r.p] = r.w
    lexicon = Lexicon(weights, prior=prior)
    if not weights:
        return lexicon

    def phrases():
        automaton = lexicon.automaton()

        def find(t: str) -> set[str]:
            out = set()
            for a, _, _ in Lexicon.matches(automaton, t):
                before = t.rfind(" ", 0, a)
                if before >= 0:
                    out.add(t[before : t.index(" ", a + 1) + 1])
            return out

        return find

    harmless = _counts(rows, phrases).filter(F.col("c0") >= min_rows).filter((F.col("c1") + 0.5) / (n1 + 1) < (F.col("c0") + 0.5) / (n0 + 1))
    lexicon.exceptions = sorted(r.p for r in harmless.select("p").collect())
    lexicon.curve = _fit(rows, lexicon, sample_rows)
    return lexicon


def _fit(rows: DataFrame, lexicon: Lexicon, sample_rows: int) -> list[float]:
    """Logistic regression with a small ridge, by Newton's method, on the bounded sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "t"):
            x = [lexicon.features(automaton, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([v[k] for v in x], pa.float64()) for k in range(3)]], names=["h", "y", "a", "b", "c"])

    sample = rows.mapInArrow(measure, "h long, y int, a double, b double, c double").orderBy("h", "y", "a", "b", "c").limit(sample_rows).toPandas()
    x = np.column_stack([np.ones(len(sample)), sample[["a", "b", "c"]].to_numpy()])
    y = sample["y"].to_numpy(float)
    beta = np.zeros(4)
    ridge = np.diag([1e-6, 0.1, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_matches, matched`` (weight outside exceptions) of every whole text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, "t"):
            out, count, matched = [], [], []
            for t in batch.column(1).to_pylist():
                folded = fold(t)
                hits = Lexicon.matches(automaton, folded)
                count.append(len(hits))
                matched.append(sum(h[2] for h in hits))
                out.append(lexicon.score(lexicon.features(automaton, folded)) if hits or not lexicon.weights else lexicon.score((0.0, 0.0, 0.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(count, pa.int64()), pa.array(matched, pa.float64())], names=["doc_id", "score", "n_matches", "matched"])

    return rows.mapInArrow(score, "doc_id long, score double, n_matches long, matched double")
