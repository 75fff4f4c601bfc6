"""Statistics of texts as DataFrame expressions (no Python on the executors).

Words are ``[^\\x20\\x09-\\x0D]+``; null texts have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def with_text_stats(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    * ``word_chars``: code points in words; ``n_symbols``: characters of ``[#*$%&|<>]``;
    * ``n_lines``, ``n_dup_lines``: ``\\n``-separated lines with a word, and those equal to an earlier one;
    * ``n_repeat_words``: words inside 5-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words.  Every step is linear in the text
    but one sort, which only texts with a repeated window need.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    rows = rows.select(
        *keep,
        F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)).alias("__w"),
        F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    grams = F.expr("IF(size(__w) < 5, array(), transform(sequence(0, size(__w) - 5), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2], __w[i + 3], __w[i + 4])))")
    rows = rows.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        grams.alias("__g"),
    )
    # windows (hash, place), sorted; those with an equal neighbour; their places, sorted; words they cover
    covered = F.expr(
        "aggregate(array(named_struct('s', array_sort(transform(__g, (h, i) -> named_struct('h', h, 'i', i))))), 0L, (z, o) -> z + aggregate("
        "array(array_sort(transform(filter(o.s, (x, k) -> (k > 0 AND o.s[k - 1].h = x.h) OR (k < size(o.s) - 1 AND o.s[k + 1].h = x.h)), x -> x.i))),"
        " 0L, (y, p) -> y + aggregate(transform(p, (i, k) -> IF(k < size(p) - 1, least(5, p[k + 1] - i), 5)), 0L, (a, b) -> a + b)))"
    )
    repeats = F.when(F.size(F.array_distinct("__g")) < F.size("__g"), covered).otherwise(F.lit(0).cast("long"))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))
