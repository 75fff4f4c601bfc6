"""Operator 5: exact histogram of encoded lengths and what it answers for every context limit.

Special cases: null texts are empty (length 0); an empty table gives an empty histogram;
other columns are ignored.  The histogram has one row for each length that occurs, so its
size is bounded by the longest document, not by the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import ship, slices, stage

#: Lengths that share a block of the two-level sums.
BLOCK = 128


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs`` for every encoded length; counted in each batch before the shuffle."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandlake.llm.tokens import encoder

        encode, seen = encoder(tokenizer), {}
        for batch in slices(batches, "t", 16 << 20):
            for n, c in zip(*(x.tolist() for x in np.unique(encode.lengths(batch.column(0)), return_counts=True)), strict=True):
                seen[n] = seen.get(n, 0) + c
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(seen.values(), pa.int64())], names=["n_tokens", "n_docs"])
                seen = {}
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(seen.values(), pa.int64())], names=["n_tokens", "n_docs"])

    parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_answers(histogram: DataFrame) -> DataFrame:
    """One row for every occurring length L, taken as a context limit.

    ``n_docs`` documents of exactly L ids, ``docs_at_most`` and ``tokens_at_most`` up to L,
    ``docs_longer`` and ``tokens_longer`` beyond (suffix sums), ``kept_tokens`` and
    ``lost_tokens`` when every document is cut at L, and ``quantile``, the share of documents
    up to L.  Sums run in two levels, so no task holds more than the blocks or one block.
    The histogram is read twice and so written first.
    """
    rows = stage(histogram, "length-histogram").select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), zero).alias("later_docs"),
        F.coalesce(F.sum("bt").over(after), zero).alias("later_tokens"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", "tokens", "all_docs", "all_tokens",
        (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(inside), zero)).alias("docs_longer"),
        (F.col("later_tokens") + F.coalesce(F.sum("tokens").over(inside), zero)).alias("tokens_longer"),
    )
    kept = F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return out.select(
        "n_tokens", "n_docs", "tokens",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_longer")).alias("tokens_at_most"),
        "docs_longer", "tokens_longer",
        kept.alias("kept_tokens"),
        (F.col("all_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(answers: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any limits, occurring or not: ``n_tokens`` (the limit), documents and tokens kept whole or cut."""
    spark = answers.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit_ long")
    below = answers.join(F.broadcast(asked), F.col("n_tokens") <= F.col("limit_"))
    found = below.groupBy("limit_").agg(*[F.max_by(c, "n_tokens").alias(c) for c in ("docs_at_most", "tokens_at_most", "docs_longer")])
    total = answers.agg(F.max("docs_at_most").alias("all_docs"))
    zero = F.lit(0).cast("long")
    out = asked.join(found, "limit_", "left").join(F.broadcast(total))
    longer = F.coalesce("docs_longer", "all_docs", zero)
    return out.select(
        F.col("limit_").alias("n_tokens"),
        F.coalesce("docs_at_most", zero).alias("docs_at_most"),
        longer.alias("docs_longer"),
        (F.coalesce("tokens_at_most", zero) + longer * F.col("limit_")).alias("kept_tokens"),
    )


def length_quantile(answers: DataFrame, share: float) -> int | None:
    """The least length L such that at least ``share`` of the documents have at most L ids."""
    return answers.filter(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]
