"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Every stage takes the documents that the one before kept, and all but the last return the
columns of ``documents``.  Null and empty texts, repeated rows and other columns are treated as
the operators' own descriptions say; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stage, without_rows
from strandlake.llm.decontaminate import build_index, contaminated, find_contamination
from strandlake.llm.forest import one_of_each_class
from strandlake.llm.linededup import drop_lines, find_first_lines
from strandlake.llm.outliers import quality_verdicts
from strandlake.llm.packing import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are robust outliers of their language and source go."""
    return without_rows(docs, quality_verdicts(docs).filter(~F.col("kept")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or (from 20 characters on) nearly equals, are cut out of the texts."""
    return drop_lines(docs, find_first_lines(docs, min_chars=20, equal_chars=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return one_of_each_class(docs, threshold=0.8, ngram=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth lies in benchmark windows go."""
    found = find_contamination(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)
    return without_rows(docs, found.filter(contaminated()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of at most 1024 ids."""
    import public_tokenizers

    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Tokenizing and classes have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
