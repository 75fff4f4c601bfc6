"""Markup and sequence sources: HTML tables, vector drawings, FASTA, alignments."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.storage import ship


class _Tables(HTMLParser):
    """Rows of all tables of a page, as lists of cell texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
        elif tag in ("script", "style"):
            self.hidden += 1

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if self.cell is not None and not self.hidden:
            self.cell.append(data)


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key, table_no, row_no, cells`` of every table row of every page."""
    ship(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                parser = _Tables()
                parser.feed(text or "")
                rows += [(k, t, r, cells) for t, table in enumerate(parser.tables) for r, cells in enumerate(table)]
            yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, html).mapInPandas(read, f"{key} {kind}, table_no int, row_no int, cells array<string>")


def table_with_header(rows: DataFrame, key: str, words: list[str]) -> DataFrame:
    """For each page the first table whose header row mentions one of ``words``: its data rows with the header."""
    named = F.lower(F.array_join("cells", " ")).rlike("|".join(rf"\Q{w}\E" for w in words))
    first = rows.filter((F.col("row_no") == 0) & named).groupBy(key).agg(F.min_by(F.struct("table_no", F.col("cells").alias("header")), "table_no").alias("h"))
    return rows.join(first, key).filter((F.col("table_no") == F.col("h.table_no")) & (F.col("row_no") > 0)).select(key, "table_no", "row_no", "h.header", "cells")


def svg_elements(docs: DataFrame, key: str, text: str, tag: str, attributes: list[str]) -> DataFrame:
    """``key, position`` and the attributes of each ``<tag ...>`` element."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(rf"(<{tag}\b[^>]*>)"), F.lit(1))).alias("position", "element"))
    return found.select(key, "position", *[F.nullif(F.regexp_extract("element", rf'\b{a}="([^"]*)"', 1), F.lit("")).alias(a.replace("-", "_")) for a in attributes])


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """``chrom, chunk_idx, seq``: contigs in chunks of ``chunk`` letters (the last one shorter).

    Files are read with ``>`` as the record separator, so one record is one contig.
    """
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")
    rows = records.select(name.alias("chrom"), seq.alias("all"))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("all") - 1) / chunk).cast("int"))), lambda i: F.struct(i.alias("chunk_idx"), F.substring("all", i * chunk + 1, F.lit(chunk)).alias("seq")))
    return rows.select("chrom", F.explode(chunks).alias("c")).select("chrom", "c.chunk_idx", "c.seq")


def fetch_spans(spans: DataFrame, contigs: DataFrame, chunk: int = 1 << 16, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """``spans`` with ``letters`` of the 0-based half-open span; null off the contig or if all are N.

    Names match with and without ``chr``.  Each distinct span is joined to the chunks it touches, and
    back by its place, so repeated spans cost nothing; empty spans have no letters.
    """
    bare = lambda c: F.regexp_replace(c, "^chr", "")
    places = spans.select(F.col(chrom).alias("__n"), F.col(start).alias("__a"), F.col(end).alias("__z")).filter("__a < __z").distinct()
    parts = places.select("__n", bare(F.col("__n")).alias("__c"), "__a", "__z", F.explode(F.sequence(F.floor(F.col("__a") / chunk), F.floor((F.col("__z") - 1) / chunk))).alias("__k"))
    pieces = parts.join(contigs.select(bare(F.col("chrom")).alias("__c"), F.col("chunk_idx").cast("long").alias("__k"), "seq"), ["__c", "__k"])
    low = F.greatest(F.col("__a") - F.col("__k") * chunk, F.lit(0))
    cut = F.substring("seq", (low + 1).cast("int"), (F.least(F.col("__z") - F.col("__k") * chunk, F.lit(chunk)) - low).cast("int"))
    joined = pieces.select("__n", "__a", "__z", "__k", cut.alias("x")).groupBy("__n", "__a", "__z").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", "x"))), lambda p: p["x"]), "").alias("letters"))
    out = spans.join(joined, (F.col(chrom) == F.col("__n")) & (F.col(start) == F.col("__a")) & (F.col(end) == F.col("__z")), "left").drop("__n", "__a", "__z")
    whole = (F.length("letters") == F.col(end) - F.col(start)) & ~F.upper("letters").rlike("^N+$") & (F.col(start) >= 0)
    return out.withColumn("letters", F.when(whole, F.col("letters")))


def first_source(*sources: Column) -> Column:
    """The first of several sources that gave letters other than N."""
    return F.coalesce(*[F.when(~F.upper(s).rlike("^N*$"), s) for s in sources])


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """``name, sequence`` of a Clustal file: the blocks of each name joined in order."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    part = lines.select("n", F.regexp_extract("value", r"^(\S+)\s+([A-Za-z\-\.]+)(?:\s+\d+)?\s*$", 1).alias("name"), F.regexp_extract("value", r"^(\S+)\s+([A-Za-z\-\.]+)(?:\s+\d+)?\s*$", 2).alias("block"))
    part = part.filter((F.col("name") != "") & ~F.upper("name").startswith("CLUSTAL"))
    return part.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda b: b["block"]), "").alias("sequence"))


def alignment_identity(alignment: DataFrame) -> DataFrame:
    """``column, letter, share``: the most frequent letter of each alignment column (least of ties) and its share."""
    cells = alignment.select(F.posexplode(F.split("sequence", "")).alias("column", "letter")).filter("letter <> ''")
    counts = cells.groupBy("column", "letter").agg(F.count("*").alias("c"))
    best = counts.groupBy("column").agg(F.sum("c").alias("n"), F.min_by("letter", F.struct(-F.col("c"), F.col("letter"))).alias("letter"), F.max("c").alias("top"))
    return best.select("column", "letter", (F.col("top") / F.col("n")).alias("share"))


def line_numbers(lines: DataFrame, order: str = "n") -> DataFrame:
    """Numbers the lines of one small file from 1."""
    return lines.withColumn("line_no", F.row_number().over(Window.orderBy(order)))
