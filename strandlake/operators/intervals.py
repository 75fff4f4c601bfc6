"""Interval joins and gene-region annotation.

A point is joined to the intervals that hold it through bins of several widths: an interval
is listed in the bins of its own width that it touches (two at most), a point in one of each
width in use, so the join is an equi join on (key, level, bin) with the limits as a residual,
and needs no deduplication.  Small interval tables are broadcast
after a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.operators.common import small

#: Region flags in output order, the RNA types without coding parts, promoter lengths by feature.
OTHER_RNA = ["lncRNA", "snRNA", "antisenseRNA", "telomeraseRNA", "RNaseMRPRNA", "snoRNA"]
FLAGS = [
    "gene", "mRNA", "mRNA_promoter", "mRNA_exon", "coding_sequence", "start_codon", "stop_codon", "five_prime_UTR", "three_prime_UTR", "mRNA_intron", "mRNA_splice",
    *[f"{r}{x}" for r in OTHER_RNA for x in ("", "_promoter", "_exon")], "other",
]
PROMOTER_LENGTHS = {"mRNA": 2000, "lncRNA": 2000, "snoRNA": 500, "snRNA": 500, "telomerase_RNA": 1500, "antisense_RNA": 1500}
#: Attributes that are read from feature files.
ATTRIBUTES = ["ID", "Parent", "Dbxref", "Name", "description", "gbkey", "gene", "gene_biotype", "product", "tag", "transcript_id"]


def bin_width(intervals: DataFrame, start: str, end: str) -> int:
    """The median interval length (1 at least), as a bin width."""
    got = intervals.agg(F.percentile_approx(F.col(end) - F.col(start) + 1, 0.5)).first()[0]
    return max(1, int(got or 1))


#: Bins grow by this factor from level to level.
LEVEL = 16


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, position: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Points with the closed intervals of the same ``key`` that hold them.

    An interval lies in bins of the first level that is as wide as it is long, so it is listed
    twice at most, however long; a point is listed once for each level that is in use.
    """
    width = width or bin_width(intervals, start, end)
    length = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(length / F.lit(float(width))) / math.log(LEVEL))).cast("int")
    size = lambda lv: F.lit(float(width)) * F.pow(F.lit(float(LEVEL)), lv)
    listed = intervals.withColumn("__level", level)
    used = sorted(r[0] for r in listed.filter(F.col("__level").isNotNull()).select("__level").distinct().collect())  # 16 at most
    bins = F.sequence(F.floor(F.col(start) / size(F.col("__level"))), F.floor(F.col(end) / size(F.col("__level"))))
    by_bin = listed.withColumn("__bin", F.explode(F.when(F.col(start) <= F.col(end), bins))).withColumnRenamed(key, "__key")
    binned = points.withColumn("__plevel", F.explode(F.array(*[F.lit(u) for u in used]).cast("array<int>"))).withColumn("__pbin", F.floor(F.col(position) / size(F.col("__plevel"))))
    inside = (F.col(key) == F.col("__key")) & (F.col("__plevel") == F.col("__level")) & (F.col("__pbin") == F.col("__bin")) & F.col(position).between(F.col(start), F.col(end))
    return binned.join(small(by_bin), inside).drop("__level", "__bin", "__plevel", "__pbin", "__key")


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of overlapping closed intervals (columns of the right side prefixed ``r_``); each pair once, in the bin of its first shared place."""
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    a = left.withColumn("__bin", F.explode(bins))
    b = right.withColumn("__rbin", F.explode(bins)).select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "__rbin")
    shared = (F.col(key) == F.col(f"r_{key}")) & (F.col("__bin") == F.col("__rbin")) & (F.col(start) <= F.col(f"r_{end}")) & (F.col(f"r_{start}") <= F.col(end))
    out = a.join(b, shared).filter(F.col("__bin") == F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / width))
    return out.drop("__bin", "__rbin")


def parse_attributes(gff: DataFrame, column: str = "Attributes") -> DataFrame:
    """One column for each attribute (the first ``name=`` in the text, null if absent), and the Ensembl number of the cross references."""
    def take(pattern: str, text: Column) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    out = gff.select("*", *[take(f"{a}=([^;]+)", F.col(column)).alias(a) for a in ATTRIBUTES])
    listed = F.filter(F.split("Dbxref", ","), lambda x: x.startswith("Ensembl:"))
    return out.withColumn("Ensembl", F.substring(F.get(listed, F.lit(0)), 9, 1 << 20))


def promoters(gff: DataFrame) -> DataFrame:
    """Features with a known promoter length, with ``Promoter_Start`` and ``Promoter_End`` before their start in reading direction."""
    length = F.create_map(*[F.lit(x) for kv in PROMOTER_LENGTHS.items() for x in kv])
    rows = gff.filter(F.col("Feature").isin(*PROMOTER_LENGTHS)).withColumn("__d", length[F.col("Feature")])
    plus = F.col("Strand") == "+"
    return rows.select(*gff.columns, F.when(plus, F.col("Start") - F.col("__d")).otherwise(F.col("End")).alias("Promoter_Start"), F.when(plus, F.col("Start")).otherwise(F.col("End") + F.col("__d")).alias("Promoter_End"))


def transcript_extents(gff: DataFrame) -> DataFrame:
    """For each chromosome and parent: least and greatest ends of exons and coding parts, and the exon edges."""
    exon, cds = F.col("Feature") == "exon", F.col("Feature") == "CDS"
    rows = gff.filter(F.col("Parent").isNotNull() & (exon | cds))
    edges = F.flatten(F.collect_list(F.when(exon, F.array(F.col("Start") - 1, F.col("Start") - 2, F.col("End") + 1, F.col("End") + 2))))
    return rows.groupBy(F.col("Chromosome").alias("t_chrom"), F.col("Parent").alias("t_parent")).agg(
        F.min(F.when(exon, F.col("Start"))).alias("exon_min"), F.max(F.when(exon, F.col("End"))).alias("exon_max"),
        F.min(F.when(cds, F.col("Start"))).alias("cds_min"), F.max(F.when(cds, F.col("End"))).alias("cds_max"), edges.alias("splice_sites"),
    )


def annotate_regions(variants: DataFrame, gff: DataFrame, promoter_table: DataFrame, chrom: str = "chrom", pos: str = "pos", width: int | None = None) -> DataFrame:
    """``variants`` with 0/1 region flags, transcript lists, ``region`` and ``region_class``.

    Each overlapping mRNA transcript is judged by itself - coding, UTR or intron, limits by
    strand from the whole transcript - and flags are the maximum over transcripts.  A variant
    with no overlap at all has ``other``.  The flags depend on the place alone, so distinct
    places are judged and joined back; a null place has ``other``.
    """
    places = variants.select(F.col(chrom).cast("string").alias("__c"), F.col(pos).cast("long").alias("__p")).dropna().distinct()
    points = places.withColumn("__v", F.struct("__c", "__p"))
    features = gff.select(F.col("Chromosome").alias("__c"), "Feature", "Start", "End", "Strand", "ID", "Parent", "transcript_id")
    hits = points_in_intervals(points, features, "__c", "__p", "Start", "End", width=width)
    is_ = lambda f: F.col("Feature") == f

    whole = hits.groupBy("__v").agg(
        *[F.max(is_(f).cast("int")).alias(f) for f in ("gene", "mRNA", *OTHER_RNA)],
        F.sort_array(F.collect_set(F.when(F.col("Feature").isin("mRNA", *OTHER_RNA), F.col("transcript_id")))).alias("transcript_set"),
    )
    parts = hits.filter(F.col("Feature").isin("exon", "CDS")).groupBy("__v", "Parent").agg(F.max(is_("exon").cast("int")).alias("in_exon"), F.max(is_("CDS").cast("int")).alias("in_cds"))
    transcripts = hits.filter(F.col("Feature").isin("mRNA", *OTHER_RNA) & (F.col("ID") == F.concat(F.lit("rna-"), "transcript_id"))).select("__v", "__c", "__p", "Feature", "Strand", F.col("ID").alias("tid")).distinct()
    t = transcripts.join(parts.withColumnRenamed("__v", "__w"), (F.col("__v") == F.col("__w")) & (F.col("tid") == F.col("Parent")), "left")
    t = t.join(small(transcript_extents(gff)), (F.col("__c") == F.col("t_chrom")) & (F.col("tid") == F.col("t_parent")), "left")
    exon, cds = F.coalesce(F.col("in_exon") == 1, F.lit(False)), F.coalesce(F.col("in_cds") == 1, F.lit(False))
    plus, p = F.col("Strand") == "+", F.col("__p")
    coding, utr, intron = exon & cds, exon & ~cds, ~exon & ~cds
    near = lambda edge, up: p.between(edge, edge + 2) if up else p.between(edge - 2, edge)
    low, high = F.col("cds_min"), F.col("cds_max")
    before, after = p.between(F.col("exon_min"), low - 1), p.between(high + 1, F.col("exon_max"))
    judged = {
        "mRNA_exon": exon,
        "coding_sequence": coding,
        "start_codon": coding & F.when(plus, near(low, True)).otherwise(near(high, False)),
        "stop_codon": coding & F.when(plus, near(high, False)).otherwise(near(low, True)),
        "five_prime_UTR": utr & F.when(plus, before).otherwise(after),
        "three_prime_UTR": utr & F.when(plus, after).otherwise(before),
        "mRNA_intron": intron,
        "mRNA_splice": intron & F.array_contains("splice_sites", p),
    }
    mrna = F.col("Feature") == "mRNA"
    by_transcript = t.groupBy("__v").agg(
        *[F.max((mrna & F.coalesce(c, F.lit(False))).cast("int")).alias(n) for n, c in judged.items()],
        *[F.max(((F.col("Feature") == r) & exon).cast("int")).alias(f"{r}_exon") for r in OTHER_RNA],
    )
    upstream = promoter_table.select(F.col("Chromosome").cast("string").alias("__c"), "Feature", "Promoter_Start", "Promoter_End", "transcript_id")
    before_tss = points_in_intervals(points, upstream, "__c", "__p", "Promoter_Start", "Promoter_End", width=width)
    promoted = before_tss.groupBy("__v").agg(
        *[F.max(is_(f).cast("int")).alias(f"{f}_promoter") for f in ("mRNA", *OTHER_RNA)],
        F.sort_array(F.collect_set("transcript_id")).alias("promoter_transcript_set"),
        F.lit(True).alias("__promoted"),
    )
    judged_places = points.select("__v").join(whole.withColumn("__hit", F.lit(True)), "__v", "left").join(by_transcript, "__v", "left").join(promoted, "__v", "left")
    kept = variants.select(*[F.col(c).alias(f"__in_{i}") for i, c in enumerate(variants.columns)], F.col(chrom).cast("string").alias("__vc"), F.col(pos).cast("long").alias("__vp"))
    here = (F.col("__vc") == F.col("__v.__c")) & (F.col("__vp") == F.col("__v.__p"))
    out = kept.join(judged_places, here, "left")
    own = [F.col(f"__in_{i}").alias(c) for i, c in enumerate(variants.columns)]
    other = (F.col("__hit").isNull() & F.col("__promoted").isNull()).cast("int").alias("other")
    flags = [F.coalesce(F.col(f), F.lit(0)).alias(f) for f in FLAGS[:-1]]
    empty = F.array().cast("array<string>")
    out = out.select(*own, *flags, other, F.coalesce("transcript_set", empty).alias("transcript_set"), F.coalesce("promoter_transcript_set", empty).alias("promoter_transcript_set"))
    region = F.array_join(F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in FLAGS])), ",")
    return out.withColumn("region", region).withColumn("region_class", region_class())


def region_class() -> Column:
    """The class of the flags, by falling priority."""
    any_flag = lambda *names: reduce(lambda a, b: a | b, [F.col(n) == 1 for n in names])
    coding = any_flag("coding_sequence", "start_codon", "stop_codon")
    return (
        F.when(coding & any_flag("mRNA_splice"), "CODING, SPLICE").when(coding, "CODING").when(any_flag("mRNA_splice"), "SPLICE").when(any_flag("five_prime_UTR"), "UTR_5")
        .when(any_flag("three_prime_UTR"), "UTR_3").when(any_flag("mRNA_promoter"), "PROMOTER").when(any_flag("mRNA_intron"), "INTRONIC").when(any_flag("gene", "mRNA", "mRNA_exon"), "GENIC_OTHER").otherwise("OTHER")
    )


def most_severe(variants: DataFrame, severity: list[str], key: str, start: str, end: str, term: str) -> DataFrame:
    """``key, position, term``: at each place of a transcript the most severe term of the variants that cover it (listed first: worst)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in severity]), F.col(term))
    places = variants.withColumn("position", F.explode(F.sequence(F.least(start, end), F.greatest(start, end))))
    return places.groupBy(key, "position").agg(F.min_by(term, F.struct(F.when(rank > 0, rank).otherwise(1 << 20), F.col(term))).alias(term))


def shared_windows(rows: DataFrame, keys: list[str], pos: str, span: str, max_span: int, period: int = 128, context: int | None = None) -> DataFrame:
    """Groups rows that can share one window: same keys and phase (position modulo ``period``), greedily from the left.

    A group takes rows while they end within ``max_span`` of its first.  Each step depends on
    where the last group began, so this is a scan: rows are dealt by (keys, phase), sorted
    inside the partitions and streamed through, with one open group as the only state.
    Adds ``phase``, ``window_no`` (from 0 within keys and phase) and ``window_first``.  With
    ``context`` also ``window_start``, 0-based: a window of so many letters is centred on the
    first row and moved right by whole periods, as many as half the group's extent rounds to
    (halves to even), never before 0.
    """
    added = [T.StructField("phase", T.LongType()), T.StructField("window_no", T.LongType()), T.StructField("window_first", T.LongType())]
    schema = T.StructType([*rows.schema.fields, *added])
    phased = rows.withColumn("phase", F.pmod(F.col(pos).cast("long") - 1, F.lit(period)).cast("long"))
    dealt = phased.repartition(*keys, "phase").sortWithinPartitions(*keys, "phase", pos, span)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, number, first = None, -1, None
        for pdf in batches:
            numbers, firsts = [], []
            for key, p, size in zip(zip(*(pdf[c] for c in (*keys, "phase")), strict=True), pdf[pos], pdf[span], strict=True):
                if key != group:
                    group, number, first = key, -1, None
                if first is None or p + max(1, size) - first > max_span:
                    first, number = p, number + 1
                numbers.append(number)
                firsts.append(first)
            yield pdf.assign(window_no=numbers, window_first=firsts)

    out = dealt.mapInPandas(scan, schema)
    if context is None:
        return out
    last = F.max(pos).over(Window.partitionBy(*keys, "phase", "window_no"))  # a group is bounded by max_span
    shift = F.bround((last - F.col("window_first")) / 2.0 / period) * period
    return out.withColumn("window_start", F.greatest(F.lit(0), F.col("window_first") - 1 + shift - context // 2).cast("long"))
