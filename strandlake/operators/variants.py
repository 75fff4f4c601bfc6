"""Whole steps over variant tables: impact frame, signal extraction, source rows, checks and interpretation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import text as tx
from strandlake.operators import families as fam
from strandlake.operators import reference_z as rz
from strandlake.operators import topk
from strandlake.operators.common import any_of, clean
from strandlake.operators.tables import unpivoted
from strandlake.sources.documents import fetch_spans
from strandlake.sources.tabular import resolve_aliases

# --- scores -----------------------------------------------------------------------------------


def _score_columns(values: Column, prefix: str) -> dict[str, Column]:
    mean, greatest, log_sum = fam.vector_scores(values, "x")
    return {f"{prefix}_mean_abs": mean, f"{prefix}_max_abs": greatest, f"{prefix}_sum_log": log_sum}


def impact_frame(df: DataFrame, group: str, bed: str, bw: str, is_reference: Column | None = None, moments: tuple[DataFrame, DataFrame] | None = None, bed_k: int = 3, bw_k: int = 10) -> DataFrame:
    """``df`` with the impact columns of two families held as arrays ``bed`` and ``bw``.

    ``BED_*`` (raw values), ``BW_z_*`` and ``Global_z_*`` (z-scores against the reference rows of
    the group, or given ``moments`` of both families): mean and greatest magnitude and the sum
    of log(1 + magnitude); ``BED_top<k>_mean``, ``BW_z_top<k>_mean``; ``Composite_mean`` and
    ``Composite_top`` are the even means of the two.  A missing z is 0; a missing raw value
    makes the raw top-k mean null.
    """
    own = list(df.columns)
    if moments is None:
        moments = tuple(rz.reference_moments(df, group, a, is_reference) for a in (bed, bw))
    out = rz.apply_z(rz.apply_z(df, group, bed, moments[0], "__zb"), group, bw, moments[1], "__zw")
    both = F.concat("__zb", "__zw")
    scores = _score_columns(F.col(bed), "BED") | {f"BED_top{bed_k}_mean": fam.top_k_mean(F.col(bed), bed_k)}
    scores |= _score_columns(F.col("__zw"), "BW_z") | {f"BW_z_top{bw_k}_mean": fam.top_k_mean(F.col("__zw"), bw_k)} | _score_columns(both, "Global_z")
    out = out.select(*own, *[c.alias(n) for n, c in scores.items()])
    half = lambda a, b: 0.5 * F.col(a) + 0.5 * F.col(b)
    return out.withColumns({"Composite_mean": half("BED_mean_abs", "BW_z_mean_abs"), "Composite_top": half(f"BED_top{bed_k}_mean", f"BW_z_top{bw_k}_mean")})


def burden_by_kind(long: DataFrame, key: str, kind: str, background: DataFrame, order: str | None = None, fallback: str = "indel", floor: float = 1e-8) -> DataFrame:
    """``key, burden``: the sum of log(1 + |z|) of each row's tracks against the background of its kind.

    ``long``: ``key, kind, track, value``; ``background``: ``variant_type, delta_col, mean, std``
    (the first row by ``order`` of a repeated pair counts).  Kinds the background lacks, other
    than snp, take ``fallback``.  Missing values and tracks without a background are left out; a
    row with none left has a null burden; a deviation below ``floor`` or missing counts as 1.
    """
    b = background
    if order is not None:
        b = b.groupBy("variant_type", "delta_col").agg(F.min_by(F.struct("mean", "std"), order).alias("s")).select("variant_type", "delta_col", "s.mean", "s.std")
    known = b.select(F.lower("variant_type").alias("__t")).distinct().withColumn("__known", F.lit(True))
    rows = long.withColumn("__t", F.lower(kind)).join(F.broadcast(known), "__t", "left")  # a row for each kind
    use = F.when(F.col("__known"), F.col("__t")).when(F.col("__t") != "snp", F.lit(fallback))
    stats = b.select(F.lower("variant_type").alias("__u"), F.col("delta_col").alias("__d"), "mean", F.when(clean(F.col("std")) >= floor, F.col("std")).otherwise(1.0).alias("std"))
    joined = rows.select(key, use.alias("__use"), F.col("track").alias("__track"), clean(F.col("value").cast("double")).alias("__v"))
    joined = joined.join(stats, (F.col("__use") == F.col("__u")) & (F.col("__track") == F.col("__d")), "left")
    z = F.abs((F.col("__v") - F.col("mean")) / F.col("std"))
    return joined.groupBy(key).agg(F.sum(F.log1p(clean(z))).alias("burden"))


# --- signals ----------------------------------------------------------------------------------

#: Column, label and digits of the summary of sequence-model scores; the last three for indels only.
SUMMARY_FIELDS = [("LLR", "LLR", 3), ("MLM_Delta", "MLM_Delta", 3), ("MLM_Prior", "MLM_Prior", 3), ("MLM_logprob_delta", "LogProb_Delta", 1), ("MLM_logprob_ref", "LogProb_Ref", 1)]
SUMMARY_FIELDS_INDEL = [("EMB_cosine_dist", "EMB_cos", 3), ("MLM_KL_max", "KL_max", 3), ("MLM_KL_mean", "KL_mean", 3)]


def model_summary(df: DataFrame, indel: bool = False) -> Column:
    """``label=value; ...`` of the sequence-model columns that are there, missing values left out; ``None`` if nothing is."""
    parts = []
    for column, label, digits in SUMMARY_FIELDS + (SUMMARY_FIELDS_INDEL if indel else []):
        if column in df.columns:
            x = clean(F.col(column).cast("double"))
            parts.append(F.when(x.isNotNull(), F.concat(F.lit(f"{label}="), F.format_string(f"%.{digits}f", x))))
    listed = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return F.when(F.size(listed) > 0, F.array_join(listed, "; ")).otherwise("None")


def extract_signals(df: DataFrame, key: str, families: dict[str, tuple[str, str | None, list[str]]], k: int = 5, strong: float = 0.3, indel: bool = False) -> DataFrame:
    """``key``, for each family its greatest magnitude, number of strong members and three rendered lists, and ``MLM_Summary``.

    ``families``: name -> (array of differences, array of reference values or None, member
    names).  Missing differences count as 0, as in the strings that judges are shown.
    """
    out: list[Column] = [F.col(key)]
    for name, (values, refs, names) in families.items():
        filled = F.transform(values, lambda x: F.coalesce(clean(x.cast("double")), F.lit(0.0)))
        found = topk.members(filled, F.col(refs) if refs else None)
        out += [
            F.coalesce(F.array_max(F.transform(filled, F.abs)), F.lit(0.0)).alias(f"{name}_Max_Abs_Delta"),
            F.size(F.filter(filled, lambda x: F.abs(x) > strong)).alias(f"{name}_N_Strong_Signals"),
            topk.render(topk.top_abs(found, k), names).alias(f"{name}_Top_Abs"),
            topk.render(topk.top_gains(found, k), names).alias(f"{name}_Top_Gains"),
            topk.render(topk.top_losses(found, k), names).alias(f"{name}_Top_Losses"),
        ]
    return df.select(*out, model_summary(df, indel).alias("MLM_Summary"))


# --- source rows ------------------------------------------------------------------------------

#: Names that source tables give to a field, in order of preference.
SOURCE_ALIASES = {
    "species": ["species name", "species"], "chrom": ["chromosome", "chr.", "chr", "chrom"], "genomic": ["g. or m.", "g.or m.", "hgvs genomic", "genomic hgvs"],
    "coding": ["c. or n.", "c.or n.", "hgvs coding", "hgvs"], "position": ["position", "pos", "start"], "gene": ["gene", "gene symbol", "gene_symbol"],
    "phenotype": ["variant phenotype", "phenotype", "phene", "trait"], "effect": ["variant effect", "variant_effect", "effect"],
    "description": ["verbal description", "description", "verbal_description", "summary"], "source_id": ["omia id", "omia_id", "id", "omia-id"],
    "allele": ["allele", "alleles", "allele1", "variant allele"], "assembly": ["reference sequence", "reference", "assembly"], "row": ["row"],
}


def parse_source_rows(df: DataFrame, species: list[str], assemblies: list[str], contigs: DataFrame | None = None, longest: int = 4096, chunk: int = 1 << 16) -> DataFrame:
    """Variants of one species from a table with free column names: ``chrom, pos, ref, alt, rationale, gene, phenotype, effect, source_id, variant_type``.

    A genomic substitution comes first; else a genomic indel, whose letters come from
    ``contigs`` (``chrom, chunk_idx, seq``); else any substitution in the notations with a
    number of four digits or more as its place.  A row whose genomic notation is an indel is
    never read as a substitution, and without contigs it goes.  Rows of other species or
    assemblies, without a chromosome or with other letters go.  Of equal variants the one with
    the least ``row`` (a column of the table; without it the least by all fields) stays.
    """
    rows = resolve_aliases(df, SOURCE_ALIASES)
    rows = rows.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in rows.columns])
    rows = rows.filter(tx.matches_species(F.col("species"), species))
    if assemblies:
        rows = rows.filter(any_of([F.contains(tx.normal_text(F.col("assembly")), tx.normal_text(F.lit(a))) for a in assemblies]))
    rows = rows.withColumn("chrom", F.trim(F.regexp_replace("chrom", "^(?:chr|Chr|CHR)", ""))).filter(~F.lower("chrom").isin("", "nan", "none", "?"))
    snp, indel = tx.hgvs_substitution(F.col("genomic")), tx.hgvs_indel(F.col("genomic"))
    # generators keep long expressions from being copied into every use of them
    rows = rows.select("*", F.explode(F.array(snp)).alias("__s"), tx.is_any_indel(F.col("genomic")).alias("__any"))
    rows = rows.select("*", F.explode(F.array(indel)).alias("__i"))
    anchored = F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("alt"))
    if contigs is not None:
        # the letters from the place before the event to its end: there the event begins at place 2
        rows = rows.withColumns({"__from": F.col("__i.start") - 2, "__to": F.least(F.col("__i.end"), F.col("__i.start") + longest + 1)})
        rows = fetch_spans(rows, contigs, chunk, "chrom", "__from", "__to")
        near = F.struct(F.lit(2).cast("long").alias("start"), (F.col("__i.end") - F.col("__from")).alias("end"), F.col("__i.kind").alias("kind"), F.col("__i.letters").alias("letters"), F.col("__i.ranged").alias("ranged"))
        rows = rows.select("*", F.explode(F.array(tx.anchored_indel(near, F.col("letters"), longest))).alias("__a"))
        anchored = F.struct((F.col("__a.pos") + F.col("__from")).alias("pos"), F.col("__a.ref").alias("ref"), F.col("__a.alt").alias("alt"))
    every = F.concat_ws(" | ", "genomic", "coding", "allele")
    loose = r"(?i)\b([ACGT])>([ACGT])\b"
    number = lambda c: F.regexp_extract(c, r"\b(\d{4,})\b", 1).try_cast("long")
    other = F.struct(F.coalesce(number("position"), number("genomic")).alias("pos"), F.upper(F.regexp_extract(every, loose, 1)).alias("ref"), F.upper(F.regexp_extract(every, loose, 2)).alias("alt"))
    found = F.when(F.col("__s.pos").isNotNull(), F.col("__s")).when(F.col("__any"), anchored).otherwise(other)
    known = lambda c: F.when(F.col(c) == "", F.lit("Unknown")).otherwise(F.col(c))
    described = (F.length("description") > 15) & ~F.lower("description").isin("nan", "none")
    rationale = F.when(described, F.col("description")).otherwise(F.concat(F.lit("["), known("gene"), F.lit("] "), known("phenotype"), F.lit(" — "), known("effect")))
    out = rows.select("*", F.explode(F.array(found)).alias("__v")).filter((F.col("__v.pos") > 0) & tx.valid_allele(F.col("__v.ref")) & tx.valid_allele(F.col("__v.alt")))
    kind = F.when((F.length("__v.ref") == 1) & (F.length("__v.alt") == 1), "snp").otherwise("indel")
    fields = [rationale.alias("rationale"), known("gene").alias("gene"), known("phenotype").alias("phenotype"), known("effect").alias("effect"), F.col("source_id"), kind.alias("variant_type")]
    picked = out.select("chrom", "__v.pos", "__v.ref", "__v.alt", F.struct(*fields).alias("f"), F.struct(F.col("row").try_cast("long").alias("n"), *fields).alias("o"))
    first = picked.groupBy("chrom", "pos", "ref", "alt").agg(F.min_by("f", "o").alias("f"))
    return first.select("chrom", "pos", "ref", "alt", "f.*")


def batch_errors(df: DataFrame, row: str, limit: int = 10, required: tuple[str, ...] = ("chrom", "pos", "ref", "alt")) -> DataFrame:
    """``row_no, error`` of an input table: missing columns, too many rows (both with row 0), alleles of other letters than ACGTN; empty if it is good.

    Only the first failing check is reported, as a reader of the message meets them.
    """
    spark = df.sparkSession
    say = lambda message: spark.createDataFrame([(0, message)], "row_no long, error string")
    missing = sorted(set(required) - set(df.columns))
    if missing:
        return say(f"Missing columns: {', '.join(missing)}")
    n = df.count()
    if n > limit:
        return say(f"Batch size limited to {limit} variants (received {n})")
    bad = any_of([~tx.valid_allele(F.trim(F.col(c)), allow_n=True) for c in ("ref", "alt")])
    return df.filter(bad).select(F.col(row).cast("long").alias("row_no"), F.lit("Invalid REF/ALT: use A/C/G/T/N only").alias("error"))


def point_lookup(df: DataFrame, chrom: str, pos: int, ref: str, alt: str) -> DataFrame:
    """The rows of one variant by its four keys."""
    return df.filter((F.col("chrom") == chrom) & (F.col("pos") == pos) & (F.col("ref") == ref) & (F.col("alt") == alt))


def drop_all_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value (no null, no NaN) in one of ``columns`` at least."""
    return df.filter(any_of([clean(F.col(c).cast("double")).isNotNull() for c in columns]))


# --- checks and reports -------------------------------------------------------------------------


def output_checks(df: DataFrame, families: dict[str, list[str]], other: list[str] = (), unit: tuple[str, ...] = ()) -> DataFrame:
    """``column, family, n, non_null, infinite, least, greatest, mean, problem`` of a result table.

    ``problem`` (null: none) is ``empty``, ``infinite``, ``all missing``, ``all zero`` (of the
    families' columns) or ``out of bounds`` (families in ``unit`` must lie in 0 to 1).
    """
    named = {c: f for f, columns in families.items() for c in columns} | {c: "other" for c in other}
    absent = [c for c in named if c not in df.columns]
    if absent:
        raise ValueError(f"missing outputs: {', '.join(absent)}")
    infinite = lambda x: x.isin(float("inf"), float("-inf"))
    v = F.col("value")
    g = unpivoted(df, [], list(named)).groupBy(F.col("name").alias("column")).agg(
        F.count("*").alias("n"), F.count("value").alias("non_null"), F.count_if(infinite(v)).alias("infinite"), F.min("value").alias("least"),
        F.max("value").alias("greatest"), F.avg("value").alias("mean"), F.count_if(v != 0).alias("__some"),
    )
    wanted = df.sparkSession.createDataFrame(list(named.items()), "column string, family string")
    out = F.broadcast(wanted).join(g, "column", "left").na.fill(0, ["n", "non_null", "infinite"])
    zero = (F.col("__some") == 0) & (F.col("family") != "other")
    beyond = F.col("family").isin(*unit) & ~(F.col("least").between(0, 1) & F.col("greatest").between(0, 1)) if unit else F.lit(False)
    problem = F.when(F.col("n") == 0, "empty").when(F.col("infinite") > 0, "infinite").when(F.col("non_null") == 0, "all missing").when(zero, "all zero").when(beyond, "out of bounds")
    return out.select("column", "family", "n", "non_null", "infinite", "least", "greatest", "mean", problem.alias("problem"))


def top_values(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """``attribute, place, value, n``: the most frequent values of each column (ties: least value), as many as asked for."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("attribute", "value").agg(F.count("*").alias("n"))
    wanted = reduce(lambda rest, kv: F.when(F.col("attribute") == kv[0], kv[1]).otherwise(rest), columns.items(), F.lit(0))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "value"))  # cut before the shuffle by a group limit
    most = max(columns.values())
    return counts.withColumn("place", place).filter(F.col("place") <= most).filter(F.col("place") <= wanted).select("attribute", "place", "value", "n")


def table_report(df: DataFrame, group: str | None, distinct: list[str], long_text: str, least_chars: int, position: str) -> DataFrame:
    """One row (for each group): ``n``, distinct values of columns, rows with a longer text than ``least_chars``, least and greatest position."""
    aggs = [F.count("*").alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct], F.count_if(F.length(long_text) > least_chars).alias("n_rich"), F.min(position).alias("least_position"), F.max(position).alias("greatest_position")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def family_extent(df: DataFrame, group: str, array: str) -> DataFrame:
    """``group, n, mean_abs, max_abs`` over all members of an array of all rows of a group (null groups are kept)."""
    m = F.transform(array, lambda x: F.abs(clean(x.cast("double"))))
    there = F.filter(m, lambda x: x.isNotNull())
    rows = df.select(group, F.aggregate(there, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(there).alias("c"), F.array_max(there).alias("t"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.try_divide(F.sum("s"), F.sum("c")).alias("mean_abs"), F.max("t").alias("max_abs"))


# --- interpretation -----------------------------------------------------------------------------

#: Magnitudes from which a difference is strong, moderate and subtle; limits of the sequence scores.
STRONG, MODERATE, WEAK = 0.2, 0.1, 0.05
LLR_LIMIT, KL_LIMIT = -1.5, 0.15


def strength(delta: Column) -> Column:
    """The word for a magnitude."""
    m = F.abs(delta)
    return F.when(m >= STRONG, "strong").when(m >= MODERATE, "moderate").when(m >= WEAK, "subtle").otherwise("weak")


def hypothesis(structure: Column, structure_delta: Column, context_delta: Column, llr: Column, kl: Column, labels: dict[str, str]) -> Column:
    """The primary hypothesis: the strongest structural track unless weak, a regulatory change, a sequence signal, or mixed evidence."""
    named = reduce(lambda rest, kv: F.when(structure == kv[0], kv[1]).otherwise(rest), labels.items(), F.lit("localized structural disruption"))
    return (
        F.when(F.abs(structure_delta) >= WEAK, named).when(F.abs(context_delta) >= MODERATE, "context-specific regulatory change")
        .when(clean(llr) <= LLR_LIMIT, "sequence-constraint signal").when(clean(kl) >= KL_LIMIT, "sequence-disruption signal").otherwise("mixed or weak evidence")
    )


def evidence(ranked: Column, most: int = 5) -> Column:
    """Lines for the strongest members (structs ``source, name, value, ref``), in order, joined by line ends; a fixed line if there are none."""
    line = lambda s: F.concat(s["source"], F.lit(" "), s["name"], F.lit(": "), strength(s["value"]), F.when(s["value"] > 0, " gain").otherwise(" loss"), F.format_string(" (%.3f to %.3f)", s["ref"], s["ref"] + s["value"]))
    lines = F.transform(F.slice(ranked, 1, most), line)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("weak outputs: a low-confidence summary only")


def review(top_delta: Column, llr: Column, least: float = 0.03, least_llr: float = 0.5) -> Column:
    """``manual_review`` where the strongest difference is missing, or weak while the sequence score is weak or missing; else ``pass``."""
    delta, score = clean(top_delta), clean(llr)
    weak = delta.isNull() | ((delta < least) & (score.isNull() | (F.abs(score) < least_llr)))
    return F.when(weak, "manual_review").otherwise("pass")


# --- model input and replies --------------------------------------------------------------------


def token_ids(sequence: Column, table: dict[str, int], length: int, pad: int, unknown: int = 0) -> Column:
    """Ids of single letters (without regard to case), cut or padded on the right to ``length``; letters outside the table are ``unknown``."""
    ids = F.create_map(*[F.lit(x) for k, v in sorted(table.items()) if len(k) == 1 for x in (k.upper(), v)])
    letters = F.transform(F.filter(F.split(F.left(F.coalesce(sequence, F.lit("")), F.lit(length)), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(ids, F.upper(c)), F.lit(unknown)))
    return F.concat(letters, F.array_repeat(F.lit(pad), F.lit(length) - F.size(letters)))


def reply_text(entry: Column) -> Column:
    """The text of a batch service's answer: candidates, content or text of the response, candidates of the body, else the body or the response itself."""
    paths = ["$.response.candidates[0].content.parts[0].text", "$.response.content.parts[0].text", "$.response.text", "$.body.candidates[0].content.parts[0].text", "$.body", "$.response"]
    return tx.first_json_field(entry, paths)
