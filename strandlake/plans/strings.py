"""Queries of text functions, notation, sources and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import text as tx
from strandlake.functions import vectors as vec
from strandlake.operators import intervals as iv
from strandlake.operators.tables import combined_rationale
from strandlake.plans.catalog import query, table
from strandlake.sources import tabular as tab
from strandlake.sources.documents import html_tables, svg_elements, table_with_header

#: A small made-up gene model: two overlapping coding transcripts on either strand and a lncRNA.
GENE_MODEL = [
    ("chr1", "gene", 1000, 2000, "+", "gene-A", None, None), ("chr1", "mRNA", 1000, 2000, "+", "rna-T1", "gene-A", "T1"),
    ("chr1", "exon", 1000, 1200, "+", "e1", "rna-T1", "T1"), ("chr1", "exon", 1400, 1600, "+", "e2", "rna-T1", "T1"), ("chr1", "exon", 1800, 2000, "+", "e3", "rna-T1", "T1"),
    ("chr1", "CDS", 1100, 1200, "+", "c1", "rna-T1", "T1"), ("chr1", "CDS", 1400, 1600, "+", "c1", "rna-T1", "T1"), ("chr1", "CDS", 1800, 1900, "+", "c1", "rna-T1", "T1"),
    ("chr1", "gene", 1195, 2600, "-", "gene-B", None, None), ("chr1", "mRNA", 1195, 2600, "-", "rna-T2", "gene-B", "T2"),
    ("chr1", "exon", 1195, 1399, "-", "f1", "rna-T2", "T2"), ("chr1", "exon", 2400, 2600, "-", "f2", "rna-T2", "T2"),
    ("chr1", "CDS", 1250, 1399, "-", "d1", "rna-T2", "T2"), ("chr1", "CDS", 2400, 2500, "-", "d1", "rna-T2", "T2"),
    ("chr2", "lncRNA", 500, 900, "+", "rna-L1", "gene-L", "L1"), ("chr2", "exon", 500, 600, "+", "g1", "rna-L1", "L1"),
]


def gene_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GENE_MODEL, "Chromosome string, Feature string, Start long, End long, Strand string, ID string, Parent string, transcript_id string")


_MODEL_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in GENE_MODEL)
_REGION_SQL = f"""
    WITH m(chrom, f, s, e, strand, id, parent, tid) AS (VALUES {_MODEL_SQL}),
    p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'chr2' ELSE 'chr1' END AS chrom, o_orderkey % 3000 + 1 AS pos FROM orders),
    h AS (SELECT o_orderkey, pos, m.* EXCLUDE (chrom) FROM p JOIN m ON m.chrom = p.chrom AND pos BETWEEN s AND e),
    x AS (
        SELECT parent, min(s) FILTER (WHERE f = 'exon') AS es, max(e) FILTER (WHERE f = 'exon') AS ee, min(s) FILTER (WHERE f = 'CDS') AS cs, max(e) FILTER (WHERE f = 'CDS') AS ce,
               list(s) FILTER (WHERE f = 'exon') AS ls, list(e) FILTER (WHERE f = 'exon') AS le FROM m WHERE parent IS NOT NULL GROUP BY parent
    ),
    part AS (SELECT o_orderkey, parent, bool_or(f = 'exon') AS ex, bool_or(f = 'CDS') AS cd FROM h WHERE f IN ('exon', 'CDS') GROUP BY ALL),
    t AS (
        SELECT h.o_orderkey, h.pos, h.f, h.strand = '+' AS plus, x.* EXCLUDE (parent), coalesce(ex, false) AS ex, coalesce(cd, false) AS cd
        FROM h LEFT JOIN x ON x.parent = h.id LEFT JOIN part ON part.o_orderkey = h.o_orderkey AND part.parent = h.id WHERE h.f IN ('mRNA', 'lncRNA')
    ),
    k AS (
        SELECT o_orderkey, bool_or(f = 'mRNA' AND ex) AS exon, bool_or(f = 'mRNA' AND ex AND cd) AS coding,
               bool_or(f = 'mRNA' AND ex AND cd AND CASE WHEN plus THEN pos - cs IN (0, 1, 2) ELSE ce - pos IN (0, 1, 2) END) AS start_codon,
               bool_or(f = 'mRNA' AND ex AND cd AND CASE WHEN plus THEN ce - pos IN (0, 1, 2) ELSE pos - cs IN (0, 1, 2) END) AS stop_codon,
               bool_or(f = 'mRNA' AND ex AND NOT cd AND CASE WHEN plus THEN pos < cs ELSE pos > ce END) AS utr5,
               bool_or(f = 'mRNA' AND ex AND NOT cd AND CASE WHEN plus THEN pos > ce ELSE pos < cs END) AS utr3,
               bool_or(f = 'mRNA' AND NOT ex AND NOT cd) AS intron,
               bool_or(f = 'mRNA' AND NOT ex AND NOT cd AND (list_contains(ls, pos + 1) OR list_contains(ls, pos + 2) OR list_contains(le, pos - 1) OR list_contains(le, pos - 2))) AS splice,
               bool_or(f = 'lncRNA' AND ex) AS lnc_exon
        FROM t GROUP BY o_orderkey
    ),
    g AS (SELECT o_orderkey, bool_or(f = 'gene') AS gene, bool_or(f = 'mRNA') AS mrna, bool_or(f = 'lncRNA') AS lnc FROM h GROUP BY o_orderkey),
    pr AS (
        SELECT o_orderkey, bool_or(f = 'mRNA') AS mp, bool_or(f = 'lncRNA') AS lp FROM p JOIN m ON m.chrom = p.chrom AND f IN ('mRNA', 'lncRNA')
            AND pos BETWEEN CASE strand WHEN '+' THEN s - 2000 ELSE e END AND CASE strand WHEN '+' THEN s ELSE e + 2000 END GROUP BY o_orderkey
    ),
    r AS (
        SELECT o_orderkey, list_filter([CASE WHEN gene THEN 'gene' END, CASE WHEN mrna THEN 'mRNA' END, CASE WHEN mp THEN 'mRNA_promoter' END, CASE WHEN exon THEN 'mRNA_exon' END, CASE WHEN coding THEN 'coding_sequence' END,
            CASE WHEN start_codon THEN 'start_codon' END, CASE WHEN stop_codon THEN 'stop_codon' END, CASE WHEN utr5 THEN 'five_prime_UTR' END, CASE WHEN utr3 THEN 'three_prime_UTR' END, CASE WHEN intron THEN 'mRNA_intron' END,
            CASE WHEN splice THEN 'mRNA_splice' END, CASE WHEN lnc THEN 'lncRNA' END, CASE WHEN lp THEN 'lncRNA_promoter' END, CASE WHEN lnc_exon THEN 'lncRNA_exon' END,
            CASE WHEN g.o_orderkey IS NULL AND pr.o_orderkey IS NULL THEN 'other' END], lambda q: q IS NOT NULL) AS flags
        FROM p LEFT JOIN g USING (o_orderkey) LEFT JOIN k USING (o_orderkey) LEFT JOIN pr USING (o_orderkey)
    )
    SELECT o_orderkey, array_to_string(flags, ',') AS region,
           CASE WHEN list_has_any(flags, ['coding_sequence', 'start_codon', 'stop_codon']) THEN CASE WHEN list_contains(flags, 'mRNA_splice') THEN 'CODING, SPLICE' ELSE 'CODING' END WHEN list_contains(flags, 'mRNA_splice') THEN 'SPLICE'
                WHEN list_contains(flags, 'five_prime_UTR') THEN 'UTR_5' WHEN list_contains(flags, 'three_prime_UTR') THEN 'UTR_3' WHEN list_contains(flags, 'mRNA_promoter') THEN 'PROMOTER'
                WHEN list_contains(flags, 'mRNA_intron') THEN 'INTRONIC' WHEN list_has_any(flags, ['gene', 'mRNA', 'mRNA_exon']) THEN 'GENIC_OTHER' ELSE 'OTHER' END AS region_class
    FROM r
"""


@query(_REGION_SQL)
def region_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order number as a place on one of two chromosomes of a made-up gene model."""
    v = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "chr2").otherwise("chr1").alias("chrom"), (F.col("o_orderkey") % 3000 + 1).alias("pos"))
    gff = gene_model(spark)
    return iv.annotate_regions(v, gff, iv.promoters(gff), width=500).select("o_orderkey", "region", "region_class")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->>'$.k')::BIGINT >= 50 THEN 'high' ELSE 'low' END AS level FROM events WHERE event_id % 7 <> 0")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as lines - some of them blank or broken - and read back."""
    from strandlake.storage import new_folder

    whole = F.to_json(F.struct("event_id", F.from_json("props", "k long").alias("props")))
    line = F.when(F.col("event_id") % 7 != 0, whole).when(F.col("event_id") % 14 == 0, F.lit("  ")).otherwise(F.left(whole, F.lit(9)))
    path = new_folder(spark, "lines")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    doc = tab.read_json_lines(spark, path, "event_id long, props struct<k: long>").filter("doc.event_id is not null")
    return doc.select("doc.event_id", "doc.props.k", F.when(F.col("doc.props.k") >= 50, "high").otherwise("low").alias("level"))


@query("""
    SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events
""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with the JSON plain, fenced or inside prose, by event number."""
    props = F.col("props")
    wrapped = F.when(F.col("event_id") % 3 == 0, props).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nBye {"))).otherwise(F.concat(F.lit("I think "), props, F.lit(" is right.")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(tx.repaired_json(wrapped), "$.k").try_cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) ELSE 'UNKNOWN' END AS kind FROM events")
def enum_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.one_of(F.upper("event_type"), ["CLICK", "VIEW"], "UNKNOWN").alias("kind"))


@query("""
    SELECT event_id, CASE event_type WHEN 'click' THEN 'CONCORDANT' ELSE 'PARSE_ERROR' END AS concordance, CASE event_type WHEN 'click' THEN 'STRONG' ELSE 'UNKNOWN' END AS signal_category, CASE event_type WHEN 'click' THEN 'splice' ELSE '' END AS primary_mechanism FROM events
""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.lit('```json\n{"concordance": "CONCORDANT", "signal_category": "STRONG", "primary_signal_mechanism": "splice"}\n```')
    reply = F.when(F.col("event_type") == "click", good).when(F.col("event_type") == "view", F.lit('{"concordance": "MAYBE"}')).otherwise(F.lit("no answer {"))
    out = table(spark, sf_dir, "events").select("event_id", tx.judge_answer(reply).alias("a"))
    return out.select("event_id", "a.concordance", "a.signal_category", "a.primary_mechanism")


_LABELS = "l AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'Splice_donor loss' WHEN 1 THEN 'benign missense' WHEN 2 THEN 'tolerated' WHEN 3 THEN 'premature stop|NMD' WHEN 4 THEN 'unclear' WHEN 5 THEN p_name WHEN 6 THEN 'CAGE expression' ELSE NULL END AS label FROM part)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_size") % 8
    label = F.when(c == 0, "Splice_donor loss").when(c == 1, "benign missense").when(c == 2, "tolerated").when(c == 3, "premature stop|NMD").when(c == 4, "unclear").when(c == 5, F.col("p_name")).when(c == 6, "CAGE expression")
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query(f"""
    WITH {_LABELS} SELECT p_partkey, CASE label WHEN 'Splice_donor loss' THEN 'Splicing' WHEN 'benign missense' THEN 'MLM / Sequence-constraint signal' WHEN 'tolerated' THEN 'Benign / Neutral / None' WHEN 'premature stop|NMD' THEN 'Nonsense / Truncation / NMD'
        WHEN 'unclear' THEN 'Uncertain / Unknown' WHEN 'CAGE expression' THEN 'Regulatory / Expression' ELSE CASE WHEN label IS NULL THEN 'Uncertain / Unknown' ELSE 'Other / Unclassified' END END AS bucket FROM l
""")
def mechanism_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("p_partkey", tx.mechanism_bucket(F.col("label")).alias("bucket"))


@query(f"""
    WITH {_LABELS} SELECT p_partkey, CASE WHEN label IS NULL THEN 'Uncertain / Unknown' WHEN regexp_matches(lower(replace(label, '_', ' ')), '\\bsplice\\b|\\bdonor\\b') THEN 'Splicing' WHEN regexp_matches(lower(label), '\\bnmd\\b') THEN 'Nonsense / Truncation / NMD'
        WHEN regexp_matches(lower(label), '\\bmissense\\b') THEN 'Missense / Protein function' ELSE 'Other / Unclassified' END AS bucket FROM l
""")
def rationale_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("p_partkey", tx.rationale_bucket(F.col("label")).alias("bucket"))


@query("""
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_partkey END AS pos, CASE p_size % 3 WHEN 0 THEN 'C' END AS ref, CASE p_size % 3 WHEN 0 THEN 'T' END AS alt, p_size % 3 = 1 AS is_indel FROM part
""")
def hgvs_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    c = F.col("p_size") % 3
    text = F.when(c == 0, F.concat(F.lit("NC_1.1:g."), key, F.lit("c>t"))).when(c == 1, F.concat(F.lit("g."), key, F.lit("_99999del"))).otherwise("c.12A>G")
    out = table(spark, sf_dir, "part").select("p_partkey", tx.hgvs_substitution(text).alias("s"), tx.is_any_indel(text).alias("is_indel"))
    return out.select("p_partkey", "s.pos", "s.ref", "s.alt", "is_indel")


@query("""
    WITH c AS (
        SELECT o_orderkey, o_orderkey % 900 + 2 AS s, o_orderkey % 900 + 2 + o_custkey % 6 AS e, o_orderkey % 6 AS kind, repeat('ACGT', 500) AS g FROM orders
    ), l AS (
        SELECT *, substr(g, s::INTEGER, (e - s + 1)::INTEGER) AS region, substr(g, (s - 1)::INTEGER, 1) AS before FROM c
    )
    SELECT o_orderkey, CASE kind WHEN 0 THEN s - 1 WHEN 1 THEN e WHEN 2 THEN s WHEN 3 THEN s END AS pos,
           CASE kind WHEN 0 THEN before || region WHEN 1 THEN right(region, 1) WHEN 2 THEN left(region, 1) WHEN 3 THEN region END AS ref,
           CASE kind WHEN 0 THEN before WHEN 1 THEN right(region, 1) || region WHEN 2 THEN left(region, 1) || 'GG' WHEN 3 THEN 'TT' END AS alt
    FROM l
""")
def hgvs_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, duplications, insertions, replacements, unreadable lengths and wrong letters on a periodic contig, one for each order."""
    s = (F.col("o_orderkey") % 900 + 2).cast("string")
    e = (F.col("o_orderkey") % 900 + 2 + F.col("o_custkey") % 6).cast("string")
    span = F.concat(F.lit("NC_1:g."), s, F.lit("_"), e)
    point = F.concat(F.lit("NC_1:g."), s, F.lit("_"), (F.col("o_orderkey") % 900 + 3).cast("string"))
    kind = F.col("o_orderkey") % 6
    hgvs = F.when(kind == 0, F.concat(span, F.lit("del"))).when(kind == 1, F.concat(span, F.lit("dup"))).when(kind == 2, F.concat(point, F.lit("insGG"))).when(kind == 3, F.concat(span, F.lit("delinsTT"))).when(kind == 4, F.concat(point, F.lit("insN[226]"))).otherwise(F.concat(span, F.lit("delAAAAAAAAA")))
    # generators keep each long expression from being copied into every use of it
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(hgvs)).alias("hgvs"))
    rows = rows.select("o_orderkey", F.explode(F.array(tx.hgvs_indel(F.col("hgvs")))).alias("i"))
    return rows.select("o_orderkey", F.explode(F.array(tx.anchored_indel(F.col("i"), F.lit("ACGT" * 500), 8))).alias("v")).select("o_orderkey", "v.pos", "v.ref", "v.alt")


@query("SELECT c_custkey, 'chr' || c_custkey AS with_prefix, c_custkey::VARCHAR AS bare, CASE WHEN c_nationkey % 2 = 0 THEN 'Pathogenic' ELSE 'Benign' END AS label FROM customer")
def name_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    mixed = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("chr"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return c.select("c_custkey", tx.chromosome_name(mixed).alias("with_prefix"), tx.chromosome_name(mixed, False).alias("bare"), tx.label_name((F.col("c_nationkey") % 2 == 0)).alias("label"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'SNP' WHEN '2-HIGH' THEN 'Deletion' WHEN '3-MEDIUM' THEN 'Insertion' WHEN '4-NOT SPECIFIED' THEN 'Indel' ELSE 'Indel' END AS kind FROM orders")
def variant_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    ref = F.when(p == "1-URGENT", "A").when(p == "2-HIGH", "ACG").when(p == "3-MEDIUM", "A").otherwise("AC")
    alt = F.when(p == "1-URGENT", "C").when(p == "2-HIGH", "A").when(p == "3-MEDIUM", "ATT").otherwise("GT")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.variant_kind(F.when(p == "5-LOW", "Indel"), ref, alt).alias("kind"))


@query("SELECT s_suppkey, 'chr' || s_nationkey || ':' || s_suppkey || ':A>G' AS key, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS number FROM supplier")
def keys_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal").cast("string")).otherwise("-")
    return s.select("s_suppkey", tx.variant_key(F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")), F.col("s_suppkey"), F.lit("A"), F.lit("G")).alias("key"), tx.number_or_null(text).alias("number"))


@query("""
    SELECT doc_id, 'Language: ' || lang || E'\\nText: ' || left(trim(text), 1500) || CASE WHEN length(trim(text)) > 1500 THEN '... [truncated]' ELSE '' END AS prompt FROM documents WHERE trim(text) <> ''
""")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.trim("text") != "")
    return d.select("doc_id", tx.prompt("Language: {lang}\nText: {text}", {"lang": F.col("lang"), "text": F.col("text")}).alias("prompt"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'DESC: ' || p_name ELSE '' END || CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN E'\\n' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'EXPL: ' || p_type ELSE '' END || CASE WHEN p_size % 2 <> 0 AND p_size % 3 <> 0 THEN 'No detailed rationale provided.' ELSE '' END AS rationale FROM part")
def combined_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", combined_rationale(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_type"))).alias("rationale"))


@query("SELECT doc_id, contains(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), 'the of') OR regexp_matches(lower(text), '(^|[^\\pL\\pN_])idiot([^\\pL\\pN_]|$)') AS found FROM documents")
def species_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.matches_species(F.col("text"), ["the of", "Idiot"]).alias("found"))


@query("SELECT p_partkey, substr('ACGTACGTAC', p_size % 5 + 1, 5) AS mer, translate(reverse(substr('ACGTACGTAC', p_size % 5 + 1, 5)), 'ACGT', 'TGCA') AS revcomp, left(left('ACGTACGTAC', p_size % 5) || 'TT' || substr('ACGTACGTAC', p_size % 5 + 2), 10) AS spliced FROM part")
def sequence_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.lit("ACGTACGTAC"), (F.col("p_size") % 5).cast("int")
    mer = vec.five_mer(s, c + 2)
    return table(spark, sf_dir, "part").select("p_partkey", mer.alias("mer"), vec.reverse_complement(mer).alias("revcomp"), vec.splice_allele(s, c, F.substring(s, c + 1, F.lit(1)), F.lit("TT")).alias("spliced"))


@query("""
    WITH b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS alt), p AS (SELECT n_nationkey + 1 AS pos, substr('ACGTNACGTACGTACGTACGTACGTAC', n_nationkey::INTEGER + 1, 1) AS ref FROM nation)
    SELECT 'chr1' AS chrom, pos::BIGINT AS pos, ref, alt FROM p, b WHERE ref <> alt AND ref <> 'N'
""")
def saturation_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").count()
    return tab.saturation_variants(spark, "chr1", 1, n, F.lit("ACGTNACGTACGTACGTACGTACGTAC"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 END::INTEGER AS stars FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def gold_star_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "practice guideline").when(p == "2-HIGH", "reviewed by expert panel").when(p == "3-MEDIUM", "criteria provided, multiple submitters, no conflicts").when(p == "4-NOT SPECIFIED", "criteria provided, single submitter").otherwise("no assertion provided")
    return table(spark, sf_dir, "orders").select("o_orderkey", tab.gold_stars(status).alias("stars")).filter("stars >= 2")


@query("""
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'H3K27ac' WHEN p_size % 4 = 1 THEN 'DNase' WHEN p_size % 4 = 2 THEN 'CAGE' END AS grp,
           CASE WHEN p_size % 4 = 3 THEN p_brand ELSE 'liver|' || p_type || '|' || CASE p_size % 4 WHEN 0 THEN 'Histone ChIP-seq|H3K27ac' WHEN 1 THEN 'DNase-seq' ELSE 'CAGE' END END AS description
    FROM part WHERE p_size % 4 <> 3
""")
def track_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_size") % 4
    meta = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_partkey").alias("idx"), F.col("p_partkey").cast("string").alias("file_id"), F.lit("liver").alias("tissue"), F.col("p_type").alias("biosample_type"),
        F.when(c == 0, "Histone ChIP-seq").when(c == 1, "DNase-seq").when(c == 2, "CAGE").otherwise("WGBS").alias("assay"), F.when(c == 0, "H3K27ac").alias("experiment_target"), F.when(c == 3, "other").otherwise("encode_v3").alias("dataset"),
    )
    marks = ["H3K27ac", "H3K4me3"]
    kept = tab.select_tracks(meta, marks)
    return kept.select("p_partkey", tab.track_group(F.col("assay"), F.col("experiment_target"), marks).alias("grp"), tab.track_description(F.col("file_id"), F.col("tissue"), F.col("biosample_type"), F.col("assay"), F.col("experiment_target")).alias("description"))


@query("""
    SELECT r_regionkey AS page_id, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey))::INTEGER AS row_no, ['Gene', 'Key'] AS header, [n_name, n_nationkey::VARCHAR] AS cells
    FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def html_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table of the nations of each region, behind another table: written as markup and read back."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit("</td><td> "), F.col("n_nationkey").cast("string"), F.lit("\n</td></tr>"))
    rows = n.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("x")))), lambda s: s["x"]), "").alias("rows"))
    page = F.concat(F.lit("<p>x</p><table><tr><th>other</th></tr></table><table><tr><th>Gene</th><th>Key</th></tr>"), "rows", F.lit("</table>"))
    pages = r.join(rows, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("page_id"), page.alias("html"))
    return table_with_header(html_tables(pages, "page_id", "html"), "page_id", ["gene", "phenotype"]).select("page_id", "row_no", "header", "cells")


@query("SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::INTEGER AS position, nullif(regexp_extract(x, '\\bhref=\"([^\"]*)\"', 1), '') AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\b[^>]*>')) AS x, generate_subscripts(regexp_extract_all(html, '<a\\b[^>]*>'), 1) AS o FROM pages)")
def markup_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg_elements(table(spark, sf_dir, "pages"), "page_id", "html", "a", ["href"])
