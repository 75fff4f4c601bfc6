"""Queries of the whole steps over variant tables; the SQL is written from the definitions, not from the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import text as tx
from strandlake.operators import families as fam
from strandlake.operators import relational as rel
from strandlake.operators import rules as rl
from strandlake.operators import stats as st
from strandlake.operators import variants as vr
from strandlake.plans.catalog import query, table


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_linestatus AS g, l_returnflag = 'N' AS r, l_discount, l_tax, l_quantity, l_extendedprice FROM lineitem),
    m AS (
        SELECT g, avg(l_discount) FILTER (r) AS m1, stddev_pop(l_discount) FILTER (r) AS s1, avg(l_tax) FILTER (r) AS m2, stddev_pop(l_tax) FILTER (r) AS s2,
               avg(l_quantity) FILTER (r) AS m3, stddev_pop(l_quantity) FILTER (r) AS s3, avg(l_extendedprice) FILTER (r) AS m4, stddev_pop(l_extendedprice) FILTER (r) AS s4, count(*) FILTER (r) AS n
        FROM b GROUP BY g
    ), p AS (
        SELECT avg(l_discount) AS m1, stddev_pop(l_discount) AS s1, avg(l_tax) AS m2, stddev_pop(l_tax) AS s2, avg(l_quantity) AS m3, stddev_pop(l_quantity) AS s3, avg(l_extendedprice) AS m4, stddev_pop(l_extendedprice) AS s4 FROM b WHERE r
    ), k AS (
        SELECT g, CASE WHEN n < 10 THEN p.m1 ELSE m.m1 END AS m1, CASE WHEN n < 10 THEN p.s1 ELSE m.s1 END AS s1, CASE WHEN n < 10 THEN p.m2 ELSE m.m2 END AS m2, CASE WHEN n < 10 THEN p.s2 ELSE m.s2 END AS s2,
               CASE WHEN n < 10 THEN p.m3 ELSE m.m3 END AS m3, CASE WHEN n < 10 THEN p.s3 ELSE m.s3 END AS s3, CASE WHEN n < 10 THEN p.m4 ELSE m.m4 END AS m4, CASE WHEN n < 10 THEN p.s4 ELSE m.s4 END AS s4
        FROM m, p
    ), z AS (
        SELECT b.*, abs((l_discount - m1) / s1) AS z1, abs((l_tax - m2) / s2) AS z2, abs((l_quantity - m3) / s3) AS z3, abs((l_extendedprice - m4) / s4) AS z4 FROM b JOIN k USING (g)
    )
    SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS BED_mean_abs, round(greatest(l_discount, l_tax), 6) AS BED_top1_mean, round(ln(1 + z3) + ln(1 + z4), 6) AS BW_z_sum_log, round((z3 + z4) / 2, 6) AS BW_z_top2_mean,
           round(greatest(z1, z2, z3, z4), 6) AS Global_z_max_abs, round(ln(1 + z1) + ln(1 + z2) + ln(1 + z3) + ln(1 + z4), 6) AS Global_z_sum_log,
           round(0.5 * (l_discount + l_tax) / 2 + 0.5 * (z3 + z4) / 2, 6) AS Composite_mean, round(0.5 * greatest(l_discount, l_tax) + 0.5 * (z3 + z4) / 2, 6) AS Composite_top
    FROM z
""")
def impact_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole impact frame of two families."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    rows = fam.to_array(fam.to_array(rows, ["l_discount", "l_tax"], "bed"), ["l_quantity", "l_extendedprice"], "bw")
    out = vr.impact_frame(rows, "l_linestatus", "bed", "bw", F.col("l_returnflag") == "N", bed_k=1, bw_k=2)
    return _rounded(out.select("l_orderkey", "l_linenumber", "BED_mean_abs", "BED_top1_mean", "BW_z_sum_log", "BW_z_top2_mean", "Global_z_max_abs", "Global_z_sum_log", "Composite_mean", "Composite_top"))


@query("""
    WITH e AS (SELECT vec_id, ['SNP', 'Deletion', 'Insertion', 'Indel'][vec_id % 4 + 1] AS kind, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings),
    b AS (SELECT CASE WHEN kind IN ('SNP', 'Deletion') THEN lower(kind) ELSE 'indel' END AS t, idx, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE idx % 3 <> 0 GROUP BY ALL)
    SELECT vec_id, round(sum(ln(1 + abs((v - m) / s))), 6) AS burden FROM e JOIN b USING (idx) WHERE b.t = CASE WHEN kind IN ('SNP', 'Deletion') THEN lower(kind) ELSE 'indel' END GROUP BY vec_id
""")
def burden_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden against the background of each row's kind; insertions have none of their own, a third of the tracks none at all."""
    e = table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("SNP", "Deletion", "Insertion", "Indel")]), (F.col("vec_id") % 4 + 1).cast("int"))
    long = e.select("vec_id", kind.alias("kind"), F.posexplode("embedding").alias("idx", "v")).select("vec_id", "kind", F.col("idx").cast("string").alias("track"), F.col("v").cast("double").alias("value"))
    own = F.when(F.col("kind").isin("SNP", "Deletion"), F.lower("kind")).otherwise("indel")
    background = long.filter("cast(track as int) % 3 <> 0").groupBy(own.alias("variant_type"), F.col("track").alias("delta_col")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return _rounded(vr.burden_by_kind(long, "vec_id", "kind", background))


@query("""
    WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings),
    a AS (SELECT *, CASE WHEN idx < 16 THEN 'BED' ELSE 'BW' END AS f, 't' || idx AS name FROM e),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY vec_id, f ORDER BY abs(v) DESC, idx) AS ra, row_number() OVER (PARTITION BY vec_id, f ORDER BY v DESC, idx) AS rg, row_number() OVER (PARTITION BY vec_id, f ORDER BY v, idx) AS rl FROM a
    )
    SELECT vec_id, round(max(abs(v)) FILTER (f = 'BED'), 6) AS BED_Max_Abs_Delta, count(*) FILTER (f = 'BW' AND abs(v) > 0.3)::INTEGER AS BW_N_Strong_Signals,
           string_agg(name || '=' || printf('%.3f', v) || '(ref=' || printf('%.3f', 0.5) || ')', '; ' ORDER BY ra) FILTER (f = 'BED' AND ra <= 5) AS BED_Top_Abs,
           coalesce(string_agg(name || '=' || printf('%.3f', v), '; ' ORDER BY rg) FILTER (f = 'BW' AND rg <= 5 AND v > 0.01), 'None') AS BW_Top_Gains,
           coalesce(string_agg(name || '=' || printf('%.3f', v), '; ' ORDER BY rl) FILTER (f = 'BW' AND rl <= 5 AND v < -0.01), 'None') AS BW_Top_Losses,
           CASE WHEN vec_id % 2 = 0 THEN 'LLR=' || printf('%.3f', any_value(v) FILTER (idx = 0)) || '; ' ELSE '' END || 'LogProb_Delta=' || printf('%.1f', any_value(v) FILTER (idx = 1)) AS MLM_Summary
    FROM r GROUP BY vec_id
""")
def signal_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings that judges are shown."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(x, 1, 16).alias("bed"), F.array_repeat(F.lit(0.5), 16).alias("ref"), F.slice(x, 17, 1 << 20).alias("bw"), F.when(F.col("vec_id") % 2 == 0, x[0]).alias("LLR"), x[1].alias("MLM_logprob_delta"))
    out = vr.extract_signals(rows, "vec_id", {"BED": ("bed", "ref", [f"t{i}" for i in range(16)]), "BW": ("bw", None, [f"t{i}" for i in range(16, 64)])})
    return _rounded(out.select("vec_id", "BED_Max_Abs_Delta", "BW_N_Strong_Signals", "BED_Top_Abs", "BW_Top_Gains", "BW_Top_Losses", "MLM_Summary"))


@query("""
    WITH s AS (
        SELECT c_custkey AS k, c_nationkey % 5 AS chrom, c_custkey % 5 AS kind, c_custkey % 700 + 1001 AS p, c_custkey % 4 AS d, 'ACGT' AS g FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 11 <> 0
    ), v AS (
        SELECT k, chrom, CASE kind WHEN 0 THEN p WHEN 1 THEN p - 1 WHEN 2 THEN p END AS pos,
               CASE kind WHEN 0 THEN 'A' WHEN 1 THEN array_to_string(list_transform(range(p - 1, p + d + 1), lambda i: substr(g, ((i - 1) % 4 + 1)::INTEGER, 1)), '') WHEN 2 THEN 'C' END AS ref,
               CASE kind WHEN 0 THEN 'G' WHEN 1 THEN substr(g, ((p - 2) % 4 + 1)::INTEGER, 1) WHEN 2 THEN 'T' END AS alt
        FROM s WHERE kind < 3
    ), f AS (SELECT chrom, pos, ref, alt, min(k) AS k FROM v GROUP BY ALL)
    SELECT chrom::VARCHAR AS chrom, pos, ref, alt, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' ELSE 'indel' END AS variant_type, 'c' || k AS gene,
           CASE WHEN k % 2 = 0 THEN 'a long description of ' || k ELSE '[c' || k || '] Unknown — Unknown' END AS rationale
    FROM f
""")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows of one species made from customers: substitutions, deletions, loose notations, unreadable indels and empty ones."""
    c = table(spark, sf_dir, "customer")
    k, kind, p = F.col("c_custkey"), F.col("c_custkey") % 5, (F.col("c_custkey") % 700 + 1001).cast("string")
    end = (F.col("c_custkey") % 700 + 1001 + F.col("c_custkey") % 4).cast("string")
    genomic = F.when(kind == 0, F.concat(F.lit("g."), p, F.lit("A>G"))).when(kind == 1, F.concat(F.lit("g."), p, F.lit("_"), end, F.lit("del"))).when(kind == 3, F.concat(F.lit("g."), p, F.lit("insN[40] A>G")))
    rows = c.select(
        k.alias("Row"), F.when(F.col("c_mktsegment") == "BUILDING", "Ovis aries").otherwise("domestic  Cat").alias(" Species Name"), F.concat(F.lit("CHR"), (F.col("c_nationkey") % 5).cast("string")).alias("Chr"),
        genomic.alias("g. or m."), F.when(kind == 2, F.lit("c.? C>T")).alias("c. or n."), p.alias("Position"), F.concat(F.lit("c"), k.cast("string")).alias("Gene Symbol"),
        F.when(k % 2 == 0, F.concat(F.lit("a long description of "), k.cast("string"))).alias("Description"), F.when(k % 11 == 0, "old build").otherwise("Fca  126").alias("Assembly"),
    )
    contigs = spark.range(5).select(F.col("id").cast("string").alias("chrom"), F.lit(0).alias("chunk_idx"), F.lit("ACGT" * 1000).alias("seq"))
    out = vr.parse_source_rows(rows, ["cat"], ["fca 126"], contigs, chunk=4000)
    return out.select("chrom", "pos", "ref", "alt", "variant_type", "gene", "rationale")


@query("""
    WITH u AS (
        SELECT unnest(['l_discount', 'l_tax', 'l_quantity', 'zero', 'gone', 'broken']) AS "column", unnest(['unit', 'unit', 'unit', 'other', 'free', 'free']) AS family,
               unnest([l_discount, l_tax, l_quantity, 0, NULL, CASE WHEN l_linenumber = 1 THEN 'inf'::DOUBLE ELSE 1 END]) AS v FROM lineitem
    )
    SELECT "column", family, count(*) AS n, count(v) AS non_null, count(*) FILTER (isinf(v)) AS infinite, min(v) AS least, max(v) AS greatest,
           CASE "column" WHEN 'l_quantity' THEN 'out of bounds' WHEN 'gone' THEN 'all missing' WHEN 'broken' THEN 'infinite' END AS problem
    FROM u GROUP BY "column", family
""")
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract checks of a result table: bounds, missing, infinite and zero columns."""
    nothing, broken = F.when(F.col("l_tax") > 1, F.col("l_tax")), F.when(F.col("l_linenumber") == 1, float("inf")).otherwise(1.0)
    rows = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax", "l_quantity", F.lit(0.0).alias("zero"), nothing.alias("gone"), broken.alias("broken"))
    return vr.output_checks(rows, {"unit": ["l_discount", "l_tax", "l_quantity"], "free": ["gone", "broken"]}, ["zero"], unit=("unit",)).drop("mean")


@query("SELECT n_nationkey AS row_no, 'Invalid REF/ALT: use A/C/G/T/N only' AS error FROM nation WHERE left(n_name, 1) NOT IN ('A', 'C', 'G', 'T', 'N')")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an input table with unreadable alleles."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit("1").alias("chrom"), F.lit(5).alias("pos"), F.left("n_name", F.lit(1)).alias("ref"), F.lit(" t ").alias("alt"))
    return vr.batch_errors(n, "n_nationkey", limit=100)


@query("""
    WITH l AS (SELECT p_partkey, list_transform(range(1, 17), lambda i: substr(p_type, i::INTEGER, 1)) AS x FROM part)
    SELECT p_partkey, list_transform(x, lambda c: CASE WHEN c = '' THEN 9 ELSE coalesce(list_position(['A', 'C', 'G', 'T', 'N'], upper(c)), 0) END::INTEGER) AS ids FROM l
""")
def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of letters, cut or padded to sixteen."""
    return table(spark, sf_dir, "part").select("p_partkey", vr.token_ids(F.col("p_type"), {"A": 1, "c": 2, "G": 3, "T": 4, "N": 5, "<pad>": 9}, 16, 9).alias("ids"))


_PUBLISHED = rl.published_rules("indel")
_FEATURES = sorted({c.feature for r in _PUBLISHED for c in (*r.primary, *r.secondary)})


def _sql_rules() -> str:
    """The published table as SQL over the features in ``x``: one boolean for each rule, in order."""
    def one(c: rl.Condition) -> str:
        v = f"x[{_FEATURES.index(c.feature) + 1}]"
        return {"negative": f"{v} <= {c.threshold}", "positive": f"{v} >= {c.threshold}", "any": f"abs({v}) >= {abs(c.threshold)}"}[c.direction]

    return ", ".join("(" + " OR ".join(map(one, r.primary)) + ")" + "".join(f" AND {one(c)}" for c in r.secondary) for r in _PUBLISHED)


@query(f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: 3 * v::DOUBLE) AS x FROM embeddings), f AS (SELECT vec_id, [{_sql_rules()}] AS fired FROM e),
    p AS (SELECT vec_id, nullif(list_position(fired, true), 0) AS spot, len(list_filter(fired, lambda b: b)) AS n FROM f)
    SELECT vec_id, coalesce(list_extract({[r.name for r in _PUBLISHED]}, spot), 'UNCERTAIN_SIGNIFICANCE') AS NT_Mechanism, coalesce(list_extract({[r.tier for r in _PUBLISHED]}, spot), -1)::INTEGER AS NT_Tier, n::INTEGER AS NT_Mechanism_Count FROM p
""")
def published_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 38 rules of the published table on vectors read as features."""
    x = [(3 * F.col("embedding")[i].cast("double")).alias(f) for i, f in enumerate(_FEATURES)]
    return rl.assign(table(spark, sf_dir, "embeddings").select("vec_id", *x), _PUBLISHED).select("vec_id", "NT_Mechanism", "NT_Tier", "NT_Mechanism_Count")


@query("""
    WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings),
    t AS (SELECT vec_id, arg_max(idx, (abs(v), -idx)) FILTER (idx < 16) AS s, max(abs(v)) FILTER (idx < 16) AS sm, max(abs(v)) FILTER (idx >= 16) AS cm, max(abs(v)) AS m, any_value(v) FILTER (idx = 0) * 10 AS llr, abs(any_value(v) FILTER (idx = 1)) AS kl FROM e GROUP BY vec_id)
    SELECT vec_id, CASE WHEN m >= 0.2 THEN 'strong' WHEN m >= 0.1 THEN 'moderate' WHEN m >= 0.05 THEN 'subtle' ELSE 'weak' END AS strength,
           CASE WHEN sm >= 0.05 THEN CASE s WHEN 0 THEN 'splice disruption' WHEN 1 THEN 'coding disruption' ELSE 'localized structural disruption' END WHEN cm >= 0.1 THEN 'context-specific regulatory change'
                WHEN llr <= -1.5 THEN 'sequence-constraint signal' WHEN kl >= 0.15 THEN 'sequence-disruption signal' ELSE 'mixed or weak evidence' END AS hypothesis,
           CASE WHEN m < 0.3 AND abs(llr) < 0.5 THEN 'manual_review' ELSE 'pass' END AS review
    FROM t
""")
def signal_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", fam.signed_extreme(F.slice(x, 1, 16), [f"t{i}" for i in range(16)]).alias("s"), fam.signed_extreme(F.slice(x, 17, 1 << 20)).alias("c"), fam.signed_extreme(x).alias("a"), (x[0] * 10).alias("llr"), F.abs(x[1]).alias("kl"))
    said = vr.hypothesis(F.col("s.track"), F.col("s.value"), F.col("c.value"), F.col("llr"), F.col("kl"), {"t0": "splice disruption", "t1": "coding disruption"})
    return rows.select("vec_id", vr.strength(F.col("a.value")).alias("strength"), said.alias("hypothesis"), vr.review(F.abs("a.value"), F.col("llr"), least=0.3).alias("review"))


@query("""
    WITH u AS (SELECT 'event_type' AS attribute, event_type AS value FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events), c AS (SELECT attribute, value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL),
    r AS (SELECT attribute, value, n, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value) AS place FROM c)
    SELECT attribute, place::INTEGER AS place, value, n FROM r WHERE place <= CASE attribute WHEN 'event_type' THEN 2 ELSE 8 END
""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report of the most frequent values of attributes."""
    return vr.top_values(table(spark, sf_dir, "events"), {"event_type": 2, "user_id": 8})


@query("""
    SELECT lang, count(*) AS n, count(DISTINCT source) AS n_source, count(*) FILTER (WHERE length(text) > 500) AS n_rich, min(doc_id) AS least_position, max(doc_id) AS greatest_position FROM documents GROUP BY lang
""")
def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vr.table_report(table(spark, sf_dir, "documents"), "lang", ["source"], "text", 500, "doc_id")


@query("""
    WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)
    SELECT label, count(DISTINCT vec_id) AS n, round(avg(abs(v)), 6) AS mean_abs, round(max(abs(v)), 6) AS max_abs FROM e GROUP BY label
""")
def family_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and greatest magnitude of a family by group."""
    return _rounded(vr.family_extent(table(spark, sf_dir, "embeddings"), "label", "embedding"))


@query("""
    WITH j AS (SELECT (quality = 1)::INT::VARCHAR AS a, (n_chars > 600)::INT::VARCHAR AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
    t AS (SELECT count(*) AS n, avg((a = b)::INT) AS po, avg((a = '1')::INT) AS pa, avg((b = '1')::INT) AS pb FROM j)
    SELECT n, round(po, 6) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM t
""")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two labels."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("quality is not null")
    return _rounded(st.cohens_kappa(d.select((F.col("quality") == 1).cast("int").alias("a"), (F.col("n_chars") > 600).cast("int").alias("b")), "a", "b"))


@query("""
    WITH t AS (SELECT l_discount AS v, count(*) AS k, sum(count(*)) OVER (ORDER BY l_discount) AS upto, sum(count(*)) OVER () AS n FROM lineitem GROUP BY l_discount)
    SELECT l_orderkey, l_linenumber, ['a', 'b', 'c', 'd'][least(ceil((upto - (k - 1) / 2.0::DOUBLE) / n * 4), 4)::INTEGER] AS bin, list_position(['d', 'c', 'b', 'a'], ['a', 'b', 'c', 'd'][least(ceil((upto - (k - 1) / 2.0::DOUBLE) / n * 4), 4)::INTEGER])::BIGINT - 1 AS level
    FROM lineitem JOIN t ON l_discount = v
""")
def percent_rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a column with many ties, and their ordinal codes."""
    out = st.percent_rank_bins(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount", list("abcd"))
    return out.select("l_orderkey", "l_linenumber", "bin", st.ordinal(F.col("bin"), list("dcba")).alias("level"))


@query("SELECT a.doc_id, a.lang, coalesce(b.lang, 'none') AS lang_judge, 'x' AS extra FROM documents a LEFT JOIN (SELECT doc_id, 'q' || quality AS lang FROM labels) b USING (doc_id)")
def suffixed_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that keeps both columns of a name, and one to a table that does not exist."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    q = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    out = rel.suffixed_join(d, q, ["doc_id"], "_judge", {"lang_judge": F.lit("none")})
    return rel.optional_join(out, lambda: table(spark, sf_dir, "no_such_table"), ["doc_id"], "extra", F.lit("x"))


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN text ELSE '{"x":1}' END AS reply FROM conversations
""")
def reply_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies taken out of the envelopes of a batch service."""
    c = table(spark, sf_dir, "conversations")
    part = F.struct(F.array(F.struct(F.col("text"))).alias("parts"))
    kind = F.col("turn") % 3
    entry = F.when(kind == 0, F.to_json(F.struct(F.struct(F.array(F.struct(part.alias("content"))).alias("candidates")).alias("response")))).when(kind == 1, F.to_json(F.struct(F.struct(F.col("text")).alias("response")))).otherwise(F.lit('{"body": {"x": 1}}'))
    return c.select("conv_id", "turn", vr.reply_text(entry).alias("reply"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 AND n_name IS NOT NULL UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant by its keys, and rows with any value in some columns."""
    n = table(spark, sf_dir, "nation")
    keyed = n.select("n_nationkey", "n_name", F.lit("1").alias("chrom"), F.col("n_nationkey").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    some = n.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") == 2, 1.0).alias("a"), F.lit(float("nan")).alias("b"))
    return vr.point_lookup(keyed, "1", 7, "A", "C").select("n_nationkey", "n_name").unionByName(vr.drop_all_missing(some, ["a", "b"]).select("n_nationkey", "n_name"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN printf('%.2f', s_acctbal) ELSE 'N/A' END AS shown FROM supplier")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, missing ones named."""
    v = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(tx.exact_format(v, 2), F.lit("N/A")).alias("shown"))
