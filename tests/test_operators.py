"""Analytics operators on hand-computed fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import text as tx
from strandlake.functions import vectors as vec
from strandlake.functions.special import beta_inc, ks_two_sided, t_two_sided
from strandlake.operators import families as fam
from strandlake.operators import intervals as iv
from strandlake.operators import reference_z as rz
from strandlake.operators import relational as rel
from strandlake.operators import rules as rl
from strandlake.operators import sampling
from strandlake.operators import stats as st
from strandlake.operators import tables as tb
from strandlake.operators import topk
from strandlake.operators.scoring import HashScorer, judge_rows, score_rows


def one(df, column):
    return df.select(column.alias("x")).first().x


# --- families and reference scores ---------------------------------------------------------


def cohort(spark, rows=120):
    rng = random.Random(0)
    kinds = ["SNP", "Deletion", "Insertion", "Indel"]
    data = [(kinds[i % 4], i % 2 == 0, *[rng.gauss(0, 1) * (5 if i % 4 == 0 else 1) for _ in range(5)]) for i in range(rows)]
    return spark.createDataFrame(data, "variant_type string, benign boolean, D_BED_exon double, D_BED_ORF double, D_BW_a double, D_BW_b double, D_BW_c double")


def test_frozen_equals_recomputed_and_any_partitioning(spark):
    df = cohort(spark)
    names = fam.family_columns(df, "D_")
    assert names == ["D_BED_exon", "D_BED_ORF", "D_BW_a", "D_BW_b", "D_BW_c"]
    results = []
    for n in (1, 4, 17):
        rows = fam.to_array(df.repartition(n), names, "d")
        moments = rz.reference_moments(rows, "variant_type", "d", F.col("benign"))
        frozen = rz.thaw_background(rz.freeze_background(moments, "variant_type", names), "variant_type", names)
        for m in (moments, frozen):
            z = rz.apply_z(rows, "variant_type", "d", m)
            results.append(sorted(round(r.s, 9) for r in z.select(fam.vector_scores(F.col("z"), "z")[2].alias("s")).collect()))
    assert all(r == results[0] for r in results)


def test_few_reference_rows_take_the_pool(spark):
    rows = spark.createDataFrame([("a", True, [float(i)]) for i in range(20)] + [("b", True, [100.0])] + [("b", False, [50.0]), ("c", False, [None])], "g string, r boolean, x array<double>")
    m = {r.g: (r.mu[0], r.sigma[0]) for r in rz.reference_moments(rows, "g", "x", F.col("r")).collect()}
    pool = [*range(20), 100]
    mean = sum(pool) / 21
    assert m["a"][0] == pytest.approx(9.5)
    assert m["b"][0] == m["c"][0] == pytest.approx(mean)
    assert m["b"][1] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in pool) / 21))
    flat = spark.createDataFrame([("a", True, [2.0])] * 12, "g string, r boolean, x array<double>")
    assert rz.reference_moments(flat, "g", "x", F.col("r")).first().sigma == [1.0]


def test_duplicate_background_rows(spark):
    b = spark.createDataFrame([("indel", "t", 1.0, 2.0, 0), ("indel", "t", 3.0, 4.0, 1)], "variant_type string, delta_col string, mean double, std double, n int")
    assert rz.thaw_background(b, "v", ["t"], "last", "n").first().mu == [3.0]
    assert rz.thaw_background(b, "v", ["t"], "first", "n").first().mu == [1.0]


def test_vector_scores_with_missing_values(spark):
    df = spark.createDataFrame([([1.0, -3.0, None],), ([None, None],), ([],)], "x array<double>")
    got = df.select(*fam.vector_scores(F.col("x"), "s"), fam.top_k_mean(F.col("x"), 1).alias("top"), fam.top_k_mean(F.col("x"), 0).alias("none")).collect()
    assert got[0].s_mean == 2 and got[0].s_max == 3 and got[0].s_sum_log == pytest.approx(math.log(2) + math.log(4)) and got[0].top is None
    assert got[1].s_mean is None and got[1].s_max is None and got[1].s_sum_log == 0
    assert all(r.none == 0 for r in got)


def test_signed_extreme_takes_the_lowest_index(spark):
    df = spark.createDataFrame([([0.1, -0.5, 0.5],), ([None, None, None],)], "x array<double>")
    got = [r.x for r in df.select(fam.signed_extreme(F.col("x"), ["a", "b", "c"]).alias("x")).collect()]
    assert (got[0].value, got[0].idx, got[0].track) == (-0.5, 1, "b") and got[1].value is None and got[1].track is None


# --- relational ------------------------------------------------------------------------------


def test_dedup_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, n int")
    assert sorted(r.n for r in rel.keep_first(df, ["k"], [F.col("n").asc()]).collect()) == [1, 3, 4]
    assert sorted(r.n for r in rel.keep_last(df, ["k"], ["n"]).collect()) == [2, 3, 5]
    assert sorted(r.n for r in rel.drop_repeated(df, ["k"]).collect()) == [3]


def test_numbered_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    assert sorted((r.v, r.row_no) for r in rel.numbered(df, ["v"]).collect()) == [(i, i) for i in range(1000)]
    with pytest.raises(ValueError, match="no common positions"):
        rel.positional_join(df, df.limit(3), ["v"], ["v"])


def test_row_count_is_checked(spark):
    with pytest.raises(ValueError, match="2 before, 3 after"):
        rel.assert_same_rows(spark.range(2), spark.range(3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v double, p boolean")
    assert rel.keep_first(none, ["k"], [F.col("v")]).count() == 0
    assert st.rank_statistics(none, [], "v", F.col("p")).first().auc is None
    assert st.spearman(none.select(F.col("v").alias("a"), F.col("v").alias("b")), "a", "b").first().rho is None
    assert st.histogram(none, "v", 5).count() == 0
    assert st.gaussian_density(none, "v").count() == 0
    assert tb.value_counts(none, ["k"]).count() == 0


# --- intervals -------------------------------------------------------------------------------


def test_bins_equal_plain_range_join(spark):
    rng = random.Random(4)
    points = spark.createDataFrame([(i, rng.choice("ab"), rng.randint(0, 500)) for i in range(300)], "i int, c string, p int")
    spans = spark.createDataFrame([(j, rng.choice("ab"), s := rng.randint(0, 480), s + rng.choice([0, 3, 90, 400])) for j in range(80)], "j int, c string, a int, z int")
    plain = {(p.i, s.j) for p in points.collect() for s in spans.collect() if p.c == s.c and s.a <= p.p <= s.z}
    for width in (1, 17, 1000, None):
        assert {(r.i, r.j) for r in iv.points_in_intervals(points, spans, "c", "p", "a", "z", width=width).collect()} == plain
    pairs = [(x.j, y.j) for x in spans.collect() for y in spans.collect() if x.c == y.c and x.a <= y.z and y.a <= x.z]
    assert sorted((r.j, r.r_j) for r in iv.overlapping(spans, spans, "c", "a", "z", 50).collect()) == sorted(pairs)


def brute_region(model, chrom, pos):
    """Flags of one place, transcript by transcript."""
    flags, here = set(), [x for x in model if x[0] == chrom and x[2] <= pos <= x[3]]
    for x in here:
        if x[1] == "gene":
            flags.add("gene")
        if x[1] in ("mRNA", "lncRNA"):
            flags.add(x[1])
            parts = [y for y in here if y[6] == x[5]]
            exon, cds = any(y[1] == "exon" for y in parts), any(y[1] == "CDS" for y in parts)
            whole = [y for y in model if y[0] == chrom and y[6] == x[5]]
            if x[1] == "lncRNA":
                flags |= {"lncRNA_exon"} if exon else set()
                continue
            c = [(y[2], y[3]) for y in whole if y[1] == "CDS"]
            e = [(y[2], y[3]) for y in whole if y[1] == "exon"]
            low, high = min(a for a, _ in c), max(z for _, z in c)
            if exon:
                flags.add("mRNA_exon")
            if exon and cds:
                flags.add("coding_sequence")
                left, right = ("start_codon", "stop_codon") if x[4] == "+" else ("stop_codon", "start_codon")
                flags |= ({left} if low <= pos <= low + 2 else set()) | ({right} if high - 2 <= pos <= high else set())
            elif exon:
                left, right = ("five_prime_UTR", "three_prime_UTR") if x[4] == "+" else ("three_prime_UTR", "five_prime_UTR")
                flags |= ({left} if pos < low else set()) | ({right} if pos > high else set())
            else:
                flags.add("mRNA_intron")
                if any(pos in (a - 1, a - 2, z + 1, z + 2) for a, z in e):
                    flags.add("mRNA_splice")
    for x in model:
        if x[0] == chrom and x[1] in ("mRNA", "lncRNA"):
            a, z = (x[2] - 2000, x[2]) if x[4] == "+" else (x[3], x[3] + 2000)
            if a <= pos <= z:
                flags.add(f"{x[1]}_promoter")
    return ",".join(f for f in iv.FLAGS if f in flags) or "other"


def test_region_annotation_by_brute_force(spark):
    from strandlake.plans.strings import GENE_MODEL, gene_model

    places = [("chr1", p) for p in range(980, 2700)] + [("chr2", p) for p in (1, 499, 500, 600, 601, 900, 901, 5000)] + [("chr9", 5)]
    v = spark.createDataFrame(places, "chrom string, pos long")
    gff = gene_model(spark)
    for width in (100, 5000):
        got = {(r.chrom, r.pos): r for r in iv.annotate_regions(v, gff, iv.promoters(gff), width=width).collect()}
        assert {k: r.region for k, r in got.items()} == {k: brute_region(GENE_MODEL, *k) for k in places}
    classes = {r.region_class for r in got.values()}
    assert {"CODING", "CODING, SPLICE", "SPLICE", "UTR_5", "UTR_3", "PROMOTER", "INTRONIC", "OTHER"} <= classes
    assert got["chr1", 1196].transcript_set == ["T1", "T2"]


def test_attributes(spark):
    df = spark.createDataFrame([("ID=rna-X;Parent=gene-Y;Dbxref=GeneID:7,Ensembl:ENST1.2;gbkey=mRNA",)], "Attributes string")
    r = iv.parse_attributes(df).first()
    assert (r.ID, r.Parent, r.Ensembl, r.product) == ("rna-X", "gene-Y", "ENST1.2", None)


def test_shared_windows_restart(spark):
    df = spark.createDataFrame([("c", p, 1) for p in (1, 129, 257, 2, 1 + 128 * 9)], "chrom string, pos long, span long")
    got = {r.pos: (r.phase, r.window_no) for r in iv.shared_windows(df, ["chrom"], "pos", "span", 200).collect()}
    assert got == {1: (0, 0), 129: (0, 0), 257: (0, 1), 1 + 128 * 9: (0, 2), 2: (1, 0)}


# --- top-k ------------------------------------------------------------------------------------


def test_topk_ties_limits_and_rendering(spark):
    df = spark.createDataFrame([([0.2, -0.2, 0.01, -0.01, None, 0.5], [0.1, None, 0.3, 0.4, 0.5, 0.6]), ([None] * 6, [None] * 6)], "x array<double>, r array<double>")
    m = topk.members(F.col("x"), F.col("r"))
    names = [f"t{i}" for i in range(6)]
    got = df.select(topk.top_abs(m, 3).alias("a"), topk.top_gains(m, 5).alias("g"), topk.top_losses(m, 5).alias("l"), topk.render(topk.top_abs(m, 2), names).alias("s")).collect()
    assert [s.idx for s in got[0].a] == [5, 0, 1]
    assert [s.idx for s in got[0].g] == [5, 0] and [s.idx for s in got[0].l] == [1]  # exactly 0.01 is no gain
    assert got[0].s == "t5=0.500(ref=0.600); t0=0.200(ref=0.100)" and got[1].s == "None"
    back = df.select(topk.parse_rendered(topk.render(topk.top_abs(m, 3), names)).alias("p")).collect()
    assert [(x.name, x.value, x.ref) for x in back[0].p] == [("t5", 0.5, 0.6), ("t0", 0.2, 0.1), ("t1", -0.2, None)] and back[1].p == []


def test_window_extremes_without_change(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([-1.0, 2.0, 2.0],), ([None],)], "x array<double>")
    got = [r.x for r in df.select(topk.window_extremes(F.col("x"), -1).alias("x")).collect()]
    assert (got[0].gain, got[0].gain_pos, got[0].loss, got[0].loss_pos) == (0, None, 0, None)
    assert (got[1].gain, got[1].gain_pos, got[1].loss, got[1].loss_pos) == (2, 0, 1, -1)
    assert (got[2].gain_pos, got[2].loss_pos) == (None, None)


# --- rules ------------------------------------------------------------------------------------


def test_rule_provenance(spark):
    df = spark.createDataFrame([(0.2, -0.12, 0.0), (None, None, None), (0.01, 0.0, -0.1)], "D_BED_exon double, D_BED_intron double, LLR double")
    got = rl.assign(df, rl.SPLICE_RULES).collect()
    assert [r.NT_Mechanism for r in got] == ["SPLICE_INDUCED_EXONIZATION", rl.NONE, rl.NONE]
    assert [r.NT_Tier for r in got] == [1, -1, -1]
    assert got[0].NT_Rule == "exon>=0.15 [obs 0.200] AND intron<=-0.10 [obs -0.120]" and got[0].NT_Trigger == "exon=0.200"
    assert [r.NT_Scored for r in got] == [True, False, True]


def test_only_fired_primaries_are_listed(spark):
    df = spark.createDataFrame([(-0.3, 0.0), (-0.3, -0.25)], "D_BED_splice_donor double, D_BED_splice_acceptor double")
    got = [r.NT_Rule for r in rl.assign(df, rl.SPLICE_RULES).collect()]
    assert got == ["splice_donor<=-0.20 [obs -0.300]", "splice_donor<=-0.20 [obs -0.300] OR splice_acceptor<=-0.20 [obs -0.250]"]


def test_rule_tables_are_data(tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("variant_type,mechanism,tier,order_within_tier,condition_role,feature,direction,operator,threshold,description\nsnp,A,0,0,primary (OR),x,positive,>=,0.2,first\nsnp,B,1,0,primary (OR),x,positive,>=,0.3,second\nsnp,B,1,0,secondary (AND),y,any,,0.1,second\nindel,C,0,0,primary (OR),x,negative,<=,-1,third\n")
    rules = rl.read_rules(str(path), "snp")
    assert [r.name for r in rules] == ["A", "B"] and rl.pre_empted(rules) == {"B": "A"}
    assert rl.feature_usage(rules) == {"x": ["A", "B"], "y": ["B"]}


# --- statistics -------------------------------------------------------------------------------


def test_special_functions():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert t_two_sided(-12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert ks_two_sided(0.0, 10, 10) == 1 and 0 < ks_two_sided(0.5, 100, 100) < 1e-9


def test_rank_statistics_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (2.0, False), (0.5, False), (float("nan"), True), (None, True)], "v double, p boolean")
    r = st.rank_statistics(df, [], "v", F.col("p")).first()
    assert (r.n1, r.n0) == (2, 3) and r.auc == pytest.approx((1 + 0 + 0 + 1 + 0.5 + 0.5) / 6) and r.ks == pytest.approx(1 / 3)
    assert st.rank_statistics(df.filter("p"), [], "v", F.col("p")).first().auc is None
    assert st.spearman(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double"), "a", "b").first().rho is None


def test_bins_with_repeated_edges(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 1.0, 5.0, None)], "v double")
    got = [r.bin for r in st.quantile_bins(df, "v", ["a", "b", "c", "d"]).orderBy("v").collect()]
    assert got[0] is None and got[1:] == ["a"] * 5


# --- text and vectors ---------------------------------------------------------------------------


def test_indel_notation(spark):
    cases = {"g.5_7del": (4, "TACG", "T"), "g.5dup": (5, "A", "AA"), "g.4_5insGG": (4, "T", "TGG"), "g.5_6delinsTT": (5, "AC", "TT"), "g.5insN[226]": (None,) * 3, "g.900del": (None,) * 3, "g.5_7delACT": (None,) * 3, "g.5_7delACG": (4, "TACG", "T"), "g.4_7insA": (None,) * 3, "c.3del": (None,) * 3, "g.1del": (None,) * 3}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("v", tx.anchored_indel(tx.hgvs_indel(F.col("t")), F.lit("ACGTACGTACGTACGT"), 8))
    assert {r.t: (r.v.pos, r.v.ref, r.v.alt) for r in df.collect()} == cases


def test_json_repair(spark):
    cases = ['{"a": 1}', 'so:\n```json\n{"a": 2}\n```', 'x {"a": {"b": 3}} y', "```\nnot json\n``` {\"a\": 4}", '{"a": ', "", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", tx.repaired_json(F.col("t")).alias("j")).collect()}
    assert [got[i] is not None for i in range(7)] == [True, True, True, True, False, False, False]
    assert got[2] == '{"a": {"b": 3}}'


def test_buckets(spark):
    cases = {"benign missense": "MLM / Sequence-constraint signal", "silent": tx.BENIGN, None: tx.UNKNOWN, " ": tx.UNKNOWN, "Exon_skipping": "Splicing", "model favours variant, benign": "Model favors variant", "zzz": tx.OTHER}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("b", tx.mechanism_bucket(F.col("t")))
    assert {r.t: r.b for r in df.collect()} == cases


def test_names_and_formats(spark):
    df = spark.range(1)
    assert one(df, tx.chromosome_name(F.lit("chrmt"))) == "chrM" and one(df, tx.chromosome_name(F.lit("CHR7"), False)) == "7"
    assert one(df, tx.label_name(F.lit(True))) == "Pathogenic" and one(df, tx.label_name(F.lit("VUS"))) == "VUS"
    assert one(df, tx.number_or_null(F.lit("-"))) is None and one(df, tx.number_or_null(F.lit("1e-3"))) == 0.001
    assert one(df, tx.exact_format(F.lit(0.125), 2)) == "0.12"
    assert one(df, tx.short_name(F.lit("  a   b "))) == "a b" and one(df, tx.short_name(F.lit("nan"))) is None
    assert one(df, tx.matches_species(F.lit("the Sheepdog"), ["sheep"])) is False and one(df, tx.matches_species(F.lit("a  Ovis   ARIES x"), ["ovis aries"])) is True
    assert one(df, tx.prompt("a {x} b {y}", {"x": F.lit("q" * 2000), "y": F.lit(None)})) == f"a {'q' * 1500}... [truncated] b Not available"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [1000.0, 1001.0])], "a array<double>, b array<double>, l array<double>")
    assert one(df, vec.cosine_distance(F.col("a"), F.col("b"))) == pytest.approx(1)
    assert one(df, vec.l2_distance(F.col("a"), F.col("b"))) == pytest.approx(math.sqrt(2))
    assert sum(one(df, vec.softmax(F.col("l")))) == pytest.approx(1)
    assert one(df, vec.five_mer(F.lit("ACGTA"), F.lit(2))) == "ACGTA" and one(df, vec.five_mer(F.lit("ACGT"), F.lit(1))) == "NNNNN"
    assert one(df, vec.splice_allele(F.lit("ACGT"), F.lit(1), F.lit("C"), F.lit("TTT"))) == "ATTT" and one(df, vec.splice_allele(F.lit("ACGT"), F.lit(1), F.lit("G"), F.lit("T"))) is None


# --- scorers and samples --------------------------------------------------------------------------


def test_equal_inputs_are_scored_once(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "x")], "i int, t string, s string")
    got = {r.i: r.scores for r in score_rows(df, "t", "s", HashScorer).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None


def test_failing_clients_are_reported(spark):
    def client():
        def call(prompt):
            if "bad" in prompt:
                raise RuntimeError("no")
            return prompt.upper()

        return call

    got = {r.i: (r.reply, r.attempts, r.error) for r in judge_rows(spark.createDataFrame([(1, "ok"), (2, "bad")], "i int, p string"), "i", "p", client).collect()}
    assert got == {1: ("OK", 1, None), 2: (None, 3, "no")}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    picks = [{(r.g, r.id) for r in sampling.stratified(df.repartition(n), ["g"], "id", 7).collect()} for n in (1, 9)]
    assert picks[0] == picks[1] and len(picks[0]) == 21
