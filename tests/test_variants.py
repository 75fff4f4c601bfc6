"""Whole steps over variant tables, and the places where rows were once lost or doubled."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import relational as rel
from strandlake.operators import rules as rl
from strandlake.operators import stats as st
from strandlake.operators import topk
from strandlake.operators import variants as vr
from strandlake.operators.running import exact_quantiles, running_sums
from strandlake.sources import tabular as tab
from strandlake.storage import folder_bytes, is_small, stage


def test_numbering_of_many_wide_rows(spark):
    """400,000 rows of 512 bytes over many partitions, with ties and equal rows: every number once, in order."""
    rows = spark.range(400_000, numPartitions=16).select((F.col("id") * 7919 % 1000).alias("v"), F.repeat(F.lit("x"), 512).alias("w"), (F.col("id") % 90_000).alias("u"))
    for partitions, size in (("8", None), ("32", "4m")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        if size:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        try:
            got = rel.numbered(rows, ["v"])
            n, kinds, low, high, ordered = got.agg(F.count("*"), F.count_distinct("row_no"), F.min("row_no"), F.max("row_no"), F.count_if(F.floor(F.col("row_no") / 400) == F.col("v"))).first()
            assert (n, kinds, low, high, ordered) == (400_000, 400_000, 0, 399_999, 400_000)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = rel.keep_first(df, ["k"], [F.col("id").asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_nan_fires_no_rule_and_is_no_signal(spark):
    df = spark.createDataFrame([(float("nan"), float("nan")), (0.3, float("nan")), (None, None)], "a double, b double")
    rules = [rl.Rule("X", 0, (rl.Condition("a", "positive", 0.2), rl.Condition("b", "any", 0.1)), (), "x")]
    assert [r.NT_Mechanism for r in rl.assign(df, rules).collect()] == [rl.NONE, "X", rl.NONE]
    assert [r.NT_Scored for r in rl.assign(df, rules).collect()] == [False, True, False]
    top = df.select(topk.top_gains(topk.members(F.array("a", "b")), 5).alias("t")).collect()
    assert [[s.value for s in r.t] for r in top] == [[], [0.3], []]


def test_late_columns_of_repeated_and_null_keys(spark, tmp_path):
    rows = [(1, "a", 10.0, "p"), (1, "b", 20.0, "q"), (None, "a", 30.0, "r"), (2, "b", 40.0, "s")]
    spark.createDataFrame(rows, "k int, f string, w double, x string").repartition(2).write.parquet(str(tmp_path / "t"))
    for batch in (None, 1):
        got = tab.late_columns(spark, str(tmp_path / "t"), ["k"], ["f"], F.col("f").isin("a", "b") & (F.coalesce("k", F.lit(1)) == 1), ["w", "x"], batch)
        assert sorted((r.k is None, r.w, r.x) for r in got.collect()) == [(False, 10.0, "p"), (False, 20.0, "q"), (True, 30.0, "r")]
    assert 0 < tab.sample_scan(spark, str(tmp_path / "t")).count() <= 4


def test_banner_lines_in_the_data_stay(spark, tmp_path):
    (tmp_path / "s.txt").write_text("junk\n#a\tb\njunk\n1\t2\n#a\tb\n")
    assert [(r.a, r.b) for r in tab.read_after_banner(spark, str(tmp_path / "s.txt"), 1).collect()] == [("junk", None), ("1", "2"), ("#a", "b")]
    (tmp_path / "j").write_text("\n{}\nx\n")
    assert [r.line_no for r in tab.read_json_lines(spark, str(tmp_path / "j"), "a int").orderBy("line_no").collect()] == [2, 3]


def test_running_sums_and_quantiles_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([rng.random(), 0.5])) for _ in range(500)] + [("c", 1.0), (None, 2.0), (None, 4.0), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.q) for r in exact_quantiles(df, ["k"], "v", [0, 0.25, 0.5, 1]).collect()}
    for k in ("a", "b", "c", None):
        x = sorted(v for g, v in rows if g == k and v is not None and v == v)
        at = lambda s: x[int(s * (len(x) - 1))] + (x[min(len(x) - 1, int(s * (len(x) - 1)) + 1)] - x[int(s * (len(x) - 1))]) * (s * (len(x) - 1) % 1)  # noqa: B023, E731
        assert got[k][0] == len(x) and got[k][1] == pytest.approx([at(s) for s in (0, 0.25, 0.5, 1)])
    counts = df.dropna().groupBy("k", "v").agg(F.count("*").alias("c"))
    for r in running_sums(counts, ["k"], "v", ["c"]).collect():
        assert r.upto_c == sum(g == r.k and v is not None and v <= r.v for g, v in rows) and r.all_c == sum(g == r.k and v is not None and v == v for g, v in rows)
    assert exact_quantiles(df.limit(0), [], "v", [0.5]).first().n is None


def test_repeated_edges_fall_back_to_percent_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 1.0, 5.0, None)], "v double")
    got = [r.bin for r in st.quantile_bins(df, "v", list("abcd"), fallback=True).orderBy("v").collect()]
    assert got == [None, "b", "b", "b", "b", "d"]


def test_density_is_exact_with_a_short_reach(spark):
    import math

    x = [0.0, 0.1, 0.2, 50.0, 100.0]
    n, mean = len(x), sum(x) / len(x)
    h = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1)) * n**-0.2
    got = {round(r.x, 6): r.density for r in st.gaussian_density(spark.createDataFrame([(v,) for v in x], "v double"), "v", 11).collect()}
    for g, d in got.items():
        assert d == pytest.approx(sum(math.exp(-0.5 * ((g - v) / h) ** 2) for v in x) / (n * h * math.sqrt(2 * math.pi)))
    assert len(got) == 11
    assert st.gaussian_density(spark.createDataFrame([(v,) for v in x], "v double"), "v", 11, cells=4).count() == 11


def test_kappa_intervals_and_quantiles_of_t(spark):
    from strandlake.functions.special import t_quantile

    assert t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), (None, "a")], "x string, y string")
    r = st.cohens_kappa(df, "x", "y").first()
    assert (r.n, r.agreement) == (4, 0.75) and r.kappa == pytest.approx(0.5)
    m = st.mean_interval(st.class_moments(spark.createDataFrame([(1.0, True), (2.0, True), (4.0, True), (1.0, False)], "v double, p boolean"), [], "v", F.col("p"))).first()
    assert m.high1 - m.m1 == pytest.approx(t_quantile(0.975, 2) * (7 / 3 / 3) ** 0.5) and m.low0 is None


def test_published_rules():
    snp, indel = rl.published_rules("snp"), rl.published_rules("indel")
    assert (len(snp), len(indel)) == (37, 38)
    assert [sum(len(r.primary) + len(r.secondary) for r in x) for x in (snp, indel)] == [69, 70]
    for rules in (snp, indel):
        assert rl.pre_empted(rules)["RECIPROCAL_EXON_GAIN_INTRON_LOSS"] == "SPLICE_INDUCED_EXONIZATION"
        assert sorted({r.tier for r in rules}) == [0, 1, 2, 3, 4, 5]
    assert rl.rule_descriptions(snp)["EXON_LOSS"] == "Loss of exon identity"


def test_rule_export_merges_equal_conditions(spark):
    got = {(r.mechanism, r.feature): r.variant_type for r in rl.merged_rule_table({"snp": rl.published_rules("snp"), "indel": rl.published_rules("indel")}, spark).collect()}
    assert got["EXON_LOSS", "D_BED_exon"] == "Both" and got["SEQUENCE_CONSTRAINED", "LLR"] == "snp" and got["EMBEDDING_DISRUPTED", "EMB_cosine_dist"] == "indel"


def test_output_checks_follow_the_contract(spark):
    families = {"delta": ["d"], "prob": ["p"]}
    problems = lambda rows: {r.column: r.problem for r in vr.output_checks(spark.createDataFrame(rows, "d double, p double, llr double"), families, ["llr"], unit=("prob",)).collect()}
    nan, inf = float("nan"), float("inf")
    assert set(problems([(0.1, 0.4, 1.0)]).values()) == {None}
    assert problems([(0.1, 1.4, 1.0)])["p"] == "out of bounds"
    assert set(problems([(nan, nan, 0.0), (0.1, 0.4, 0.0)]).values()) == {None}
    assert problems([(0.0, 0.4, 1.0), (0.0, 0.3, 1.0)])["d"] == "all zero"
    assert problems([(inf, 0.4, 1.0)])["d"] == "infinite" and problems([(nan, 0.4, nan)])["d"] == "all missing"
    assert set(problems([]).values()) == {"empty"}
    with pytest.raises(ValueError, match="missing outputs: d"):
        vr.output_checks(spark.createDataFrame([(1.0,)], "p double"), families)


def test_batches_are_checked_in_order(spark):
    df = spark.createDataFrame([(1, "1", 5, "A", "t"), (2, "1", 6, "", "C"), (3, "1", 7, None, "C"), (4, "1", 7, "N", "X")], "i int, chrom string, pos int, ref string, alt string")
    assert [r.row_no for r in vr.batch_errors(df, "i").orderBy("row_no").collect()] == [2, 3, 4]
    assert vr.batch_errors(df, "i", limit=3).first().error == "Batch size limited to 3 variants (received 4)"
    assert vr.batch_errors(df.drop("alt", "pos"), "i").first().error == "Missing columns: alt, pos"


def test_source_rows_without_contigs_and_copies(spark):
    rows = [(1, "cat", "1", "g.1234A>G", None), (2, "Cat", "chr1", "g.1234A>G", "a much longer text"), (3, "cat", "1", "g.5_7del A>C 9999", None), (4, "cat", "?", "g.77A>C", None), (5, "caterpillar", "1", "g.78A>C", None), (6, "cat", "2", "nothing 4321 C>T", None)]
    df = spark.createDataFrame(rows, "row int, species string, chrom string, `g. or m.` string, description string")
    got = sorted((r.chrom, r.pos, r.ref, r.alt, r.rationale) for r in vr.parse_source_rows(df, ["cat"], []).collect())
    assert got == [("1", 1234, "A", "G", "[Unknown] Unknown — Unknown"), ("2", 4321, "C", "T", "[Unknown] Unknown — Unknown")]


def test_tracks_without_metadata_stay(spark):
    tracks = spark.createDataFrame([("t1",), ("t2",)], "file_id string")
    assert tab.select_tracks(None, [], tracks=tracks).count() == 2
    none = spark.createDataFrame([], "file_id string, idx int, assay string, dataset string, experiment_target string")
    assert tab.select_tracks(none, [], tracks=tracks).count() == 2
    named = tab.with_track_metadata(tracks, spark.createDataFrame([("t1", "x"), ("t1", "y")], "file_id string, tissue string"))
    assert sorted((r.file_id, r.tissue) for r in named.collect()) == [("t1", "x"), ("t2", None)]


def test_joins_orders_and_columns(spark):
    a, b = spark.createDataFrame([(1, 2, "x")], "k int, m int, v string"), spark.createDataFrame([(1, "y")], "k int, v string")
    assert rel.join_on_common(a.drop("v"), b, ["k", "m"]).first().v == "y"
    with pytest.raises(ValueError, match="none of"):
        rel.join_on_common(a, b, ["z"])
    assert rel.column_difference(a, b) == (["m"], [])
    t = spark.createDataFrame([("10", 1), ("9", 2), ("x", 0), ("9", 1)], "c string, _row int")
    assert [(r.c, r._row) for r in rel.sort_typed(t, ["c", "_row"]).collect()] == [("9", 1), ("9", 2), ("10", 1), ("x", 0)]
    assert [r.c for r in rel.in_input_order(t).select("c").collect()][0] == "x"


def test_staged_tables_know_their_size(spark):
    t = stage(spark.range(1000), "t")
    assert t.staged_rows == 1000 and folder_bytes(spark, t.staged_at) > 1000 and t.count() == 1000
    assert is_small(t, 1000) and not is_small(t, 999) and not is_small(t, 1000, size=100)
    assert stage(spark.range(0), "t").staged_rows == 0 and stage(spark.createDataFrame([], "a string"), "t").staged_rows == 0
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1 << 20).alias("w"))
    assert not is_small(wide, 100, size=1 << 20) and is_small(wide, 100)


def test_review_and_evidence(spark):
    df = spark.createDataFrame([(0.01, 0.1), (0.5, None), (None, 3.0), (0.01, -2.0), (float("nan"), 1.0)], "d double, l double")
    assert [r.x for r in df.select(vr.review(F.col("d"), F.col("l")).alias("x")).collect()] == ["manual_review", "pass", "manual_review", "pass", "manual_review"]
    s = spark.createDataFrame([([("BED", "exon", -0.25, 0.5), ("BW", "heart", 0.06, 0.1)],), ([],)], "r array<struct<source: string, name: string, value: double, ref: double>>")
    got = [r.x for r in s.select(vr.evidence(F.col("r")).alias("x")).collect()]
    assert got == ["BED exon: strong loss (0.500 to 0.250)\nBW heart: subtle gain (0.100 to 0.160)", "weak outputs: a low-confidence summary only"]


def test_judges_wait_and_run_side_by_side(spark):
    import time

    from strandlake.operators.scoring import judge_rows

    def client():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            time.sleep(0.02)
            if seen[prompt] < 3:
                raise RuntimeError(f"busy {seen[prompt]}")
            return prompt.upper()

        return call

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, p string").coalesce(1)
    got = {r.i: (r.reply, r.attempts, r.error) for r in judge_rows(df, "i", "p", client, retries=3, wait=0.01, threads=5).collect()}
    assert got == {i: (f"P{i}", 3, None) for i in range(20)}
    assert {(r.reply, r.attempts, r.error) for r in judge_rows(df, "i", "p", client, retries=2).collect()} == {(None, 2, "busy 2")}


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    from strandlake.sources.sinks import write_csv_cells

    write_csv_cells(spark.createDataFrame([(1, ["b", "a"])], "i int, x array<string>").coalesce(1), str(tmp_path / "o"), byte_order_mark=True)
    (file,) = (tmp_path / "o").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfi,x") and "a;b" in file.read_text()


def test_python_tasks_find_the_package_without_help():
    """A session of any folder, with no search path set: the workers get the package from the driver."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
for q in ("model_scorer", "element_p_values", "html_table_scan"):
    print(q, e.queries()[q](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=300)
    found = dict(x.split() for x in out.stdout.split("\n") if len(x.split()) == 2)
    assert set(found) == {"model_scorer", "element_p_values", "html_table_scan"} and all(int(n) > 0 for n in found.values()), out.stderr[-2000:]
