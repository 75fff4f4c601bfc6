"""Queries of families, reference scores, top-k, rules and scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import families as fam
from strandlake.operators import reference_z as rz
from strandlake.operators import rules as rl
from strandlake.operators import topk
from strandlake.operators.scoring import HashScorer, score_rows
from strandlake.plans.catalog import query, table
from strandlake.sources.tabular import late_columns, read_projected

FAMILY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LONG = """
    base AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus AS g, l_returnflag = 'N' AS r,
               unnest([0, 1, 2, 3]) AS idx, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v, row_number() OVER () AS rid
        FROM lineitem
    ), mom AS (
        SELECT g, idx, avg(v) FILTER (WHERE r) AS mu, stddev_pop(v) FILTER (WHERE r) AS sd FROM base GROUP BY g, idx
    ), z AS (
        SELECT base.*, abs((v - mu) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END) AS z FROM base JOIN mom USING (g, idx)
    )
"""


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fam.to_array(table(spark, sf_dir, "lineitem").select(*KEYS, "l_linestatus", "l_returnflag", *FAMILY), FAMILY, "x")


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _family(spark, sf_dir)
    z = rz.apply_z(rows, "l_linestatus", "x", rz.reference_moments(rows, "l_linestatus", "x", F.col("l_returnflag") == "N"))
    return z.select(*KEYS, *fam.vector_scores(F.col("z"), "z"), fam.top_k_mean(F.col("z"), 2).alias("z_top2"))


@query(f"""
    WITH {_LONG}, s AS (
        SELECT rid, any_value(l_orderkey) AS l_orderkey, any_value(l_partkey) AS l_partkey, any_value(l_suppkey) AS l_suppkey, any_value(l_linenumber) AS l_linenumber,
               sum(ln(1 + z)) AS sum_log, list(z ORDER BY z DESC) AS zs
        FROM z GROUP BY rid
    )
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum_log, 6) AS z_sum_log, round((zs[1] + zs[2]) / 2, 6) AS z_top2
    FROM s ORDER BY round(sum_log, 6) DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20
""")
def impact_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-20 report of the burden score against the reference class."""
    s = _impact(spark, sf_dir)
    out = s.select(*KEYS, F.round("z_sum_log", 6).alias("z_sum_log"), F.round("z_top2", 6).alias("z_top2"))
    return out.orderBy(F.desc("z_sum_log"), *KEYS).limit(20)


@query(f"""
    WITH {_LONG}
    SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, round(avg(z), 6) AS z_mean, round(max(z), 6) AS z_max, round(sum(ln(1 + z)), 6) AS z_sum_log
    FROM z GROUP BY rid
""")
def impact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _impact(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("z_mean", "z_max", "z_sum_log")])


@query("""
    SELECT g AS variant_type, ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'][idx + 1] AS delta_col, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
    FROM (SELECT l_linestatus AS g, unnest([0, 1, 2, 3]) AS idx, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem WHERE l_returnflag = 'N') GROUP BY g, idx
""")
def frozen_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _family(spark, sf_dir)
    b = rz.freeze_background(rz.reference_moments(rows, "l_linestatus", "x", F.col("l_returnflag") == "N"), "l_linestatus", FAMILY)
    return b.select("variant_type", "delta_col", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""
    WITH {_LONG} SELECT any_value(l_orderkey) AS l_orderkey, round(sum(ln(1 + z)), 6) AS z_sum_log FROM z GROUP BY rid
""")
def frozen_background_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from a frozen background equal those computed anew."""
    rows = _family(spark, sf_dir)
    frozen = rz.freeze_background(rz.reference_moments(rows, "l_linestatus", "x", F.col("l_returnflag") == "N"), "l_linestatus", FAMILY)
    if not rz.groups_without_background(rows, "l_linestatus", frozen).isEmpty():
        raise ValueError("a group has no background")
    z = rz.apply_z(rows, "l_linestatus", "x", rz.thaw_background(frozen, "l_linestatus", FAMILY))
    return z.select("l_orderkey", F.round(fam.vector_scores(F.col("z"), "z")[2], 6).alias("z_sum_log"))


@query("""
    WITH m AS (
        SELECT unnest(CASE WHEN l_linestatus = 'O' THEN [l_returnflag] ELSE [l_returnflag, 'late'] END) AS member_of, l_quantity, l_discount FROM lineitem
    )
    SELECT member_of, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_pop(l_discount), 6) AS sd_discount FROM m GROUP BY member_of
""")
def overlapping_group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rz.group_members(table(spark, sf_dir, "lineitem"), "l_returnflag", {"late": F.col("l_linestatus") == "F"})
    return rows.groupBy("member_of").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.stddev_pop("l_discount"), 6).alias("sd_discount"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 6) AS o_totalprice_z FROM orders")
def column_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = rz.column_z(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return z.select("o_orderkey", F.round("o_totalprice_z", 6).alias("o_totalprice_z"))


@query("""
    WITH s AS (SELECT stddev_pop(l_quantity) AS q, stddev_pop(l_tax) AS t FROM lineitem WHERE l_returnflag = 'N')
    SELECT l_orderkey, l_linenumber, round(l_quantity / q, 6) AS quantity_scaled, round(l_tax / t, 6) AS tax_scaled FROM lineitem, s
""")
def reference_sd_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fam.to_array(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], "x")
    out = rz.scale_by_reference_sd(rows, "x", F.col("l_returnflag") == "N")
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("scaled")[0], 6).alias("quantity_scaled"), F.round(F.col("scaled")[1], 6).alias("tax_scaled"))


@query("""
    WITH b AS (SELECT unnest([0, 1, 2, 3]) AS idx, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem WHERE l_returnflag = 'N')
    SELECT idx::INTEGER AS idx, round(median(v), 6) AS med, round(mad(v), 6) AS mad FROM b GROUP BY idx
""")
def median_absolute_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rz.mad_moments(_family(spark, sf_dir), "x", F.col("l_returnflag") == "N")
    return out.select("idx", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM lineitem")
def projected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_projected(spark, f"{sf_dir}/lineitem.parquet", ["l_ext", "l_dis"], ["l_orderkey", "l_linenumber"])


@query("""
    WITH k AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)
    SELECT o_orderkey, o_orderpriority, o_custkey FROM orders SEMI JOIN k USING (o_orderkey)
""")
def late_materialisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_columns(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"], ["o_orderstatus", "o_totalprice"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000), ["o_orderpriority", "o_custkey"])


_EMB = "e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", topk.members(F.col("embedding")).alias("m"), "embedding")


@query(f"WITH {_EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, idx) AS place FROM e) SELECT vec_id, place::INTEGER AS place, idx::INTEGER AS idx, round(v, 6) AS value FROM r WHERE place <= 5")
def topk_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(topk.top_abs(F.col("m"), 5)).alias("place", "s"))
    return out.select("vec_id", (F.col("place") + 1).alias("place"), "s.idx", F.round("s.value", 6).alias("value"))


@query(f"""
    WITH {_EMB}, g AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, idx) AS place, 'gain' AS side FROM e WHERE v > 0.01),
    l AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v, idx) AS place, 'loss' AS side FROM e WHERE v < -0.01)
    SELECT vec_id, side, place::INTEGER AS place, idx::INTEGER AS idx, round(v, 6) AS value FROM (SELECT * FROM g UNION ALL SELECT * FROM l) WHERE place <= 3
""")
def topk_gains_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    sides = [v.select("vec_id", F.lit(side).alias("side"), F.posexplode(f(F.col("m"), 3)).alias("place", "s")) for side, f in (("gain", topk.top_gains), ("loss", topk.top_losses))]
    out = sides[0].unionByName(sides[1])
    return out.select("vec_id", "side", (F.col("place") + 1).alias("place"), "s.idx", F.round("s.value", 6).alias("value"))


@query(f"""
    WITH {_EMB}, t AS (SELECT idx, avg(v) - 1.5 * stddev_pop(v) AS lo, avg(v) + 1.5 * stddev_pop(v) AS hi FROM e WHERE idx % 2 = 0 GROUP BY idx),
    p AS (SELECT vec_id, idx, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, idx) AS place FROM e JOIN t USING (idx) WHERE v > 0 AND v > hi)
    SELECT vec_id, place::INTEGER AS place, idx::INTEGER AS idx, round(v, 6) AS value FROM p WHERE place <= 3
""")
def threshold_gated_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = fam.to_long(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")), ["vec_id"], "x").withColumn("track", F.col("idx").cast("string"))
    limits = long.filter("idx % 2 = 0").groupBy("track").agg((F.avg("value") - 1.5 * F.stddev_pop("value")).alias("lo"), (F.avg("value") + 1.5 * F.stddev_pop("value")).alias("hi")).withColumn("reference", F.lit("benign")).withColumn("stat", F.lit("std"))
    passed = topk.gate(long, limits, "gain")
    w = Window.partitionBy("vec_id").orderBy(F.desc("value"), "idx")
    return passed.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("vec_id", "place", "idx", F.round("value", 6).alias("value"))


@query(f"""
    WITH {_EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, idx) AS place FROM e)
    SELECT vec_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS greatest FROM r WHERE place <= 7 GROUP BY vec_id
""")
def kept_signal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = topk.kept_statistics(topk.top_abs(F.col("m"), 7), [f"d{i}" for i in range(64)])
    return _vectors(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("mean", "median", "least", "greatest")])


_SRC = f"{_EMB}, f AS (SELECT vec_id, CASE WHEN idx < 16 THEN 'BED' ELSE 'BW' END AS source, idx, v FROM e)"


def _ranked_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    return rows.select("vec_id", F.when(F.col("idx") < 16, "BED").otherwise("BW").alias("source"), "idx", F.col("v").cast("double").alias("value"), F.lit(0.5).alias("ref"))


@query(f"WITH {_SRC} SELECT vec_id, source, idx::INTEGER AS idx, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, source, idx)::INTEGER AS rank, round(0.5 + v, 6) AS alt FROM f")
def unified_track_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.ranked_tracks(_ranked_long(spark, sf_dir), "vec_id").select("vec_id", "source", "idx", "rank", F.round("alt", 6).alias("alt"))


@query(f"""
    WITH {_SRC}, own AS (SELECT *, row_number() OVER (PARTITION BY vec_id, source ORDER BY abs(v) DESC, idx) AS o FROM f),
    pick AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN source = 'BED' AND o <= 4 THEN 0 ELSE 1 END, abs(v) DESC, source, idx) AS p FROM own)
    SELECT vec_id, source, idx::INTEGER AS idx, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, source, idx)::INTEGER AS rank FROM pick WHERE p <= 10
""")
def quota_constrained_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.quota_top(_ranked_long(spark, sf_dir), "vec_id", 10, "BED", 4).select("vec_id", "source", "idx", "rank")


@query(f"WITH {_SRC}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, source ORDER BY abs(v) DESC, idx) AS rank FROM f WHERE abs(v) >= 0.03) SELECT vec_id, source, idx::INTEGER AS idx, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def summary_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.summary_signals(_ranked_long(spark, sf_dir), "vec_id").select("vec_id", "source", "idx", "rank")


@query("""
    SELECT n_nationkey, CASE WHEN count(*) OVER (PARTITION BY r_name) > 1 THEN r_name || ' [' || row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) || ']' ELSE r_name END AS name
    FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def distinct_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.lit(1).alias("one"), F.col("r_name").alias("name"))
    return topk.distinct_names(rows, "one", "name", "n_nationkey").select("n_nationkey", "name")


@query(f"""
    WITH {_EMB}, w AS (SELECT vec_id, idx, v FROM e)
    SELECT vec_id, round(greatest(max(v), 0), 6) AS gain, CASE WHEN max(v) > 0 THEN arg_max(idx, v) - 32 END::INTEGER AS gain_pos, round(greatest(max(-v), 0), 6) AS loss, CASE WHEN min(v) < 0 THEN arg_min(idx, v) - 32 END::INTEGER AS loss_pos
    FROM w GROUP BY vec_id
""")
def window_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double"))
    s = topk.window_extremes(values, -32)
    return table(spark, sf_dir, "embeddings").select("vec_id", s.alias("s")).select("vec_id", F.round("s.gain", 6).alias("gain"), "s.gain_pos", F.round("s.loss", 6).alias("loss"), "s.loss_pos")


@query(f"WITH {_EMB}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, idx) AS p FROM e) SELECT vec_id, round(v, 6) AS value, 'd' || idx AS track FROM r WHERE p = 1")
def signed_extreme_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fam.signed_extreme(F.transform("embedding", lambda x: x.cast("double")), [f"d{i}" for i in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", s.alias("s")).select("vec_id", F.round("s.value", 6).alias("value"), "s.track")


@query("SELECT l_orderkey, l_linenumber, round(log2((l_extendedprice + 1) / (l_quantity + 1)), 6) AS lfc, round(CASE WHEN l_discount > 0 AND l_discount < 1 THEN ln(l_discount / (1 - l_discount)) END, 6) AS logit FROM lineitem")
def log_fold_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fam.log2_fold_change(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("lfc"), F.round(fam.inverse_sigmoid(F.col("l_discount")), 6).alias("logit"))


RULES = [
    rl.Rule("DEEP_DISCOUNT", 0, (rl.Condition("l_discount", "positive", 0.1), rl.Condition("l_tax", "positive", 0.08)), (rl.Condition("l_quantity", "positive", 40.0),), "Large and cheap"),
    rl.Rule("SMALL_ORDER", 1, (rl.Condition("l_quantity", "negative", 5.0),), (), "Few pieces"),
    rl.Rule("TINY_ORDER", 2, (rl.Condition("l_quantity", "negative", 2.0),), (), "Never first: fewer pieces than few"),
    rl.Rule("COSTLY", 2, (rl.Condition("l_extendedprice", "any", -80000.0), rl.Condition("l_missing", "positive", 1.0)), (), "High price", 1),
]
_RULES_SQL = """
    r AS (
        SELECT *, (l_discount >= 0.1 OR l_tax >= 0.08) AND l_quantity >= 40 AS a, l_quantity <= 5 AS b, l_quantity <= 2 AS c, l_extendedprice >= 80000 AS d FROM lineitem
    )
"""


@query(f"""
    WITH {_RULES_SQL}
    SELECT l_orderkey, l_linenumber, CASE WHEN a THEN 'DEEP_DISCOUNT' WHEN b THEN 'SMALL_ORDER' WHEN c THEN 'TINY_ORDER' WHEN d THEN 'COSTLY' ELSE 'UNCERTAIN_SIGNIFICANCE' END AS NT_Mechanism,
           CASE WHEN a THEN 0 WHEN b THEN 1 WHEN c OR d THEN 2 ELSE -1 END::INTEGER AS NT_Tier,
           (a::INT + b::INT + c::INT + d::INT)::INTEGER AS NT_Mechanism_Count,
           array_to_string(list_filter([CASE WHEN a THEN 'DEEP_DISCOUNT(P0)' END, CASE WHEN b THEN 'SMALL_ORDER(P1)' END, CASE WHEN c THEN 'TINY_ORDER(P2)' END, CASE WHEN d THEN 'COSTLY(P2)' END], lambda x: x IS NOT NULL), '; ') AS NT_All_Mechanisms
    FROM r
""")
def rule_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rl.assign(table(spark, sf_dir, "lineitem"), RULES)
    return out.select("l_orderkey", "l_linenumber", "NT_Mechanism", "NT_Tier", "NT_Mechanism_Count", "NT_All_Mechanisms")


@query(f"""
    WITH {_RULES_SQL}
    SELECT CASE WHEN a THEN 'DEEP_DISCOUNT' WHEN b THEN 'SMALL_ORDER' WHEN c THEN 'TINY_ORDER' WHEN d THEN 'COSTLY' ELSE 'UNCERTAIN_SIGNIFICANCE' END AS mechanism, l_returnflag, count(*) AS n
    FROM r GROUP BY ALL
""")
def rule_mechanism_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.assign(table(spark, sf_dir, "lineitem"), RULES).groupBy(F.col("NT_Mechanism").alias("mechanism"), "l_returnflag").agg(F.count("*").alias("n"))


@query(f"""
    WITH {_RULES_SQL}, f AS (
        SELECT unnest(['DEEP_DISCOUNT', 'SMALL_ORDER', 'TINY_ORDER', 'COSTLY']) AS mechanism, unnest([a, b, c, d]) AS fired, unnest([a, b AND NOT a, c AND NOT a AND NOT b, d AND NOT a AND NOT b AND NOT c]) AS assigned FROM r
    )
    SELECT mechanism, count(*) FILTER (WHERE fired) AS n_fired, count(*) FILTER (WHERE assigned) AS n_assigned, mechanism <> 'TINY_ORDER' AS can_be_assigned FROM f GROUP BY mechanism
""")
def rule_pre_emption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on which each rule fires and is assigned; a rule that an earlier one pre-empts is never assigned."""
    out = rl.assign(table(spark, sf_dir, "lineitem"), RULES)
    counts = [F.struct(F.lit(r.name).alias("mechanism"), F.count_if(F.array_contains(F.split("NT_All_Mechanisms", "; "), f"{r.name}(P{r.tier})")).alias("n_fired"), F.count_if(F.col("NT_Mechanism") == r.name).alias("n_assigned"), F.lit(r.name not in rl.pre_empted(RULES)).alias("can_be_assigned")) for r in RULES]
    return out.agg(F.array(*counts).alias("x")).select(F.inline("x"))


@query(f"""
    WITH {_RULES_SQL}
    SELECT l_orderkey, l_linenumber, CASE WHEN a THEN 'DEEP_DISCOUNT' WHEN b THEN 'SMALL_ORDER' WHEN c AND d THEN CASE WHEN -(l_extendedprice / 1e5) <= -0.5 THEN 'COSTLY' ELSE 'TINY_ORDER' END WHEN c THEN 'TINY_ORDER' WHEN d THEN 'COSTLY' ELSE 'UNCERTAIN_SIGNIFICANCE' END AS mechanism
    FROM r
""")
def rule_assignment_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = {"DEEP_DISCOUNT": F.col("l_discount"), "SMALL_ORDER": F.lit(1.0), "TINY_ORDER": F.lit(0.5), "COSTLY": F.col("l_extendedprice") / 1e5}
    return rl.assign_by_confidence(table(spark, sf_dir, "lineitem"), RULES, confidence).select("l_orderkey", "l_linenumber", "mechanism")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice >= 80000 THEN 'High' WHEN l_extendedprice >= 40000 THEN 'Moderate' WHEN l_extendedprice >= 10000 THEN 'Low' ELSE 'Minimal' END AS label FROM lineitem")
def threshold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rl.ladder(F.col("l_extendedprice"), [(80000, "High"), (40000, "Moderate"), (10000, "Low")], "Minimal").alias("label"))


@query("""
    WITH h AS (SELECT doc_id, sha256(lang || chr(10) || text) AS h FROM documents)
    SELECT doc_id, list_transform([1, 3, 5, 7], lambda i: ('0x' || substr(h, i, 2))::INTEGER / 255.0::DOUBLE) AS scores FROM h
""")
def model_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a deterministic scorer, equal texts once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return score_rows(docs, "text", "lang", HashScorer).select("doc_id", "scores")
