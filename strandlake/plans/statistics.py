"""Queries of effect sizes, rank statistics, bins, densities and vector functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import vectors as vec
from strandlake.operators import stats as st
from strandlake.operators import tables as tb
from strandlake.operators.running import exact_quantiles
from strandlake.plans.catalog import query, table

_CLASSED = "s AS (SELECT n_chars::DOUBLE AS x, quality = 1 AS pos, lang FROM documents JOIN labels USING (doc_id))"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").cast("double").alias("x"), (F.col("quality") == 1).alias("pos"), "lang")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""
    WITH {_CLASSED}, m AS (
        SELECT count(*) FILTER (WHERE pos) AS n1, avg(x) FILTER (WHERE pos) AS m1, var_samp(x) FILTER (WHERE pos) AS v1, count(*) FILTER (WHERE NOT pos) AS n0, avg(x) FILTER (WHERE NOT pos) AS m0, var_samp(x) FILTER (WHERE NOT pos) AS v0 FROM s
    ), p AS (SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS sp FROM m)
    SELECT n1, n0, round((m1 - m0) / sp, 6) AS cohens_d, round((m1 - m0) / (sp * sqrt(1.0 / n1 + 1.0 / n0)), 6) AS t, n1 + n0 - 2 AS df FROM p
""")
def cohens_d_and_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.student(st.class_moments(_classed(spark, sf_dir), [], "x", F.col("pos"))).select("n1", "n0", "cohens_d", "t", "df"))


_ELEMENTS = """
    u AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x, l_returnflag = 'R' AS pos FROM lineitem),
    m AS (
        SELECT name, count(*) FILTER (WHERE pos) AS n1, avg(x) FILTER (WHERE pos) AS m1, var_samp(x) FILTER (WHERE pos) AS v1, count(*) FILTER (WHERE NOT pos) AS n0, avg(x) FILTER (WHERE NOT pos) AS m0, var_samp(x) FILTER (WHERE NOT pos) AS v0 FROM u GROUP BY name
    )
"""
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("pos"), *_NUMBERS)
    return st.class_moments(tb.unpivoted(li, ["pos"], _NUMBERS, value="x"), ["name"], "x", F.col("pos"))


@query(f"""
    WITH {_ELEMENTS}
    SELECT name, n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohens_d,
           round((m1 - m0) / (sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) * sqrt(1.0 / n1 + 1.0 / n0)), 6) AS t FROM m
""")
def per_element_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.student(_elements(spark, sf_dir)).select("name", "n1", "n0", "cohens_d", "t"))


@query(f"""
    WITH {_ELEMENTS}
    SELECT name, round(sqrt(v1 / n1), 6) AS sem1, round(sqrt(v0 / n0), 6) AS sem0, round(m1 - m0, 6) AS difference, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS t,
           round((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 3) AS df, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS cohens_d FROM m
""")
def welch_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.welch(_elements(spark, sf_dir)).select("name", "sem1", "sem0", "difference", "t", F.round("df", 3).alias("df"), "cohens_d")
    return _rounded(out)


# p: the density of Student's t summed over 20,000 strips from 0 to |t|
@query(f"""
    WITH {_ELEMENTS},
    s AS (SELECT name, n1 + n0 - 2 AS df, (m1 - m0) / (sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) * sqrt(1.0 / n1 + 1.0 / n0)) AS t FROM m),
    h AS (SELECT *, least(abs(t), 40) / 20000 AS w, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS front FROM s),
    p AS (SELECT name, t, df, greatest(0, 1 - 2 * front * w * sum((1 + ((i + 0.5::DOUBLE) * w) ** 2 / df) ** (-(df + 1) / 2))) AS p_value FROM h, range(20000) r(i) GROUP BY name, t, df, front, w)
    SELECT name, round(t, 6) AS t, df, round(p_value, 6) AS p_value, p_value < 0.05 / 4 AS significant FROM p
""")
def element_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p values with the Bonferroni limit."""
    return _rounded(st.with_p_values(st.student(_elements(spark, sf_dir)), tests=len(_NUMBERS)).select("name", "t", "df", "p_value", "significant"))


@query(f"""
    WITH {_CLASSED}, c AS (
        SELECT count(*) FILTER (WHERE pos) AS n1, count(*) FILTER (WHERE NOT pos) AS n0 FROM s
    ), a AS (
        SELECT sum(CASE WHEN p.x > q.x THEN 1.0 WHEN p.x = q.x THEN 0.5 ELSE 0 END) AS u FROM s p JOIN s q ON p.pos AND NOT q.pos
    ), k AS (
        SELECT max(abs((SELECT count(*) FROM s WHERE pos AND s.x <= v.x) / (SELECT n1 FROM c) - (SELECT count(*) FROM s WHERE NOT pos AND s.x <= v.x) / (SELECT n0 FROM c))) AS ks FROM (SELECT DISTINCT x FROM s) v
    )
    SELECT n1, n0, round(u / (n1 * n0), 6) AS auc, round(greatest(u / (n1 * n0), 1 - u / (n1 * n0)), 6) AS auc_any, round(2 * u / (n1 * n0) - 1, 6) AS rank_biserial, round(ks, 6) AS ks FROM a, c, k
""")
def rank_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.rank_statistics(_classed(spark, sf_dir), [], "x", F.col("pos"), least=5))


@query("""
    WITH u AS (SELECT unnest(['quantity', 'discount']) AS name, unnest([l_quantity, l_discount]) AS x, l_returnflag = 'R' AS pos FROM lineitem),
    r AS (SELECT name, pos, rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2.0 AS r FROM u),
    a AS (SELECT name, sum(r) FILTER (WHERE pos) AS s, count(*) FILTER (WHERE pos)::DOUBLE AS n1, count(*) FILTER (WHERE NOT pos)::DOUBLE AS n0 FROM r GROUP BY name),
    m AS (SELECT name, avg(x) FILTER (WHERE pos) AS m1, avg(x) FILTER (WHERE NOT pos) AS m0, var_pop(x) FILTER (WHERE pos) AS v1, var_pop(x) FILTER (WHERE NOT pos) AS v0 FROM u GROUP BY name)
    SELECT name, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(abs(m1 - m0) / sqrt((v1 + v0) / 2), 6) AS abs_d FROM a JOIN m USING (name)
""")
def score_discrimination_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("pos"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    long = tb.unpivoted(li, ["pos"], ["quantity", "discount"], value="x")
    auc = st.rank_statistics(long, ["name"], "x", F.col("pos")).select("name", "auc")
    one, other = F.when(F.col("pos"), F.col("x")), F.when(~F.col("pos"), F.col("x"))
    d = long.groupBy("name").agg((F.abs(F.avg(one) - F.avg(other)) / F.sqrt((F.var_pop(one) + F.var_pop(other)) / 2)).alias("abs_d"))
    return _rounded(auc.join(d, "name"))


@query("""
    WITH r AS (
        SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_orderpriority) - 1) / 2.0 AS b FROM orders
    ) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r
""")
def spearman_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority"))


@query("""
    WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL), e AS (SELECT o, sum(o) OVER (PARTITION BY x) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c)
    SELECT any_value(n)::BIGINT AS n, round(sum((o - e) ** 2 / e), 6) AS chi2, round(sqrt(sum((o - e) ** 2 / e) / any_value(n)), 6) AS v FROM e
""")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.cramers_v(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"))


@query("""
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'Q1' WHEN o_totalprice <= b THEN 'Q2' WHEN o_totalprice <= c THEN 'Q3' ELSE 'Q4' END AS bin FROM orders, q
""")
def quartile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.quantile_bins(table(spark, sf_dir, "orders"), "o_totalprice", ["Q1", "Q2", "Q3", "Q4"]).select("o_orderkey", "bin")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.005) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.995) FROM orders)")
def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.clip_percentiles(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey")


@query("""
    WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 60)) + 1, 60)::BIGINT AS bin, count(*) AS n FROM lineitem, m GROUP BY bin
""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 60)


@query("""
    WITH b AS (SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_samp(l_quantity) AS sd FROM lineitem), h AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS h FROM b),
    c AS (SELECT l_quantity AS v, count(*) AS k FROM lineitem GROUP BY l_quantity), g AS (SELECT lo + i * ((hi - lo) / 499) AS x FROM h, range(0, 500) AS t(i))
    SELECT round(x, 6) AS x, round(sum(k * exp(-0.5 * ((x - v) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM g, c, h GROUP BY x
""")
def gaussian_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.gaussian_density(table(spark, sf_dir, "lineitem"), "l_quantity", 500))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'In-frame' ELSE 'Frameshift' END AS frame FROM lineitem")
def frame_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", st.frame_class(F.col("l_linenumber")).alias("frame"))


@query("SELECT round(count(quality) FILTER (WHERE lang <> 'fr') / count(*) FILTER (WHERE lang <> 'fr'), 6) AS coverage, CASE WHEN count(quality) FILTER (WHERE lang <> 'fr') / count(*) FILTER (WHERE lang <> 'fr') >= 0.95 THEN 'All' ELSE 'Indels' END AS subset FROM documents LEFT JOIN labels USING (doc_id)")
def coverage_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return _rounded(st.coverage_rule(d, "quality", F.col("lang") == "fr"))


@query("SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY l_returnflag")
def class_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.5])
    return q.select("l_returnflag", F.col("q")[0].alias("median"))


@query(f"""
    WITH {_CLASSED}, t AS (SELECT x, count(*) AS n, count(*) FILTER (WHERE pos) AS n1 FROM s GROUP BY x), r AS (SELECT n1, sum(n) OVER (ORDER BY x DESC) AS c, sum(n1) OVER (ORDER BY x DESC) AS c1 FROM t)
    SELECT sum(n1)::BIGINT AS n1, round(sum(n1 * c1 / c) / sum(n1), 6) AS average_precision FROM r
""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.average_precision(_classed(spark, sf_dir), "x", F.col("pos")))


@query("""
    WITH u AS (SELECT o_custkey AS k, sum(o_totalprice) AS s, count(o_totalprice) AS c FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_custkey),
    steps AS (SELECT list(t ORDER BY k) AS upto FROM (SELECT k, sum(exp(-1::DOUBLE) / factorial(k::INTEGER)) OVER (ORDER BY k) AS t FROM range(12) r(k))),
    d AS (SELECT b, s, c, ('0x' || substr(md5('42:' || k || ':' || (b // 4)), (8 * (b % 4) + 1)::INTEGER, 8))::BIGINT / 4294967296::DOUBLE AS x FROM u, range(200) r(b)),
    w AS (SELECT b, s, c, len(list_filter(upto, lambda t: t <= x)) AS w FROM d, steps),
    m AS (SELECT sum(w * s) / sum(w * c) AS m FROM w GROUP BY b)
    SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m
""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson bootstrap of a mean over customers."""
    return _rounded(st.bootstrap_mean(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice"), 4)


@query("""
    WITH c AS (SELECT label, idx, avg(v) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS idx, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL), k AS (SELECT label, list(m ORDER BY idx) AS c FROM c GROUP BY label)
    SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], c), 6) AS cosine, round(list_distance(embedding::DOUBLE[], c), 6) AS l2 FROM embeddings JOIN k USING (label)
""")
def embedding_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    long = e.select("label", F.posexplode("embedding").alias("idx", "v")).groupBy("label", "idx").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "m"))), lambda s: s["m"]).alias("c"))
    j = e.join(centre, "label")
    return j.select("vec_id", F.round(vec.cosine_distance(F.col("embedding"), F.col("c")), 6).alias("cosine"), F.round(vec.l2_distance(F.col("embedding"), F.col("c")), 6).alias("l2"))


@query("""
    WITH e AS (SELECT vec_id, unnest(embedding[1:len(embedding) // 2])::DOUBLE AS a, unnest(embedding[len(embedding) // 2 + 1:])::DOUBLE AS b FROM embeddings),
    s AS (SELECT vec_id, exp(a) / sum(exp(a)) OVER (PARTITION BY vec_id) AS p, exp(b) / sum(exp(b)) OVER (PARTITION BY vec_id) AS q FROM e)
    SELECT vec_id, round(sum(p * ln(p / q)), 6) AS kl, round(max(p), 6) AS top FROM s GROUP BY vec_id
""")
def softmax_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.size("embedding") / 2).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", vec.softmax(F.slice("embedding", F.lit(1), half)).alias("p"), vec.softmax(F.slice("embedding", half + 1, half)).alias("q"))
    return _rounded(e.select("vec_id", vec.kl_divergence(F.col("p"), F.col("q")).alias("kl"), F.array_max("p").alias("top")))


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-l_quantity / 10)), 6) AS sigmoid, round(ln((l_tax / (l_discount + 1e-10)) + 1e-10), 6) + 0.0::DOUBLE AS llr, round(CASE WHEN l_quantity <= 10 THEN l_quantity * 0.5 WHEN l_quantity <= 30 THEN 5 + (l_quantity - 10) * 2.0 ELSE 45 END, 6) AS mapped FROM lineitem")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    mapped = vec.piecewise_linear(F.col("l_quantity"), [(0, 0), (10, 5), (30, 45)])
    return _rounded(li.select("l_orderkey", "l_linenumber", vec.sigmoid(F.col("l_quantity") / 10).alias("sigmoid"), (F.round(vec.log_likelihood_ratio(F.col("l_discount"), F.col("l_tax")), 6) + F.lit(0.0)).alias("llr"), mapped.alias("mapped")))
