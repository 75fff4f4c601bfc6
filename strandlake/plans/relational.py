"""Queries of joins, deduplication, set operations, counts and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import intervals as iv
from strandlake.operators import relational as rel
from strandlake.operators import tables as tb
from strandlake.plans.catalog import query, table
from strandlake.streaming.resumable import windowed_counts


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.keep_first(table(spark, sf_dir, "documents"), ["text"], [F.col("doc_id").asc()]).select("doc_id", "lang", "source")


@query("SELECT lang, source, max(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.keep_last(table(spark, sf_dir, "documents"), ["lang", "source"], ["doc_id"]).select("lang", "source", "doc_id")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)")
def dedup_drop_all_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.drop_repeated(table(spark, sf_dir, "documents"), ["text"]).select("doc_id")


@query("""
    WITH c AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)
    SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN c ON c_custkey = c.o_custkey LEFT JOIN orders ON o_orderkey = k AND orders.o_custkey = c_custkey
""")
def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    out = rel.left_lookup(cust, orders, ["c_custkey"], {"status": F.lit("none")}, [F.col("o_orderkey")])
    return rel.assert_same_rows(cust, out)


@query("SELECT l_orderkey, l_linenumber, p_brand, s_nationkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def left_equi_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "s_nationkey")


@query("""
    WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS note FROM labels), b AS (SELECT doc_id, lang AS note, source FROM documents)
    SELECT b.doc_id, coalesce(a.note, b.note) AS note, b.source FROM b JOIN a USING (doc_id)
""")
def coalescing_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("note"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("note"), "source")
    return rel.coalescing_join(a, b, ["doc_id"], "inner")


@query("SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey::VARCHAR = r.r_regionkey::VARCHAR")
def key_harmonised_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("k"))
    r = table(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").cast("string").alias("k"))
    return rel.harmonised_join(n, r, "k").select("n_name", "r_name")


@query("""
    WITH a AS (SELECT * FROM orders WHERE o_totalprice < 300000), b AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_totalprice > 100000)
    SELECT count(*) FILTER (WHERE b.o_orderkey IS NULL) AS left_only, count(*) FILTER (WHERE a.o_orderkey IS NULL) AS right_only, count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey) AS in_both,
           count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey AND a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS differ_o_orderstatus,
           count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey AND a.o_custkey IS DISTINCT FROM b.o_custkey) AS differ_o_custkey
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
""")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_totalprice < 300000")
    b = o.filter("o_totalprice > 100000").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus")))
    return rel.table_diff(a, b, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'VUS' ELSE lang END AS lang FROM documents")
def membership_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return rel.flag_members(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", toxic, "lang", "VUS")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def not_yet_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.not_yet_done(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
    WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_no FROM orders), b AS (SELECT o_orderkey AS other, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_no FROM orders)
    SELECT row_no, o_orderkey, other FROM a JOIN b USING (row_no)
""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = rel.positional_join(o.select("o_orderkey", "o_totalprice"), o.select(F.col("o_orderkey").alias("other"), "o_orderdate"), ["o_totalprice", "o_orderkey"], ["o_orderdate", "other"])
    return out.select("row_no", "o_orderkey", "other")


@query("""
    SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R') AS n_left, (SELECT count(*) FROM part) AS n_right, count(*) AS n_common,
           round(count(*) / (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag = 'R'), 6) AS overlap
    FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part)
""")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    return rel.key_overlap(a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), ["k"]).withColumn("overlap", F.round("overlap", 6))


@query("""
    WITH t AS (SELECT text, count(*) AS c FROM documents GROUP BY text), u AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY ALL)
    SELECT 'text' AS scope, sum(c)::BIGINT AS n_rows, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS n_duplicate_rows, count(*) FILTER (WHERE c > 1) AS n_duplicate_keys FROM t
    UNION ALL SELECT 'origin', sum(c)::BIGINT, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT, count(*) FILTER (WHERE c > 1) FROM u
""")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.duplicate_summary(table(spark, sf_dir, "documents"), {"text": ["text"], "origin": ["lang", "source"]})


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return rel.union_aligned(c, s)


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey"))


@query("SELECT x AS event_type FROM (VALUES ('click'), ('view'), ('refund'), ('chat')) AS t(x) EXCEPT SELECT event_type FROM events")
def expected_not_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.expected_minus_observed(table(spark, sf_dir, "events"), "event_type", ["click", "view", "refund", "chat"])


_POINTS = "p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events), i AS (SELECT event_id AS interval_id, user_id, t AS a, t + 86400 AS z FROM p WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase'))"


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "event_type")
    i = p.filter("event_type = 'purchase'").select(F.col("event_id").alias("interval_id"), "user_id", F.col("t").alias("a"), (F.col("t") + 86400).alias("z"))
    return p.select("event_id", "user_id", "t"), i


@query(f"WITH {_POINTS} SELECT p.event_id, i.interval_id FROM p JOIN i ON p.user_id = i.user_id AND p.t BETWEEN i.a AND i.z")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = _points(spark, sf_dir)
    return iv.points_in_intervals(p, i, "user_id", "t", "a", "z").select("event_id", "interval_id")


@query(f"WITH {_POINTS} SELECT x.interval_id, y.interval_id AS r_interval_id FROM i x JOIN i y ON x.user_id = y.user_id AND x.a <= y.z AND y.a <= x.z WHERE x.interval_id < y.interval_id")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, i = _points(spark, sf_dir)
    return iv.overlapping(i, i, "user_id", "a", "z", 86400).filter("interval_id < r_interval_id").select("interval_id", "r_interval_id")


@query("""
    WITH v AS (SELECT l_suppkey AS k, l_linenumber AS a, l_linenumber + (l_quantity::INTEGER % 3) AS z, l_returnflag AS term FROM lineitem), e AS (SELECT k, unnest(range(least(a, z), greatest(a, z) + 1)) AS position, term FROM v)
    SELECT k, position::INTEGER AS position, CASE min(CASE term WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) WHEN 1 THEN 'R' WHEN 2 THEN 'A' ELSE 'N' END AS term FROM e GROUP BY k, position
""")
def most_severe_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("int").alias("a"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 3).cast("int").alias("z"), F.col("l_returnflag").alias("term"))
    return iv.most_severe(v, ["R", "A", "N"], "k", "a", "z", "term")


@query("""
    WITH f AS (SELECT conv_id, trim(text) AS t, min(turn) AS turn FROM conversations WHERE trim(text) NOT IN ('-', '') GROUP BY ALL)
    SELECT conv_id, string_agg(t, ' | ' ORDER BY turn, t) AS text FROM f GROUP BY conv_id
""")
def ordered_text_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], "text", ["turn"])


@query("""
    SELECT o_custkey, count(*) AS n, CASE WHEN count(*) = 1 THEN bool_and(o_orderpriority = '1-URGENT') ELSE bool_and(o_orderpriority <> '5-LOW') AND bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) END AS passes FROM orders GROUP BY o_custkey
""")
def review_status_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.review_status_ok(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], ["1-URGENT", "2-HIGH"], "1-URGENT")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.value_counts(table(spark, sf_dir, "events"), ["event_type"]).withColumn("pct", F.round("pct", 6))


@query("""
    SELECT quality, count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS n_toxic, count(*) FILTER (WHERE n_chars > 2000) AS n_long, round(count(*) FILTER (WHERE toxic = 1) / count(*), 6) AS rate
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality
""")
def stratified_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return tb.conditional_counts(d, ["quality"], {"n_toxic": F.col("toxic") == 1, "n_long": F.col("n_chars") > 2000}).withColumn("rate", F.round(F.try_divide(F.col("n_toxic").cast("double"), F.col("total")), 6))


@query("SELECT lang, count(*) AS n, round(avg((quality = 1)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return tb.accuracy_by(d, ["lang"], F.col("quality") == 1).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.pivot_sum(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]).select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("""
    WITH o AS (SELECT * FROM (VALUES (0, 'R'), (1, 'A'), (2, 'N'), (3, 'Z')) AS t(position, l_returnflag))
    SELECT o.l_returnflag, o.position::INTEGER AS position, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'X') AS X
    FROM o LEFT JOIN lineitem USING (l_returnflag) GROUP BY ALL
""")
def cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.cross_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["R", "A", "N", "Z"], ["F", "O", "X"])


@query("""
    WITH c AS (SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents WHERE lang IN ('en', 'de') GROUP BY source)
    SELECT source, round(en / (en + de), 6) AS en, round(de / (en + de), 6) AS de, en + de AS total FROM c WHERE en + de >= 5
""")
def row_normalised_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    sources = sorted(r[0] for r in d.select("source").dropna().distinct().collect())  # the rows of the table
    t = tb.cross_table(d, "source", "lang", sources, ["en", "de"])
    return tb.row_shares(t, "source", ["en", "de"], 5).select("source", F.round("en", 6).alias("en"), F.round("de", 6).alias("de"), "total")


@query("""
    SELECT l_discount >= 0.05 AS x_high, l_extendedprice >= 50000 AS y_high, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_positive, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS pct_positive FROM lineitem GROUP BY ALL
""")
def quadrant_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.quadrants(table(spark, sf_dir, "lineitem"), "l_discount", "l_extendedprice", 0.05, 50000, F.col("l_returnflag") == "R").withColumn("pct_positive", F.round("pct_positive", 6))


_UNPIVOT = "u AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS name, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem)"
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"WITH {_UNPIVOT} SELECT name, count(*) AS n, count(value) AS non_null, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean FROM u GROUP BY name")
def column_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.column_summary(table(spark, sf_dir, "lineitem"), _NUMBERS).withColumn("mean", F.round("mean", 6))


@query(f"""
    WITH {_UNPIVOT} SELECT name, count(value) AS non_null, count(*) FILTER (WHERE NOT CASE name WHEN 'l_quantity' THEN value BETWEEN 1 AND 45 ELSE value BETWEEN 0.01 AND 0.07 END) AS violations,
        round(count(*) FILTER (WHERE NOT CASE name WHEN 'l_quantity' THEN value BETWEEN 1 AND 45 ELSE value BETWEEN 0.01 AND 0.07 END) / count(value), 6) AS rate
    FROM u WHERE name IN ('l_quantity', 'l_discount') GROUP BY name
""")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.bounds_check(table(spark, sf_dir, "lineitem"), {"l_quantity": (1, 45), "l_discount": (0.01, 0.07)}).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_UNPIVOT} SELECT name, round(avg(abs(value)), 6) AS mean_abs, row_number() OVER (ORDER BY avg(abs(value)) DESC)::INTEGER AS place FROM u GROUP BY name")
def column_magnitude_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.rank_by_magnitude(table(spark, sf_dir, "lineitem"), _NUMBERS).withColumn("mean_abs", F.round("mean_abs", 6))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS p FROM c)
    SELECT user_id, event_type AS mode, n::BIGINT AS n, round(c / n, 6) AS share FROM r WHERE p = 1
""")
def modal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.modal_share(table(spark, sf_dir, "events"), ["user_id"], "event_type").withColumn("share", F.round("share", 6))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("""
    SELECT 0 AS position, 'all' AS step, count(*) AS n FROM documents UNION ALL SELECT 1, 'english', count(*) FILTER (WHERE lang = 'en') FROM documents
    UNION ALL SELECT 2, 'long', count(*) FILTER (WHERE lang = 'en' AND n_chars > 500) FROM documents
""")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.funnel(table(spark, sf_dir, "documents"), {"english": F.col("lang") == "en", "long": F.col("n_chars") > 500})


@query("SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 THEN 'Both' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def group_value_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.operators.stats import shared_label

    return shared_label(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts in event-time windows."""
    return windowed_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    WITH r AS (SELECT doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, lang, quality FROM r WHERE n <= 3
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling operator: up to three documents of each language and quality, by hash order."""
    from strandlake.operators.sampling import stratified

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")
    return stratified(d, ["lang", "quality"], "doc_id", 3)


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling operator: one hundred orders in hash order."""
    from strandlake.operators.sampling import by_hash

    return by_hash(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("""
    WITH RECURSIVE e AS (
        SELECT user_id, event_id + 1 AS pos, event_id % 128 AS phase, row_number() OVER (PARTITION BY user_id, event_id % 128 ORDER BY event_id) AS n FROM events
    ), w AS (
        SELECT user_id, pos, phase, n, 0::BIGINT AS window_no, pos AS window_first FROM e WHERE n = 1
        UNION ALL
        SELECT e.user_id, e.pos, e.phase, e.n, CASE WHEN e.pos + 1 - w.window_first > 2000 THEN w.window_no + 1 ELSE w.window_no END, CASE WHEN e.pos + 1 - w.window_first > 2000 THEN e.pos ELSE w.window_first END
        FROM w JOIN e ON e.user_id = w.user_id AND e.phase = w.phase AND e.n = w.n + 1
    ), s AS (
        SELECT *, (max(pos) OVER (PARTITION BY user_id, phase, window_no) - window_first) / 2 / 128.0::DOUBLE AS half FROM w
    )
    SELECT user_id, pos, 1::INTEGER AS span, phase, window_no, window_first, greatest(0, window_first - 1 + round_even(half, 0)::BIGINT * 128 - 4096)::BIGINT AS window_start FROM s
""")
def shared_window_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that share a window, and where a window of 8,192 letters begins."""
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") + 1).alias("pos"), F.lit(1).alias("span"))
    return iv.shared_windows(rows, ["user_id"], "pos", "span", 2000, 128, context=8192)
