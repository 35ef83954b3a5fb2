"""Splits, evaluation, fits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.columns import wilson
from quarry.operators import metrics as M
from quarry.registry import query, table

DRAW = "('0x' || substr(md5('0|' || {} || '|' || {}), 1, 7))::BIGINT"
SCORED = "(SELECT doc_id, lang, source, quality AS y, (n_chars % 97) / 97.0 AS s FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 97 / 97.0).alias("s"))
    return docs.join(table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query("unit_split", """
WITH u AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM u) SELECT c_custkey, CASE WHEN rn <= round_even(0.2 * n, 0) THEN 'eval' ELSE 'train' END AS side FROM r""")
def unit_split(spark, d):
    return M.stratified_split(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 0.2).select("c_custkey", "side")


@query("linked_unit_split", """
WITH u AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, o_orderpriority FROM orders),
o AS (SELECT component, arg_min(o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END || o_orderpriority) AS o_orderpriority FROM u GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(component::VARCHAR), component) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM o)
SELECT o_orderkey, component, r.o_orderpriority, CASE WHEN rn <= round_even(0.25 * n, 0) THEN 'eval' ELSE 'train' END AS side FROM u JOIN r USING (component)""")
def linked_unit_split(spark, d):
    """A customer's orders are linked into one unit; units fall wholly on one side."""
    from quarry.operators.cluster import components

    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    edges = o.select(F.col("o_orderkey").alias("a"), F.min("o_orderkey").over(W.partitionBy("o_custkey")).alias("b"))
    units = components(o, edges, "o_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    one = M.primary(units, "component", "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return units.select("o_orderkey", "component").join(M.stratified_split(one, "component", "o_orderpriority", 0.25), "component")


@query("split_is_disjoint", "SELECT 0::BIGINT AS broken")
def split_is_disjoint(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", M.fold_of(F.col("l_orderkey"), 5).alias("fold"))
    return M.disjoint(rows, "l_orderkey", "fold").agg(F.count("*").alias("broken"))


@query("grouped_folds", "SELECT ('0x' || substr(md5(l_orderkey || 'f'), 1, 8))::BIGINT % 5 AS fold, count(*) AS n FROM lineitem GROUP BY 1")
def grouped_folds(spark, d):
    return table(spark, d, "lineitem").groupBy(M.fold_of(F.col("l_orderkey"), 5, "f").alias("fold")).agg(F.count("*").alias("n"))


@query("primary_type", "SELECT o_custkey, arg_min(o_orderpriority, CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '5-LOW' THEN 1 ELSE 2 END || o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def primary_type(spark, d):
    return M.primary(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["2-HIGH", "5-LOW"])


@query("registry_split", "SELECT source, CASE WHEN source IN ('src1', 'src2') THEN 'eval' WHEN source = 'src3' THEN 'drop' ELSE 'train' END AS side, source = 'src2' AS biased, count(*) AS n FROM documents GROUP BY 1")
def registry_split(spark, d):
    reg = spark.createDataFrame([("src1", "eval", False), ("src2", "eval", True), ("src3", "drop", False)], "source string, side string, biased boolean")
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).join(reg, "source", "left")
    return rows.select("source", F.coalesce("side", F.lit("train")).alias("side"), F.coalesce("biased", F.lit(False)).alias("biased"), "n")


AP = "WITH t AS (SELECT {g} s, sum(y) AS p, count(*) AS n FROM {t} GROUP BY ALL), r AS (SELECT *, sum(p) OVER ({w} ORDER BY s DESC) / sum(n) OVER ({w} ORDER BY s DESC) AS pr FROM t) SELECT {g} round(sum(pr * p) / nullif(sum(p), 0), 6) AS ap FROM r {e}"


@query("average_precision", AP.format(g="", t=SCORED, w="", e=""))
def average_precision(spark, d):
    return M.average_precision(scored(spark, d), "y", "s").withColumn("ap", F.round("ap", 6))


@query("average_precision_by_lang", AP.format(g="lang,", t=SCORED, w="PARTITION BY lang", e="GROUP BY lang"))
def average_precision_by_lang(spark, d):
    return M.average_precision(scored(spark, d), "y", "s", ["lang"]).withColumn("ap", F.round("ap", 6))


@query("roc_auc", f"""
WITH r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM {SCORED}) SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""")
def roc_auc(spark, d):
    return M.roc_auc(scored(spark, d), "y", "s").withColumn("auc", F.round("auc", 6))


@query("precision_at_k", f"WITH r AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS rn FROM {SCORED}) SELECT k, round(avg(y) FILTER (rn <= k), 6) AS precision FROM r, (VALUES (10), (25), (100)) v(k) GROUP BY k")
def precision_at_k(spark, d):
    return M.precision_at(scored(spark, d), "y", "s", "doc_id", [10, 25, 100]).withColumn("precision", F.round("precision", 6))


@query("spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, d):
    return M.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount").withColumn("spearman", F.round("spearman", 6))


GRID = f"g AS (SELECT round(0.02 + i * 0.01, 4)::DOUBLE AS t FROM range(97) r(i)), c AS (SELECT t, count(*) FILTER (y = 1 AND s >= t - 1e-11) AS tp, count(*) FILTER (y = 0 AND s >= t - 1e-11) AS fp, count(*) FILTER (y = 1 AND s < t - 1e-11) AS fn FROM g, {SCORED} GROUP BY t)"


@query("threshold_counts", f"WITH {GRID} SELECT * FROM c")
def threshold_counts(spark, d):
    return M.threshold_grid(scored(spark, d), F.col("y") == 1, "s")


@query("fbeta_sweep", f"WITH {GRID}, f AS (SELECT t, round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 0), 12)::DOUBLE AS f FROM c) SELECT max(t) AS t, round(max(f), 6) AS f FROM f WHERE f = (SELECT max(f) FROM f)")
def fbeta_sweep(spark, d):
    return M.best_threshold(M.threshold_grid(scored(spark, d), F.col("y") == 1, "s"), 0.5).withColumn("f", F.round("f", 6))


@query("confusion_by_lang", f"SELECT lang, count(*) FILTER (y = 1 AND s >= 0.5) AS tp, count(*) FILTER (y = 0 AND s >= 0.5) AS fp, count(*) FILTER (y = 1 AND s < 0.5) AS fn, count(*) FILTER (y = 0 AND s < 0.5) AS tn FROM {SCORED} GROUP BY 1")
def confusion_by_lang(spark, d):
    return M.confusion(scored(spark, d), F.col("y") == 1, F.col("s") >= 0.5, ["lang"])


@query("best_f1_cut", f"""
WITH s AS {SCORED}, c AS (SELECT DISTINCT s AS t FROM s), f AS (SELECT t, 2.0 * count(*) FILTER (y = 1 AND s >= t) / (2.0 * count(*) FILTER (y = 1 AND s >= t) + count(*) FILTER (y = 1 AND s < t) + count(*) FILTER (y = 0 AND s >= t)) AS f FROM c, s GROUP BY t)
SELECT round(max(t), 6) AS t, round(max(f), 6) AS f FROM f WHERE round(f, 12) = (SELECT max(round(f, 12)) FROM f)""")
def best_f1_cut(spark, d):
    out = M.best_cut(scored(spark, d), F.col("y") == 1, "s")
    return out.select(F.round("t", 6).alias("t"), F.round("f", 6).alias("f"))


@query("loo_fbeta", f"""
WITH {GRID}, x AS (SELECT doc_id, y, s, t, tp - (y = 1 AND s >= t - 1e-11)::INT AS tp, fp - (y = 0 AND s >= t - 1e-11)::INT AS fp, fn - (y = 1 AND s < t - 1e-11)::INT AS fn FROM {SCORED}, c),
f AS (SELECT doc_id, y, s, t, round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 0), 12)::DOUBLE AS f FROM x), m AS (SELECT doc_id, max(f) AS f FROM f GROUP BY 1),
b AS (SELECT f.doc_id, any_value(y) AS y, any_value(s) AS s, max(t) AS t FROM f JOIN m ON f.doc_id = m.doc_id AND f.f = m.f GROUP BY 1),
z AS (SELECT count(*) FILTER (y = 1 AND s >= t - 1e-11) AS tp, count(*) FILTER (y = 0 AND s >= t - 1e-11) AS fp, count(*) FILTER (y = 1 AND s < t - 1e-11) AS fn FROM b) SELECT *, round(1.25 * tp / (1.25 * tp + 0.25 * fn + fp), 6)::DOUBLE AS f FROM z""")
def loo_fbeta(spark, d):
    out = M.leave_one_out(scored(spark, d), "doc_id", F.col("y") == 1, "s", 0.5)
    return out.withColumn("f", F.round("f", 6))


@query("partition_thresholds", f"""
WITH s AS {SCORED}, n AS (SELECT lang, count(*) AS n, sum(y)::BIGINT AS positives FROM s GROUP BY 1), c AS (SELECT round(0.02 + i * 0.01, 4)::DOUBLE AS t FROM range(0, 97) r(i)),
g AS (SELECT lang, t, count(*) FILTER (y = 1 AND s >= t - 1e-11) AS tp, count(*) FILTER (y = 0 AND s >= t - 1e-11) AS fp, count(*) FILTER (y = 1 AND s < t - 1e-11) AS fn FROM s, c GROUP BY 1, 2),
f AS (SELECT lang, t, round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 0), 12)::DOUBLE AS f FROM g), b AS (SELECT lang, max(f) AS f FROM f GROUP BY 1), x AS (SELECT lang, max(t) AS t, f FROM f JOIN b USING (lang, f) GROUP BY lang, f)
SELECT lang, n, positives, CASE WHEN positives >= 15 THEN t END AS t, round(f, 6) AS f, CASE WHEN positives >= 15 THEN 'DERIVED' ELSE 'UNCALIBRATED' END AS status FROM n JOIN x USING (lang)""")
def partition_thresholds(spark, d):
    """Per language: positives, the best threshold, DERIVED or UNCALIBRATED (under 15 positives)."""
    rows = scored(spark, d)
    best = M.best_threshold(M.threshold_grid(rows, F.col("y") == 1, "s", ["lang"]), 0.5, ["lang"])
    n = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    status = F.when(F.col("positives") >= 15, "DERIVED").otherwise("UNCALIBRATED")
    return n.join(best, "lang").select("lang", "n", "positives", F.when(F.col("positives") >= 15, F.col("t")).alias("t"), F.round("f", 6).alias("f"), status.alias("status"))


@query("retention_cut", f"""
WITH s AS {SCORED} SELECT source, count(*) AS n, round(CASE WHEN count(*) >= 15 THEN quantile_cont(s, 0.1) ELSE (SELECT quantile_cont(s, 0.1) FROM s) END, 6) AS cut, count(*) < 15 AS is_pooled FROM s GROUP BY 1""")
def retention_cut(spark, d):
    return M.retention_cut(scored(spark, d), "source", "s", 0.9, 15).withColumn("cut", F.round("cut", 6))


@query("surfacing_metrics", """
WITH r AS (SELECT l_orderkey, (l_quantity >= 30)::INT AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem),
q AS (SELECT l_orderkey, max(good) FILTER (rn = 1) AS top, max(good) FILTER (rn <= 3) AS anyk, sum(CASE WHEN rn <= 3 THEN good ELSE 0 END) / nullif(sum(good), 0) AS rec, avg(good) AS share FROM r GROUP BY 1)
SELECT round(avg(top), 6) AS top1_good, round(avg(anyk), 6) AS topk_contains, round(avg(rec), 6) AS recall_at_k, round(avg(share), 6) AS random FROM q""")
def surfacing_metrics(spark, d):
    rows = table(spark, d, "lineitem").withColumn("good", (F.col("l_quantity") >= 30).cast("int"))
    out = M.surfacing(rows, "l_orderkey", "good", "l_extendedprice", "l_linenumber")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("wilson_interval", """
WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p FROM c)
SELECT lang, n, k, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 4) AS high FROM p""")
def wilson_interval(spark, d):
    c = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("lang", "n", "k", low.alias("low"), high.alias("high"))


@query("cluster_bootstrap", f"""
WITH k AS (SELECT l_orderkey AS k, sum(l_discount)::DOUBLE AS s, count(l_discount) AS n FROM lineitem GROUP BY 1), p AS (SELECT j, sum(exp(-1) / factorial(j::INTEGER)) OVER (ORDER BY j) AS c FROM range(0, 9) r(j)),
u AS (SELECT r, s, n, ({DRAW.format("r", "k")} + 0.5::DOUBLE) / 268435456 AS u FROM k, range(1, 201) t(r)), w AS (SELECT r, s, n, len(list_filter((SELECT list(c ORDER BY j) FROM p WHERE j < 8), lambda c: u > c)) AS w FROM u),
m AS (SELECT r, sum(w * s) / sum(w * n) AS m FROM w GROUP BY 1)
SELECT round(avg(l_discount), 6)::DOUBLE AS mean, (SELECT round(quantile_cont(m, 0.025), 6) FROM m) AS low, (SELECT round(quantile_cont(m, 0.975), 6) FROM m) AS high FROM lineitem""")
def cluster_bootstrap(spark, d):
    out = M.bootstrap(table(spark, d, "lineitem"), "l_orderkey", "l_discount", 200)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("permutation_p", f"""
WITH o AS (SELECT s_acctbal::DOUBLE AS x, s_nationkey::DOUBLE AS y, row_number() OVER (ORDER BY s_acctbal, s_nationkey) AS i FROM supplier), m AS (SELECT r, i, y, row_number() OVER (PARTITION BY r ORDER BY {DRAW.format("r", "i")}, i) AS j FROM o, range(1, 201) t(r)),
s AS (SELECT r, sum(o.x * m.y) AS s FROM m JOIN o ON o.i = m.j GROUP BY 1)
SELECT (count(*) FILTER (s >= (SELECT sum(x * y) FROM o) - 1e-9) + 1) / (count(*) + 1) AS p FROM s""")
def permutation_p(spark, d):
    return M.permutation_p(table(spark, d, "supplier"), "s_acctbal", "s_nationkey", 200)


@query("split_half_stability", f"""
WITH h AS (SELECT r, l_suppkey, l_extendedprice::DOUBLE AS v, {DRAW.format("r", "l_orderkey")} % 2 AS h FROM lineitem, range(1, 11) t(r)),
m AS (SELECT r, avg(v) FILTER (h = 0) AS a, avg(v) FILTER (h = 1) AS b FROM h GROUP BY r, l_suppkey HAVING a IS NOT NULL AND b IS NOT NULL),
k AS (SELECT r, rank() OVER (PARTITION BY r ORDER BY a) + (count(*) OVER (PARTITION BY r, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY r ORDER BY b) + (count(*) OVER (PARTITION BY r, b) - 1) / 2 AS rb FROM m),
c AS (SELECT r, corr(ra, rb) AS rho FROM k GROUP BY 1) SELECT round(median(rho), 6) AS median_rho, count(rho) AS splits FROM c""")
def split_half_stability(spark, d):
    out = M.split_half(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_extendedprice", 10)
    return out.withColumn("median_rho", F.round("median_rho", 6))


@query("run_comparison", """
WITH w AS (SELECT event_id % 2 AS arm, count(*) FILTER (event_type = 'purchase') AS hits, count(*) AS n FROM events GROUP BY 1), p AS (SELECT max(hits / n) FILTER (arm = 0) AS a, max(hits / n) FILTER (arm = 1) AS b, min(n) AS n FROM w)
SELECT round(b / a, 6) AS ratio, CASE WHEN n < 100 THEN 'VOID' WHEN b / a >= 1.1 THEN 'WIN' WHEN b / a <= 0.9 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM p""")
def run_comparison(spark, d):
    w = table(spark, d, "events").groupBy((F.col("event_id") % 2).alias("arm")).agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("r"), F.count("*").alias("n"))
    p = w.agg(F.max(F.when(F.col("arm") == 0, F.col("r"))).alias("a"), F.max(F.when(F.col("arm") == 1, F.col("r"))).alias("b"), F.min("n").alias("n"))
    ratio = F.try_divide("b", "a")
    return p.select(F.round(ratio, 6).alias("ratio"), F.when(F.col("n") < 100, "VOID").when(ratio >= 1.1, "WIN").when(ratio <= 0.9, "LOSS").otherwise("TIE").alias("verdict"))


@query("oof_logistic")
def oof_logistic(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").cast("double").alias("q"), "l_discount", (F.col("l_extendedprice") > 40000).cast("int").alias("y"), M.fold_of(F.col("l_orderkey"), 3).alias("fold"))
    return M.out_of_fold_logistic(rows, "k", ["q", "l_discount"], "y", "fold").withColumn("p", F.round("p", 6))


@query("ridge_fit", """
SELECT name, round(value, 4) AS value FROM (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem) UNPIVOT (value FOR name IN (a, b))""")
def ridge_fit(spark, d):
    w = M.ridge(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 0.0)
    return spark.createDataFrame([("a", round(float(w[0]), 4)), ("b", round(float(w[1]), 4))], "name string, value double")


@query("bradley_terry")
def bradley_terry(spark, d):
    pairs = M.cross_tier_pairs(table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).alias("tier"), (F.col("l_suppkey") % 20).alias("s"), "l_discount"), "l_orderkey", "tier", "s", "l_discount")
    return M.bradley_terry(pairs.where("hi <> lo"), "hi", "lo").withColumn("strength", F.round("strength", 6))


@query("location_ranker", """
WITH s AS (SELECT p_partkey, 1 / (1 + exp(-((p_retailprice - 1400) / 300 + (p_size - 25) / 15))) AS score FROM part) SELECT p_partkey, round(score, 6) AS score, round(cume_dist() OVER (ORDER BY round(score, 9)), 6) AS pct FROM s""")
def location_ranker(spark, d):

    from quarry.functions.columns import linear_score

    s = table(spark, d, "part").select("p_partkey", linear_score([(F.col("p_retailprice"), 1400, 300, 1.0), (F.col("p_size"), 25, 15, 1.0)], 0.0).alias("score"))
    return s.select("p_partkey", F.round("score", 6).alias("score"), F.round(F.cume_dist().over(W.orderBy(F.round("score", 9))), 6).alias("pct"))
