"""Counts, rates, quantiles, histograms, variance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregate as A
from quarry.registry import query, table


@query("group_counts", "SELECT source, count(*) AS n, count(quality) AS n_labeled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def group_counts(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_labeled"))


@query("rate_by_category", "SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS hits, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def rate_by_category(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    out = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("hits"))
    return out.withColumn("rate", A.rate(F.col("hits"), F.col("n")))


@query("rates_pooled_and_grouped", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50) / count(*), 4) AS rate FROM events GROUP BY GROUPING SETS ((event_type), ())")
def rates_pooled_and_grouped(spark, d):
    return A.rates(table(spark, d, "events"), "event_type", F.col("value") > 50)


@query("contingency_margins", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def contingency_margins(spark, d):
    return A.contingency(table(spark, d, "documents"), "lang", "source")


@query("batch_family_census", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def batch_family_census(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("class_currency", "SELECT c_nationkey, round(sum(CASE c_custkey % 5 WHEN 4 THEN 1.0 WHEN 3 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS currency FROM customer GROUP BY 1")
def class_currency(spark, d):
    out = A.currency(table(spark, d, "customer").withColumn("k", F.col("c_custkey") % 5), "c_nationkey", "k", {4: 1.0, 3: 0.1})
    return out.withColumn("currency", F.round("currency", 6))


@query("two_source_census", "SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def two_source_census(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))
    return both.groupBy("nation").agg(F.count("*").alias("n"))


@query("counter_reconciliation", """
SELECT * FROM (SELECT 'admitted' AS counter, count(*) FILTER (event_type = 'purchase') AS logged, count(*) FILTER (event_type = 'purchase') AS stated, true AS ok FROM events
UNION ALL SELECT 'checks', count(*), count(*) + 1, false FROM events)""")
def counter_reconciliation(spark, d):
    e = table(spark, d, "events")
    log = e.agg(F.count("*").alias("checks"), F.count_if(F.col("event_type") == "purchase").alias("admitted"))
    return A.reconcile(log, log.withColumn("checks", F.col("checks") + 1), ["checks", "admitted"])


@query("ledger_conservation", "SELECT count(*) AS rows_in, count(*) FILTER (o_orderstatus = 'F') AS admitted, count(*) FILTER (o_orderstatus = 'O') AS rejected, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS remainder FROM orders")
def ledger_conservation(spark, d):
    s = F.col("o_orderstatus")
    return A.conservation(table(spark, d, "orders"), {"admitted": s == "F", "rejected": s == "O"})


@query("occupancy_stats", """
WITH c AS (SELECT p_brand, p_type, count(*) AS size FROM part GROUP BY 1, 2)
SELECT p_brand, count(*) AS clusters, count(*) FILTER (size = 1) AS singletons, max(size) AS largest, round(count(*) FILTER (size = 1) / count(*), 4) AS singleton_share FROM c GROUP BY 1""")
def occupancy_stats(spark, d):
    return A.occupancy(table(spark, d, "part"), "p_type", "p_brand")


@query("cell_occupancy", """
WITH f AS (SELECT s.n_nationkey, count(c_custkey) AS fills FROM nation s LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON n_nationkey = c_nationkey GROUP BY 1)
SELECT count(*) FILTER (fills > 0) AS populated, count(*) FILTER (fills >= 6) AS capped, count(*) FILTER (fills = 0) AS empty FROM f""")
def cell_occupancy(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("fills"))
    f = table(spark, d, "nation").join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.coalesce("fills", F.lit(0)).alias("fills"))
    return f.agg(F.count_if(F.col("fills") > 0).alias("populated"), F.count_if(F.col("fills") >= 6).alias("capped"), F.count_if(F.col("fills") == 0).alias("empty"))


@query("currency_deficit", """
WITH h AS (SELECT c_nationkey, sum(CASE WHEN c_acctbal > 5000 THEN 1.0 WHEN c_acctbal > 0 THEN 0.1 ELSE 0 END)::DOUBLE AS currency, (1 + c_nationkey % 3)::DOUBLE AS ratio FROM customer GROUP BY 1)
SELECT c_nationkey, round(currency, 6) AS currency, round(max(currency) OVER () * ratio / max(ratio) OVER (), 6) AS target, round(greatest(0, max(currency) OVER () * ratio / max(ratio) OVER () - currency), 6) AS deficit FROM h""")
def currency_deficit(spark, d):
    worth = F.when(F.col("c_acctbal") > 5000, 1.0).when(F.col("c_acctbal") > 0, 0.1).otherwise(0.0)
    have = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sum(worth).alias("currency"))
    out = A.deficits(have, "c_nationkey", "currency", (1 + F.col("c_nationkey") % 3).cast("double"))
    return out.select("c_nationkey", *(F.round(c, 6).alias(c) for c in ("currency", "target", "deficit")))


@query("price_pool_shrink", """
WITH p AS (SELECT s_nationkey, sum(l_extendedprice) AS cost, sum(l_quantity) AS units, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT s_nationkey, round(price, 4) AS price, round(exp(0.7 * ln(price) + (1 - 0.7) * ln(median(price) OVER ())), 4) AS shrunk FROM p""")
def price_pool_shrink(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = A.shrink(A.pooled_price(rows, "s_nationkey", "l_extendedprice", "l_quantity"), "price", 0.7)
    return out.select("s_nationkey", F.round("price", 4).alias("price"), F.round("shrunk", 4).alias("shrunk"))


@query("best_over_group", "SELECT l_orderkey, max(l_extendedprice) AS best, max(l_linenumber) AS label FROM lineitem GROUP BY 1")
def best_over_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"), F.max("l_linenumber").alias("label"))


@query("fold_mean_std", """
WITH f AS (SELECT ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 5 AS fold, avg(l_discount) AS m FROM lineitem GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM f""")
def fold_mean_std(spark, d):
    from quarry.operators.metrics import fold_of

    folds = table(spark, d, "lineitem").groupBy(fold_of(F.col("l_orderkey"), 5).alias("fold")).agg(F.avg("l_discount").alias("m"))
    m = F.nanvl("m", F.lit(None).cast("double"))
    return folds.agg(F.round(F.avg(m), 6).alias("mean"), F.round(F.stddev_pop(m), 6).alias("std"))


@query("fitness_summary", """
SELECT p_brand, min(p_retailprice) AS low, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(median(p_retailprice), 6) AS median, round(avg(p_retailprice), 6) AS mean, round(quantile_cont(p_retailprice, 0.75), 6) AS p75, max(p_retailprice) AS high FROM part GROUP BY 1""")
def fitness_summary(spark, d):
    out = A.five_numbers(table(spark, d, "part"), "p_retailprice", ["p_brand"])
    return out.select("p_brand", "low", *(F.round(c, 6).alias(c) for c in ("p25", "median", "mean", "p75")), "high")


@query("linear_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.1), 4) AS q10, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1")
def linear_quantiles(spark, d):
    q = lambda p, n: F.round(F.percentile("o_totalprice", F.lit(p)), 4).alias(n)
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(q(0.1, "q10"), q(0.9, "q90"))


RANKED = "(SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@query("nearest_rank_quantile", f"SELECT p_brand, p_retailprice AS quantile FROM {RANKED} WHERE i = floor(0.3 * (n - 1) + 0.5)")
def nearest_rank_quantile(spark, d):
    return A.nearest_rank(table(spark, d, "part"), "p_retailprice", 0.3, ["p_brand"])


@query("truncating_quantile", f"SELECT p_brand, p_retailprice AS quantile FROM {RANKED} WHERE i = least(n - 1, floor(0.3::DOUBLE * n))")
def truncating_quantile(spark, d):
    return A.truncating_quantile(table(spark, d, "part"), "p_retailprice", 0.3, ["p_brand"])


@query("escape_distribution", """
WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY 1)
SELECT l_returnflag, any_value(m.n) AS n, round(any_value(mean), 6) AS mean, median(l_quantity)::DOUBLE AS median, round(any_value(std), 6) AS std, round(avg(pow((l_quantity - mean) / std, 3)), 6) AS skew, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high,
  round(quantile_cont(l_quantity, 0.05), 6)::DOUBLE AS p5, round(quantile_cont(l_quantity, 0.95), 6)::DOUBLE AS p95, round(quantile_cont(l_quantity, 0.95) - quantile_cont(l_quantity, 0.05), 6)::DOUBLE AS spread
FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def escape_distribution(spark, d):
    out = A.distribution(table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("double")).withColumnRenamed("q", "v"), "v", ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "skew", "low", "high", "p5", "p95", "spread")))


@query("weighted_histogram", """
WITH c AS (SELECT l_returnflag, floor(l_quantity / 5)::BIGINT AS bin, sum(l_discount) AS w FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, bin, round(w / (sum(w) OVER (PARTITION BY l_returnflag) + 1e-9), 6) AS share FROM c""")
def weighted_histogram(spark, d):
    out = A.weighted_histogram(table(spark, d, "lineitem"), F.floor(F.col("l_quantity") / 5), F.col("l_discount"), ["l_returnflag"])
    return out.withColumn("share", F.round("share", 6))


@query("quantile_bin_edges", """
WITH r AS (SELECT p_size, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM part), k AS (SELECT unnest(range(1, 60)) AS k),
e AS (SELECT k, p_size::DOUBLE AS edge FROM k JOIN r ON i = floor(k / 60.0 * (n - 1) + 0.5))
SELECT k::INT AS k, round(edge, 6) AS edge, row_number() OVER (PARTITION BY edge ORDER BY k) = 1 AS first FROM e""")
def quantile_bin_edges(spark, d):
    from pyspark.sql import Window as W

    out = A.quantile_edges(table(spark, d, "part"), "p_size", 60).select("k", "edge")
    return out.select("k", F.round("edge", 6).alias("edge"), (F.row_number().over(W.partitionBy(F.round("edge", 6)).orderBy("k")) == 1).alias("first"))


@query("frozen_bin_histogram", """
WITH c AS (SELECT l_returnflag, (l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, bin, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM c""")
def frozen_bin_histogram(spark, d):
    return A.frozen_histogram(table(spark, d, "lineitem"), "l_quantity", [10, 20, 40], ["l_returnflag"]).withColumn("share", F.round("share", 6))


@query("grid_bin_means", """
SELECT greatest(0, least(3, trunc((c_nationkey) / 25.0 * 4)))::BIGINT * 5 + greatest(0, least(4, trunc((c_acctbal + 1000) / 11000.0 * 5)))::BIGINT AS cell, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1 HAVING count(*) >= 10""")
def grid_bin_means(spark, d):
    out = A.grid_means(table(spark, d, "customer"), "c_acctbal", "c_nationkey", "c_acctbal", 5, 4, (-1000, 10000, 0, 25), 10)
    return out.select(F.col("cell").cast("long").alias("cell"), "n", F.round("mean", 4).alias("mean"))


@query("eta_squared", """
WITH g AS (SELECT avg(l_quantity) AS gm FROM lineitem), m AS (SELECT l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT round(sum((m - gm) * (m - gm)) / sum((l_quantity - gm) * (l_quantity - gm)), 8) AS eta_squared FROM lineitem JOIN m USING (l_linenumber), g""")
def eta_squared(spark, d):
    return A.eta_squared(table(spark, d, "lineitem"), "l_quantity", "l_linenumber").withColumn("eta_squared", F.round("eta_squared", 8))


@query("anova_icc", """
WITH g AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n*n) AS nn, sum(n*m)/sum(n) AS gm, sum(n*v) AS sw FROM g),
s AS (SELECT any_value(k) AS k, any_value(t.n) AS n, any_value(nn) AS nn, any_value(sw) AS sw, sum(g.n * (m - gm) * (m - gm)) / (any_value(k) - 1) AS msb FROM g, t),
u AS (SELECT msb, sw / (n - k) AS msw, (n - nn / n) / (k - 1) AS n0 FROM s), w AS (SELECT *, greatest(0, (msb - msw) / n0) AS between_ FROM u)
SELECT round(msb, 2) AS msb, round(msw, 2) AS msw, round(n0, 6) AS n0, round(between_, 2) AS "between", round(between_ / (between_ + msw), 6) AS icc FROM w""")
def anova_icc(spark, d):
    out = A.variance_components(table(spark, d, "customer"), "c_acctbal", "c_nationkey")
    return out.select(F.round("msb", 2).alias("msb"), F.round("msw", 2).alias("msw"), F.round("n0", 6).alias("n0"), F.round("between", 2).alias("between"), F.round("icc", 6).alias("icc"))


@query("top_mass_admit", """
WITH r AS (SELECT s_suppkey, s_acctbal, sum(s_acctbal) OVER (ORDER BY s_acctbal DESC, s_suppkey) / sum(s_acctbal) OVER () AS run FROM (SELECT * FROM supplier WHERE s_acctbal > 0))
SELECT s_suppkey FROM r WHERE s_acctbal >= (SELECT max(s_acctbal) FROM r WHERE run >= 0.6) OR s_acctbal >= 8000""")
def top_mass_admit(spark, d):
    return A.top_mass(table(spark, d, "supplier").where("s_acctbal > 0"), "s_acctbal", "s_suppkey", 0.6, 8000).select("s_suppkey")


@query("voxel_centroids", """
SELECT floor(l_quantity / 10)::BIGINT AS v_l_quantity, floor(l_discount * 100 / 4)::BIGINT AS v_disc, floor(l_tax * 100 / 4)::BIGINT AS v_tax, count(*) AS n, round(avg(l_quantity), 6) AS c_l_quantity FROM lineitem GROUP BY 1, 2, 3""")
def voxel_centroids(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("l_quantity"), (F.col("l_discount") * 100 / 4).alias("disc"), (F.col("l_tax") * 100 / 4).alias("tax"))
    out = A.voxel_centroids(rows, ["l_quantity", "disc", "tax"], 1.0)
    return out.select("v_l_quantity", "v_disc", "v_tax", "n", F.round(F.col("c_l_quantity") * 10, 6).alias("c_l_quantity"))


@query("radius_of_gyration", """
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), v AS (SELECT label, i, var_pop(x) AS v FROM e GROUP BY 1, 2) SELECT label, round(sqrt(sum(v)), 6) AS radius FROM v GROUP BY 1""")
def radius_of_gyration(spark, d):
    return A.radius_of_gyration(table(spark, d, "embeddings"), "embedding", "label").withColumn("radius", F.round("radius", 6))


@query("distinct_sets", "SELECT source, count(DISTINCT lang) AS langs, array_to_string(list_sort(list(DISTINCT lang)), ',') AS names, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY 1")
def distinct_sets(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names"), F.countDistinct("n_chars").alias("sizes"))


@query("directory_sizes", """
WITH p AS (SELECT string_split(trim(source || '/' || lang || '/' || doc_id, '/'), '/') AS p, n_chars FROM documents), e AS (SELECT '/' || array_to_string(p[1:i], '/') AS dir, n_chars FROM p, (SELECT unnest(range(0, 3)) AS i))
SELECT dir, sum(n_chars)::BIGINT AS bytes, count(*) AS files FROM e GROUP BY 1""")
def directory_sizes(spark, d):
    rows = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "n_chars")
    return A.path_sizes(rows, "path", "n_chars")


@query("price_ema", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS after, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, any_value(n) AS n, round(sum(0.3 * pow(0.7, after) * greatest(5, least(80, value))) + pow(0.7, any_value(n)) * 20, 6) AS ema FROM r GROUP BY 1""")
def price_ema(spark, d):
    return A.ema(table(spark, d, "events"), "user_id", ["event_id"], "value", 20.0, 0.3, 5.0, 80.0).withColumn("ema", F.round("ema", 6))


@query("harvest_leak_rate", "SELECT lang, round(count(*) FILTER (toxic = 1) / nullif(count(quality), 0), 4) AS leak FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def harvest_leak_rate(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(A.rate(F.count_if(F.col("toxic") == 1), F.nullif(F.count("quality"), F.lit(0))).alias("leak"))
