"""Ranks, percentiles and running values."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import dedup
from quarry.operators import ranking as R
from quarry.registry import query, table


@query("niche_percentile", "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_type, p_size % 5 ORDER BY p_retailprice), 6) AS pct FROM part")
def niche_percentile(spark, d):
    return table(spark, d, "part").withColumn("b", F.col("p_size") % 5).select("p_partkey", F.round(R.niche_percentile("p_retailprice", ["p_type", "b"]), 6).alias("pct"))


AVG = "(rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2)"


@query("pct_rank_average_ties", f"SELECT p_partkey, {AVG}::DOUBLE AS avg_rank, round(({AVG} - 1) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0), 6) AS pct FROM part")
def pct_rank_average_ties(spark, d):
    return table(spark, d, "part").select("p_partkey", R.average_rank(F.col("p_size"), ["p_brand"]).alias("avg_rank"), F.round(R.percent_rank(F.col("p_size"), ["p_brand"]), 6).alias("pct"))


@query("queue_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority DESC, coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END, -1e9) DESC, o_orderkey)::INT AS place FROM orders")
def queue_rank(spark, d):
    rows = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_totalprice")))
    return rows.select("o_orderkey", R.queue_rank("o_orderpriority", "s", ["o_orderkey"], ["o_orderstatus"]).alias("place"))


@query("first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark, d):
    return dedup.first_wins(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("last_wins_first_position", """
WITH e AS (SELECT event_id, CASE WHEN user_id % 10 > 0 THEN user_id END AS u, value FROM events)
SELECT u, event_id, value, first_position FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY event_id DESC) AS rn, min(event_id) OVER (PARTITION BY u) AS first_position FROM e WHERE u IS NOT NULL) WHERE rn = 1
UNION ALL SELECT u, event_id, value, event_id FROM e WHERE u IS NULL""")
def last_wins_first_position(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 10 > 0, F.col("user_id")).alias("u"), "value")
    return dedup.last_wins(e, "u", "event_id")


@query("top_two_gap", """
WITH r AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS n FROM lineitem)
SELECT l_orderkey, max(l_extendedprice) AS best, max(l_extendedprice) FILTER (n = 2) AS second, round(max(l_extendedprice) - max(l_extendedprice) FILTER (n = 2), 6) AS gap FROM r WHERE n <= 2 GROUP BY 1""")
def top_two_gap(spark, d):
    return R.top_gap(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice").withColumn("gap", F.round("gap", 6))


@query("running_distinct", """
WITH f AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS fresh FROM events) SELECT event_id, fresh, sum(fresh::INT) OVER (ORDER BY event_id)::BIGINT AS distinct_so_far FROM f""")
def running_distinct(spark, d):
    return R.first_seen_curve(table(spark, d, "events").select("event_id", "user_id"), "event_id", "user_id").select("event_id", "fresh", "distinct_so_far")


@query("hourly_rate", """
WITH m AS (SELECT epoch(ts - (SELECT min(ts) FROM events)) / 60.0 AS m FROM events), b AS (SELECT least(floor(m / 60), ceil(2430.0 / 60) - 1)::BIGINT AS bin, count(*) AS n FROM m WHERE m <= 2430 GROUP BY 1)
SELECT bin, n, least(60.0, 2430.0 - bin * 60)::DOUBLE AS width, round(n * 60 / least(60.0, 2430.0 - bin * 60), 6)::DOUBLE AS rate FROM b""")
def hourly_rate(spark, d):
    e = table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    start = e.agg(F.min("us")).first()[0]
    return R.time_bins(e, (F.col("us") - start) / 60e6, 60.0, 2430.0).withColumn("rate", F.round("rate", 6))


@query("running_percentile", """
SELECT a.user_id, a.event_id, a.value, count(b.event_id) AS seen, count(*) FILTER (b.value < a.value) AS below, CASE WHEN count(b.event_id) >= 5 THEN round(count(*) FILTER (b.value < a.value) / count(b.event_id), 6) ELSE 0.5 END AS percentile
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id GROUP BY 1, 2, 3""")
def running_percentile(spark, d):
    return R.running_percentile(table(spark, d, "events"), "user_id", "event_id", "value", 5).withColumn("percentile", F.round("percentile", 6))


@query("within_query_position", """
WITH p AS (SELECT l_quantity, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) - 1) / nullif(count(*) OVER (PARTITION BY l_orderkey) - 1, 0) AS pos FROM lineitem) SELECT floor(l_quantity / 10)::BIGINT AS tier, round(avg(pos), 6) AS position FROM p GROUP BY 1""")
def within_query_position(spark, d):
    rows = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("tier"), R.within_position(["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")]).alias("p"))
    return rows.groupBy("tier").agg(F.round(F.avg("p"), 6).alias("position"))


@query("recency_memory", """
WITH b AS (SELECT event_id, user_id, event_id // 100 AS block FROM events) SELECT event_id, EXISTS (SELECT 1 FROM b p WHERE p.user_id = b.user_id AND p.block BETWEEN b.block - 3 AND b.block - 1) AS seen FROM b""")
def recency_memory(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.expr("event_id div 100").alias("block"))
    return R.recency_window(rows, "block", "user_id", 3).select("event_id", "seen")


@query("consecutive_differences", """
WITH s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d, event_id, value FROM events)
SELECT user_id, round(sum(d), 6) AS variation, round(abs(arg_max(value, event_id) - arg_min(value, event_id)), 6) AS seam, count(d) AS steps FROM s GROUP BY 1""")
def consecutive_differences(spark, d):
    out = R.consecutive(table(spark, d, "events"), "user_id", "event_id", "value")
    return out.select("user_id", F.round("variation", 6).alias("variation"), F.round("seam", 6).alias("seam"), "steps")


@query("integer_crossings", """
WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 11 > 0 THEN value / 10 END AS v FROM events), c AS (SELECT user_id, abs(floor(v) - floor(lag(v) OVER (PARTITION BY user_id ORDER BY event_id))) AS c FROM s) SELECT user_id, coalesce(sum(c), 0)::DOUBLE AS crossings FROM c GROUP BY 1""")
def integer_crossings(spark, d):
    from quarry.functions.vectors import crossings

    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 11 > 0, F.col("value") / 10).otherwise(F.lit(float("nan"))).alias("v"))
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "v"))).alias("s"))  # a user's events, as the operator works on arrays
    return lists.select("user_id", crossings(F.transform("s", lambda x: x["v"])).alias("crossings"))


@query("frozen_percentile_of_rank", "SELECT l_linenumber, round(percent_rank() OVER (ORDER BY s), 6) AS pct FROM (SELECT l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY 1)")
def frozen_percentile_of_rank(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("s"))
    return s.select("l_linenumber", F.round(F.percent_rank().over(W.orderBy("s")), 6).alias("pct"))
