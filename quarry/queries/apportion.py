"""Deals, quotas, shares, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import apportion as A
from quarry.operators import ranking as R
from quarry.registry import query, table

DEAL = """
WITH c AS (SELECT p_brand, count(*) AS size, (count(*) % 3)::BIGINT AS pre FROM part GROUP BY 1), u AS (SELECT p_brand, size, pre + unnest(range(0, size)) AS level FROM c),
t AS (SELECT p_brand FROM (SELECT p_brand, row_number() OVER (ORDER BY level, size DESC, p_brand) AS rn FROM u) WHERE rn <= {n})
SELECT c.p_brand, any_value(size)::BIGINT AS size, count(t.p_brand) AS take FROM c LEFT JOIN t USING (p_brand) GROUP BY 1"""


def brands(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("size")).withColumn("pre", F.col("size") % 3)


@query("deal_round_robin", DEAL.replace("(count(*) % 3)::BIGINT", "0").format(n=137))
def deal_round_robin(spark, d):
    return A.deal(brands(spark, d), "p_brand", "size", 137)


@query("deal_preseeded", DEAL.format(n=60))
def deal_preseeded(spark, d):
    return A.deal(brands(spark, d), "p_brand", "size", 60, "pre")


@query("deal_is_balanced", "SELECT true AS balanced")
def deal_is_balanced(spark, d):
    return A.balanced(A.deal(brands(spark, d), "p_brand", "size", 137))


@query("balanced_draw_round_robin", "SELECT p_partkey, rn::INT AS turn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) ORDER BY rn, p_brand LIMIT 60")
def balanced_draw_round_robin(spark, d):
    return R.round_robin(table(spark, d, "part"), "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey")], 60).select("p_partkey", "turn")


@query("balanced_draw", """
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS size FROM part) SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY rn, size DESC, p_brand) AS o FROM r) WHERE o <= 70""")
def balanced_draw(spark, d):
    return A.draw_balanced(table(spark, d, "part"), "p_brand", ["p_partkey"], 70).select("p_partkey")


@query("reserved_draw", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders),
p AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN 30 ELSE 0 END AS pre FROM r), x AS (SELECT o_orderkey, rn, pre, row_number() OVER (ORDER BY rn - 1, size - pre DESC, o_orderstatus) AS o FROM p WHERE rn > pre)
SELECT o_orderkey, true AS reserved FROM p WHERE rn <= pre UNION ALL SELECT o_orderkey, false FROM x WHERE o <= 70""")
def reserved_draw(spark, d):
    return A.draw_reserved(table(spark, d, "orders"), "o_orderstatus", [F.col("o_totalprice").desc()], "o_orderkey", 100, {"P": 30}).select("o_orderkey", "reserved")


@query("webster_sequence", """
WITH RECURSIVE c AS (SELECT n_regionkey AS cell, count(*) AS size, row_number() OVER (ORDER BY n_regionkey) AS i FROM nation GROUP BY 1),
t AS (SELECT 0::BIGINT AS pos, -1 AS cell, list_transform(list(size ORDER BY i), lambda x: 0::BIGINT) AS taken, list(size ORDER BY i) AS sizes, list(cell ORDER BY i) AS cells, sum(size)::BIGINT AS n FROM c
UNION ALL SELECT pos + 1, cells[best], list_transform(taken, lambda x, j: CASE WHEN j = best THEN x + 1 ELSE x END), sizes, cells, n FROM (
  SELECT *, list_position(list_transform(range(1, len(sizes) + 1), lambda j: CASE WHEN taken[j] < sizes[j] THEN (pos + 1) * sizes[j] - taken[j] * n ELSE -1e18::BIGINT END),
    list_max(list_transform(range(1, len(sizes) + 1), lambda j: CASE WHEN taken[j] < sizes[j] THEN (pos + 1) * sizes[j] - taken[j] * n ELSE -1e18::BIGINT END))) AS best FROM t WHERE pos < n))
SELECT pos, cell AS n_regionkey FROM t WHERE pos > 0""")
def webster_sequence(spark, d):
    cells = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("size"))
    return A.sequence_by_deficit(cells, "n_regionkey", "size")


@query("prefix_deviation", """
WITH s AS (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) AS pos, count(*) OVER () AS n FROM part), c AS (SELECT p_brand, count(*) AS size FROM s GROUP BY 1),
g AS (SELECT c.p_brand, c.size, s.pos, s.n, sum((s.p_brand = c.p_brand)::INT) OVER (PARTITION BY c.p_brand ORDER BY s.pos) AS k FROM c, s) SELECT round(max(abs(k - pos * size / n)), 6) AS deviation FROM g""")
def prefix_deviation(spark, d):
    from pyspark.sql import Window as W

    seq = table(spark, d, "part").select("p_brand", F.row_number().over(W.orderBy("p_partkey")).alias("pos"))
    return A.prefix_deviation(seq, "p_brand", "pos").withColumn("deviation", F.round("deviation", 6))


@query("mode_allocation", """
WITH b AS (SELECT * FROM (SELECT l_suppkey, l_shipmode, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_shipmode) AS rn FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_extendedprice FROM lineitem)) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY l_shipmode ORDER BY l_extendedprice DESC, l_suppkey) AS m FROM b)
SELECT l_suppkey, l_shipmode, CASE WHEN m <= 50 // (2 + (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)) THEN 'floor' ELSE 'surplus' END AS phase FROM r ORDER BY CASE WHEN m <= 50 // (2 + (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)) THEN 0 ELSE 1 END, l_extendedprice DESC, l_suppkey LIMIT 50""")
def mode_allocation(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), "l_extendedprice")
    return A.allocate_modes(rows, "l_suppkey", "l_shipmode", "l_extendedprice", 200).select("l_suppkey", "l_shipmode", "phase")


@query("band_allocation", DEAL.replace("p_brand, count(*) AS size, (count(*) % 3)::BIGINT AS pre FROM part", "p_size // 13 AS p_brand, count(*) AS size, 0 AS pre FROM part").format(n=42).replace("c.p_brand, any", "c.p_brand AS band, any"))
def band_allocation(spark, d):
    cells = table(spark, d, "part").groupBy(F.expr("p_size div 13").cast("int").alias("band")).agg(F.count("*").alias("size"))
    return A.deal(cells, "band", "size", 42)


@query("floor_shares", "SELECT * FROM (VALUES ('a', 0.05), ('b', 0.316667), ('c', 0.316667), ('d', 0.316667)) t(part, share)")
def floor_shares(spark, d):
    got = A.floor_shares({"a": 0.0, "b": 10.0, "c": 10.0, "d": 10.0}, dict.fromkeys("abcd", 1.0), 0.05)
    return spark.createDataFrame(sorted(got.items()), "part string, share double").withColumn("share", F.round("share", 6))


@query("serve_furthest_below", """
WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, round(gap, 9) AS gap FROM (SELECT c_nationkey, 1 / 25.0 - n / sum(n) OVER () AS gap FROM c) ORDER BY round(gap, 12) DESC, c_nationkey LIMIT 1""")
def serve_furthest_below(spark, d):
    c = A.shares(table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")
    return A.furthest_below(c, "c_nationkey", F.lit(1 / 25), F.col("share")).withColumn("gap", F.round("gap", 9))


@query("deficit_per_price", """
WITH s AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) + 2000 AS price FROM supplier GROUP BY 1) SELECT s_nationkey, round(v, 9) AS value FROM (SELECT s_nationkey, greatest(0, max(n) OVER () - n) / price AS v FROM s) ORDER BY round(v, 12) DESC, s_nationkey LIMIT 1""")
def deficit_per_price(spark, d):
    from pyspark.sql import Window as W

    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), (F.avg("s_acctbal") + 2000).alias("price"))
    v = F.greatest(F.lit(0), F.max("n").over(W.partitionBy()) - F.col("n")) / F.col("price")
    return R.top_n(s.select("s_nationkey", v.alias("v")), 1, [F.round("v", 12).desc(), F.col("s_nationkey")]).select("s_nationkey", F.round("v", 9).alias("value"))


@query("intent_folding", """
WITH n AS (SELECT n_nationkey AS k, n_regionkey AS parent, n_nationkey % 3 > 0 AS ok, 1.0 + n_nationkey AS intent FROM nation) SELECT k, round(CASE WHEN ok THEN intent ELSE 0 END + coalesce((SELECT sum(intent) FROM n c WHERE NOT c.ok AND c.parent = n.k), 0), 6)::DOUBLE AS folded FROM n""")
def intent_folding(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("parent"), (F.col("n_nationkey") % 3 > 0).alias("ok"), (1.0 + F.col("n_nationkey")).alias("intent"))
    return A.fold_intent(n, "k", "parent", "intent", "ok").select("k", F.round("folded", 6).alias("folded"))


SOFT = """WITH c AS (SELECT c_nationkey, avg(c_acctbal) AS d FROM customer GROUP BY 1), e AS (SELECT c_nationkey, exp((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) / 0.35) AS e FROM c), p AS (SELECT c_nationkey, e / sum(e) OVER () AS p FROM e)
"""


@query("softmax_range_norm", SOFT + "SELECT c_nationkey, round(p, 6) AS p FROM p")
def softmax_range_norm(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("d"))
    return A.softmax_shares(c, "d", 0.35).select("c_nationkey", F.round("p", 6).alias("p"))


@query("root_allocation", SOFT + ", r AS (SELECT c_nationkey, p, floor(p * 100) AS f, p * 100 - floor(p * 100) AS rest FROM p) SELECT c_nationkey, (f + CASE WHEN row_number() OVER (ORDER BY rest DESC, p DESC, c_nationkey) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS draws FROM r")
def root_allocation(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("d"))
    return A.multinomial_expectation(A.softmax_shares(c, "d", 0.35), "p", 100).select("c_nationkey", "draws")


@query("option_choice", SOFT + ", r AS (SELECT c_nationkey, sum(p) OVER (ORDER BY c_nationkey) AS run FROM p) SELECT c_nationkey FROM r WHERE run > ('0x' || substr(md5('draw-1'), 1, 8))::BIGINT / 4294967296.0 ORDER BY run LIMIT 1")
def option_choice(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("d"))
    return A.sample_by_share(A.softmax_shares(c, "d", 0.35), "p", "c_nationkey", F.lit("draw-1")).select("c_nationkey")


@query("release_shares", "WITH r AS (SELECT r_regionkey, 1 + (r_regionkey * 7) % 3 AS ratio FROM region) SELECT r_regionkey, ratio, round(ratio / sum(ratio) OVER (), 6) AS share FROM r")
def release_shares(spark, d):
    r = table(spark, d, "region").select("r_regionkey", (1 + F.col("r_regionkey") * 7 % 3).alias("ratio"))
    return A.shares(r, "ratio").withColumn("share", F.round("share", 6))


@query("mix_completeness", "SELECT n_regionkey AS k, 'no ratio' AS problem FROM (SELECT DISTINCT n_regionkey FROM nation) WHERE n_regionkey = 4 UNION ALL SELECT 9, 'unknown'")
def mix_completeness(spark, d):
    have = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 9)], "k int")
    return A.incomplete(have, table(spark, d, "nation").select(F.col("n_regionkey").alias("k")), "k")


@query("target_measure", """
WITH w AS (SELECT n_regionkey, count(*) * (1 + n_regionkey % 2) AS weight FROM nation GROUP BY 1) SELECT n_nationkey, round(weight / (SELECT sum(weight) FROM w) / count(*) OVER (PARTITION BY n_regionkey), 8) AS target FROM nation JOIN w USING (n_regionkey)""")
def target_measure(spark, d):
    n = table(spark, d, "nation")
    w = n.groupBy("n_regionkey").agg((F.count("*") * (1 + F.first("n_regionkey") % 2)).alias("weight"))
    return A.target_measure(n, "n_regionkey", w).select("n_nationkey", F.round("target", 8).alias("target"))


@query("cell_deficit", """
WITH f AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_nationkey, n, round(n / sum(n) OVER (), 6) AS fraction, round(0.04 - n / sum(n) OVER (), 6) AS deficit FROM f""")
def cell_deficit(spark, d):
    support = table(spark, d, "nation").select("n_nationkey", F.lit(0.04).alias("target"))
    fills = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"))
    return A.cell_deficit(support, fills, ["n_nationkey"], "target").select("n_nationkey", "n", F.round("fraction", 6).alias("fraction"), F.round("deficit", 6).alias("deficit"))


@query("sampler_weights", """
WITH w AS (SELECT doc_id, 1 / sqrt(count(*) OVER (PARTITION BY lang)) / count(*) OVER (PARTITION BY source) * CASE WHEN doc_id % 4 = 0 THEN 0.4 ELSE 1 END AS w FROM documents) SELECT doc_id, round(w, 8) AS weight, round(w / sum(w) OVER (), 8) AS mass FROM w""")
def sampler_weights(spark, d):
    out = A.sampler_weights(table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 4 == 0).alias("biased")), "lang", "source", "biased")
    return out.select("doc_id", F.round("weight", 8).alias("weight"), F.round("mass", 8).alias("mass"))


@query("weighted_sample", """
WITH k AS (SELECT p_partkey, p_brand, -ln((('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296.0) / (1.0 / (1 + p_size)) AS k FROM part) SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_partkey) AS rn FROM k) WHERE rn <= 3""")
def weighted_sample(spark, d):
    return A.weighted_sample(table(spark, d, "part"), 1 / (1 + F.col("p_size")), "p_partkey", 3, ["p_brand"]).select("p_partkey")


@query("query_composition", """
SELECT p_partkey, slot, CASE WHEN p_partkey % 3 = 0 THEN 'palette' WHEN p_partkey % 3 = 1 THEN 'param' ELSE 'joint' END AS kind, ('0x' || substr(md5(p_partkey || '/' || slot), 1, 8))::BIGINT % 100 AS pick FROM part, (SELECT unnest(range(0, 6))::INT AS slot)""")
def query_composition(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("slot"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "palette").when(F.col("p_partkey") % 3 == 1, "param").otherwise("joint")
    from quarry.functions.columns import hash_pick

    return p.select("p_partkey", "slot", kind.alias("kind"), hash_pick(F.concat_ws("/", F.col("p_partkey").cast("string"), F.col("slot").cast("string")), 100).alias("pick"))


@query("alternating_sample", """
WITH c AS (SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders) WHERE s <= 2) SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS t FROM c) ORDER BY t, o_orderstatus LIMIT 90""")
def alternating_sample(spark, d):
    return A.alternating_sample(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", 2, 90).select("o_orderkey")


@query("repeats_queue", """
WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey)::DOUBLE AS w FROM customer), u AS (SELECT c_custkey, w, 1 AS pass FROM f UNION ALL SELECT c_custkey, w + 12.5, 2 FROM f WHERE w % 10 = 0) SELECT row_number() OVER (ORDER BY w, pass)::INT AS pos, c_custkey, pass FROM u""")
def repeats_queue(spark, d):
    return A.repeats_queue(table(spark, d, "customer"), "c_custkey")


@query("sitting_cut", """
WITH q AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders), a AS (SELECT * FROM q WHERE NOT o_totalprice > 250000), b AS (SELECT * FROM a WHERE NOT (o_orderstatus = 'P' AND o_custkey % 2 = 0)),
c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn FROM b), e AS (SELECT * FROM c WHERE rn = 1)
SELECT (SELECT count(*) FROM q) AS rows_in, (SELECT count(*) FROM q) - (SELECT count(*) FROM a) AS removed_interior, (SELECT count(*) FROM a) - (SELECT count(*) FROM b) AS removed_machine, (SELECT count(*) FROM b) - (SELECT count(*) FROM e) AS removed_dup, least((SELECT count(*) FROM e), 1000) AS drawn, greatest(0, (SELECT count(*) FROM e) - 1000) AS over_cap""")
def sitting_cut(spark, d):
    from quarry.plans.sitting import cut_report

    return cut_report(table(spark, d, "orders"), 250000, 1000)
