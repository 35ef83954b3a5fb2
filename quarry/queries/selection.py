"""Draws from the top, greedy selections, clusters, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cluster, dedup, greedy
from quarry.operators import ranking as R
from quarry.registry import query, table


@query("enriched_plus_reserve", """
WITH e AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40), r AS (SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 40)
SELECT o_orderkey, max(role) AS role FROM (SELECT o_orderkey, 'enriched' AS role FROM e UNION ALL SELECT o_orderkey, 'reserve' FROM r) GROUP BY 1""")
def enriched_plus_reserve(spark, d):
    return R.enriched_with_reserve(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 40, 40).select("o_orderkey", "role")


@query("frontier_pop", """
WITH l AS (SELECT *, o_orderpriority = '1-URGENT' AS res FROM orders WHERE o_custkey % 7 < 5), r AS (SELECT *, row_number() OVER (PARTITION BY res ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM l)
SELECT o_orderkey FROM r ORDER BY CASE WHEN res AND rn <= 8 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 32""")
def frontier_pop(spark, d):
    rows = table(spark, d, "orders").withColumn("used", F.col("o_custkey") % 7)
    return R.pop_batch(rows, "o_custkey", "used", 5, F.col("o_orderpriority") == "1-URGENT", 0.25, 32, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("frontier_prune", """
WITH r AS (SELECT *, o_orderstatus = 'P' AS p, row_number() OVER (PARTITION BY o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_orderkey FROM r ORDER BY CASE WHEN p AND rn <= 100 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 500""")
def frontier_prune(spark, d):
    return R.prune(table(spark, d, "orders"), F.col("o_orderstatus") == "P", 0.2, 500, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("per_parent_top_n", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 2")
def per_parent_top_n(spark, d):
    return R.top_n(table(spark, d, "lineitem"), 2, [F.col("l_extendedprice").desc(), F.col("l_linenumber")], ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("dive_plan", """
SELECT o_orderkey, 'top' AS kind FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12)
UNION ALL SELECT o_orderkey, 'control' FROM (SELECT o_orderkey FROM orders WHERE o_totalprice < 200000 ORDER BY md5(o_orderkey::VARCHAR || 'dive'), o_orderkey LIMIT 12)""")
def dive_plan(spark, d):
    o = table(spark, d, "orders")
    top = R.top_n(o, 12, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", F.lit("top").alias("kind"))
    return top.union(R.top_n(o.where("o_totalprice < 200000"), 12, [R.hash_order(F.col("o_orderkey"), "dive"), F.col("o_orderkey")]).select("o_orderkey", F.lit("control").alias("kind")))


@query("stratified_sample", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR || 's1'), o_orderkey) AS rn FROM orders) WHERE rn <= 25")
def stratified_sample(spark, d):
    return R.stratified_sample(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", 25, "s1").select("o_orderkey")


def thinned(order: str, radius: float) -> str:
    """SQL of f: per nation (g) and row number the customers kept so far, none within the radius of an earlier one."""
    return f"""
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal::DOUBLE AS x, (c_custkey % 1000)::DOUBLE AS y, row_number() OVER (PARTITION BY c_nationkey ORDER BY {order}) AS i FROM customer),
f AS (SELECT DISTINCT g, 0::BIGINT AS i, []::STRUCT(k BIGINT, x DOUBLE, y DOUBLE)[] AS m FROM c
UNION ALL SELECT c.g, c.i, CASE WHEN len(list_filter(f.m, lambda q: (q.x - c.x) ** 2 + (q.y - c.y) ** 2 < {radius} ** 2)) = 0 THEN list_append(f.m, {{'k': c.k, 'x': c.x, 'y': c.y}}) ELSE f.m END FROM f JOIN c ON c.g = f.g AND c.i = f.i + 1)
"""


@query("candidate_assembly", thinned("c_acctbal, c_custkey", 60) + """
SELECT c_custkey, c_nationkey, x, y FROM (SELECT k AS c_custkey, g AS c_nationkey, x, y, row_number() OVER (PARTITION BY g ORDER BY x DESC, k) AS rn FROM (SELECT g, unnest(arg_max(m, i), recursive := true) FROM f GROUP BY g)) WHERE rn <= 32""")
def candidate_assembly(spark, d):
    """Per nation the best customers, thinned in space, up to target + max(12, ceil(0.3 target)) rows."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    kept = greedy.spatial_dedup(c, ["c_nationkey"], ["x"], "c_custkey", "x", "y", 60.0)
    target = 20
    return R.top_n(c.join(kept, "c_custkey"), target + max(12, -(-3 * target // 10)), [F.col("x").desc(), F.col("c_custkey")], ["c_nationkey"])


@query("maximin_order", """
WITH RECURSIVE v AS (SELECT vec_id AS k, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT k, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
f AS (SELECT label, 0::BIGINT AS place, arg_min(e, k) AS last, min(k) AS vec_id, list({'k': k, 'e': e, 'far': 1e9} ORDER BY k) AS m FROM n GROUP BY 1
UNION ALL SELECT label, place + 1, list_filter(m, lambda q: q.k = b)[1].e, b, m FROM (SELECT label, place, m, list_filter(m, lambda q: round(q.far, 12) = list_max(list_transform(m, lambda r: round(r.far, 12))))[1].k AS b FROM (
  SELECT label, place, list_transform(list_filter(f.m, lambda q: q.k <> f.vec_id), lambda q: {'k': q.k, 'e': q.e, 'far': least(q.far, 1 - list_dot_product(q.e, f.last))}) AS m FROM f WHERE place < 9)) WHERE b IS NOT NULL)
SELECT place, vec_id, label FROM f""")
def maximin_order(spark, d):
    return greedy.maximin_order(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 10)


@query("map_elites_core", "SELECT p_type, p_size // 10 AS bucket, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_size // 10 ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1")
def map_elites_core(spark, d):
    p = table(spark, d, "part").withColumn("bucket", F.expr("p_size div 10").cast("int"))
    return R.top_n(p, 1, [F.col("p_retailprice").desc(), F.col("p_partkey")], ["p_type", "bucket"]).select("p_type", "bucket", "p_partkey")


@query("map_elites_capped", """
WITH RECURSIVE p AS (SELECT p_partkey, p_type || '|' || p_size // 10 AS cell, p_brand, p_name, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part),
f AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS cells, []::VARCHAR[] AS brands, []::VARCHAR[] AS names, []::BIGINT[] AS keys
UNION ALL SELECT i, CASE WHEN ok THEN list_append(cells, cell) ELSE cells END, CASE WHEN ok THEN list_append(brands, p_brand) ELSE brands END, CASE WHEN ok THEN list_append(names, p_name) ELSE names END, CASE WHEN ok THEN list_append(keys, p_partkey) ELSE keys END FROM (
  SELECT p.*, f.cells, f.brands, f.names, f.keys, NOT list_contains(f.cells, p.cell) AND NOT list_contains(f.names, p.p_name) AND len(list_filter(f.brands, lambda b: b = p.p_brand)) < 5 AS ok FROM f JOIN p ON p.i = f.i + 1))
SELECT unnest(arg_max(keys, i)) AS p_partkey FROM f""")
def map_elites_capped(spark, d):
    p = table(spark, d, "part").withColumn("bucket", F.expr("p_size div 10").cast("int"))
    return greedy.map_elites(p, ["p_type", "bucket"], "p_partkey", "p_retailprice", "p_brand", 5, "p_name")


@query("marginal_gain_select", """
WITH RECURSIVE v AS (SELECT vec_id AS k, label, embedding::DOUBLE[] AS e, (vec_id * 37 % 101)::DOUBLE AS s FROM embeddings),
n AS (SELECT k, label, s, cume_dist() OVER (PARTITION BY label ORDER BY s) AS pct, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
f AS (SELECT label, -1::BIGINT AS place, NULL::BIGINT AS vec_id, NULL::DOUBLE AS gain, list({'k': k, 'e': e, 's': s, 'pct': pct, 'near': 0.0::DOUBLE} ORDER BY s DESC, k) AS m FROM n GROUP BY 1
UNION ALL SELECT label, place + 1, b.k, round(b.pct * (1 - b.near), 12), list_transform(list_filter(m, lambda q: q.k <> b.k), lambda q: {'k': q.k, 'e': q.e, 's': q.s, 'pct': q.pct, 'near': greatest(q.near, list_dot_product(q.e, b.e))}) FROM (
  SELECT label, place, m, list_filter(m, lambda q: round(q.pct * (1 - q.near), 12) = list_max(list_transform(m, lambda r: round(r.pct * (1 - r.near), 12))))[1] AS b FROM f WHERE place < 4 AND len(m) > 0))
SELECT place, vec_id, gain FROM f WHERE place >= 0""")
def marginal_gain_select(spark, d):
    v = table(spark, d, "embeddings").withColumn("score", F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double"))
    return greedy.marginal_gain(v, ["label"], "vec_id", "embedding", "score", 5)


@query("collision_assign")
def collision_assign(spark, d):
    return greedy.collision_assign(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 6, 0.5, 0.2)


@query("namespaced_union", """
SELECT lower(part) || '__' || k AS ns_id, nation FROM (SELECT *, row_number() OVER (PARTITION BY nation, grp ORDER BY ord, k) AS rn FROM (
SELECT 'Customer' AS part, 0 AS ord, c_custkey AS k, c_nationkey AS nation, c_custkey % 10 AS grp FROM customer UNION ALL SELECT 'Supplier', 1, s_suppkey, s_nationkey, s_suppkey % 15 FROM supplier)) WHERE rn = 1""")
def namespaced_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 10).alias("grp"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 15).alias("grp"))
    return dedup.namespaced_union([("Customer", c), ("Supplier", s)], "k", ["nation", "grp"])[0].select("ns_id", "nation")


@query("union_diagnostics", """
SELECT part, count(*) AS n_rows, count(*) FILTER (rn = 1) AS n_kept, count(*) FILTER (rn > 1) AS n_overlap FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY ord, k) AS rn FROM (
SELECT 'customer' AS part, 0 AS ord, c_custkey AS k, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', 1, s_suppkey, s_nationkey FROM supplier)) GROUP BY 1""")
def union_diagnostics(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    return dedup.namespaced_union([("customer", c), ("supplier", s)], "k", ["nation"])[1]


@query("signature_dedup", "SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY list_transform(embedding[1:3], lambda x: round_even(x::DOUBLE / 0.2, 0) + 0)")
def signature_dedup(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("v"))
    return dedup.by_signature(v, "v", 0.2, ["vec_id"]).select("vec_id")


@query("greedy_spatial_dedup", thinned("c_custkey", 200) + "SELECT unnest(arg_max(m, i)).k AS c_custkey FROM f GROUP BY g")
def greedy_spatial_dedup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    return greedy.spatial_dedup(c, ["c_nationkey"], [], "c_custkey", "x", "y", 200.0)


CHAIN = """
WITH RECURSIVE s AS (SELECT s_suppkey, s_acctbal AS x, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
f AS (SELECT 1::BIGINT AS i, [x] AS kept, [s_suppkey] AS keys FROM s WHERE i = 1
UNION ALL SELECT s.i, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - s.x) < 120)) = 0 THEN list_append(f.kept, s.x) ELSE f.kept END, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - s.x) < 120)) = 0 THEN list_append(f.keys, s.s_suppkey) ELSE f.keys END FROM f JOIN s ON s.i = f.i + 1)
SELECT unnest(arg_max(keys, i)) AS s_suppkey FROM f"""


@query("spacing_thinning", CHAIN)
def spacing_thinning(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return greedy.spatial_dedup(s, [], [], "s_suppkey", "x", "y", 120.0)


@query("near_dup_cloud", """
WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS g, s_acctbal::DOUBLE AS x, 100.0::DOUBLE + s_suppkey % 900 AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
f AS (SELECT DISTINCT g, 0::BIGINT AS i, []::STRUCT(k BIGINT, x DOUBLE, w DOUBLE)[] AS m FROM s
UNION ALL SELECT s.g, s.i, CASE WHEN len(list_filter(f.m, lambda q: abs(q.x - s.x) < 0.25 * least(q.w, s.w))) = 0 THEN list_append(f.m, {'k': s.k, 'x': s.x, 'w': s.w}) ELSE f.m END FROM f JOIN s ON s.g = f.g AND s.i = f.i + 1)
SELECT unnest(arg_max(m, i)).k AS s_suppkey FROM f GROUP BY g""")
def near_dup_cloud(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"), (100.0 + F.col("s_suppkey") % 900).alias("w"))
    return greedy.near_dup_cloud(s, ["s_nationkey"], "s_suppkey", "x", "y", "w")


@query("medoid_clusters", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
n AS (SELECT vec_id, label, i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
f AS (SELECT label, 1::BIGINT AS i, vec_id, vec_id AS cluster, [{'k': vec_id, 'e': e}] AS m FROM n WHERE i = 1
UNION ALL SELECT label, i, vec_id, CASE WHEN s > 0.35 THEN b ELSE vec_id END, CASE WHEN s > 0.35 THEN m ELSE list_append(m, {'k': vec_id, 'e': e}) END FROM (
  SELECT n.label, n.i, n.vec_id, n.e, f.m, list_max(list_transform(f.m, lambda q: round(list_dot_product(q.e, n.e), 12))) AS s,
    list_filter(f.m, lambda q: round(list_dot_product(q.e, n.e), 12) = list_max(list_transform(f.m, lambda r: round(list_dot_product(r.e, n.e), 12))))[1].k AS b FROM f JOIN n ON n.label = f.label AND n.i = f.i + 1))
SELECT vec_id, cluster FROM f""")
def medoid_clusters(spark, d):
    return greedy.medoid_clusters(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.35)


@query("distinct_looks", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
n AS (SELECT vec_id, label, i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
f AS (SELECT DISTINCT label, 0::BIGINT AS i, NULL::BIGINT AS vec_id, NULL::BOOLEAN AS fresh, []::DOUBLE[][] AS m FROM n
UNION ALL SELECT label, i, vec_id, fresh, CASE WHEN fresh THEN list_append(m, e) ELSE m END FROM (
  SELECT n.label, n.i, n.vec_id, n.e, f.m, len(list_filter(f.m, lambda q: list_dot_product(q, n.e) >= 0.974)) = 0 AS fresh FROM f JOIN n ON n.label = f.label AND n.i = f.i + 1))
SELECT vec_id, fresh FROM f WHERE i > 0""")
def distinct_looks(spark, d):
    return greedy.distinct_looks(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 0.974)


LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.4),
c AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT l.b, c.r FROM c JOIN l ON c.vec_id = l.a WHERE c.r < l.b)
"""


@query("connected_components", LINKS + "SELECT vec_id, min(r) AS component FROM c GROUP BY 1")
def connected_components(spark, d):
    return cluster.single_linkage(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4, ["label"])


@query("component_representatives", LINKS + "SELECT component AS vec_id, count(*) AS size FROM (SELECT vec_id, min(r) AS component FROM c GROUP BY 1) GROUP BY 1")
def component_representatives(spark, d):
    comps = cluster.single_linkage(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4, ["label"])
    return comps.groupBy(F.col("component").alias("vec_id")).agg(F.count("*").alias("size"))


@query("viewport_groups", """
WITH RECURSIVE s AS (SELECT s_suppkey, s_acctbal AS x FROM supplier), l AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey AND abs(a.x - b.x) <= 40),
c AS (SELECT s_suppkey, s_suppkey AS r FROM s UNION SELECT l.b, c.r FROM c JOIN l ON c.s_suppkey = l.a WHERE c.r < l.b) SELECT s_suppkey, min(r) AS component FROM c GROUP BY 1""")
def viewport_groups(spark, d):
    from quarry.operators.joins import line_links

    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"))
    return cluster.components(s, line_links(s, "s_suppkey", "x", 40.0), "s_suppkey")


@query("agglomerative_cuts")
def agglomerative_cuts(spark, d):
    return cluster.agglomerate(table(spark, d, "embeddings"), "label", "vec_id", "embedding", [2, 5, 10])


@query("nesting_check")
def nesting_check(spark, d):
    cuts = cluster.agglomerate(table(spark, d, "embeddings"), "label", "vec_id", "embedding", [2, 5])
    return cuts.groupBy("cut_5").agg(F.countDistinct("cut_2").alias("parents")).agg(F.bool_and(F.col("parents") == 1).alias("nested"))


@query("kmeans_cells")
def kmeans_cells(spark, d):
    return cluster.kmeans(table(spark, d, "embeddings"), "embedding", 12).select("vec_id", "cell", F.round("distance", 6).alias("distance"))


@query("hamming_dedup", """
WITH h AS (SELECT doc_id, ('0x' || substr(md5(lang || n_chars % 40), 1, 8))::BIGINT AS h FROM documents), c AS (SELECT h, min(doc_id) AS first, count(*) AS n FROM h GROUP BY 1),
l AS (SELECT a.h, any_value(a.first) AS first, sum(b.n)::BIGINT - 1 AS n_links FROM c a JOIN c b ON bit_count(xor(a.h, b.h)) <= 6 GROUP BY 1) SELECT doc_id, first, n_links FROM h JOIN l USING (h)""")
def hamming_dedup(spark, d):
    code = F.conv(F.substring(F.md5(F.concat(F.col("lang"), (F.col("n_chars") % 40).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return cluster.hamming_counts(table(spark, d, "documents").select("doc_id", code.alias("h")), "doc_id", "h", 6).select("doc_id", "first", "n_links")


@query("perceptual_hash", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), m AS (SELECT vec_id, e[1:64] AS e, (list_sort(e[1:64])[32] + list_sort(e[1:64])[33]) / 2 AS m FROM e),
b AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN e[i] > m THEN CASE WHEN i = 64 THEN -9223372036854775808::HUGEINT ELSE (2::HUGEINT ** (i - 1))::HUGEINT END ELSE 0::HUGEINT END) AS b FROM m)
SELECT vec_id, list_sum(b)::BIGINT AS h, len(list_filter(b, lambda x: x <> 0))::INT AS bits FROM b""")
def perceptual_hash(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", cluster.average_hash(F.col("embedding")).alias("h"))
    return v.select("vec_id", "h", F.bit_count("h").alias("bits"))


@query("membership_diff", """
SELECT k, CASE WHEN b IS NULL THEN 'old' WHEN a IS NULL THEN 'new' ELSE 'both' END AS side FROM (SELECT coalesce(a.k, b.k) AS k, a.k AS a, b.k AS b FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k)""")
def membership_diff(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return dedup.membership(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


@query("pair_classes", """
SELECT CASE WHEN a.p_brand = b.p_brand THEN 'sampler_dup' ELSE 'perceptual_collapse' END AS class, count(*) AS n FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey GROUP BY 1""")
def pair_classes(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    of = lambda c: F.col(c) * (F.col(c) - 1) / 2  # noqa: E731  pairs among so many
    brands = p.groupBy("p_type", "p_size", "p_brand").agg(F.count("*").alias("n"))
    groups = brands.groupBy("p_type", "p_size").agg(F.sum("n").alias("all"), F.sum(of("n")).alias("same"))
    both = groups.agg(F.sum("same").alias("same"), F.sum(of("all") - F.col("same")).alias("other"))
    return both.select(F.explode(F.create_map(F.lit("sampler_dup"), "same", F.lit("perceptual_collapse"), "other")).alias("class", "n")).where("n > 0").select("class", F.col("n").cast("long").alias("n"))


@query("spaced_pool", """
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS g, c_acctbal::DOUBLE AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
f AS (SELECT DISTINCT g, 0::BIGINT AS i, []::STRUCT(k BIGINT, x DOUBLE)[] AS m FROM c
UNION ALL SELECT c.g, c.i, CASE WHEN len(f.m) < 12 AND len(list_filter(f.m, lambda q: abs(q.x - c.x) < 300)) = 0 THEN list_append(f.m, {'k': c.k, 'x': c.x}) ELSE f.m END FROM f JOIN c ON c.g = f.g AND c.i = f.i + 1)
SELECT unnest(arg_max(m, i)).k AS c_custkey FROM f GROUP BY g""")
def spaced_pool(spark, d):
    return greedy.spaced_pool(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 300.0, 12)
