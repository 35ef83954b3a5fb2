"""Overlays, checks, as-of and neighbour joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import dedup, joins, metrics, overlay
from quarry.registry import query, table


@query("label_overlay", """
SELECT d.doc_id, coalesce(a.toxic, CASE WHEN d.n_chars > 4000 THEN 1 END, s.quality) AS score FROM documents d
LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, quality FROM labels) s USING (doc_id)""")
def label_overlay(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 4000, 1).alias("own")), table(spark, d, "labels")
    out = overlay.overlay(docs, "doc_id", "own", labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("value")), labels.select("doc_id", F.col("quality").alias("value")))
    return out.select("doc_id", "score")


@query("rescored_ledger", """
SELECT o.o_orderkey, coalesce(r.o_totalprice, o.o_totalprice) AS o_totalprice, coalesce(r.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o
LEFT JOIN (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'Z' END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0) r USING (o_orderkey)""")
def rescored_ledger(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    over = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "Z").alias("o_orderstatus"))
    return overlay.overlay_columns(o, over, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("rekey_through_owner", "SELECT o_orderdate, min(p) AS p FROM (SELECT o_orderkey, extract(year FROM o_orderdate) AS p FROM orders) JOIN orders USING (o_orderkey) GROUP BY 1")
def rekey_through_owner(spark, d):
    o = table(spark, d, "orders")
    return overlay.rekey(o.select("o_orderkey", F.year("o_orderdate").cast("long").alias("p")), o.select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate", "p")


@query("label_conflicts", """
SELECT 'conflict' AS kind, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 1
UNION ALL SELECT 'unlabeled', count(*) FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'unjoinable', count(*) FROM labels ANTI JOIN documents USING (doc_id)""")
def label_conflicts(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(docs.join(labels, "doc_id").where("quality = 1 and toxic = 1"), "conflict").union(n(docs.join(labels, "doc_id", "left_anti"), "unlabeled")).union(n(labels.join(docs, "doc_id", "left_anti"), "unjoinable"))


@query("silent_sources", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND source IS NOT NULL)")
def silent_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return overlay.sources_without_rows(docs, docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id"), "source")


@query("manifest_provenance", "SELECT l_orderkey, l_linenumber, coalesce(o_orderpriority, '') AS priority FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def manifest_provenance(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("admission_times", """
SELECT l_orderkey, l_linenumber, extract(year FROM o_orderdate)::INT AS batch FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'""")
def admission_times(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.year("o_orderdate").alias("batch"))
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "batch")


@query("asof_step", """
SELECT event_id, s.value AS last_buy FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_step(spark, d):
    e = table(spark, d, "events")
    steps = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("last_buy"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), "ts", steps, "at", "last_buy", ["user_id"]).select("event_id", "last_buy")


@query("first_reaching", "SELECT min(event_id) AS event_id FROM (SELECT event_id, sum(value) OVER (ORDER BY event_id) AS total FROM events) WHERE total >= 1000")
def first_reaching(spark, d):
    from quarry.operators.ranking import running_sum

    steps = running_sum(table(spark, d, "events").select("event_id", "value"), "event_id", F.col("value"), "total")
    return joins.first_reaching(steps, "event_id", "total", 1000)


@query("walk_outcomes", "SELECT o_orderpriority, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 GROUP BY 1")
def walk_outcomes(spark, d):
    first = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber")
    return table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("recovered_arm", "SELECT d.doc_id, coalesce(nullif(d.lang, 'en'), CASE WHEN l.quality = 1 THEN 'q1' WHEN l.quality = 0 THEN 'q0' END) AS arm FROM documents d LEFT JOIN labels l USING (doc_id)")
def recovered_arm(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "q1").when(F.col("quality") == 0, "q0").alias("other"))
    return table(spark, d, "documents").join(l, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("en")), "other").alias("arm"))


@query("feasible_cells", "SELECT o.p_brand, f.flavor, s.style FROM (SELECT DISTINCT p_brand FROM part) o, (VALUES ('warm'), ('cold')) f(flavor), (VALUES ('flat'), ('deep'), ('line')) s(style)")
def feasible_cells(spark, d):
    return joins.feasible_grid(table(spark, d, "part").select("p_brand"), ("flavor", ["warm", "cold"]), ("style", ["flat", "deep", "line"]))


@query("sweep_windows", """
SELECT n_nationkey, n_regionkey + dx * 2 AS wx, n_nationkey + dy * 2 AS wy, k * 2 AS ww FROM nation, (VALUES (-0.5), (0), (0.5)) a(dx), (VALUES (-0.5), (0), (0.5)) b(dy), (VALUES (1), (0.5)) c(k)""")
def sweep_windows(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.lit(2).alias("w"))
    out = joins.sweep(n, "n_regionkey", "n_nationkey", "w", [-0.5, 0, 0.5], [1, 0.5])
    return out.select("n_nationkey", *(F.col(c).cast("double").alias(c) for c in ("wx", "wy", "ww")))


PLACED = "(SELECT s_suppkey, (s_nationkey * 100 + s_suppkey % 97)::DOUBLE AS x, s_acctbal / 100 AS y, 1 + s_suppkey % 4 AS w, s_nationkey % 3 AS g FROM supplier)"


def placed(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 100 + F.col("s_suppkey") % 97).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"), (1 + F.col("s_suppkey") % 4).alias("w"), (F.col("s_nationkey") % 3).alias("g"))


@query("theta_neighbours", f"""
SELECT a.s_suppkey, b.s_suppkey AS o_s_suppkey FROM {PLACED} a JOIN {PLACED} b ON a.s_suppkey < b.s_suppkey AND a.w * 20.0 / (b.w * 20.0) BETWEEN 1/1.5 AND 1.5
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.5 * least(a.w, b.w) * 20.0""")
def theta_neighbours(spark, d):
    return joins.viewport_neighbours(placed(spark, d).withColumn("w", F.col("w") * 20.0), "s_suppkey", "x", "y", "w")


@query("near_dup_pairs", f"""
SELECT a.s_suppkey, b.s_suppkey AS o_s_suppkey FROM {PLACED} a JOIN {PLACED} b ON a.g = b.g AND a.s_suppkey < b.s_suppkey AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 1600""")
def near_dup_pairs(spark, d):
    p = placed(spark, d).select("s_suppkey", "x", "y", "g")
    return joins.near_pairs(p, p, ["g"], "x", "y", 40.0).where("s_suppkey < o_s_suppkey").select("s_suppkey", "o_s_suppkey")


@query("same_place", f"""
SELECT a.s_suppkey, b.s_suppkey AS o_s_suppkey FROM {PLACED} a JOIN {PLACED} b ON a.s_suppkey < b.s_suppkey AND a.g = b.g
WHERE CASE WHEN a.g = 0 THEN abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10 ELSE a.w = b.w AND abs(a.y - b.y) <= 10 AND abs(a.x - b.x) <= 10 END""")
def same_place(spark, d):
    p = placed(spark, d)
    pairs = joins.near_pairs(p, p, ["g"], "x", "y", 10 * 2**0.5).where("s_suppkey < o_s_suppkey")
    close = (F.abs(F.col("x") - F.col("o_x")) <= 10) & (F.abs(F.col("y") - F.col("o_y")) <= 10)
    return pairs.where(close & ((F.col("g") == 0) | (F.col("w") == F.col("o_w")))).select("s_suppkey", "o_s_suppkey")


@query("neighbourhood_count", f"""
SELECT a.s_suppkey, count(b.s_suppkey) AS n_near FROM {PLACED} a LEFT JOIN {PLACED} b ON a.s_suppkey <> b.s_suppkey AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 900 GROUP BY 1""")
def neighbourhood_count(spark, d):
    return joins.count_within(placed(spark, d), "s_suppkey", "x", "y", 30.0)


@query("overlap_census", f"""
SELECT g, count(*) AS n FROM {PLACED} a WHERE s_suppkey % 2 = 1 AND EXISTS (SELECT 1 FROM {PLACED} b WHERE b.s_suppkey % 2 = 0 AND a.g = b.g AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 2500) GROUP BY 1""")
def overlap_census(spark, d):
    p = placed(spark, d)
    hits = joins.near_pairs(p.where("s_suppkey % 2 = 1"), p.where("s_suppkey % 2 = 0"), ["g"], "x", "y", 50.0)
    return hits.select("g", "s_suppkey").distinct().groupBy("g").agg(F.count("*").alias("n"))


COS = "round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6)"


@query("cosine_exemplars", f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT * FROM v WHERE vec_id < 8)
SELECT a.vec_id, max({COS}) AS best, round(avg({COS}), 5) AS mean FROM v a, x b GROUP BY 1""")
def cosine_exemplars(spark, d):
    v = table(spark, d, "embeddings")
    few = v.where("vec_id < 8").groupBy().agg(F.collect_list("embedding").alias("few"))  # at most eight, by the filter
    sims = F.transform("few", lambda x: F.round(V.cosine(F.col("embedding"), x), 6))
    out = v.join(F.broadcast(few), F.lit(True)).withColumn("s", sims)
    return out.select("vec_id", F.array_max("s").alias("best"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s"), 5).alias("mean"))


@query("distance_matrix", f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(1 - {COS}, 6) AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id""")
def distance_matrix(spark, d):
    """Distances within each label: the matrix is the result, so it is as large as the squares of the labels' counts."""
    return joins.cosine_distances(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("knn_graph", f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, neighbour, round(c, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, neighbour) AS rank FROM s) WHERE rank <= 3""")
def knn_graph(spark, d):
    return joins.nearest_by_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", 3).withColumn("similarity", F.round("similarity", 6))


@query("cross_tier_pairs", """
SELECT a.l_orderkey, a.l_linenumber AS hi, b.l_linenumber AS lo FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND floor(a.l_quantity / 10) > floor(b.l_quantity / 10)""")
def cross_tier_pairs(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).alias("tier"), "l_linenumber", "l_discount")
    return metrics.cross_tier_pairs(rows, "l_orderkey", "tier", "l_linenumber", "l_discount").select("l_orderkey", "hi", "lo")


@query("pair_accuracy", """
SELECT (floor(a.l_quantity / 10))::BIGINT AS tier_hi, (floor(b.l_quantity / 10))::BIGINT AS tier_lo, count(*) AS n, round(avg((a.l_discount > b.l_discount)::INT), 6) AS accuracy, round(avg(greatest(0, 0.05 - (a.l_discount - b.l_discount))), 6)::DOUBLE AS hinge
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND floor(a.l_quantity / 10) > floor(b.l_quantity / 10) GROUP BY 1, 2""")
def pair_accuracy(spark, d):
    from quarry.functions.columns import hinge

    rows = table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).alias("tier"), "l_linenumber", "l_discount")
    p = metrics.cross_tier_pairs(rows, "l_orderkey", "tier", "l_linenumber", "l_discount")
    return p.groupBy("tier_hi", "tier_lo").agg(F.count("*").alias("n"), F.round(F.avg((F.col("score_hi") > F.col("score_lo")).cast("int")), 6).alias("accuracy"), F.round(F.avg(hinge(0.05, F.col("score_hi") - F.col("score_lo"))), 6).alias("hinge"))


@query("repeat_agreement", """
SELECT a.role AS role, count(*) AS n, round(avg((length(a.text) > 200 AND length(b.text) > 200 OR length(a.text) <= 200 AND length(b.text) <= 200)::INT), 6) AS agreement
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn = 0 AND b.turn = 2 GROUP BY 1""")
def repeat_agreement(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", "turn", (F.length("text") > 200).alias("long"))
    two = c.where("turn = 0").alias("a").join(c.where("turn = 2").alias("b"), ["conv_id", "role"])
    return two.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg((F.col("a.long") == F.col("b.long")).cast("int")), 6).alias("agreement"))


@query("kept_missed", """
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS b FROM part)
SELECT count(*) FILTER (a <= 50 AND b <= 50) AS kept, count(*) FILTER (a <= 50 AND b > 50) AS missed, count(*) FILTER (a > 50 AND b <= 50) AS new FROM r""")
def kept_missed(spark, d):
    from quarry.operators.ranking import top_n

    p = table(spark, d, "part")
    old, new = top_n(p, 50, [F.col("p_retailprice").desc(), F.col("p_partkey")]), top_n(p, 50, [F.col("p_size").desc(), F.col("p_partkey")])
    m = dedup.membership(old, new, "p_partkey")
    return m.agg(F.count_if(F.col("side") == "both").alias("kept"), F.count_if(F.col("side") == "old").alias("missed"), F.count_if(F.col("side") == "new").alias("new"))


@query("recluster_diff", """
WITH c AS (SELECT p_size % 5 AS old_cluster, p_size % 7 AS new_cluster, count(*) AS n FROM part GROUP BY 1, 2)
SELECT old_cluster, new_cluster, n, count(*) OVER (PARTITION BY old_cluster) > 1 AS split, count(*) OVER (PARTITION BY new_cluster) > 1 AS merged FROM c""")
def recluster_diff(spark, d):
    p = table(spark, d, "part")
    return dedup.assignment_diff(p.select("p_partkey", (F.col("p_size") % 5).alias("c")), p.select("p_partkey", (F.col("p_size") % 7).alias("c")), "p_partkey", "c")


@query("longest_prefix", """
SELECT page_id, CASE WHEN url LIKE 'https://www.%' THEN 'www' WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http%' THEN 'web' END AS owner FROM pages""")
def longest_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", joins.covering_prefix(table(spark, d, "pages"), "url", [("http", "web"), ("https://", "secure"), ("https://www.", "www"), ("ftp", "old")]).alias("owner"))
