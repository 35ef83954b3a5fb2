"""Keys, predicates, decoding, JSON fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.registry import query, table


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k, json_exists(props, '$.missing') AS has_missing, length(props) AS n FROM events")
def json_props(spark, d):
    p = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").cast("long").alias("k"), F.get_json_object(p, "$.missing").isNotNull().alias("has_missing"), F.length(p).cast("long").alias("n"))


@query("location_key_dedup", """
SELECT k, min(c_custkey) AS first_key, count(*) AS n FROM (
  SELECT c_custkey, coalesce(c_mktsegment, '') || '|' || coalesce(c_nationkey::VARCHAR, '') || '|' || coalesce(nullif(c_custkey % 3, 0)::VARCHAR, '') AS k FROM customer) GROUP BY k""")
def location_key_dedup(spark, d):
    key = C.location_key("c_mktsegment", "c_nationkey", F.nullif(F.col("c_custkey") % 3, F.lit(0)))
    return table(spark, d, "customer").groupBy(key.alias("k")).agg(F.min("c_custkey").alias("first_key"), F.count("*").alias("n"))


@query("composite_join_key", """
SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""")
def composite_join_key(spark, d):
    p = table(spark, d, "part")
    one = p.groupBy(C.join_key(F.col("p_brand"), "p_type", "p_size").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    return one.select(F.col("k.location").alias("p_brand"), "k.p_type", "k.p_size", "n")


@query("hash_pick", "SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 17 AS pick FROM documents")
def hash_pick(spark, d):
    return table(spark, d, "documents").select("doc_id", C.hash_pick(F.col("doc_id"), 17).alias("pick"))


@query("safe_names", "SELECT DISTINCT p_type, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS slug FROM part")
def safe_names(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_type", C.safe_name(t).alias("safe"), C.slug(t).alias("slug")).distinct()


@query("current_rows", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def current_rows(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus") == "O")
    return rows.where(C.require_current(F.col("o_orderstatus"), "O")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("admission", """
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE l_linestatus = 'O' AND l_quantity > 5 AND l_discount > 0.02 AND (l_returnflag = 'R' OR coalesce(nullif(l_linenumber, 7), 0) >= 3) GROUP BY 1""")
def admission(spark, d):
    ok = C.admitted(F.col("l_linestatus") == "O", F.col("l_quantity") > 5, F.col("l_discount") > 0.02, F.col("l_returnflag"), ["R"], F.nullif(F.col("l_linenumber"), F.lit(7)))
    return table(spark, d, "lineitem").where(ok).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("admission_reasons", """
SELECT CASE WHEN NOT l_quantity >= 10 THEN 'quantity' WHEN NOT l_discount <= 0.08 THEN 'discount' WHEN NOT l_tax > 0 THEN 'tax' END AS reason, count(*) AS n
FROM lineitem GROUP BY 1""")
def admission_reasons(spark, d):
    reason = C.first_reason(("quantity", F.col("l_quantity") >= 10), ("discount", F.col("l_discount") <= 0.08), ("tax", F.col("l_tax") > 0))
    return table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("band_verdict", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.07 THEN 'interior' WHEN l_quantity < 10 THEN 'median' WHEN l_tax < 0.02 THEN 'spread' END AS reason,
  round(0.07 - l_discount, 6)::DOUBLE AS m_interior, round(l_quantity - 10, 6)::DOUBLE AS m_median, round(l_tax - 0.02, 6)::DOUBLE AS m_spread FROM lineitem""")
def band_verdict(spark, d):
    v = C.band_verdict(F.col("l_discount"), F.col("l_quantity").cast("double"), F.col("l_tax"), 0.07, 10, 0.02)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", "v.reason", *(F.round(f"v.{m}", 6).alias(m) for m in ("m_interior", "m_median", "m_spread")))


@query("degenerate_guard", """
SELECT CASE WHEN l_discount >= 0.05 AND l_quantity < 6 THEN 'both' WHEN l_discount >= 0.05 THEN 'interior' WHEN l_quantity < 6 THEN 'flat' END AS fail, count(*) AS n FROM lineitem GROUP BY 1""")
def degenerate_guard(spark, d):
    return table(spark, d, "lineitem").groupBy(C.guard_fail(F.col("l_discount"), F.col("l_quantity"), 0.05).alias("fail")).agg(F.count("*").alias("n"))


KINDS = {"1-URGENT": "front", "2-HIGH": "front", "3-MEDIUM": "middle", "5-LOW": "back"}


@query("partition_resolver", """
SELECT CASE WHEN o_orderkey = 7 AND o_custkey = 7 THEN 'origin' WHEN o_orderpriority IN ('front', 'middle', 'back') THEN o_orderpriority
  WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'front' WHEN o_orderpriority = '3-MEDIUM' THEN 'middle' WHEN o_orderpriority = '5-LOW' THEN 'back' END AS part, count(*) AS n
FROM orders GROUP BY 1""")
def partition_resolver(spark, d):
    part = C.resolve_partition(F.col("o_orderpriority"), KINDS, F.col("o_orderkey"), F.col("o_custkey"), (7, 7), "origin")
    return table(spark, d, "orders").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("schema_era", """
SELECT CASE WHEN event_id % 3 = 0 THEN 'walk' WHEN event_id % 3 = 1 THEN 'campaign' END AS era, count(*) AS n FROM events GROUP BY 1""")
def schema_era(spark, d):
    third = F.col("event_id") % 3
    era = C.schema_era(F.when(third == 0, F.col("event_type")), F.when(third == 1, F.col("event_type")))
    return table(spark, d, "events").groupBy(era.alias("era")).agg(F.count("*").alias("n"))


@query("category_collapse", """
SELECT CASE WHEN source LIKE 'src1%' THEN 'ones' WHEN source LIKE 'src0%' THEN 'zero' ELSE 'rest' END AS grp, count(*) AS n FROM documents GROUP BY 1""")
def category_collapse(spark, d):
    return table(spark, d, "documents").groupBy(C.collapse(F.col("source"), [("src1", "ones"), ("src0", "zero")], "rest").alias("grp")).agg(F.count("*").alias("n"))


@query("ordinal_decode", """
SELECT l_orderkey, l_linenumber, 1 + (l_discount >= 0.02)::INT + (l_tax >= 0.04)::INT + (l_quantity >= 30)::INT AS decoded FROM lineitem""")
def ordinal_decode(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.ordinal_decode(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), 0.04, 0.02, 30).alias("decoded"))


@query("quality_flags", """
SELECT array_to_string(list_filter([CASE WHEN l_quantity < 5 THEN 'small' END, CASE WHEN l_discount > 0.08 THEN 'cheap' END, CASE WHEN l_tax = 0 THEN 'free' END], lambda x: x IS NOT NULL), ',') AS flags, count(*) AS n
FROM lineitem GROUP BY 1""")
def quality_flags(spark, d):
    names = C.flags(("small", F.col("l_quantity") < 5), ("cheap", F.col("l_discount") > 0.08), ("free", F.col("l_tax") == 0))
    return table(spark, d, "lineitem").groupBy(F.array_join(names, ",").alias("flags")).agg(F.count("*").alias("n"))


@query("score_bands", """
SELECT CASE WHEN l_linenumber <= 1 THEN 'REJECT' WHEN l_discount < 0.03 THEN 'SUB' WHEN l_discount < 0.07 THEN 'Q3' ELSE 'HIGH' END AS band, count(*) AS n FROM lineitem GROUP BY 1""")
def score_bands(spark, d):
    return table(spark, d, "lineitem").groupBy(C.score_band(F.col("l_discount"), F.col("l_linenumber"), 0.03, 0.07).alias("band")).agg(F.count("*").alias("n"))


@query("stamped_cut", "SELECT count(*) AS n FROM lineitem WHERE l_discount >= 0.05")
def stamped_cut(spark, d):
    return table(spark, d, "lineitem").where(C.stamped_cut(F.col("l_discount"), 0.05, "v2", "v2")).agg(F.count("*").alias("n"))


@query("style_routing", "SELECT CASE WHEN p_type LIKE '%BRASS%' THEN 'smooth_head' ELSE 'other_head' END AS head, count(*) AS n FROM part GROUP BY 1")
def style_routing(spark, d):
    return table(spark, d, "part").groupBy(F.when(F.col("p_type").contains("BRASS"), "smooth_head").otherwise("other_head").alias("head")).agg(F.count("*").alias("n"))


RULES = [(r"\.html$", "page"), (r"\?.*utm_", "tracked"), ("/en/", "english"), ("#", "anchor")]


@query("rule_classes", r"""
SELECT CASE WHEN regexp_matches(url, '\.html$') THEN 'page' WHEN regexp_matches(url, '\?.*utm_') THEN 'tracked' WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE '%#%' THEN 'anchor' ELSE 'other' END AS class, count(*) AS n
FROM pages GROUP BY 1""")
def rule_classes(spark, d):
    return table(spark, d, "pages").groupBy(C.first_match(F.col("url"), RULES, "other").alias("class")).agg(F.count("*").alias("n"))


@query("interval_rule", "SELECT CASE WHEN v IS NULL THEN 'kept_null' WHEN v > 60 THEN 'removed' ELSE 'kept' END AS fate, count(*) AS n FROM (SELECT nullif((props->>'$.k')::INT, 7) AS v FROM events) GROUP BY 1")
def interval_rule(spark, d):
    from quarry.operators.overlay import split_three_ways

    rows = table(spark, d, "events").select(F.nullif(F.get_json_object("props", "$.k").cast("int"), F.lit(7)).alias("v"))
    return split_three_ways(rows, "v", 60).groupBy("fate").agg(F.count("*").alias("n"))


@query("machine_discard", """
SELECT l_shipmode_like AS part, count(*) AS n FROM (SELECT l_returnflag AS l_shipmode_like, l_linenumber, l_linestatus FROM lineitem)
WHERE NOT (l_linenumber = 1 AND l_linestatus = 'O' AND l_shipmode_like IN ('A', 'N')) GROUP BY 1""")
def machine_discard(spark, d):
    flagged = spark.createDataFrame([("A", True), ("N", True), ("R", False)], "part string, drops boolean")
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), "l_linenumber", "l_linestatus").join(flagged, "part", "left")
    gone = (F.col("l_linenumber") == 1) & (F.col("l_linestatus") == "O") & F.coalesce("drops", F.lit(False))
    return rows.where(~gone).groupBy("part").agg(F.count("*").alias("n"))


@query("auto_maxiter", """
SELECT p_partkey, least(greatest(round_even(500 * (1 + 0.35 * log2(3.0 / (1.0 / p_size))), 0)::BIGINT, 300), 20000)::BIGINT AS maxiter FROM part""")
def auto_maxiter(spark, d):
    return table(spark, d, "part").select("p_partkey", C.auto_maxiter(1 / F.col("p_size")).alias("maxiter"))


@query("recording_floor", "SELECT l_orderkey, l_linenumber, round(least(l_discount, greatest(0.02, 0.6 * l_discount))::DOUBLE, 6) AS tau FROM lineitem")
def recording_floor(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.recording_floor(F.col("l_discount"), 0.02), 6).alias("tau"))


@query("rank_score", "SELECT l_orderkey, l_linenumber, round(1/(1+exp(-l_discount*10)) + 1/(1+exp(-(l_tax*10-1))), 6) AS score, round(1/(1+exp(-(0.1 + 0.5*(l_quantity-25)/14 - 0.3*(l_discount-0.05)/0.03))), 6) AS linear FROM lineitem")
def rank_score(spark, d):
    linear = C.linear_score([(F.col("l_quantity"), 25.0, 14.0, 0.5), (F.col("l_discount"), 0.05, 0.03, -0.3)], 0.1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.rank_score(F.col("l_discount") * 10, F.col("l_tax") * 10 - 1), 6).alias("score"), F.round(linear, 6).alias("linear"))


@query("guarded_score", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 6 THEN -1.0::DOUBLE ELSE l_discount::DOUBLE END AS score FROM lineitem")
def guarded_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(C.guard_fail(F.lit(0.0), F.col("l_quantity")).isNotNull(), F.lit(-1.0)).otherwise(F.col("l_discount")).alias("score"))


@query("priority_terms", """
SELECT l_orderkey, l_linenumber, round(l_quantity / 50.0 + 0.1 - l_tax - 0.5 * greatest(0, least(1, (l_discount * 10 - 0.2) / 0.5)) + 0.05 * l_linenumber, 6)::DOUBLE AS priority FROM lineitem""")
def priority_terms(spark, d):
    p = C.priority(F.col("l_quantity") / 50.0, F.lit(0.1), F.col("l_tax"), F.col("l_discount") * 10, 0.5, 0.05, F.col("l_linenumber"), 0.2, 0.7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 6).alias("priority"))


@query("canonical_atoms", """
SELECT k, min(c_custkey) AS first_key, count(*) AS n FROM (SELECT c_custkey, (c_nationkey % 7 - 3)::DOUBLE::VARCHAR || ',' || abs(c_custkey % 5 - 2)::DOUBLE::VARCHAR AS k FROM customer) GROUP BY k""")
def canonical_atoms(spark, d):
    key = C.canonical_point((F.col("c_nationkey") % 7 - 3).cast("long"), (F.col("c_custkey") % 5 - 2).cast("long"), 0)
    return table(spark, d, "customer").groupBy(key.alias("k")).agg(F.min("c_custkey").alias("first_key"), F.count("*").alias("n"))


@query("label_validation", "SELECT doc_id, quality, quality IS NULL OR quality BETWEEN 0 AND 1 AS valid, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS word FROM labels")
def label_validation(spark, d):
    word = F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").otherwise("plain")
    return table(spark, d, "labels").select("doc_id", "quality", (F.col("quality").isNull() | F.col("quality").between(0, 1)).alias("valid"), word.alias("word"))
