"""Merges, stamps, sinks and readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import overlay
from quarry.registry import query, table
from quarry.sources import jsonl, logs, palettes


@query("upsert_merge", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 8 <> 4 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 8 = 4""")
def upsert_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return overlay.upsert(o.where("o_orderkey % 8 <> 4"), new, "o_orderkey")


@query("fill_merge_status", """
WITH r AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN quality END AS own FROM documents d LEFT JOIN labels l USING (doc_id)), n AS (SELECT doc_id + 10 AS doc_id, CASE WHEN doc_id % 11 = 0 THEN 9 ELSE quality END AS v FROM labels),
b AS (SELECT r.doc_id AS a, n.doc_id AS b, own, v FROM r FULL JOIN n ON r.doc_id = n.doc_id)
SELECT CASE WHEN b IS NULL THEN 'untouched' WHEN NOT coalesce(v BETWEEN 0 AND 1, false) THEN 'out_of_range' WHEN a IS NULL THEN 'unknown' WHEN own IS NULL THEN 'filled' WHEN own = v THEN 'reaffirmed' ELSE 'conflict' END AS status, count(*) AS n FROM b GROUP BY 1""")
def fill_merge_status(spark, d):
    l = table(spark, d, "labels")
    rows = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("quality")).alias("own"))
    new = l.select((F.col("doc_id") + 10).alias("doc_id"), F.when(F.col("doc_id") % 11 == 0, 9).otherwise(F.col("quality")).alias("v"))
    return overlay.fill_status(rows, new, "doc_id", "own", "v", 0, 1).groupBy("status").agg(F.count("*").alias("n"))


@query("fill_merge", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN quality END, CASE WHEN quality BETWEEN 0 AND 1 THEN quality END) AS own FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_merge(spark, d):
    l = table(spark, d, "labels")
    rows = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("quality")).alias("own"))
    return overlay.fill(rows, l.select("doc_id", "quality"), "doc_id", "own", "quality", 0, 1)


@query("revision_routing", """
WITH o AS (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0), n AS (SELECT doc_id, toxic FROM labels) SELECT CASE WHEN quality IS NULL THEN 'fresh' WHEN toxic > quality THEN 'promoted' WHEN toxic < quality THEN 'demoted' ELSE 'reaffirmed' END AS kind, count(*) AS n FROM n LEFT JOIN o USING (doc_id) GROUP BY 1""")
def revision_routing(spark, d):
    l = table(spark, d, "labels")
    old, new = l.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("v")), l.select("doc_id", F.col("toxic").alias("v"))
    return overlay.route_revisions(old, new, "doc_id", "v").groupBy("kind").agg(F.count("*").alias("n"))


@query("rule_labels", """
SELECT d.doc_id, CASE WHEN quality IS NULL AND n_chars / 10000.0 > 0.3 THEN 1 ELSE quality END AS quality, CASE WHEN quality IS NULL AND n_chars / 10000.0 > 0.3 THEN 'rule:long' END AS labeler FROM documents d LEFT JOIN labels USING (doc_id)""")
def rule_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return overlay.apply_rule(rows, "quality", F.col("n_chars") / 10000.0, 0.3, 1, "long").select("doc_id", "quality", "labeler")


@query("back_stamp", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'old' END, CASE WHEN value > 50 THEN 'high' ELSE 'low' END) AS tag FROM events")
def back_stamp(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_id") % 5 == 0, "old").alias("tag"))
    once = overlay.back_stamp(rows, "tag", F.when(F.col("value") > 50, "high").otherwise("low"))
    return overlay.back_stamp(once, "tag", F.lit("never")).select("event_id", "tag")


@query("provenance_block", "SELECT o_orderkey, o_orderstatus AS status, NULL::VARCHAR AS seed, o_orderpriority AS priority FROM orders")
def provenance_block(spark, d):
    o = table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    return o.select("o_orderkey", overlay.provenance(["status", "seed", "priority"], o).alias("p")).select("o_orderkey", "p.status", "p.seed", "p.priority")


@query("jsonl_round_trip", "SELECT event_id, user_id, event_type, value FROM events")
def jsonl_round_trip(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    path = jsonl.scratch_path(spark)
    jsonl.write(e, path)
    return jsonl.read(spark, path, e.schema)


@query("jsonl_torn_lines", "SELECT count(*) FILTER (event_id % 10 > 0) AS n, count(*) FILTER (event_id % 10 = 0) AS torn FROM events")
def jsonl_torn_lines(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    path = jsonl.scratch_path(spark)
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    rows, torn = jsonl.read_torn(spark, path, e.schema)
    return rows.agg(F.count("event_id").alias("n")).join(torn.hint("broadcast"), F.lit(True))


@query("sidecar_shapes", "SELECT doc_id::VARCHAR AS id, quality AS score, shape FROM labels, (VALUES ('bare'), ('labels'), ('scored')) s(shape) WHERE quality IS NOT NULL")
def sidecar_shapes(spark, d):
    """A sidecar of each shape for every 1,000 ids, so that no map holds more; all are read back."""
    l = table(spark, d, "labels").where("quality is not null").groupBy(F.floor(F.col("doc_id") / 1000)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("quality")))).alias("m"))
    bare = F.to_json("m")
    scored = F.to_json(F.transform_values("m", lambda k, v: F.struct(v.alias("score"), F.lit(1).alias("revealed"))))
    files = l.select(F.explode(F.array(F.struct(F.lit("bare").alias("shape"), bare.alias("text")), F.struct(F.lit("labels").alias("shape"), F.concat(F.lit('{"labels":'), bare, F.lit("}")).alias("text")), F.struct(F.lit("scored").alias("shape"), scored.alias("text")))).alias("f"))
    return jsonl.sidecar(files.select("f.*"), "text", "shape").withColumnRenamed("value", "score")


@query("batch_files", "SELECT 'b' || (o_orderkey % 4) AS batch, count(*) AS n FROM orders GROUP BY 1")
def batch_files(spark, d):
    path = jsonl.scratch_path(spark)
    o = table(spark, d, "orders").select("o_orderkey")
    for b in range(4):
        jsonl.write(o.where(F.col("o_orderkey") % 4 == b), f"{path}/b{b}/images")
    return jsonl.read_batches(spark, f"{path}/*/images", o.schema).groupBy("batch").agg(F.count("*").alias("n"))


@query("log_regex_scan", "SELECT event_id // 50 AS batch, round(arg_max(value, event_id), 1) AS minutes FROM events GROUP BY 1")
def log_regex_scan(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("batch "), F.expr("event_id div 50").cast("string"), F.lit(": ok active="), F.format_string("%.1f", "value"), F.lit("m")).alias("value"))
    return logs.batch_minutes(e, "value", "event_id").select("batch", "minutes")


@query("palette_lines", "SELECT p_partkey, p_size % 256 AS r, p_partkey % 256 AS g, (p_partkey * 3) % 256 AS b FROM part")
def palette_lines(spark, d):
    lines = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", (F.col("p_size") % 256).cast("string"), (F.col("p_partkey") % 256).cast("string"), (F.col("p_partkey") * 3 % 256).cast("string"), F.lit(" comment")).alias("line"))
    return lines.select("p_partkey", palettes.map_line(F.col("line")).alias("c")).select("p_partkey", "c.r", F.col("c.g").cast("long").alias("g"), F.col("c.b").cast("long").alias("b"))


@query("run_registry", "SELECT source, 'unregistered' AS problem FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN ('src0', 'src1') UNION ALL SELECT 'src99', 'missing'")
def run_registry(spark, d):
    reg = spark.createDataFrame([("src0",), ("src1",), ("src99",)], "source string")
    return logs.registry_problems(reg, table(spark, d, "documents").select("source"), "source")


@query("artifact_paths", "SELECT page_id, CASE WHEN url LIKE 'https://www.%' THEN '/mnt/www/' || url[13:] WHEN regexp_matches(url, '^https?://m\\.') THEN '/mnt/mobile/' || regexp_replace(url, '^https?://m\\.', '') ELSE url END AS path FROM pages")
def artifact_paths(spark, d):
    return table(spark, d, "pages").select("page_id", logs.relocate(F.col("url"), [(r"^https://www\.", "/mnt/www/"), (r"^https?://m\.", "/mnt/mobile/")]).alias("path"))
