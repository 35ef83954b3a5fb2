"""Runs that can be resumed, stores, backends, scorers, readers of labelled batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import backends, fields
from quarry.operators import cluster, greedy
from quarry.plans import frontier
from quarry.plans import state as P
from quarry.registry import query, table
from quarry.sources import jsonl, sinks, stores

CLASSES = ("purchase", "click", "view")


@query("foreign_windows", """
WITH w AS (SELECT event_id, 'b' || (user_id % 4) AS batch, CASE WHEN event_id % 5 = 0 THEN event_type END AS own FROM events),
k AS (SELECT event_id, batch, CASE WHEN own IN ('purchase', 'click', 'view') THEN own END AS own, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'click' END AS late, CASE event_id % 4 WHEN 0 THEN 'purchase' WHEN 1 THEN 'click' WHEN 2 THEN 'view' END AS early FROM w)
SELECT event_id, batch, coalesce(own, late, early) AS klass FROM k WHERE batch IN ('b0', 'b1', 'b2')""")
def foreign_windows(spark, d):
    """Own labels by name, a first sidecar by number (3 is none), a later one by name (of which half is none)."""
    e = table(spark, d, "events").withColumn("batch", F.concat(F.lit("b"), (F.col("user_id") % 4).cast("string")))
    early = e.select("batch", "event_id", F.lit(0).alias("nth"), (F.col("event_id") % 4).cast("string").alias("value"))
    late = e.where("event_id % 3 = 0").select("batch", "event_id", F.lit(1), F.when(F.col("event_id") % 2 == 0, "click").otherwise("unsure"))
    registered = spark.createDataFrame([("b0",), ("b1",), ("b2",)], "batch string")
    rows = e.select("event_id", "batch", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("own"))
    return stores.resolve_classes(rows, early.union(late), ["batch", "event_id"], "own", CLASSES, registered).select("event_id", "batch", "klass")


@query("labeled_batches", """
SELECT doc_id, 'b' || (doc_id % 3) AS batch, CASE coalesce(CASE WHEN doc_id % 2 = 0 THEN quality END, toxic) WHEN 1 THEN 'good' ELSE 'poor' END AS klass
FROM documents JOIN labels USING (doc_id) WHERE (doc_id % 2 = 0 AND quality IS NOT NULL) OR toxic IS NOT NULL""")
def labeled_batches(spark, d):
    """All batches of a store, each row with its own label, else its sidecar's; rows without either are left out."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("doc_id % 2 = 0").select("doc_id", "quality"), "doc_id", "left")
    path = jsonl.scratch_path(spark)
    for b in range(3):
        jsonl.write(rows.where(F.col("doc_id") % 3 == b), f"{path}/b{b}/images")
    read = jsonl.read_batches(spark, f"{path}/*/images", rows.schema).withColumn("own", F.col("quality").cast("string"))
    batch = F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")).alias("batch")
    side = table(spark, d, "labels").select(batch, "doc_id", F.lit(0).alias("nth"), F.col("toxic").cast("string").alias("value"))
    return stores.resolve_classes(read, side, ["batch", "doc_id"], "own", ("poor", "good"), read.select("batch"), labeled_only=True).select("doc_id", "batch", "klass")


@query("embedding_store", "SELECT vec_id::VARCHAR AS id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def embedding_store(spark, d):
    """Vectors of even labels in files of many, of odd ones in a file each; both layouts are read back."""
    v = table(spark, d, "embeddings")
    files = stores.pack_embeddings(v.where("label % 2 = 0"), "vec_id", "embedding", 100).union(stores.pack_embeddings(v.where("label % 2 <> 0 or label is null"), "vec_id", "embedding", 1))
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return stores.unpack_embeddings(files).select("id", F.size("vector").cast("long").alias("dims"), F.round(total, 5).alias("total"))


@query("field_cache", "SELECT event_id::VARCHAR AS key, value + event_id % 2 AS first, value * 2 AS second FROM events WHERE event_id % 3 = 0")
def field_cache(spark, d):
    """Even events first, then all with other values: first fields stay. Every third is looked up, with keys that are absent."""
    e = table(spark, d, "events").select("event_id", F.col("event_id").cast("string").alias("key"), "value")
    store = stores.FieldStore(spark, jsonl.scratch_path(spark), "raw", buckets=8)
    store.append(e.where("event_id % 2 = 0").select("key", F.array("value", F.col("value") * 2).alias("values")))
    store.append(e.select("key", F.array(F.col("value") + 1, F.col("value") * 2).alias("values")))
    wanted = e.where("event_id % 3 = 0").select("key").union(e.select(F.concat(F.lit("no"), "key")))
    return store.lookup(wanted).select("key", F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


@query("resumed_tally", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(event_id) AS last FROM events GROUP BY 1")
def resumed_tally(spark, d):
    """Events by quarters into a saved tally; the third save is cut off before its commit, so a second run does it again."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    root = jsonl.scratch_path(spark)

    def go(last: int, torn: int) -> None:
        state = P.RunState(spark, root)
        held = state.load()
        for i in range(held[0] + 1 if held else 0, last + 1):
            part = e.where(F.col("event_id") % 4 == i).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("event_id").alias("last"))
            both = held[1]["tally"].unionByName(part) if held else part
            state.save(i, {"tally": both.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))}, commit=i != torn)
            held = state.load()

    go(2, torn=2)
    go(3, torn=-1)
    return P.RunState(spark, root).load()[1]["tally"].withColumn("total", F.round("total", 4))


@query("resumed_frontier")
def resumed_frontier(spark, d):
    """The frontier of steered_frontier, stopped after its first round and taken up again from its state."""
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("root"), (F.col("s_acctbal") / 10000).alias("score"))
    state = P.RunState(spark, jsonl.scratch_path(spark))
    for rounds in (1, 3):
        out = frontier.run(seeds, rounds=rounds, batch=20, cap=6, children=3, state=state)
    return out


@query("harvest_cycles", """
WITH c AS (SELECT event_id // 100 AS cycle, count(*) AS rows, count(*) FILTER (value > 50) AS salvaged, max(event_id) AS e FROM events GROUP BY 1),
s AS (SELECT *, cycle % 3 <> 1 AS one, cycle % 7 <> 4 AS two FROM c), o AS (SELECT *, one OR two AS ok, min((one OR two)::INT) OVER (ORDER BY cycle) AS clear FROM s)
SELECT cycle, rows, CASE WHEN ok THEN rows ELSE salvaged END AS harvested, CASE WHEN ok THEN 0 ELSE rows - salvaged END AS deferred, CASE WHEN one THEN 1 ELSE 2 END AS tries, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS state,
max(CASE WHEN clear = 1 THEN e END) OVER (ORDER BY cycle) AS watermark FROM o""")
def harvest_cycles(spark, d):
    """Cycles of 100 events; of the first tries one in three fails, of the second one in seven."""
    e = table(spark, d, "events").select(F.expr("event_id div 100").alias("cycle"), F.col("event_id").alias("position"), (F.col("value") > 50).alias("harvested"))
    c = e.select("cycle").distinct()
    tries = c.select("cycle", F.lit(0).alias("attempt"), (F.col("cycle") % 3 != 1).alias("ok")).union(c.select("cycle", F.lit(1), F.col("cycle") % 7 != 4))
    return P.harvest_cycles(e, tries)


@query("pool_in_waves", """
WITH a AS (SELECT p_partkey % 6 AS wave, (p_partkey * i) % 1009 AS atom FROM part, range(1, 4) r(i)), f AS (SELECT atom, min(wave) AS wave FROM a GROUP BY 1),
n AS (SELECT wave, sum(count(*)) OVER (ORDER BY wave) AS held FROM f GROUP BY 1) SELECT atom FROM f WHERE wave <= coalesce((SELECT min(wave) FROM n WHERE held >= 400), 5)""")
def pool_in_waves(spark, d):
    seeds = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 6).alias("wave"))
    expand = lambda df: df.select(F.explode(F.array(*(F.col("p_partkey") * i % 1009 for i in (1, 2, 3)))).alias("atom"))
    state = P.RunState(spark, jsonl.scratch_path(spark))
    P.enumerate_pool(state, seeds, "wave", 1, expand, "atom", 400)
    return P.enumerate_pool(state, seeds, "wave", 6, expand, "atom", 400)


@query("budgeted_looks", """
WITH RECURSIVE v AS (SELECT vec_id, label, CASE WHEN vec_id % 11 > 0 THEN embedding::DOUBLE[] END AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
n AS (SELECT vec_id, label, i, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
f AS (SELECT label, 0::BIGINT AS i, NULL::BIGINT AS vec_id, NULL::VARCHAR AS status, []::DOUBLE[][] AS m FROM n GROUP BY 1
UNION ALL SELECT label, i, vec_id, s, CASE WHEN s = 'kept' THEN list_append(m, e) ELSE m END FROM (SELECT n.label, n.i, n.vec_id, n.e, f.m,
  CASE WHEN n.i > 40 THEN 'not_reached' WHEN n.e IS NULL THEN 'unembeddable' WHEN len(list_filter(f.m, lambda q: list_dot_product(q, n.e) >= 0.35)) > 0 THEN 'removed' ELSE 'kept' END AS s FROM f JOIN n ON n.label = f.label AND n.i = f.i + 1))
SELECT vec_id, status FROM f WHERE i > 0""")
def budgeted_looks(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 11 > 0, F.col("embedding")))
    return greedy.embedded_looks(v, ["label"], "vec_id", "embedding", greedy.budgeted(40), 0.35)


@query("batch_scorer", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 13 > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * (i % 5 - 2))) + 0.25))), 6) AS p, CASE WHEN e IS NULL THEN 'no features' END AS why FROM v""")
def batch_scorer(spark, d):
    v = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 13 > 0, F.col("embedding").cast("array<double>")))
    width = v.agg(F.max(F.size("embedding"))).head()[0]
    model = backends.linear_scorer([i % 5 - 2 for i in range(1, width + 1)], 0.25)
    return backends.batch_score(v, "vec_id", "embedding", model, width).withColumn("p", F.round("p", 6))


@query("backend_samples", """
WITH RECURSIVE v AS (SELECT s_suppkey, s_nationkey % 2 AS fold, -0.7 + s_nationkey / 200.0::DOUBLE AS cx, s_acctbal::DOUBLE / 20000 AS cy FROM supplier),
g AS (SELECT s_suppkey, fold, i, j, cx + ((j + 0.5::DOUBLE) / 4 - 0.5::DOUBLE) * 0.5::DOUBLE AS re, cy + ((i + 0.5::DOUBLE) / 4 - 0.5::DOUBLE) * 0.5::DOUBLE AS im FROM v, range(0, 4) a(i), range(0, 4) b(j)),
z AS (SELECT *, 0 AS n, 0::DOUBLE AS x, 0::DOUBLE AS y FROM g
UNION ALL SELECT s_suppkey, fold, i, j, re, im, n + 1, nx, ny FROM (SELECT *, x * x - y * y + re AS nx, CASE fold WHEN 1 THEN 2 * abs(x) * abs(y) ELSE 2 * x * y END + im AS ny FROM z WHERE n < 48) WHERE nx * nx + ny * ny <= 4)
SELECT s_suppkey, i, j, max(n)::BIGINT AS steps FROM z GROUP BY 1, 2, 3""")
def backend_samples(spark, d):
    """A grid of each supplier's view, by one of two backends."""
    name = F.when(F.col("s_nationkey") % 2 == 1, "folded").otherwise("square").alias("backend")
    views = table(spark, d, "supplier").select("s_suppkey", name, (-0.7 + F.col("s_nationkey") / 200.0).cast("double").alias("cx"), (F.col("s_acctbal").cast("double") / 20000).alias("cy"), F.lit(0.5).alias("width"))
    return backends.sample(views, "s_suppkey", 4, 48)


@query("json_document", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document(spark, d):
    """A small table as one JSON document over many lines, parsed whole."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = jsonl.scratch_path(spark)
    n.agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct(*n.columns))), ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.text(path)
    return jsonl.read_document(spark, path, n.schema)


@query("append_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def append_log(spark, d):
    """Two commits to one log."""
    e = table(spark, d, "events").select("event_id", "event_type")
    path = jsonl.scratch_path(spark)
    for part in (0, 1):
        jsonl.append(e.where(F.col("event_id") % 2 == part), path)
    return jsonl.read(spark, path, e.schema).groupBy("event_type").agg(F.count("*").alias("n"))


@query("sink_classes", "SELECT kind, count(*) AS n FROM orders, (VALUES ('scratch'), ('bulk'), ('durable')) k(kind) GROUP BY 1")
def sink_classes(spark, d):
    """The orders in a sink of each class, written under its own root."""
    o, root = table(spark, d, "orders").select("o_orderkey"), jsonl.scratch_path(spark)
    policy = sinks.SinkPolicy({k: f"{root}/{k}" for k in sinks.CLASSES})
    read = [spark.read.parquet(policy.write(o, k, "orders")).select(F.lit(k).alias("kind")) for k in sinks.CLASSES]
    return read[0].union(read[1]).union(read[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("dct_hash", """
WITH s AS (SELECT vec_id, list_transform(range(0, 16), lambda t: list_sum(list_transform(range(0, 64), lambda x: embedding[x + 1]::DOUBLE * cos(pi() * (2 * (t // 4) + 1) * (x // 8) / 16) * cos(pi() * (2 * (t % 4) + 1) * (x % 8) / 16)))) AS s FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(0, 16), lambda t: CASE WHEN s[t + 1] > list_median(s[5:16]) THEN (1 << (15 - t)) ELSE 0 END))::BIGINT AS h FROM s""")
def dct_hash(spark, d):
    return cluster.dct_hash(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 8, 4)


@query("probe_governor", """
WITH RECURSIVE e AS (SELECT user_id, event_id, floor(value / 10) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
f AS (SELECT DISTINCT user_id, -1::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, []::STRUCT(c DOUBLE, i BIGINT)[] AS m FROM e
UNION ALL SELECT user_id, i, event_id, ok, CASE WHEN ok THEN list_append(m, {'c': c, 'i': i}) ELSE m END FROM (
  SELECT e.*, f.m, len(list_filter(f.m, lambda q: e.i - q.i < 6)) < 3 AND len(list_filter(f.m, lambda q: q.c = e.c AND e.i - q.i < 12)) = 0 AS ok FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, allowed FROM f WHERE i >= 0""")
def probe_governor(spark, d):
    """A user's events as probes of cells of ten values: three in six steps, none into a cell of the last twelve."""
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") / 10).alias("cell"))
    return greedy.governed(e, "user_id", "event_id", "cell", rate=3, window=6, ttl=12)


@query("budgeted_batches", """
WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0::DOUBLE AS spent, 0::DOUBLE AS est FROM e
UNION ALL SELECT e.user_id, e.i, e.event_id, f.spent + e.v, CASE WHEN f.spent = 0 THEN e.v ELSE 0.5 * f.est + 0.5 * e.v END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1 WHERE f.spent + f.est <= 400)
SELECT event_id, round(spent, 4) AS spent FROM f WHERE i > 0""")
def budgeted_batches(spark, d):
    """A user's events as batches with a cost each, under a budget a user."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return greedy.within_budget(e, "user_id", "event_id", "value", 400.0).withColumn("spent", F.round("spent", 4))


@query("seeded_stream", """
WITH m AS (SELECT doc_id, 18446744073709551616::UHUGEINT AS w, (doc_id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM documents),
a AS (SELECT doc_id, w, (xor(z, z >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT) % w AS z FROM m), b AS (SELECT doc_id, (xor(z, z >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT) % w AS z FROM a)
SELECT doc_id, xor(z, z >> 31::UHUGEINT)::VARCHAR AS draw FROM b""")
def seeded_stream(spark, d):
    """The first draw of a SplitMix64 generator seeded with each doc_id."""
    return table(spark, d, "documents").select("doc_id", fields.first_draw("doc_id").alias("draw"))
