"""Streaming operators, run to the end of their input (availableNow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import frontier
from quarry.registry import query, table
from quarry.streaming import replay


@query("replay_dedup_stream", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id // 2 AS k FROM events) GROUP BY 1, 2")
def replay_dedup_stream(spark, d):
    """Half the events replay the key of the one before; the stream keeps one of each."""
    def shape(df):
        return df.select("user_id", "event_type", F.expr("event_id div 2").alias("k"), F.col("ts").cast("timestamp").alias("ts"))

    out = replay.run_to_table(spark, f"{d}/events.parquet", lambda s: shape(s).dropDuplicates(["user_id", "event_type", "k"]))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("hourly_stream", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_stream(spark, d):
    def windows(s):
        w = s.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 day").groupBy(F.window("t", "1 hour").alias("w"), "event_type")
        return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")

    return replay.run_to_table(spark, f"{d}/events.parquet", windows, mode="complete")


@query("stateful_distinct_looks", "SELECT user_id, count(DISTINCT floor(value / 10)) AS looks, count(*) AS n FROM events GROUP BY 1")
def stateful_distinct_looks(spark, d):
    out = replay.run_to_table(spark, f"{d}/events.parquet", lambda s: replay.distinct_tally(s.select("user_id", F.floor(F.col("value") / 10).alias("look")), "user_id", "look"), mode="update")
    return out.groupBy("user_id").agg(F.max("looks").alias("looks"), F.max("n").alias("n"))


@query("deficit_tracker", """
WITH h AS (SELECT user_id % 8 AS bin, count(*) AS n FROM events GROUP BY 1) SELECT bin, round(0.125 - n / sum(n) OVER (), 6) AS deficit FROM h""")
def deficit_tracker(spark, d):
    t = replay.DeficitTracker([0.125] * 8)
    for r in table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("bin")).count().collect():  # eight numbers
        t.ingest(r["bin"], r["count"])
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(t.deficit())], "bin long, deficit double")


@query("steered_frontier")
def steered_frontier(spark, d):
    """A frontier over suppliers: best nodes are popped, expanded and scored in rounds until the budget is spent."""
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("long").alias("root"), (F.col("s_acctbal") / 10000).alias("score"))
    return frontier.run(seeds, rounds=3, batch=20, cap=6, children=3)


@query("guided_descents")
def guided_descents(spark, d):
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("walk"), (-0.7 + F.col("s_nationkey") / 200.0).alias("cx"), (0.2 + F.col("s_acctbal") / 60000).alias("cy"))
    return frontier.descend(seeds, steps=5)


@query("maneuvers")
def maneuvers(spark, d):
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("view"), (-1.0 + F.col("s_nationkey") / 25.0).alias("cx"), (F.col("s_acctbal") / 20000).alias("cy"))
    return frontier.snap(seeds, [2, 3, 4])
