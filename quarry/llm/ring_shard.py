"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import Table

#: Places on the ring, and parts of a place among which rows with one key are dealt.
PLACES, PARTS = 1024, 64
#: Equal rows that one task numbers.
RUN = 100_000


def ring(shards: int, virtual: int) -> list[list[int]]:
    """For each place the shards in the order in which their virtual nodes follow clockwise; depends on nothing else."""
    nodes: list[list[tuple[str, int]]] = [[] for _ in range(PLACES)]
    for s in range(shards):
        for v in range(virtual):
            h = hashlib.md5(f"{s}/{v}".encode()).hexdigest()
            nodes[int(h[:8], 16) % PLACES].append((h, s))
    turn = [s for place in nodes for _, s in sorted(place)]
    first = [0]
    for place in nodes:
        first.append(first[-1] + len(place))
    return [list(dict.fromkeys(turn[first[p] :] + turn[: first[p]])) for p in range(PLACES)]


def deal(counts: dict[int, int], shards: int, virtual: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the rows of each cell go, by rank within the cell.

    A shard holds n / shards rows, rounded down, or up for the first n % shards. In each round the rows left at a cell are
    offered to the next shard clockwise, cells in ring order; what does not fit goes on.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    order = ring(shards, virtual)
    left, out = [(c, 0, n) for c, n in sorted(counts.items())], []
    for turn in range(shards):
        after = []
        for cell, done, n in left:
            shard = order[cell // PARTS][turn]
            take = min(n - done, room[shard] - used[shard])
            if take:
                out.append((cell, done, done + take, shard, used[shard]))
                used[shard] += take
            if done + take < n:
                after.append((cell, done + take, n))
        left = after
    return out


def assign(docs: DataFrame, shards: int = 40, virtual: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot and grown_shard (null) of each row of docs(doc_id, text).

    A row starts at the place of its doc_id's hash and goes to the shard whose virtual node follows clockwise; rows that
    overflow a full shard continue to the next. Loads are bounded to the mean, so counts differ by one at most; what has
    room stays where the ring puts it, so a change of the shard count moves few rows beyond those it must.

    Only counts of the ring's PLACES x PARTS cells reach the driver, and only the plan made of them, of about as many
    rows, is sent to each task. Rows that share a doc_id, however many, are spread over PARTS cells. slot runs from 0
    without gaps in each shard. A null text has 0 bytes; a null doc_id is a key like any other; repeated rows are rows
    of their own, counted and numbered, so that the result does not depend on the order of input. Ties in the hash are
    broken by doc_id, text and number. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key, same = F.xxhash64("doc_id"), ["doc_id", "size", "text_crc32", "content"]
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("content"))
    # equal rows are counted, then numbered in runs, so that no task numbers all of a large group
    runs = rows.groupBy(*same).agg(F.count("*").alias("n")).select(*same, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    first = F.col("run") * RUN
    long = runs.where(f"n > {RUN}").repartition(*same, "run").union(runs.where(f"n <= {RUN}"))
    rows = long.select(*same, F.explode(F.sequence(first, F.least(first + RUN, F.col("n")) - 1)).alias("nth"))
    rows = Table(rows.withColumn("cell", (F.pmod(key, F.lit(PLACES)) * PARTS + F.pmod(F.xxhash64("content", "nth", "doc_id"), F.lit(PARTS))).cast("int"))).df
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    kinds = "p_cell int, lo long, hi long, shard int, slot long"
    plan = docs.sparkSession.createDataFrame(deal(counts, shards, virtual), kinds)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("cell").orderBy(key, *same, "nth")) - 1)
    placed = ranked.join(F.broadcast(plan), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
