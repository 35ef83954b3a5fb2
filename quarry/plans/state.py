"""State of a run that can be taken up again, harvest cycles, pools made in waves."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class RunState:
    """Tables of a run after each round. A round counts once its commit is written, which is after all its tables.

    What an interrupted save left behind is overwritten when the round is run again; a reader never sees it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        spark.createDataFrame([], "round int, tables array<string>").write.mode("ignore").json(f"{self.root}/commits")

    def save(self, round_: int, tables: dict[str, DataFrame], commit: bool = True) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/round={round_}/{name}")
        if commit:
            self.spark.createDataFrame([(round_, list(tables))], "round int, tables array<string>").write.mode("append").json(f"{self.root}/commits")

    def load(self) -> tuple[int, dict[str, DataFrame]] | None:
        """The last committed round and its tables; None before the first."""
        last = self.spark.read.schema("round int, tables array<string>").json(f"{self.root}/commits").orderBy(F.desc("round")).head()
        if last is None:
            return None
        return last["round"], {name: self.spark.read.parquet(f"{self.root}/round={last['round']}/{name}") for name in last["tables"]}


def harvest_cycles(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row a cycle: rows, harvested, deferred, tries, state and watermark.

    ledger holds cycle, position and harvested; attempts cycle, attempt and ok. A cycle is tried at most twice and then left,
    so later ones go on. The watermark is the last ledger position up to which every cycle succeeded (null before). Cycles
    are few beside rows: the running minimum goes over cycles only.
    """
    tried = attempts.where("attempt < 2").groupBy("cycle").agg(F.max("ok").alias("ok"), F.min_by("attempt", F.struct(~F.col("ok"), F.col("attempt"))).alias("first"))
    rows = ledger.groupBy("cycle").agg(F.count("*").alias("rows"), F.count_if("harvested").alias("salvaged"), F.max("position").alias("end"))
    both = rows.join(tried, "cycle", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    so_far = W.orderBy("cycle").rowsBetween(W.unboundedPreceding, 0)
    harvested = F.when(F.col("ok"), F.col("rows")).otherwise(F.col("salvaged"))
    return both.withColumn("clear", F.min("ok").over(so_far)).select(
        "cycle", "rows", harvested.alias("harvested"), (F.col("rows") - harvested).alias("deferred"),
        F.when(F.col("ok"), F.col("first") + 1).otherwise(F.lit(2)).alias("tries"), F.when(F.col("ok"), "ok").otherwise("failed").alias("state"),
        F.max(F.when(F.col("clear"), F.col("end"))).over(so_far).alias("watermark"),
    )


def enumerate_pool(state: RunState, seeds: DataFrame, wave: str, waves: int, expand: Callable[[DataFrame], DataFrame], key: str, target: int, seconds: float | None = None) -> DataFrame:
    """Distinct atoms (by key, the first found) that seeds expand to, in waves until `target` are held or time is up.

    A wave's seeds are expanded by all tasks at once; after each the pool is saved, and a later call goes on from there.
    A started wave is always finished, so the pool depends on no timing but the number of waves.
    """
    began, held = time.monotonic(), state.load()
    done, pool = (held[0], held[1]["pool"]) if held else (-1, None)
    for i in range(done + 1, waves):
        if pool is not None and (pool.count() >= target or (seconds is not None and time.monotonic() - began >= seconds)):
            break
        found = expand(seeds.where(F.col(wave) == i)).dropDuplicates([key])
        state.save(i, {"pool": found if pool is None else pool.unionByName(found.join(pool.select(key), key, "left_anti"))})
        pool = state.load()[1]["pool"]
    if pool is None:
        raise ValueError("no wave was run")
    return pool
