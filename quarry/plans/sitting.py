"""A labelling sitting: stages that each part rows into kept and removed, then a balanced draw; nothing is lost on the way."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.apportion import draw_balanced
from quarry.operators.dedup import first_wins

#: A stage maps rows to the rows that it keeps.
Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def run_stages(rows: DataFrame, stages: Sequence[Stage]) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """What all stages keep, and after each stage its name and what is kept so far."""
    trail = []
    for name, stage in stages:
        rows = rows.transform(stage)
        trail.append((name, rows))
    return rows, trail


def cut(rows: DataFrame, stages: Sequence[Stage], cell: str, order: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The drawn rows, and one row of counts: rows_in = all removed_* + drawn + over_cap."""
    kept, trail = run_stages(rows, stages)
    drawn = draw_balanced(kept, cell, order, most)
    counts = [rows.agg(F.count("*").alias("n")), *(df.agg(F.count("*").alias("n")) for _, df in trail)]
    table = counts[0].select(F.lit(0).alias("i"), "n")
    for i, c in enumerate(counts[1:], 1):
        table = table.union(c.select(F.lit(i), "n"))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    removed = [(at(i) - at(i + 1)).alias(f"removed_{name}") for i, (name, _) in enumerate(trail)]
    last = at(len(trail))
    return drawn, table.agg(at(0).alias("rows_in"), *removed, F.least(last, F.lit(most)).alias("drawn"), F.greatest(F.lit(0), last - most).alias("over_cap"))


def order_stages(limit: float) -> list[Stage]:
    return [
        ("interior", lambda df: df.where(~F.coalesce(F.col("o_totalprice") > limit, F.lit(False)))),
        ("machine", lambda df: df.where(~((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 2 == 0)))),
        ("dup", lambda df: first_wins(df, ["o_custkey", "o_orderstatus"], ["o_orderkey"])),
    ]


def cut_report(orders: DataFrame, limit: float, most: int) -> DataFrame:
    return cut(orders, order_stages(limit), "o_orderstatus", ["o_orderkey"], most)[1]
