"""Deduplication by key and order, unions, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each identity."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, with `first_position`, where the key first stood. Rows without key all stay.

    One aggregation: the last row travels as a struct, so it is pre-aggregated map-side.
    """
    rest = [c for c in rows.columns if c not in (key, position)]
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(position, *rest)).alias("_last"), F.min(position).alias("first_position"))
    return keyed.select(key, *(F.col(f"_last.{c}").alias(c) for c in [position, *rest]), "first_position").unionByName(
        rows.where(F.col(key).isNull()).select(key, position, *rest, F.col(position).alias("first_position"))
    )


def namespaced_union(parts: Sequence[tuple[str, DataFrame]], row_id: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of all parts under namespaced ids, the first of each identity kept; and per part rows, kept and overlaps.

    Parts come in order of priority. Two parts with one namespace are an error.
    """
    from quarry.functions.columns import namespaced_id

    names = [n.lower() for n, _ in parts]
    if len(set(names)) != len(names):
        raise ValueError("two sources share a namespace")
    union = None
    for i, (name, df) in enumerate(parts):
        one = df.withColumn("part", F.lit(name)).withColumn("_order", F.lit(i)).withColumn("ns_id", namespaced_id(F.lit(name), F.col(row_id)))
        union = one if union is None else union.unionByName(one)
    marked = union.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("_order", row_id)))
    counts = marked.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_if(F.col("_rn") == 1).alias("n_kept"), F.count_if(F.col("_rn") > 1).alias("n_overlap"))
    return marked.where("_rn = 1").drop("_rn", "_order"), counts


def by_signature(rows: DataFrame, vector: str, step: float, order: Sequence[str]) -> DataFrame:
    """The first of the rows whose vectors agree after rounding each entry to a multiple of step (half to even)."""
    return first_wins(rows.withColumn("_sig", F.transform(vector, lambda x: F.bround(x.cast("double") / step, 0))), ["_sig"], order).drop("_sig")


def membership(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and side (both, old, new)."""
    a, b = old.select(F.col(key).alias("_a")).distinct(), new.select(F.col(key).alias("_b")).distinct()
    side = F.when(F.col("_b").isNull(), "old").when(F.col("_a").isNull(), "new").otherwise("both")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), side.alias("side"))


def assignment_diff(old: DataFrame, new: DataFrame, key: str, cluster: str) -> DataFrame:
    """old and new cluster, n rows, and whether the old one was split or the new one merged."""
    o = old.select(F.col(key).alias("_k"), F.col(cluster).alias("old_cluster"))
    cells = new.join(o, F.col(key) == F.col("_k")).groupBy("old_cluster", F.col(cluster).alias("new_cluster")).agg(F.count("*").alias("n"))
    targets = cells.groupBy(F.col("old_cluster").alias("_o")).agg(F.count("*").alias("_t"))
    sources = cells.groupBy(F.col("new_cluster").alias("_n")).agg(F.count("*").alias("_s"))
    out = cells.join(targets, F.col("old_cluster") == F.col("_o")).join(sources, F.col("new_cluster") == F.col("_n"))
    return out.select("old_cluster", "new_cluster", "n", (F.col("_t") > 1).alias("split"), (F.col("_s") > 1).alias("merged"))
