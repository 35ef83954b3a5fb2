"""Layered labels, merges and stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlay(rows: DataFrame, key: str, own: str, amendments: DataFrame, sidecar: DataFrame, out: str = "score") -> DataFrame:
    """rows with `out`: the amendment, else the row's own value, else the sidecar's; amendments and sidecar are (key, value)."""
    a = amendments.select(F.col(key).alias("_ka"), F.col("value").alias("_va"))
    s = sidecar.select(F.col(key).alias("_ks"), F.col("value").alias("_vs"))
    joined = rows.join(a, F.col(key) == F.col("_ka"), "left").join(s, F.col(key) == F.col("_ks"), "left")
    return joined.withColumn(out, F.coalesce("_va", F.col(own), "_vs")).drop("_ka", "_va", "_ks", "_vs")


def overlay_columns(base: DataFrame, over: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with each of `columns` replaced by that of over's row, where it has one that is not null."""
    o = over.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    joined = base.join(o, F.col(key) == F.col("_k"), "left")
    return joined.select(*(F.coalesce(f"_o_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))


def rekey(raw: DataFrame, owner: DataFrame, row_id: str, key: str, value: str) -> DataFrame:
    """(key, value) of raw's (id, value) through owner's (id, key); an unknown id, or a key with two values, is an error."""
    o = owner.select(F.col(row_id).alias("_id"), F.col(key).alias("_key"))
    known = raw.join(o, F.col(row_id) == F.col("_id"), "left")
    checked = known.withColumn("_key", F.coalesce("_key", F.raise_error(F.concat(F.lit("unknown id "), F.col(row_id).cast("string"))).cast(owner.schema[key].dataType)))
    one = checked.groupBy("_key").agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value))
    ok = F.when(F.col("_n") <= 1, F.col(value)).otherwise(F.raise_error(F.lit("conflicting values of a key")).cast(raw.schema[value].dataType))
    return one.select(F.col("_key").alias(key), ok.alias(value))


def sources_without_rows(registry: DataFrame, joined: DataFrame, source: str) -> DataFrame:
    """Registered sources that contributed nothing; an empty result is what a healthy join gives."""
    return registry.select(source).distinct().join(joined.select(source).distinct(), source, "left_anti")


def fill_status(rows: DataFrame, new: DataFrame, key: str, own: str, value: str, lo: int, hi: int) -> DataFrame:
    """key, old, new and status of filling nulls: filled, reaffirmed, conflict, unknown, out_of_range or untouched."""
    n = new.select(F.col(key).alias("_k"), F.col(value).alias("new"))
    both = rows.select(key, F.col(own).alias("old")).join(n, F.col(key) == F.col("_k"), "full_outer")
    status = (
        F.when(F.col("_k").isNull(), "untouched").when(~F.coalesce(F.col("new").between(lo, hi), F.lit(False)), "out_of_range").when(F.col(key).isNull(), "unknown")
        .when(F.col("old").isNull(), "filled").when(F.col("old") == F.col("new"), "reaffirmed").otherwise("conflict")
    )
    return both.select(F.coalesce(key, "_k").alias(key), "old", "new", status.alias("status"))


def fill(rows: DataFrame, new: DataFrame, key: str, own: str, value: str, lo: int, hi: int) -> DataFrame:
    """rows with nulls of `own` filled from new within [lo, hi]; nothing is overwritten."""
    n = new.where(F.col(value).between(lo, hi)).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return rows.join(n, F.col(key) == F.col("_k"), "left").withColumn(own, F.coalesce(own, "_v")).drop("_k", "_v")


def route_revisions(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new and kind (promoted, demoted, reaffirmed, fresh) of revising rows."""
    o = old.select(F.col(key).alias("_k"), F.col(value).alias("old"))
    kind = F.when(F.col("old").isNull(), "fresh").when(F.col(value) > F.col("old"), "promoted").when(F.col(value) < F.col("old"), "demoted").otherwise("reaffirmed")
    return new.join(o, F.col(key) == F.col("_k"), "left").select(key, "old", F.col(value).alias("new"), kind.alias("kind"))


def apply_rule(rows: DataFrame, label: str, measure: Column, threshold: float, value: int, rule: str) -> DataFrame:
    """Unlabelled rows whose measure is over the threshold get value and labeler rule:<rule>; a null measure never fires."""
    fires = F.col(label).isNull() & F.coalesce(measure > threshold, F.lit(False))
    return rows.withColumn("labeler", F.when(fires, F.lit(f"rule:{rule}"))).withColumn(label, F.when(fires, F.lit(value)).otherwise(F.col(label)))


def back_stamp(rows: DataFrame, column: str, inferred: Column) -> DataFrame:
    """The inferred tag where there is none; applying it twice changes nothing."""
    return rows.withColumn(column, F.coalesce(F.col(column), inferred))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new by key; new wins, of several new rows the one that sorts last."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.col(c).desc_nulls_last() for c in old.columns if c != key]
    return both.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.col("_new").desc(), *rest))).where("_rn = 1").drop("_rn", "_new")


def split_three_ways(rows: DataFrame, measure: str, limit: float) -> DataFrame:
    """rows with fate: removed (over the limit), kept, or kept_null."""
    return rows.withColumn("fate", F.when(F.col(measure).isNull(), "kept_null").when(F.col(measure) > limit, "removed").otherwise("kept"))


def provenance(fields: Sequence[str], rows: DataFrame) -> Column:
    """A struct of all modelled fields; those that rows lacks are null."""
    return F.struct(*(F.col(f).cast("string").alias(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields))
