"""Logs, registries, paths, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_LINE = r"batch (\d+):.*active=([\d.]+)m"


def batch_minutes(lines: DataFrame, text: str, order: str) -> DataFrame:
    """batch and minutes of log lines that report them; the last line of a batch wins."""
    hit = lines.where(F.col(text).rlike(BATCH_LINE)).select(order, F.regexp_extract(text, BATCH_LINE, 1).cast("long").alias("batch"), F.regexp_extract(text, BATCH_LINE, 2).cast("double").alias("m"))
    return hit.groupBy("batch").agg(F.max_by("m", order).alias("minutes"))


def registry_problems(registry: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Found but unregistered, and registered but missing."""
    a, b = registry.select(key).distinct(), found.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("problem", F.lit("unregistered")).union(a.join(b, key, "left_anti").withColumn("problem", F.lit("missing")))


def require_registered(registry: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The registry, if all of it was found; else an error that names what is missing."""
    missing = [r[0] for r in registry_problems(registry, found, key).where("problem = 'missing'").limit(5).collect()]
    if missing:
        raise FileNotFoundError(f"registered but missing: {missing}")
    return registry


def relocate(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The first pattern found is replaced by its root; other paths stay."""
    out = path
    for pattern, root in reversed(rules):
        out = F.when(path.rlike(pattern), F.regexp_replace(path, pattern, root)).otherwise(out)
    return out


def files(spark: SparkSession, glob: str) -> DataFrame:
    """path and length of files, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob).select("path", "length")
