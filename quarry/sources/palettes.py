"""Palette text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LINE = r"^\s*(\d+)\s+(\d+)\s+(\d+)"


def map_line(line: Column) -> Column:
    """Red, green and blue of a line of three numbers with any comment; null for other lines. Values beyond 255 are clipped."""
    part = lambda i: F.least(F.regexp_extract(line, _LINE, i).try_cast("int"), F.lit(255))
    return F.when(line.rlike(_LINE), F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b")))


def gradient_blocks(lines: DataFrame, order: str, text: str) -> DataFrame:
    """title, index, r, g, b of gradient blocks: `name {` opens one, `index=i color=c` (blue x 65536 + green x 256 + red) is a stop."""
    opened = lines.withColumn("_title", F.nullif(F.regexp_extract(text, r"^\s*([\w-]+)\s*\{", 1), F.lit("")))
    named = opened.withColumn("title", F.last("_title", ignorenulls=True).over(W.orderBy(order)))
    stop = r"index=(-?\d+)\s+color=(\d+)"
    hit = named.where(F.col(text).rlike(stop)).select("title", F.regexp_extract(text, stop, 1).cast("int").alias("index"), F.regexp_extract(text, stop, 2).cast("long").alias("c"))
    return hit.select("title", "index", (F.col("c") % 256).alias("r"), (F.floor(F.col("c") / 256) % 256).alias("g"), (F.floor(F.col("c") / 65536) % 256).alias("b"))


def unify(parts: dict[str, DataFrame]) -> DataFrame:
    """Stop lists (name, stops) of several sources under one schema, with their source."""
    out = None
    for source, df in sorted(parts.items()):
        one = df.select("name", F.col("stops").cast("array<struct<pos:double,rgb:array<int>>>").alias("stops")).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out
