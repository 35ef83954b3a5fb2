"""Counts, rates, quantiles, histograms, variance components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(k: Column, n: Column, places: int = 4) -> Column:
    """k / n rounded; null for n = 0."""
    return F.round(F.try_divide(k, n), places)


def rates(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """n, hits and rate per group and pooled (group null)."""
    marked = rows.select(F.col(group), hit.alias("_hit"))
    return marked.rollup(group).agg(F.count("*").alias("n"), F.count_if("_hit").alias("hits")).withColumn("rate", rate(F.col("hits"), F.col("n")))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a x b with margins and the total (null: all)."""
    return rows.cube(a, b).agg(F.count("*").alias("n"))


def currency(rows: DataFrame, group: str, klass: str, weights: Mapping[int, float]) -> DataFrame:
    """Weighted count of classes per group."""
    weight = F.lit(0.0)
    for k, w in weights.items():
        weight = F.when(F.col(klass) == k, F.lit(w)).otherwise(weight)
    return rows.groupBy(group).agg(F.sum(weight).alias("currency"))


def deficits(have: DataFrame, group: str, currency: str, ratio: Column) -> DataFrame:
    """target = largest currency x ratio / its group's ratio scale; deficit = what is missing, 0 at least."""
    every = W.partitionBy()
    target = F.max(currency).over(every) * ratio / F.max(ratio).over(every)
    return have.select(group, currency, target.alias("target"), F.greatest(F.lit(0.0), target - F.col(currency)).alias("deficit"))


def pooled_price(rows: DataFrame, group: str, cost: str, units: str) -> DataFrame:
    return rows.groupBy(group).agg(F.sum(cost).alias("cost"), F.sum(units).alias("units")).withColumn("price", F.try_divide("cost", "units"))


def shrink(prices: DataFrame, price: str, alpha: float) -> DataFrame:
    """exp(alpha ln p + (1 - alpha) ln median)."""
    middle = F.median(price).over(W.partitionBy())
    return prices.withColumn("shrunk", F.exp(alpha * F.log(price) + (1 - alpha) * F.log(middle)))


def reconcile(log: DataFrame, summary: DataFrame, counters: Sequence[str]) -> DataFrame:
    """counter, logged, stated and ok of one-row counts and a one-row summary."""
    stacked = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias(name)) for c in counters))).alias("x")).select("x.*")
    return stacked(log, "logged").join(stacked(summary, "stated"), "counter").withColumn("ok", F.col("logged") == F.col("stated"))


def conservation(rows: DataFrame, fates: Mapping[str, Column]) -> DataFrame:
    """rows_in, a count per fate, and what no fate accounts for."""
    out = rows.agg(F.count("*").alias("rows_in"), *(F.count_if(c).alias(n) for n, c in fates.items()))
    return out.withColumn("remainder", F.col("rows_in") - sum((F.col(n) for n in fates), F.lit(0)))


def occupancy(rows: DataFrame, cluster: str, family: str) -> DataFrame:
    """Per family: distinct clusters, singletons, largest, and the singleton share."""
    sizes = rows.groupBy(family, cluster).agg(F.count("*").alias("size"))
    out = sizes.groupBy(family).agg(F.count("*").alias("clusters"), F.count_if(F.col("size") == 1).alias("singletons"), F.max("size").alias("largest"))
    return out.withColumn("singleton_share", rate(F.col("singletons"), F.col("clusters")))


def five_numbers(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    out = rows.groupBy(*groups).agg(q.alias("q"), F.avg(value).alias("mean"))
    return out.select(*groups, *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "p25", "median", "p75", "high"))), "mean")


def _ranked(rows: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(W.partitionBy(*groups).orderBy(value)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*groups)))


def nearest_rank(rows: DataFrame, value: str, p: float, groups: Sequence[str]) -> DataFrame:
    """The value at index floor(p (n - 1) + 0.5) of each group's ascending order."""
    return _ranked(rows, value, groups).where(F.col("_i") == F.floor(p * (F.col("_n") - 1) + 0.5)).select(*groups, F.col(value).alias("quantile"))


def truncating_quantile(rows: DataFrame, value: str, p: float, groups: Sequence[str]) -> DataFrame:
    """The value at index min(n - 1, int(p n))."""
    return _ranked(rows, value, groups).where(F.col("_i") == F.least(F.col("_n") - 1, F.floor(p * F.col("_n")))).select(*groups, F.col(value).alias("quantile"))


def distribution(rows: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """n, mean, median, population std and skewness, extremes, p5, p95 and their spread."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.skewness(value).alias("skew"), F.min(value).alias("low"), F.max(value).alias("high"), q.alias("q"))
    return out.select(*groups, "n", "mean", F.col("q")[1].alias("median"), "std", "skew", "low", "high", F.col("q")[0].alias("p5"), F.col("q")[2].alias("p95"), (F.col("q")[2] - F.col("q")[0]).alias("spread"))


def weighted_histogram(rows: DataFrame, bin_of: Column, weight: Column, groups: Sequence[str], eps: float = 1e-9) -> DataFrame:
    """Share of weight per bin of each group."""
    cells = rows.groupBy(*groups, bin_of.alias("bin")).agg(F.sum(weight).alias("_w"))
    return cells.select(*groups, "bin", (F.col("_w") / (F.sum("_w").over(W.partitionBy(*groups)) + eps)).alias("share"))


def quantile_edges(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """k and edge of the bins - 1 inner edges at nearest ranks; an edge that does not exceed the one before is raised to it plus 1e-9."""
    n = F.col("_n") - 1
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), F.floor(F.lit(k / bins) * n + 0.5).alias("at")) for k in range(1, bins)))
    ranked = _ranked(rows, value, [])
    at = ranked.select(F.col(value).cast("double").alias("edge"), "_i", F.explode(wanted).alias("w")).where("_i = w.at").groupBy().agg(F.array_sort(F.collect_list(F.struct("w.k", "edge"))).alias("e"))
    step = lambda acc, x: F.concat(acc, F.array(F.struct(x["k"].alias("k"), F.when(x["edge"] > F.element_at(acc, -1)["edge"], x["edge"]).otherwise(F.element_at(acc, -1)["edge"] + 1e-9).alias("edge"))))
    folded = F.aggregate(F.slice("e", 2, bins), F.slice("e", 1, 1), step)
    return at.select(F.explode(folded).alias("x")).select("x.k", "x.edge")


def frozen_histogram(rows: DataFrame, value: str, edges: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """Share of values per bin of fixed ascending edges; a value on an edge belongs above it."""
    bin_of = sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, bin_of.alias("bin")).agg(F.count("*").alias("_c"))
    return counts.select(*groups, "bin", (F.col("_c") / F.sum("_c").over(W.partitionBy(*groups))).alias("share"))


def grid_means(rows: DataFrame, x: str, y: str, value: str, cols: int, lines: int, bounds: tuple[float, float, float, float], least: int) -> DataFrame:
    """cell, n and mean over a grid of clipped bins; cells with fewer than `least` rows are left out."""
    x0, x1, y0, y1 = bounds
    at = lambda c, lo, hi, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), ((F.col(c) - lo) / (hi - lo) * n).cast("int")))
    cell = at(y, y0, y1, lines) * cols + at(x, x0, x1, cols)
    return rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= least)


def eta_squared(rows: DataFrame, value: str, group: str) -> DataFrame:
    """SS between / SS total; from sums of the groups, so one aggregation over rows."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    total = F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    return g.agg(F.try_divide(between, total).alias("eta_squared"))


def variance_components(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Random-effects ANOVA: msb, msw, n0, between variance (0 at least) and the intraclass correlation."""
    g = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sm"), F.sum(F.col("n") * F.col("v")).alias("sw"))
    t = t.withColumn("msb", (F.col("sm") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)).withColumn("msw", F.col("sw") / (F.col("n") - F.col("k")))
    t = t.withColumn("n0", (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)).withColumn("between", F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / F.col("n0")))
    return t.select("msb", "msw", "n0", "between", (F.col("between") / (F.col("between") + F.col("msw"))).alias("icc"))


def top_mass(rows: DataFrame, mass: str, key: str, fraction: float, floor: float) -> DataFrame:
    """Rows whose mass reaches that at which the cumulative share, largest first, reaches `fraction`, or the floor."""
    from quarry.operators.ranking import running_sum

    total = rows.agg(F.sum(mass).alias("_total"))  # one row
    marked = running_sum(rows.withColumn("_down", -F.col(mass)), "_down", F.col(mass), "_run", ties=[key])
    cut = marked.join(F.broadcast(total), F.lit(True)).agg(F.max(F.when(F.col("_run") / F.col("_total") >= fraction, F.col(mass))).alias("_cut"))
    return rows.join(F.broadcast(cut), F.lit(True)).where((F.col(mass) >= F.col("_cut")) | (F.col(mass) >= floor)).drop("_cut")


def voxel_centroids(rows: DataFrame, axes: Sequence[str], size: float) -> DataFrame:
    keys = [F.floor(F.col(a) / size).alias(f"v_{a}") for a in axes]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"c_{a}") for a in axes))


def radius_of_gyration(rows: DataFrame, vector: str, group: str) -> DataFrame:
    """sqrt of the mean squared distance from the centroid."""
    entries = rows.select(group, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    return entries.groupBy(group, "i").agg(F.var_pop("x").alias("v")).groupBy(group).agg(F.sqrt(F.sum("v")).alias("radius"))


def path_sizes(rows: DataFrame, path: str, size: str) -> DataFrame:
    """Bytes and files of each directory, with all below it."""
    parts = F.split(F.regexp_replace(path, "^/+", ""), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return rows.select(F.explode(up).alias("dir"), F.col(size).alias("_s")).groupBy("dir").agg(F.sum("_s").alias("bytes"), F.count("*").alias("files"))


def ema(rows: DataFrame, group: str, order: Sequence[str], value: str, start: float, alpha: float, lo: float, hi: float) -> DataFrame:
    """Final p of p <- (1 - alpha) p + alpha clamp(value, lo, hi) over a group's rows in order.

    The fold is a weighted sum, alpha (1 - alpha)^(rows after), so it is an aggregation, not a gathered list.
    """
    own = W.partitionBy(group)
    after = F.count("*").over(own) - F.row_number().over(own.orderBy(*order))
    x = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(value)))
    weighted = rows.where(F.col(value).isNotNull()).select(group, x.alias("_x"), after.alias("_after"))
    return weighted.groupBy(group).agg(F.count("*").alias("n"), (F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("_after")) * F.col("_x")) + F.pow(F.lit(1 - alpha), F.count("*")) * start).alias("ema"))
