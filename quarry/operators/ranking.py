"""Ranks, percentiles, draws from the top, running tallies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def average_rank(value: Column, groups: Sequence[str] = ()) -> Column:
    """Ranks from 1; ties share their mean rank."""
    own = W.partitionBy(*groups)
    return F.rank().over(own.orderBy(value)) + (F.count("*").over(W.partitionBy(*groups, value)) - 1) / 2


def percent_rank(value: Column, groups: Sequence[str] = ()) -> Column:
    """(average rank - 1) / (n - 1); null for one row."""
    return F.try_divide(average_rank(value, groups) - 1, F.count("*").over(W.partitionBy(*groups)) - 1)


def niche_percentile(score: str, niche: Sequence[str]) -> Column:
    """Share of the niche whose score is no larger."""
    return F.cume_dist().over(W.partitionBy(*niche).orderBy(score))


def queue_rank(tier: str, score: str, ties: Sequence[str], groups: Sequence[str] = ()) -> Column:
    """Place by tier, then score (null last), then ties."""
    return F.row_number().over(W.partitionBy(*groups).orderBy(F.col(tier).desc(), F.coalesce(F.col(score), F.lit(-1e9)).desc(), *ties))


def top_gap(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Best and second best score of each group and their gap (null for one row)."""
    n = F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc()))
    two = rows.select(group, score, n.alias("_n")).where("_n <= 2").groupBy(group).agg(F.max(score).alias("best"), F.min(F.when(F.col("_n") == 2, F.col(score))).alias("second"))
    return two.withColumn("gap", F.col("best") - F.col("second"))


def top_n(rows: DataFrame, n: int, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """The first n rows of each group; without groups a plain top-n, which needs no shuffle of all rows."""
    if not groups:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def hash_order(key: Column, seed: str = "") -> Column:
    """A fixed pseudo-random order: md5 of key and seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)).cast("binary"))


def enriched_with_reserve(rows: DataFrame, key: str, score: str, n: int, reserve: int, seed: str = "") -> DataFrame:
    """The n best by (score desc, key) and `reserve` rows in hash order; role reserve wins where both hold."""
    best = top_n(rows, n, [F.col(score).desc(), F.col(key)]).withColumn("role", F.lit("enriched"))
    drawn = top_n(rows, reserve, [hash_order(F.col(key), seed), F.col(key)]).withColumn("role", F.lit("reserve"))
    both = best.unionByName(drawn)
    return both.groupBy(*[c for c in both.columns if c != "role"]).agg(F.max("role").alias("role"))


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "") -> DataFrame:
    """At most n rows of each stratum, in hash order."""
    return top_n(rows, n, [hash_order(F.col(key), seed), F.col(key)], strata)


def round_robin(rows: DataFrame, cell: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The i-th row of each cell before any (i + 1)-th; the first n."""
    turn = rows.withColumn("turn", F.row_number().over(W.partitionBy(cell).orderBy(*order)))
    return turn.orderBy("turn", cell).limit(n)


def pop_batch(rows: DataFrame, root: str, used: str, cap: int, reserved: Column, share: float, batch: int, priority: str, key: str) -> DataFrame:
    """`batch` rows by priority from roots below their cap; up to round(share batch) of them are reserved rows, taken first.

    Spare reserved places fall to the others, and the other way round.
    """
    quota = int(round(share * batch))
    live = rows.where(F.col(used) < cap).withColumn("_res", reserved)
    ranked = live.withColumn("_rn", F.row_number().over(W.partitionBy("_res").orderBy(F.col(priority).desc(), key)))
    first = ranked.withColumn("_class", F.when(F.col("_res") & (F.col("_rn") <= quota), 0).otherwise(1))
    return first.orderBy("_class", F.col(priority).desc(), key).limit(batch).drop("_res", "_rn", "_class")


def prune(rows: DataFrame, protected: Column, share: float, cap: int, priority: str, key: str) -> DataFrame:
    """The best `cap` rows; protected rows keep up to floor(share cap) places."""
    quota = int(share * cap)
    ranked = rows.withColumn("_p", protected).withColumn("_rn", F.row_number().over(W.partitionBy("_p").orderBy(F.col(priority).desc(), key)))
    return ranked.withColumn("_class", F.when(F.col("_p") & (F.col("_rn") <= quota), 0).otherwise(1)).orderBy("_class", F.col(priority).desc(), key).limit(cap).drop("_p", "_rn", "_class")


def time_bins(rows: DataFrame, minute: Column, width: float, total: float) -> DataFrame:
    """bin, n, width and rate per hour of bins of `width` minutes up to `total`; the last bin is closed and may be narrower."""
    last = max(0, int(-(-total // width)) - 1)
    b = F.least(F.floor(minute / width), F.lit(last)).cast("long")
    own = F.least(F.lit(width), F.lit(float(total)) - F.col("bin") * width)
    return rows.where((minute >= 0) & (minute <= total)).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("width", own).withColumn("rate", F.col("n") * 60 / F.col("width"))


def running_percentile(rows: DataFrame, group: str, order: str, value: str, least: int) -> DataFrame:
    """Share of a group's earlier values strictly below each value; 0.5 until there are `least`.

    A join of a group's rows with its earlier ones, so bounded by the group's square; for long groups partition `group` further.
    """
    a = rows.select(group, order, value)
    b = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(value).alias("_v"))
    out = a.join(b, (F.col(group) == F.col("_g")) & (F.col("_o") < F.col(order)), "left").groupBy(group, order, value).agg(F.count("_o").alias("seen"), F.count_if(F.col("_v") < F.col(value)).alias("below"))
    return out.withColumn("percentile", F.when(F.col("seen") >= least, F.try_divide("below", "seen")).otherwise(0.5))


def within_position(groups: Sequence[str], order: Sequence[Column]) -> Column:
    """Place in the group from 0 to 1; null for one row."""
    own = W.partitionBy(*groups)
    return F.try_divide(F.row_number().over(own.orderBy(*order)) - 1, F.count("*").over(own) - 1)


def recency_window(rows: DataFrame, block: str, key: str, back: int) -> DataFrame:
    """rows with seen: whether their key occurs in the last `back` blocks before theirs."""
    last = F.max(block).over(W.partitionBy(key).orderBy(block).rangeBetween(-back, -1))
    return rows.withColumn("seen", last.isNotNull())


def running_sum(rows: DataFrame, order: str, value: Column, out: str, ties: Sequence[str] = (), blocks: int = 256) -> DataFrame:
    """rows with the sum of `value` up to each row, in the order of a number and then of `ties`; nulls of `order` come first.

    The numbers are cut into about `blocks` ranges at approximate quantiles; a range's sum is added to those after it, so
    that each task orders one range. Rows of one number share a range.
    """
    spots = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), spots, 10 * blocks)).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col(order).cast("double")))
    dealt = rows.withColumn("_block", F.coalesce(at, F.lit(-1)) if cuts else F.lit(0)).withColumn("_value", value)
    own = W.partitionBy("_block").orderBy(F.col(order), *ties)
    sums = dealt.groupBy("_block").agg(F.sum("_value").alias("_all"))  # a row for each range
    before = sums.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_all").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    summed = dealt.withColumn(out, F.sum("_value").over(own)).join(F.broadcast(before), F.col("_block") == F.col("_b"))
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop("_block", "_value", "_b", "_before")


def first_seen_curve(rows: DataFrame, order: str, key: str) -> DataFrame:
    """Rows with fresh (first of its key) and the number of distinct keys up to them."""
    fresh = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    return running_sum(rows.withColumn("fresh", fresh), order, F.col("fresh").cast("long"), "distinct_so_far")


def consecutive(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Per group: sum of absolute steps, the step from last to first, and the number of steps."""
    own = W.partitionBy(group).orderBy(order)
    every = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    step = rows.select(group, (F.col(value) - F.lag(value).over(own)).alias("_d"), (F.last(value).over(every) - F.first(value).over(every)).alias("_seam"))
    return step.groupBy(group).agg(F.sum(F.abs("_d")).alias("variation"), F.max(F.abs("_seam")).alias("seam"), F.count("_d").alias("steps"))
