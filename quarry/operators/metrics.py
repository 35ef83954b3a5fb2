"""Splits and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.ranking import average_rank, hash_order


def fold_of(group: Column, folds: int, seed: str = "") -> Column:
    """Fold of a group: md5 of the group's key, so a group never falls apart."""
    return F.conv(F.substring(hash_order(group, seed), 1, 8), 16, 10).cast("long") % folds


def stratified_split(units: DataFrame, unit: str, stratum: str, share: float, seed: str = "") -> DataFrame:
    """units with side: the first round(share n) units of each stratum in hash order are eval."""
    own = W.partitionBy(stratum)
    rn = F.row_number().over(own.orderBy(hash_order(F.col(unit), seed), unit))
    return units.withColumn("side", F.when(rn <= F.bround(share * F.count("*").over(own), 0), "eval").otherwise("train"))


def disjoint(rows: DataFrame, unit: str, side: str) -> DataFrame:
    """Units that stand on more than one side; a sound split gives none."""
    return rows.groupBy(unit).agg(F.countDistinct(side).alias("sides")).where("sides > 1")


def primary(rows: DataFrame, group: str, kind: str, order: Sequence[str]) -> DataFrame:
    """The kind of each group that stands first in `order` (others last, by name)."""
    place = F.coalesce(*(F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(order)), F.lit(len(order)))
    return rows.groupBy(group).agg(F.min(F.struct(place.alias("p"), kind)).alias("_m")).select(group, F.col(f"_m.{kind}").alias(kind))


def average_precision(rows: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores of precision x recall step; null without positives. Null and NaN scores rank last."""
    s = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    ties = rows.groupBy(*groups, s.alias("_s")).agg(F.sum(y).alias("_p"), F.count("*").alias("_n"))
    run = W.partitionBy(*groups).orderBy(F.col("_s").desc())
    steps = ties.withColumn("_precision", F.sum("_p").over(run) / F.sum("_n").over(run))
    return steps.groupBy(*groups).agg(F.try_divide(F.sum(F.col("_precision") * F.col("_p")), F.sum("_p")).alias("ap"))


def roc_auc(rows: DataFrame, y: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with average ranks, from counts per distinct score; null if a class is missing."""
    ties = rows.groupBy(*groups, F.col(score).alias("_s")).agg(F.sum(y).cast("double").alias("_p"), F.count("*").cast("double").alias("_n"))
    below = F.sum(F.col("_n") - F.col("_p")).over(W.partitionBy(*groups).orderBy("_s").rowsBetween(W.unboundedPreceding, -1))
    wins = ties.withColumn("_w", F.col("_p") * (F.coalesce(below, F.lit(0.0)) + (F.col("_n") - F.col("_p")) / 2))
    return wins.groupBy(*groups).agg(F.try_divide(F.sum("_w"), F.sum("_p") * F.sum(F.col("_n") - F.col("_p"))).alias("auc"))


def precision_at(rows: DataFrame, y: str, score: str, key: str, ks: Sequence[int]) -> DataFrame:
    """k and the mean label of the k best; null and NaN scores rank last, ties go by key."""
    s = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    top = rows.select(F.col(y).alias("_y"), s.alias("_s"), key).orderBy(F.col("_s").desc(), key).limit(max(ks))
    placed = top.withColumn("_rn", F.row_number().over(W.orderBy(F.col("_s").desc(), key)))
    return placed.select("_y", "_rn", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("_rn <= k").groupBy("k").agg(F.avg("_y").alias("precision"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.select(average_rank(F.col(x)).alias("a"), average_rank(F.col(y)).alias("b")).agg(F.corr("a", "b").alias("spearman"))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * tp, (1 + b) * tp + b * fn + fp), F.lit(0.0))


def confusion(rows: DataFrame, y: Column, guess: Column, groups: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count_if(y & guess).alias("tp"), F.count_if(~y & guess).alias("fp"), F.count_if(y & ~guess).alias("fn"), F.count_if(~y & ~guess).alias("tn"))


def threshold_grid(rows: DataFrame, y: Column, score: str, groups: Sequence[str] = (), steps: int = 97, first: float = 0.02, width: float = 0.01) -> DataFrame:
    """t, tp, fp and fn for each threshold first + i width.

    Rows are counted once per grid cell; sums from the top then give each threshold, so rows are never multiplied by the grid.
    """
    cell = F.least(F.lit(steps - 1), F.floor((F.col(score) - first) / width + 1e-9)).cast("int")
    counts = rows.groupBy(*groups, F.greatest(F.lit(-1), cell).alias("i")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    axis = rows.select(*groups).distinct().withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(steps - 1)))) if groups else rows.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("i"))
    full = axis.join(counts, [*groups, "i"], "left").fillna(0, ["p", "n"])
    down = W.partitionBy(*groups).orderBy(F.col("i").desc())
    total = F.sum("p").over(W.partitionBy(*groups))
    out = full.select(*groups, "i", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), total.alias("_t"))
    return out.where("i >= 0").select(*groups, F.round(first + F.col("i") * width, 4).alias("t"), "tp", "fp", (F.col("_t") - F.col("tp")).alias("fn"))


def best_threshold(grid: DataFrame, beta: float, groups: Sequence[str] = ()) -> DataFrame:
    """The threshold with the largest F-beta (compared to 12 places), of equals the highest."""
    scored = grid.withColumn("f", F.round(f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta), 12))
    return scored.groupBy(*groups).agg(F.max(F.struct("f", "t")).alias("_m")).select(*groups, F.col("_m.t").alias("t"), F.col("_m.f").alias("f"))


def best_cut(rows: DataFrame, y: Column, score: str) -> DataFrame:
    """The observed score with the largest F1 when rows at or above it are positive, of equals the highest."""
    ties = rows.groupBy(F.col(score).alias("t")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))
    down = W.orderBy(F.col("t").desc())
    cum = ties.select("t", F.sum("_p").over(down).alias("tp"), F.sum("_n").over(down).alias("fp"), F.sum("_p").over(W.partitionBy()).alias("_t"))
    return best_threshold(cum.withColumn("fn", F.col("_t") - F.col("tp")), 1.0)


def leave_one_out(rows: DataFrame, key: str, y: Column, score: str, beta: float, steps: int = 97, first: float = 0.02, width: float = 0.01) -> DataFrame:
    """F-beta of predictions at thresholds that are chosen anew without each row.

    Leaving a row out changes the counts only through its label and grid cell, so thresholds are chosen once for each of
    at most 2 (steps + 1) kinds of rows.
    """
    cell = F.greatest(F.lit(-1), F.least(F.lit(steps - 1), F.floor((F.col(score) - first) / width + 1e-9))).cast("int")
    kinds = rows.select(y.cast("int").alias("_y"), cell.alias("_cell")).groupBy("_y", "_cell").agg(F.count("*").alias("_rows"))
    grid = threshold_grid(rows, y, score, (), steps, first, width).withColumn("_i", F.round((F.col("t") - first) / width, 0).cast("int"))
    every = kinds.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).join(grid, "_i")
    own = (F.col("_cell") >= F.col("_i")).cast("int")
    less = every.select(
        "_y", "_cell", "_rows", "t", "_i", (F.col("tp") - F.col("_y") * own).alias("tp"), (F.col("fp") - (1 - F.col("_y")) * own).alias("fp"), (F.col("fn") - F.col("_y") * (1 - own)).alias("fn")
    )
    chosen = less.withColumn("f", F.round(f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta), 12)).groupBy("_y", "_cell", "_rows").agg(F.max(F.struct("f", "t", "_i")).alias("m"))
    guess = (F.col("_cell") >= F.col("m._i")).cast("int") * F.col("_rows")
    out = chosen.agg(F.sum(guess * F.col("_y")).alias("tp"), F.sum(guess * (1 - F.col("_y"))).alias("fp"), F.sum((F.col("_rows") - guess) * F.col("_y")).alias("fn"))
    return out.withColumn("f", f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta))


def retention_cut(rows: DataFrame, group: str, score: str, keep: float, least: int) -> DataFrame:
    """The (1 - keep) quantile of each group's scores; groups with fewer than `least` rows get the pooled one."""
    pooled = F.percentile(score, F.lit(1 - keep))
    per = rows.groupBy(group).agg(F.count("*").alias("n"), pooled.alias("own")).join(rows.agg(pooled.alias("pooled")).hint("broadcast"), F.lit(True))
    return per.select(group, "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("pooled")).alias("cut"), (F.col("n") < least).alias("is_pooled"))


def cross_tier_pairs(rows: DataFrame, query: str, tier: str, item: str, score: str) -> DataFrame:
    """Ordered pairs of one query whose first item is of a higher tier."""
    lo = rows.select(F.col(query).alias("_q"), F.col(tier).alias("tier_lo"), F.col(item).alias("lo"), F.col(score).alias("score_lo"))
    hi = rows.select(query, F.col(tier).alias("tier_hi"), F.col(item).alias("hi"), F.col(score).alias("score_hi"))
    return hi.join(lo, (F.col(query) == F.col("_q")) & (F.col("tier_hi") > F.col("tier_lo"))).drop("_q")


def surfacing(rows: DataFrame, query: str, good: str, score: str, item: str, k: int = 3) -> DataFrame:
    """Over queries: how often the best item is good, the k best hold a good one, mean recall at k, and the chance rate."""
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(query).orderBy(F.col(score).desc(), item)))
    per = ranked.groupBy(query).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(good))).alias("_top"), F.max(F.when(F.col("_rn") <= k, F.col(good))).alias("_any"),
        F.try_divide(F.sum(F.when(F.col("_rn") <= k, F.col(good)).otherwise(0)), F.sum(good)).alias("_recall"), F.avg(good).alias("_share"),
    )
    return per.agg(F.avg("_top").alias("top1_good"), F.avg("_any").alias("topk_contains"), F.avg("_recall").alias("recall_at_k"), F.avg("_share").alias("random"))


def _draw(*parts: object) -> Column:
    """28 bits of the md5 of parts joined by bars, which any engine can reproduce."""
    text = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval over resampled clusters.

    Poisson(1) weights from a hash of cluster and replicate stand for resampling, so it is one pass and a small aggregation.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).cast("double").alias("_s"), F.count(value).alias("_n"))
    u = (_draw(seed, F.col("_r"), F.col(cluster)) + 0.5) / float(1 << 28)
    weight, p, c = F.lit(0), np.exp(-1.0), np.exp(-1.0)
    for k in range(1, 9):  # the inverse of Poisson(1)'s distribution; beyond 8 its chance is 1e-6
        weight = weight + (u > float(c)).cast("int")
        p /= k
        c += p
    drawn = sums.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    means = drawn.groupBy("_r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    edge = (1 - level) / 2
    q = means.agg(F.percentile("_m", F.lit(edge)).alias("low"), F.percentile("_m", F.lit(1 - edge)).alias("high"))
    return q.join(rows.agg(F.avg(value).alias("mean")).hint("broadcast"), F.lit(True)).select("mean", "low", "high")


def permutation_p(rows: DataFrame, x: str, y: str, replicates: int, seed: int = 0) -> DataFrame:
    """(1 + permutations whose covariance reaches the observed one) / (1 + replicates).

    A replicate pairs x in its own order with y in the order of a hash; it is one task's work, over all rows' x and y.
    """
    import hashlib

    import pandas as pd

    own = rows.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).withColumn("_i", F.row_number().over(W.orderBy("_x", "_y")))
    given = own.select("_i", "_x", "_y", F.col("_x").isNotNull().alias("_kx"), F.col("_y").isNotNull().alias("_ky"))
    many = given.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        f, r = frame.sort_values("_i"), int(frame["_r"].iloc[0])
        turn = np.arange(len(f))
        if r:  # as _draw
            turn = np.argsort([int(hashlib.md5(b"%d|%d|%d" % (seed, r, i)).hexdigest()[:7], 16) for i in f["_i"].tolist()], kind="stable")
        known = f["_kx"].to_numpy() & f["_ky"].to_numpy()[turn]
        s = float((f["_x"].to_numpy()[known] * f["_y"].to_numpy()[turn][known]).sum()) if known.any() else None
        return pd.DataFrame({"r": [r], "s": pd.array([s], "Float64")})

    stat = many.groupBy("_r").applyInPandas(one, "r long, s double")
    seen = F.max(F.when(F.col("r") == 0, F.col("s"))).over(W.partitionBy())
    return stat.withColumn("_o", seen).where("r > 0").agg(((F.count_if(F.col("s") >= F.col("_o") - 1e-9) + 1) / (F.count("*") + 1)).alias("p"))


def split_half(rows: DataFrame, unit: str, item: str, value: str, splits: int, seed: int = 0) -> DataFrame:
    """Median over hash halves of units of the rank correlation of the items' means in either half."""
    half = _draw(seed, F.col("_r"), F.col(unit)) % 2
    many = rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(splits)))).withColumn("_h", half)
    means = many.groupBy("_r", item).agg(F.avg(F.when(F.col("_h") == 0, F.col(value))).alias("a"), F.avg(F.when(F.col("_h") == 1, F.col(value))).alias("b")).where("a is not null and b is not null")
    ranks = means.select("_r", average_rank(F.col("a"), ["_r"]).alias("ra"), average_rank(F.col("b"), ["_r"]).alias("rb"))
    return ranks.groupBy("_r").agg(F.corr("ra", "rb").alias("rho")).agg(F.median("rho").alias("median_rho"), F.count("rho").alias("splits"))


def out_of_fold_logistic(rows: DataFrame, key: str, features: Sequence[str], y: str, fold: str, c: float = 1.0, rounds: int = 30) -> DataFrame:
    """key and p: standardised L2 logistic regression by Newton steps, each fold scored by a model of the others.

    The normal equations of each step are sums over rows, so only (features + 1)^2 numbers per fold reach the driver.
    """
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    d = len(features) + 1
    out = None
    for f in folds:
        train = rows.where(F.col(fold) != f)
        stats = train.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(features)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(features))).first()
        z = [F.lit(1.0)] + [(F.col(x) - F.lit(float(stats[f"m{i}"] or 0))) / F.lit(float(stats[f"s{i}"] or 1) or 1.0) for i, x in enumerate(features)]
        w = np.zeros(d)
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-sum((float(a) * b for a, b in zip(w, z, strict=True)), F.lit(0.0))))
            marked = train.select(*(v.alias(f"z{i}") for i, v in enumerate(z)), p.alias("p"), F.col(y).cast("double").alias("y"))
            grad = [F.sum((F.col("p") - F.col("y")) * F.col(f"z{i}")) for i in range(d)]
            hess = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"z{i}") * F.col(f"z{j}")) for i in range(d) for j in range(d)]
            got = np.array([x or 0.0 for x in marked.agg(*grad, *hess).first()])
            prior = np.diag([0.0] + [1 / c] * (d - 1))
            step = np.linalg.solve(got[d:].reshape(d, d) + prior + 1e-9 * np.eye(d), got[:d] + prior @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        p = 1 / (1 + F.exp(-sum((float(a) * b for a, b in zip(w, z, strict=True)), F.lit(0.0))))
        part = rows.where(F.col(fold) == f).select(key, F.col(fold), p.alias("p"))
        out = part if out is None else out.union(part)
    return out


def ridge(rows: DataFrame, features: Sequence[str], y: str, reg: float) -> np.ndarray:
    """Intercept and weights of ridge regression; the normal equations are one aggregation."""
    z = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    d = len(z)
    sums = rows.agg(*(F.sum(a * b) for a in z for b in z), *(F.sum(a * F.col(y)) for a in z)).first()
    x = np.array([v or 0.0 for v in sums])
    return np.linalg.solve(x[: d * d].reshape(d, d) + reg * np.diag([0.0] + [1.0] * (d - 1)) + 1e-12 * np.eye(d), x[d * d :])


def bradley_terry(pairs: DataFrame, winner: str, loser: str, rounds: int = 50, prior: float = 0.1) -> DataFrame:
    """item and strength (log, mean 0) by minorise-maximise rounds; `prior` wins and losses against an average item.

    Pairs are counted once; each round is a join and an aggregation over items. Items, not pairs, reach the driver: they
    are a catalogue of bounded size here.
    """
    counts = pairs.groupBy(F.col(winner).alias("w"), F.col(loser).alias("l")).agg(F.count("*").alias("n")).toPandas()
    items = sorted(set(counts["w"]) | set(counts["l"]))
    at = {x: i for i, x in enumerate(items)}
    a, b, n = counts["w"].map(at).to_numpy(int), counts["l"].map(at).to_numpy(int), counts["n"].to_numpy(float)
    s, wins = np.ones(len(items)), np.bincount(a, n, len(items)) + prior
    for _ in range(rounds):
        inv = n / (s[a] + s[b])
        s = wins / (np.bincount(a, inv, len(items)) + np.bincount(b, inv, len(items)) + 2 * prior / (s + 1))
        s /= np.exp(np.log(s).mean())
    return pairs.sparkSession.createDataFrame(pd.DataFrame({"item": items, "strength": np.log(s)}))
