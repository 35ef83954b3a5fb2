"""Deals, quotas, shares and schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deal(cells: DataFrame, cell: str, size: str, n: int, preseed: str | None = None) -> DataFrame:
    """cell, size and take: repeatedly one unit to the cell with the least (take + preseed), larger cells first, until n or all are dealt.

    Closed form: the level up to which all cells are filled is found from running sums over distinct sizes, and the rest
    goes one each in order, so units are never expanded.
    """
    pre = F.coalesce(F.col(preseed), F.lit(0)) if preseed else F.lit(0)
    base = cells.select(cell, F.col(size).cast("long").alias("size"), pre.cast("long").alias("pre"))
    # Taking starts at level pre and ends at pre + size; a cell has at level L taken clamp(L - pre, 0, size).
    events = base.select(F.explode(F.array(F.struct(F.col("pre").alias("at"), F.lit(1).alias("d")), F.struct((F.col("pre") + F.col("size")).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy("e.at").agg(F.sum("e.d").alias("d"))
    up = W.orderBy("at")
    lines = steps.select("at", F.sum("d").over(up).alias("open"), F.lead("at").over(up).alias("next"))
    dealt = lines.withColumn("before", F.sum(F.col("open") * (F.col("next") - F.col("at"))).over(up.rowsBetween(W.unboundedPreceding, -1)))
    dealt = dealt.select("at", "open", F.coalesce("next", F.lit(2**62)).alias("next"), F.coalesce("before", F.lit(0)).alias("before"))
    mark = dealt.where(F.col("before") <= n).groupBy().agg(F.max(F.struct("at", "before", "open", "next")).alias("m"))
    level = mark.select((F.col("m.at") + F.when(F.col("m.open") > 0, F.least(F.col("m.next") - F.col("m.at"), F.floor((F.lit(n) - F.col("m.before")) / F.col("m.open")))).otherwise(0)).alias("level"))
    filled = base.join(level.hint("broadcast"), F.lit(True)).withColumn("take", F.greatest(F.lit(0), F.least(F.col("size"), F.col("level") - F.col("pre"))))
    hungry = (F.col("take") < F.col("size")) & (F.col("pre") <= F.col("level"))
    left = F.lit(n) - F.sum("take").over(W.partitionBy())
    turn = F.row_number().over(W.orderBy(hungry.desc(), F.col("size").desc(), cell))
    return filled.withColumn("_left", left).withColumn("_turn", turn).select(cell, "size", (F.col("take") + F.when(hungry & (F.col("_turn") <= F.col("_left")), 1).otherwise(0)).alias("take"))


def balanced(dealt: DataFrame) -> DataFrame:
    """Whether each cell is within one of the largest take, or drained."""
    return dealt.withColumn("_max", F.max("take").over(W.partitionBy())).agg(F.bool_and((F.col("take") >= F.col("_max") - 1) | (F.col("take") == F.col("size"))).alias("balanced"))


def draw_balanced(rows: DataFrame, cell: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """n rows: each cell gives its deal's share of its first rows."""
    sizes = rows.groupBy(cell).agg(F.count("*").alias("size"))
    take = deal(sizes, cell, "size", n).select(F.col(cell).alias("_c"), "take")
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(cell).orderBy(*order)))
    return ranked.join(take, F.col(cell) == F.col("_c")).where("_rn <= take").drop("_c", "_rn", "take")


def draw_reserved(rows: DataFrame, cell: str, order: Sequence[Column | str], key: str, n: int, reservations: Mapping[str, int]) -> DataFrame:
    """Reserved cells first give their number; the other places are dealt with these as preseed."""
    reserved = F.coalesce(*(F.when(F.col(cell) == c, F.lit(k)) for c, k in reservations.items()), F.lit(0)) if reservations else F.lit(0)
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy(cell).orderBy(*order, key))).withColumn("_k", reserved)
    sizes = ranked.groupBy(cell).agg(F.count("*").alias("n"), F.max("_k").alias("k"))
    held = sizes.withColumn("pre", F.least("n", "k"))
    used = sum(min(k, n) for k in reservations.values())
    rest = held.withColumn("size", F.col("n") - F.col("pre"))
    first = held.agg(F.sum("pre")).first()[0] or 0
    take = deal(rest, cell, "size", max(0, n - min(first, used)), "pre").select(F.col(cell).alias("_c"), F.col("take").alias("_t")).join(held.select(F.col(cell).alias("_h"), "pre"), F.col("_c") == F.col("_h"))
    return ranked.join(take, F.col(cell) == F.col("_c")).where(F.col("_rn") <= F.col("pre") + F.col("_t")).withColumn("reserved", F.col("_rn") <= F.col("pre")).drop("_c", "_h", "_t", "_rn", "_k", "pre")


def sequence_by_deficit(cells: DataFrame, cell: str, size: str) -> DataFrame:
    """pos and cell of the order that always serves the cell furthest below its share; ties by cell.

    Inherently sequential: each step depends on all before, so the (few) cells go to one task.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(cell, kind="stable")
        names, sizes = frame[cell].tolist(), [int(s) for s in frame[size]]
        total, taken, out = sum(sizes), [0] * len(sizes), []
        for length in range(1, total + 1):
            best = max((i for i in range(len(sizes)) if taken[i] < sizes[i]), key=lambda i: (length * sizes[i] - taken[i] * total, -i))
            taken[best] += 1
            out.append((length, names[best]))
        return pd.DataFrame(out, columns=["pos", cell])

    kind = cells.schema[cell].dataType.simpleString()
    return cells.select(cell, size).groupBy().applyInPandas(run, f"pos long, {cell} {kind}")


def prefix_deviation(sequence: DataFrame, cell: str, pos: str) -> DataFrame:
    """The largest distance, over prefixes and cells, of a cell's count from its share of the prefix.

    A cell's distance is extreme just before or at one of its own places, or at the end, so cells are not multiplied by places.
    """
    own = W.partitionBy(cell).orderBy(pos)
    n = F.count("*").over(W.partitionBy())
    marked = sequence.select(cell, pos, F.row_number().over(own).alias("k"), F.count("*").over(W.partitionBy(cell)).alias("size"), n.alias("n"))
    at = F.abs(F.col("k") - F.col(pos) * F.col("size") / F.col("n"))
    before = F.abs(F.col("k") - 1 - (F.col(pos) - 1) * F.col("size") / F.col("n"))
    return marked.agg(F.max(F.greatest(at, before)).alias("deviation"))


def shares(rows: DataFrame, weight: str) -> DataFrame:
    return rows.withColumn("share", F.try_divide(F.col(weight), F.sum(weight).over(W.partitionBy())))


def incomplete(ratios: DataFrame, domain: DataFrame, key: str) -> DataFrame:
    """Keys without a ratio, and ratios without a key; a complete table gives none."""
    a, b = domain.select(key).distinct(), ratios.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("problem", F.lit("no ratio")).union(b.join(a, key, "left_anti").withColumn("problem", F.lit("unknown")))


def target_measure(cells: DataFrame, partition: str, weights: DataFrame) -> DataFrame:
    """cells with target: their partition's share of the weights, evenly over its cells."""
    w = weights.select(F.col(partition).alias("_p"), (F.col("weight") / F.sum("weight").over(W.partitionBy())).alias("_w"))
    return cells.join(w, F.col(partition) == F.col("_p")).withColumn("target", F.col("_w") / F.count("*").over(W.partitionBy(partition))).drop("_p", "_w")


def cell_deficit(support: DataFrame, fills: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """support with n, fraction and deficit = target - fraction of the fills in the support."""
    full = support.join(fills.groupBy(*keys).agg(F.count("*").alias("n")), [*keys], "left").fillna(0, ["n"])
    return full.withColumn("fraction", F.coalesce(F.try_divide("n", F.sum("n").over(W.partitionBy())), F.lit(0.0))).withColumn("deficit", F.col(target) - F.col("fraction"))


def softmax_shares(rows: DataFrame, value: str, temperature: float, groups: Sequence[str] = ()) -> DataFrame:
    """rows with p: exp(((v - lo) / span) / temperature) over its sum; uniform if the span is at most 1e-12."""
    own = W.partitionBy(*groups)
    lo, span = F.min(value).over(own), F.max(value).over(own) - F.min(value).over(own)
    e = F.when(span > 1e-12, F.exp((F.col(value) - lo) / span / temperature)).otherwise(1.0)
    return rows.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(own)).drop("_e")


def sample_by_share(rows: DataFrame, share: str, order: str, seed: Column) -> DataFrame:
    """The row whose cumulative share first exceeds a uniform number made from `seed`."""
    run = F.sum(share).over(W.orderBy(order))
    u = (F.conv(F.substring(F.md5(seed.cast("string").cast("binary")), 1, 8), 16, 10).cast("double")) / 4294967296.0
    return rows.withColumn("_run", run).where(F.col("_run") > u).orderBy("_run").limit(1).drop("_run")


def multinomial_expectation(rows: DataFrame, p: str, n: int) -> DataFrame:
    """rows with draws: n p by largest remainders, a fixed stand-in for a multinomial draw."""
    raw = rows.withColumn("_floor", F.floor(F.col(p) * n)).withColumn("_rest", F.col(p) * n - F.col("_floor"))
    left = F.lit(n) - F.sum("_floor").over(W.partitionBy())
    turn = F.row_number().over(W.orderBy(F.col("_rest").desc(), F.col(p).desc(), rows.columns[0]))
    return raw.withColumn("draws", (F.col("_floor") + F.when(turn <= left, 1).otherwise(0)).cast("long")).drop("_floor", "_rest")


def floor_shares(deficits: Mapping[str, float], prices: Mapping[str, float], floor: float) -> dict[str, float]:
    """Shares in proportion to deficit x price, none below `floor`: those below are pinned and the rest scaled, until none falls below.

    A few partitions of a schedule, so plain arithmetic. All-zero weights give even shares.
    """
    weight = {k: max(0.0, d) * prices[k] for k, d in deficits.items()}
    if not weight or floor * len(weight) > 1:
        raise ValueError("the floors do not fit")
    if sum(weight.values()) <= 0:
        return {k: 1 / len(weight) for k in weight}
    pinned: set[str] = set()
    while True:
        free = {k: w for k, w in weight.items() if k not in pinned}
        total, room = sum(free.values()), 1 - floor * len(pinned)
        out = {k: floor if k in pinned else room * free[k] / total if total else room / len(free) for k in weight}
        low = {k for k in free if out[k] < floor - 1e-15}
        if not low:
            return out
        pinned |= low


def furthest_below(rows: DataFrame, key: str, intended: Column, realised: Column) -> DataFrame:
    """The key with the largest intended less realised share, of equals the first by name."""
    gap = rows.select(key, (intended - realised).alias("gap"))
    return gap.orderBy(F.round("gap", 12).desc(), key).limit(1)


def fold_intent(rows: DataFrame, key: str, parent: str, intent: str, servable: str, gain: float = 1.0) -> DataFrame:
    """rows with `folded`: intents of children that cannot be served are added, times gain, to their parent's."""
    lost = rows.where(~F.col(servable) & F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.sum(F.col(intent) * gain).alias("_add"))
    own = F.when(~F.col(servable) & F.col(parent).isNotNull(), F.lit(0.0)).otherwise(F.col(intent))
    return rows.join(lost, F.col(key) == F.col("_p"), "left").withColumn("folded", own + F.coalesce("_add", F.lit(0.0))).drop("_p", "_add")


def mode_budget(n: int, modes: int, fraction: float = 0.25) -> tuple[int, int]:
    """(budget, floor per mode): round(fraction n), half to even, and budget // (modes + 2)."""
    budget = round(fraction * n)
    return budget, budget // (modes + 2)


def allocate_modes(rows: DataFrame, location: str, mode: str, score: str, n: int, fraction: float = 0.25) -> DataFrame:
    """At most one row per location: each mode's best up to the floor, then the best of what is left up to the budget."""
    modes = rows.select(mode).distinct().count()
    budget, floor = mode_budget(n, modes, fraction)
    best = rows.withColumn("_l", F.row_number().over(W.partitionBy(location).orderBy(F.col(score).desc(), mode))).where("_l = 1").drop("_l")
    ranked = best.withColumn("_m", F.row_number().over(W.partitionBy(mode).orderBy(F.col(score).desc(), location)))
    return ranked.withColumn("phase", F.when(F.col("_m") <= floor, "floor").otherwise("surplus")).orderBy("phase", F.col(score).desc(), location).limit(budget).drop("_m")


def sampler_weights(rows: DataFrame, klass: str, group: str, biased: str, beta: float = 0.4) -> DataFrame:
    """rows with weight 1 / sqrt(class count) x 1 / group count, x beta if biased, and its share of all weight."""
    w = 1 / F.sqrt(F.count("*").over(W.partitionBy(klass))) / F.count("*").over(W.partitionBy(group)) * F.when(F.col(biased), beta).otherwise(1.0)
    return rows.withColumn("weight", w).withColumn("mass", F.col("weight") / F.sum("weight").over(W.partitionBy()))


def weighted_sample(rows: DataFrame, weight: Column, key: str, n: int, strata: Sequence[str] = (), seed: str = "") -> DataFrame:
    """n rows of each stratum without replacement, by the smallest -ln(u) / weight (u from md5 of the key)."""
    u = (F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    ranked = rows.withColumn("_k", -F.log(u) / weight)
    return ranked.withColumn("_rn", F.row_number().over(W.partitionBy(*strata).orderBy("_k", key))).where(F.col("_rn") <= n).drop("_k", "_rn")


def alternating_sample(rows: DataFrame, seed_of: str, mode: str, order: str, cap: int, n: int) -> DataFrame:
    """At most cap rows per seed; then modes take turns; the first n."""
    capped = rows.withColumn("_s", F.row_number().over(W.partitionBy(seed_of).orderBy(order))).where(F.col("_s") <= cap).drop("_s")
    return capped.withColumn("turn", F.row_number().over(W.partitionBy(mode).orderBy(order))).orderBy("turn", mode).limit(n)


def repeats_queue(rows: DataFrame, key: str, share: float = 0.1, apart: int = 12, seed: str = "") -> DataFrame:
    """pos, key and pass: all rows in hash order, and a share of them again at least `apart` places later."""
    order = F.row_number().over(W.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key))
    first = rows.select(F.col(key), order.cast("double").alias("at"), F.lit(1).alias("pass"))
    every = max(1, round(1 / share))
    again = first.where(F.col("at") % every == 0).select(key, (F.col("at") + apart + 0.5).alias("at"), F.lit(2).alias("pass"))
    return first.union(again).select(F.row_number().over(W.orderBy("at", "pass")).alias("pos"), key, "pass")
