"""Order-dependent selections: one fold over each group's rows, in a stated order.

Each step depends on all before it, so a group is one task's work: choose groups that fit one. Inputs are sorted inside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarry.streaming.replay import Budget, ProbeGovernor


def fold(rows: DataFrame, groups: Sequence[str], order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, ascending: Sequence[bool] | bool = True) -> DataFrame:
    """step of each group's rows in order; without groups all rows are one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return step(frame.sort_values(list(order), ascending=ascending, kind="stable").reset_index(drop=True))

    return rows.groupBy(*groups).applyInPandas(run, schema)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def medoid_clusters(rows: DataFrame, groups: Sequence[str], key: str, vec: str, threshold: float = 0.974, strict: bool = True) -> DataFrame:
    """key and cluster: the key of the most similar medoid if its cosine is over (or, not strict, at) the threshold, else the row founds one.

    Of equally similar medoids the first wins.
    """

    def step(f: pd.DataFrame) -> pd.DataFrame:
        x, keys = _unit(f[vec]), f[key].to_numpy()
        medoids: list[int] = []
        out = []
        for i in range(len(x)):
            s = x[medoids] @ x[i] if medoids else np.zeros(0)
            j = int(np.argmax(np.round(s, 12))) if medoids else -1
            if medoids and (s[j] > threshold if strict else s[j] >= threshold):
                out.append(keys[medoids[j]])
            else:
                medoids.append(i)
                out.append(keys[i])
        return pd.DataFrame({key: keys, "cluster": out})

    return fold(rows, groups, [key], step, f"{key} long, cluster long")


def distinct_looks(rows: DataFrame, groups: Sequence[str], key: str, vec: str, threshold: float = 0.974) -> DataFrame:
    """key and fresh: whether no earlier fresh row's cosine reaches the threshold."""
    out = medoid_clusters(rows, groups, key, vec, threshold, strict=False)
    return out.select(key, (F.col(key) == F.col("cluster")).alias("fresh"))


class BudgetExhausted(Exception):
    """Raised by an embedding callback that may embed no more."""


def embedded_looks(rows: DataFrame, groups: Sequence[str], key: str, vec: str, embed: Callable[[], Callable[[object], object]], threshold: float = 0.974) -> DataFrame:
    """key and status: kept, removed (its cosine to a kept one reaches the threshold), unembeddable or not_reached.

    embed makes a callback for each group, which gets the value of `vec` and returns a vector or None, or raises
    BudgetExhausted. Rows that it cannot embed, or does not reach any more, stay and are told apart.
    """

    def step(f: pd.DataFrame) -> pd.DataFrame:
        call, looks, status = embed(), [], []
        for value in f[vec]:
            try:
                e = call(value)
            except BudgetExhausted:
                status.append("not_reached")
                continue
            if e is None:
                status.append("unembeddable")
                continue
            e = np.asarray(e, np.float64)
            e = e / max(np.sqrt((e * e).sum()), 1e-300)
            near = bool(looks) and float((np.stack(looks) @ e).max()) >= threshold
            status.append("removed" if near else "kept")
            if not near:
                looks.append(e)
        return pd.DataFrame({key: f[key], "status": status})

    return fold(rows, groups, [key], step, f"{key} long, status string")


def budgeted(calls: int) -> Callable[[], Callable[[object], object]]:
    """A maker of callbacks that hand a vector on, at most `calls` times."""

    def make() -> Callable[[object], object]:
        left = calls

        def call(value: object) -> object:
            nonlocal left
            if not left:
                raise BudgetExhausted
            left -= 1
            return value

        return call

    return make


def spatial_dedup(rows: DataFrame, groups: Sequence[str], order: Sequence[str], key: str, x: str, y: str, radius: float) -> DataFrame:
    """Keys kept, in order, such that no kept row lies closer than radius to an earlier kept one.

    Kept rows are looked up through a grid as wide as the radius, so a group costs its rows, not its pairs.
    """

    def step(f: pd.DataFrame) -> pd.DataFrame:
        grid: dict[tuple[int, int], list[tuple[float, float]]] = {}
        kept = []
        for k, a, b in zip(f[key], f[x], f[y], strict=True):
            i, j = int(np.floor(a / radius)), int(np.floor(b / radius))
            if all((a - c) ** 2 + (b - d) ** 2 >= radius * radius for di in (-1, 0, 1) for dj in (-1, 0, 1) for c, d in grid.get((i + di, j + dj), ())):
                grid.setdefault((i, j), []).append((a, b))
                kept.append(k)
        return pd.DataFrame({key: pd.Series(kept, dtype="int64")})

    return fold(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), groups, [*order, key], step, f"{key} long")


def near_dup_cloud(rows: DataFrame, groups: Sequence[str], key: str, x: str, y: str, width: str, k: float = 0.25, scale: str = "min") -> DataFrame:
    """Keys of rows that are no near-duplicate of an earlier kept one: distance below k x the smaller (or larger) width."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        pick = np.minimum if scale == "min" else np.maximum
        p, w, kept = f[[x, y]].to_numpy(float), f[width].to_numpy(float), []
        for i in range(len(f)):
            if not kept or not (np.hypot(*(p[kept] - p[i]).T) < k * pick(w[kept], w[i])).any():
                kept.append(i)
        return pd.DataFrame({key: f[key].iloc[kept].astype("int64")})

    return fold(rows, groups, [key], step, f"{key} long")


def maximin_order(rows: DataFrame, groups: Sequence[str], key: str, vec: str, n: int) -> DataFrame:
    """place and key of the first n rows of the farthest-point order by cosine distance; starts at the least key, ties by key."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        x, at, order = _unit(f[vec]), 0, [0]
        far = 1 - x @ x[0]
        while len(order) < min(n, len(x)):
            far[order[-1]] = -np.inf
            at = int(np.argmax(np.round(far, 12)))
            order.append(at)
            far = np.minimum(far, 1 - x @ x[at])
        return pd.DataFrame({"place": np.arange(len(order)), key: f[key].to_numpy()[order]} | {g: f[g].to_numpy()[order] for g in groups})

    kinds = "".join(f", {g} {rows.schema[g].dataType.simpleString()}" for g in groups)
    return fold(rows, groups, [key], step, f"place long, {key} long{kinds}")


def marginal_gain(rows: DataFrame, groups: Sequence[str], key: str, vec: str, score: str, n: int) -> DataFrame:
    """place, key and gain: repeatedly the row with the largest percentile x (1 - largest similarity to the chosen), ties by score, then key."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        x, s, keys = _unit(f[vec]), f[score].to_numpy(float), f[key].to_numpy()
        pct = np.searchsorted(np.sort(s), s, side="right") / len(s)
        near, left, out = np.zeros(len(s)), np.ones(len(s), bool), []
        for place in range(min(n, len(s))):
            gain = np.round(pct * (1 - near), 12)
            best = min(np.flatnonzero(left), key=lambda i: (-gain[i], -s[i], keys[i]))
            out.append((place, keys[best], gain[best]))
            left[best] = False
            near = np.maximum(near, np.maximum(0, x @ x[best]))
        return pd.DataFrame(out, columns=["place", key, "gain"])

    return fold(rows, groups, [key], step, f"place long, {key} long, gain double")


def map_elites(rows: DataFrame, cell: Sequence[str], key: str, score: str, palette: str, cap: int, identity: str) -> DataFrame:
    """Per cell the best row, best cells first, with at most cap rows of a palette and one of an identity.

    The caps couple all cells, so one fold chooses. SQL sends it no more than could be chosen: at most palettes x cap rows
    are, so of a cell's rows of one palette the best of each identity, and of these the best palettes x cap + 1.
    """
    most = rows.agg(F.countDistinct(palette)).head()[0] * cap + 1
    best = [F.col(score).desc(), F.col(key)]
    first = F.row_number().over(W.partitionBy(*cell, palette, identity).orderBy(*best))
    ranked = rows.withColumn("_one", first).where("_one = 1").withColumn("_rank", F.row_number().over(W.partitionBy(*cell, palette).orderBy(*best)))
    rows = ranked.where(F.col("_rank") <= most).drop("_one", "_rank")

    def step(f: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        cells, seen, out = set(), set(), []
        for k, p, i, *c in zip(f[key], f[palette], f[identity], *(f[x] for x in cell), strict=True):
            if tuple(c) not in cells and used.get(p, 0) < cap and i not in seen:
                cells.add(tuple(c))
                seen.add(i)
                used[p] = used.get(p, 0) + 1
                out.append(k)
        return pd.DataFrame({key: pd.Series(out, dtype="int64")})

    return fold(rows, [], [score, key], step, f"{key} long", ascending=[False, True])


def collision_assign(rows: DataFrame, group: str, key: str, vec: str, options: int, weight: float, tau: float = 0.9) -> DataFrame:
    """key and option: in order of the gap between best and second fit, the option with the largest fit - weight x sum of
    ramps of the cosine to rows that have it already. Fits are the first `options` entries of vec."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        x = _unit(f[vec])
        fit = x[:, :options]
        top = np.sort(fit, 1)
        taken: list[list[int]] = [[] for _ in range(options)]
        out = np.zeros(len(x), int)
        for i in np.lexsort((f[key], -(top[:, -1] - top[:, -2]))):
            cost = [sum(max(0.0, (x[j] @ x[i] - tau) / (1 - tau)) for j in taken[o]) for o in range(options)]
            out[i] = int(np.argmax(np.round(fit[i] - weight * np.array(cost), 12)))
            taken[out[i]].append(i)
        return pd.DataFrame({key: f[key], "option": out})

    return fold(rows, [group], [key], step, f"{key} long, option long")


def spaced_pool(rows: DataFrame, group: str, key: str, value: str, spacing: float, n: int) -> DataFrame:
    """Per group the first n keys whose values keep `spacing` from all kept before."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        v = f[value].to_numpy(float)
        for i in range(len(v)):
            if len(kept) < n and (not kept or np.abs(v[kept] - v[i]).min() >= spacing):
                kept.append(i)
        return pd.DataFrame({key: f[key].iloc[kept].astype("int64")})

    return fold(rows, [group], [key], step, f"{key} long")


def governed(rows: DataFrame, group: str, key: str, cell: str, rate: int, window: int, ttl: int) -> DataFrame:
    """key and allowed, of each group's rows in key order, a row a step: what ProbeGovernor lets through."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        governor = ProbeGovernor(rate, window, ttl)
        return pd.DataFrame({key: f[key], "allowed": [governor.allow(c, now) for now, c in enumerate(f[cell])]})

    return fold(rows, [group], [key], step, f"{key} long, allowed boolean")


def within_budget(rows: DataFrame, group: str, key: str, cost: str, total: float) -> DataFrame:
    """key and spent of each group's rows, in key order, that are run before the next is expected to overrun the total."""

    def step(f: pd.DataFrame) -> pd.DataFrame:
        budget, out = Budget(total), []
        for k, c in zip(f[key], f[cost], strict=True):
            if not budget.fits():
                break
            budget.charge(float(c))
            out.append((k, budget.spent))
        return pd.DataFrame(out, columns=[key, "spent"])

    return fold(rows, [group], [key], step, f"{key} long, spent double")
