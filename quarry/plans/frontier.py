"""Iterative plans: a scored frontier, guided descents, maneuvers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import fields
from quarry.operators.cluster import written
from quarry.operators.ranking import pop_batch, prune
from quarry.plans.state import RunState


def expand_by_hash(popped: DataFrame, children: int) -> DataFrame:
    """Children of popped nodes with scores near their parent's, by hash; a stand-in for rendering and scoring."""
    kids = popped.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(children))))
    jitter = (F.pmod(F.xxhash64("node", "i"), F.lit(1000)) - 500) / 2000.0
    return kids.select(F.pmod(F.xxhash64("node", "i", F.lit("id")), F.lit(2**62)).alias("node"), "root", (F.col("score") + jitter).alias("score"))


def run(seeds: DataFrame, rounds: int, batch: int, cap: int, children: int, gate: float = 0.5, most: int = 6000, expand: Callable[[DataFrame, int], DataFrame] = expand_by_hash, state: RunState | None = None) -> DataFrame:
    """node, root, score and round of what the frontier admits.

    Each round pops the best nodes of roots below their cap, expands them, admits children at or above the gate and pushes
    all back under a size cap. Frontier and admissions are tables after each round: lineage stays one round long. With a
    state they are saved there, and a later call with the same state goes on after its last round.
    """
    held = state.load() if state else None
    frontier = written(seeds.select("node", "root", "score"))
    admitted = written(seeds.select("node", "root", "score", F.lit(0).alias("round")).limit(0))
    if held:
        frontier, admitted = held[1]["frontier"], held[1]["admitted"]
    for i in range(held[0] + 1 if held else 1, rounds + 1):
        used = admitted.groupBy("root").agg(F.count("*").alias("used"))
        live = frontier.join(used, "root", "left").fillna(0, ["used"])
        popped = written(pop_batch(live, "root", "used", cap, F.col("score") > 0.9, 0.25, batch, "score", "node").select("node", "root", "score"))
        fresh = written(expand(popped, children))
        admitted = written(admitted.union(fresh.where(F.col("score") >= gate).select("node", "root", "score", F.lit(i))))
        rest = frontier.join(popped.select("node"), "node", "left_anti").select("node", "root", "score")
        frontier = written(prune(rest.unionByName(fresh), F.col("score") > 0.9, 0.2, most, "score", "node"))
        if state:
            state.save(i, {"frontier": frontier, "admitted": admitted})
    return admitted


def descend(seeds: DataFrame, steps: int, factor: float = 0.5, most_interior: float = 0.9, least_std: float = 0.5) -> DataFrame:
    """walk, step, cx, cy, width, score and end of walks that zoom to their strongest focus until a gate ends them."""

    def one(walk: int, cx: float, cy: float) -> list[tuple]:
        out, width, end = [], 1.0, "steps"
        for step in range(steps):
            c = fields.plane(cx, cy, width, 18, 32)
            v = fields.smooth_count(c, 96)
            inside = float(np.isnan(v).mean())
            std = float(np.nanstd(v)) if inside < 1 else 0.0
            if inside > most_interior or std < least_std:
                end = "interior" if inside > most_interior else "flat"
                break
            out.append((walk, step, cx, cy, width, std * (1 - inside), None))
            f = fields.foci(np.nan_to_num(np.hypot(*np.gradient(np.nan_to_num(v)))), (1,), 3, 1)
            if not len(f):
                end = "no focus"
                break
            z = c[int(f[0, 0]), int(f[0, 1])]
            cx, cy, width = float(z.real), float(z.imag), width * factor
        return [*out[:-1], (*out[-1][:-1], end)] if out else [(walk, 0, cx, cy, width, 0.0, end)]

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame([x for r in f.itertuples() for x in one(r.walk, r.cx, r.cy)], columns=["walk", "step", "cx", "cy", "width", "score", "end"])

    return seeds.mapInPandas(run_, "walk long, step long, cx double, cy double, width double, score double, end string")


def snap(views: DataFrame, periods: Sequence[int], digits: int = 20) -> DataFrame:
    """view, period, x, y and available: the centre of each period that Newton's rule finds from the view; rows where it finds none say so."""

    def run_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            out = []
            for r in f.itertuples():
                for p in periods:
                    hit = fields.newton_nucleus((repr(float(r.cx)), repr(float(r.cy))), p, digits)
                    out.append((r.view, p, *(hit or (None, None)), hit is not None))
            yield pd.DataFrame(out, columns=["view", "period", "x", "y", "available"])

    return views.mapInPandas(run_, "view long, period long, x string, y string, available boolean")
