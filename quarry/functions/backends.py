"""Samplers of a plane behind one name, and scorers that load once in each Python process."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: value of each point (re, im) at most `most` steps long
Sampler = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
BACKENDS: dict[str, Sampler] = {}


def backend(name: str) -> Callable[[Sampler], Sampler]:
    """Registers a sampler; a name can be given once."""

    def add(f: Sampler) -> Sampler:
        if name in BACKENDS:
            raise ValueError(f"{name} is registered already")
        BACKENDS[name] = f
        return f

    return add


def _escape(re: np.ndarray, im: np.ndarray, most: int, fold: bool) -> np.ndarray:
    """Steps of z -> z^2 + c (of |re| + i|im| with fold) until |z|^2 exceeds 4; most if it does not."""
    x, y, n = np.zeros_like(re), np.zeros_like(im), np.zeros(re.shape, np.int64)
    live = np.ones(re.shape, bool)
    for _ in range(most):
        a, b = (np.abs(x), np.abs(y)) if fold else (x, y)
        x, y = np.where(live, a * a - b * b + re, x), np.where(live, 2 * a * b + im, y)
        live &= x * x + y * y <= 4
        n += live
    return n


@backend("square")
def square(re: np.ndarray, im: np.ndarray, most: int) -> np.ndarray:
    return _escape(re, im, most, fold=False)


@backend("folded")
def folded(re: np.ndarray, im: np.ndarray, most: int) -> np.ndarray:
    return _escape(re, im, most, fold=True)


def sample(views: DataFrame, key: str, side: int, most: int) -> DataFrame:
    """key, i, j and steps: each view's grid of side x side points, by the backend it names.

    views holds key, backend, cx, cy and width. All views of a batch and backend are sampled as one array; an unknown
    backend is an error.
    """
    registry = dict(BACKENDS)  # goes to the executors with the function

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = (np.arange(side) + 0.5) / side - 0.5
        j, i = np.meshgrid(np.arange(side), np.arange(side))
        for f in batches:
            for name, g in f.groupby("backend", sort=False):
                cx, cy, w = (g[c].to_numpy(float)[:, None, None] for c in ("cx", "cy", "width"))
                n = registry[name](cx + step[j] * w, cy + step[i] * w, most)
                yield pd.DataFrame({key: np.repeat(g[key].to_numpy(), side * side), "i": np.tile(i.ravel(), len(g)), "j": np.tile(j.ravel(), len(g)), "steps": n.ravel()})

    return views.select(key, "backend", "cx", "cy", "width").mapInPandas(run, f"{key} long, i long, j long, steps long")


def batch_score(rows: DataFrame, key: str, features: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int) -> DataFrame:
    """key, p and why: a model's probability of each feature array, by batches.

    load runs once a task and returns the scorer of (n, width) arrays. Rows without `width` finite features get no p and say why,
    so one bad row costs no batch; an error of the scorer itself is not swallowed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in batches:
            why = [None if v is not None and len(v) == width and np.isfinite(np.asarray(v, float)).all() else "no features" if v is None else "bad features" for v in f[features]]
            good = np.array([w is None for w in why], bool)
            p = np.full(len(f), np.nan)
            if good.any():
                p[good] = model(np.array(f.loc[good, features].tolist(), np.float64))
            yield pd.DataFrame({key: f[key], "p": pd.Series(p).astype(object).where(good, None), "why": why})

    return rows.select(key, features).mapInPandas(run, f"{key} long, p double, why string")


def linear_scorer(weights: Sequence[float], bias: float) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader of the logistic of weighted sums."""
    return lambda: lambda x: 1 / (1 + np.exp(-(x @ np.asarray(weights, float) + bias)))
