"""Streams run to the end of what is there, keyed state, trackers, governors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry.sources.jsonl import scratch_path


def run_to_table(spark: SparkSession, path: str, of: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The result of a stream over the Parquet files at `path`, run until it has read them all.

    State and progress live in the shared folder, so a lost executor or a restart resumes from the last batch. Each batch
    is written to a folder of its own, and a repeated batch overwrites it. In complete mode the last batch is the result.
    """
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    base = scratch_path(spark)
    whole_folder = "." not in name
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if whole_folder else name).parquet(path if whole_folder else folder)
    out = of(source)
    query = (
        out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else i}")).start()
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out/batch=*")


def distinct_tally(rows: DataFrame, key: str, look: str) -> DataFrame:
    """key, looks (distinct values so far) and n, by custom keyed state."""

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, n = state.get if state.exists else ([], 0)
        known = set(seen)
        for f in frames:
            known.update(int(x) for x in f[look])
            n += len(f)
        state.update((sorted(known), n))
        yield pd.DataFrame({key: [keys[0]], "looks": [len(known)], "n": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy(key).applyInPandasWithState(update, f"{key} long, looks long, n long", "seen array<long>, n long", "update", GroupStateTimeout.NoTimeout)


@dataclass
class DeficitTracker:
    """A running histogram against a target."""

    target: Sequence[float]
    counts: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.counts = self.counts or [0.0] * len(self.target)

    def ingest(self, bin_: int, weight: float = 1.0) -> None:
        self.counts[bin_] += weight

    def deficit(self) -> list[float]:
        total = sum(self.counts)
        return [t - (c / total if total else 0.0) for t, c in zip(self.target, self.counts, strict=True)]

    def gain(self, histogram: Sequence[float]) -> float:
        """What adding a histogram would fill."""
        return sum(max(0.0, d) * h for d, h in zip(self.deficit(), histogram, strict=True))


@dataclass
class ProbeGovernor:
    """At most `rate` probes in a window of `window` steps, and none into a cell seen in the last `ttl` steps."""

    rate: int
    window: int
    ttl: int
    _times: list[int] = field(default_factory=list)
    _seen: dict = field(default_factory=dict)

    def allow(self, cell: object, now: int) -> bool:
        self._times = [t for t in self._times if now - t < self.window]
        self._seen = {c: t for c, t in self._seen.items() if now - t < self.ttl}
        if len(self._times) >= self.rate or cell in self._seen:
            return False
        self._times.append(now)
        self._seen[cell] = now
        return True


@dataclass
class Budget:
    """Stops before a batch that would overrun: spent + estimate > total; the estimate is a moving mean of batch costs."""

    total: float
    spent: float = 0.0
    estimate: float = 0.0
    alpha: float = 0.5

    def fits(self) -> bool:
        return self.spent + self.estimate <= self.total

    def charge(self, cost: float) -> None:
        self.estimate = cost if not self.spent else (1 - self.alpha) * self.estimate + self.alpha * cost
        self.spent += cost
