"""Shared pieces: tables in the shared folder, Arrow streams, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that Python code sees at once; the texts of a batch stay within a few MB.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if not (found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Table:
    """A DataFrame written once to the shared folder and read back, so that its lineage ends here."""

    def __init__(self, df: DataFrame, narrow: bool = False):
        """narrow: rows of a few numbers, which need no more files than there are cores to write them."""
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
        (df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if narrow else df).write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession) -> None:
    """Lets the driver notice which shuffles nothing refers to any longer, so that their files go before the next are written,
    and give back what it has freed."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then what it has freed goes back to the system: workers outlive their tasks, and stages share a machine."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return trimmed


def unused(columns: list[str], *names: str) -> list[str]:
    """Column names like the given ones that clash with no column, whatever its case."""
    line = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in columns), default=0))
    return [line + n for n in names]


def small_batches(spark: SparkSession) -> None:
    """Python stages over texts get batches of BATCH_ROWS rows at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sorted_chunks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows from a stream sorted by `keys`; a run of equal keys is never cut."""
    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        changed = run_starts(table, keys)
        cut = int(changed[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut).combine_chunks()
        kept, n = table.to_batches(), table.num_rows
        rows = max(rows, 2 * n) if not cut else rows
    if n:
        yield pa.Table.from_batches(kept).combine_chunks()


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of each run of equal keys."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        v = table.column(key).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per item: the item of each element, and the element's place within its item."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b), by min-label hooking and shortcuts."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 1_000_000) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an edge list of longs.

    Each task first connects what its own edges connect. If no more than `few` edges (16 bytes each) are left, one task
    connects them; else large-star and small-star rounds alternate until no edge changes, and each round's edges are a
    table in the shared folder. The result is the same. Hubs are safe: minima are pre-aggregated map-side,
    and a second grouping column makes the planner exchange both sides of the join anew, so that adaptive execution can
    split a hub's partition. Null ends and loops are left out.
    """
    both_ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo")
    now = Table(both_ends.mapInArrow(lean(_contracted), "hi long, lo long").distinct(), narrow=True)
    if now.df.count() <= few:
        after = Table(now.df.coalesce(1).mapInArrow(lean(lambda batches: _contracted(batches, few + 1)), "hi long, lo long"))
        now.drop()
        return after.df.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(after.df.select("lo", "lo").distinct())
    state = None
    while True:
        seen = now.df.agg(F.count("*"), *(F.sum(F.xxhash64("hi", "lo", F.lit(turn)).cast("decimal(20,0)")) for turn in (1, 2))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.df.select("lo", "hi"))
        large = _least(both, "u", "v", own=True).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = _least(large, "hi", "lo").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        after = Table(small.select("e.*").where("hi != lo").distinct(), narrow=True)
        now.drop()
        now = after
    return now.df.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.df.select("lo", "lo").distinct())


def _contracted(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same nodes as the given ones, from each node to the smallest that a run of `rows` edges reaches."""

    def stars(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept)
        hi, lo = table.column("hi").to_numpy(), table.column("lo").to_numpy()
        nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(hi)], at[len(hi) :])
        moved = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["hi", "lo"])

    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield stars(kept)
            kept, n = [], 0
    if n:
        yield stars(kept)


def _least(edges: DataFrame, u: str, v: str, own: bool = False) -> DataFrame:
    """Each edge with m: the least neighbour v of its u (u itself counts if own)."""
    least = edges.groupBy(F.col(u).alias("k"), (F.col(u) % 2).alias("_odd")).agg(F.min(v).alias("m")).drop("_odd")
    if own:
        least = least.withColumn("m", F.least("m", "k"))
    return edges.join(least, edges[u] == least["k"]).drop("k")
