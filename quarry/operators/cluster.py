"""Components, linkage, k-means, Hamming neighbours."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder named by spark.checkpoint.dir (a temporary one where it is unset): lineage ends here."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, key: str, few: int = 1_000_000) -> DataFrame:
    """key (a long) and component (its smallest key) of all nodes over undirected edges (a, b).

    Each task first connects what its own edges connect. If no more than `few` edges are left, one task connects them;
    else large-star and small-star rounds alternate until no edge changes, however long the chains are. Each round's
    edges are a written table, so a lost executor costs one round.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo"))
    now = written(ends.mapInArrow(_stars, "hi long, lo long").distinct())
    if now.count() <= few:
        now = written(now.coalesce(1).mapInArrow(lambda batches: _stars(batches, few + 1), "hi long, lo long"))
    else:
        state = None
        while (seen := now.agg(F.count("*"), *(F.sum(F.xxhash64("hi", "lo", F.lit(turn)).cast("decimal(20,0)")) for turn in (1, 2))).first()) != state:
            state = seen
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
            least = lambda df, u, v: df.join(df.groupBy(F.col(u).alias("k")).agg(F.min(v).alias("m")), F.col(u) == F.col("k"))
            large = least(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).distinct()
            small = least(large, "hi", "lo").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            now = written(small.select("e.*").where("hi <> lo").distinct())
    return nodes.select(key).join(now, F.col(key) == F.col("hi"), "left").select(key, F.coalesce("lo", key).alias("component"))


def _stars(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Edges (hi, lo) that connect the same nodes as the given ones: from each node to the smallest that a run of `rows` edges reaches."""

    def star(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(kept)
        hi, lo = table.column("hi").to_numpy(), table.column("lo").to_numpy()
        nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        a, b, root = at[: len(hi)], at[len(hi) :], np.arange(len(nodes))
        while True:
            low, before = np.minimum(root[a], root[b]), root.copy()
            for end in (before[a], before[b]):
                np.minimum.at(root, end, low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        moved = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["hi", "lo"])

    kept: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield star(kept)
            kept, n = [], 0
    if n:
        yield star(kept)


def single_linkage(rows: DataFrame, key: str, vec: str, least: float, groups: Sequence[str], block: int = 512) -> DataFrame:
    """key and component over pairs of equal groups whose cosine is `least` or more; pairs come from block products."""
    return components(rows, cosine_edges(rows, key, vec, least, groups, block), key)


def cosine_edges(rows: DataFrame, key: str, vec: str, least: float, groups: Sequence[str], block: int = 512) -> DataFrame:
    """Edges (a, b) that connect what pairs with cosine >= least connect, from pairs of hash blocks of each group."""
    n = max(1, -(-rows.count() // block))
    base = rows.select(F.col(key).cast("long").alias("k"), F.concat_ws("|", *groups, F.lit("")).alias("g"), F.col(vec).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    pairs = base.withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.least("own", i.cast("int")).alias("i"), F.greatest("own", i.cast("int")).alias("j")))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["v"].tolist())
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        keys, own = frame["k"].to_numpy(), frame["own"].to_numpy()
        a, b = np.flatnonzero(own == frame["i"].iloc[0]), np.flatnonzero(own == frame["j"].iloc[0])
        link = (x[a] @ x[b].T >= least) & (keys[a][:, None] != keys[b][None, :])
        out, free_a, free_b = [], link.any(1), np.ones(len(b), bool)
        while free_a.any():  # a spanning forest of the block's links connects what all of them do
            ahead = [int(np.argmax(free_a))]
            free_a[ahead] = False
            while ahead:
                r = ahead.pop()
                js = np.flatnonzero(link[r] & free_b)
                free_b[js] = False
                out += [(keys[a[r]], keys[b[j]]) for j in js]
                for j in js:
                    more = np.flatnonzero(link[:, j] & free_a)
                    free_a[more] = False
                    out += [(keys[a[q]], keys[b[j]]) for q in more]
                    ahead += more.tolist()
        return pd.DataFrame(out, columns=["a", "b"])

    return pairs.select("k", "g", "v", "own", "p.i", "p.j").groupBy("g", "i", "j").applyInPandas(run, "a long, b long")


def hamming_pairs(rows: DataFrame, key: str, code: str, radius: int) -> DataFrame:
    """a < b and distance of rows whose 64-bit codes differ in at most `radius` bits.

    Pigeonhole: of radius + 1 bands one is equal, so pairs meet in a band; each pair is kept at its first equal band.
    """
    bands = radius + 1
    width = -(-64 // bands)
    piece = lambda c, i: F.shiftright(c, i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1))
    banded = lambda p: rows.select(F.col(key).alias(f"{p}k"), F.col(code).alias(f"{p}c"), F.explode(F.array(*(F.struct(F.lit(i).alias("i"), piece(F.col(code), i).alias("v")) for i in range(bands)))).alias(f"{p}b"))
    joined = banded("a").join(banded("b"), (F.col("ab") == F.col("bb")) & (F.col("ak") < F.col("bk")))
    distance = F.bit_count(F.col("ac").bitwiseXOR(F.col("bc")))
    first = F.coalesce(*(F.when(piece(F.col("ac"), i) == piece(F.col("bc"), i), F.lit(i)) for i in range(bands)))
    return joined.where((distance <= radius) & (first == F.col("ab.i"))).select(F.col("ak").alias("a"), F.col("bk").alias("b"), distance.alias("distance"))


def hamming_counts(rows: DataFrame, key: str, code: str, radius: int) -> DataFrame:
    """rows with first (the smallest key of its code) and n_links (how many other rows are within `radius` bits).

    Rows of equal codes are one class; only classes are compared, and no pair of rows is made.
    """
    classes = rows.groupBy(code).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    pairs = hamming_pairs(classes, "first", code, radius)
    sizes = classes.select(F.col("first").alias("_k"), F.col("n").alias("_n"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    more = both.join(sizes, F.col("b") == F.col("_k")).groupBy("a").agg(F.sum("_n").alias("_more"))
    counted = classes.join(more, F.col("first") == F.col("a"), "left").select(F.col(code).alias("_c"), "first", (F.col("n") - 1 + F.coalesce("_more", F.lit(0))).alias("n_links"))
    return rows.join(counted, F.col(code) == F.col("_c")).drop("_c")


def average_hash(values: Column) -> Column:
    """64 bits: whether each of the first 64 entries is over their median, the first entry lowest."""
    v = F.slice(F.transform(values, lambda x: x.cast("double")), 1, 64)
    s = F.array_sort(v)
    middle = (F.element_at(s, 32) + F.element_at(s, 33)) / 2
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i"))
    step = lambda acc, x: F.struct((acc["h"] + F.when(x > middle, F.when(acc["i"] == 63, F.lit(-(2**63))).otherwise(F.pow(F.lit(2.0), acc["i"]).cast("long"))).otherwise(0)).alias("h"), (acc["i"] + 1).alias("i"))
    return F.aggregate(v, start, step, lambda acc: acc["h"])


def dct_hash(rows: DataFrame, key: str, grid: str, side: int, keep: int) -> DataFrame:
    """key and h: whether each of the lowest keep x keep cosine sums of a flattened side x side grid is over their median.

    The median leaves out the first row of sums; the first sum gives the highest of keep^2 bits (at most 63). Grids of
    another size, or with a null, have no hash.
    """
    wave = np.cos(np.pi * (2 * np.arange(keep)[:, None] + 1) * np.arange(side)[None] / (2 * side))
    weights = np.array([1 << (keep * keep - 1 - i) for i in range(keep * keep)], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            f = f[[v is not None and len(v) == side * side and not np.isnan(np.asarray(v, float)).any() for v in f[grid]]]
            if not len(f):
                continue
            a = np.array(f[grid].tolist(), np.float64).reshape(-1, side, side)
            sums = wave @ a @ wave.T
            middle = np.median(sums[:, 1:].reshape(len(a), -1), axis=1)
            yield pd.DataFrame({key: f[key].to_numpy(), "h": (sums.reshape(len(a), -1) > middle[:, None]) @ weights})

    hashed = rows.select(key, grid).mapInPandas(run, f"{key} long, h long")
    return rows.select(key).join(hashed, key, "left")


def kmeans(rows: DataFrame, vec: str, k: int, rounds: int = 10, seed: int = 7) -> DataFrame:
    """rows with cell and distance, by Spark's k-means (k-means|| start, fixed seed)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="_f", predictionCol="cell").fit(data)
    centers = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    off = F.aggregate(F.zip_with(vector_to_array("_f"), F.element_at(centers, F.col("cell") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(data).withColumn("distance", F.sqrt(off)).drop("_f")


def agglomerate(rows: DataFrame, group: str, key: str, vec: str, levels: Sequence[int]) -> DataFrame:
    """key and cut_k for each k: average linkage by cosine distance within a group, cut into k clusters; coarser cuts nest finer ones.

    Clusters are named by their smallest key. A group is one task's work: it holds its vectors, as they come, and of
    different ones the unit vectors, not their distances; the number of different vectors enters squared.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = table.column(key).to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], _rows_of(table.column(vec))[order]
        del table
        of, first = _same_rows(x)
        x = x[first].astype(float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        owners = average_linkage(x, levels, copies=(first, of))
        return pa.table({key: pa.array(keys, pa.int64())} | {f"cut_{k}": pa.array(keys[owners[k]], pa.int64()) for k in levels})

    return rows.select(group, key, vec).groupBy(group).applyInArrow(run, f"{key} long" + "".join(f", cut_{k} long" for k in levels))


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix of their own type; null entries are NaN."""
    sizes = {*column.combine_chunks().value_lengths().to_pylist()} if len(column) else {0}
    if len(sizes) != 1 or None in sizes:
        raise ValueError("vectors are null or differ in length")
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).reshape(len(column), sizes.pop())


def _same_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its vector, and the first row of each vector, in order of first rows."""
    x = np.ascontiguousarray(x + x.dtype.type(0))  # no -0
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.arange(min(1, len(x)))
    bits = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).reshape(-1)
    _, first, of = np.unique(bits, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[of.reshape(-1)], first[order]


def average_linkage(x: np.ndarray, levels: Sequence[int], entries: int = 1 << 19, copies: tuple[np.ndarray, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """For each level the first row of each row's cluster. x: unit or zero vectors; ties (12 digits) go to the first rows.

    The mean distance of two clusters is 1 less the product of their mean vectors, so sums of vectors stand for the
    matrix. Each cluster knows its nearest later one; only those whose nearest was merged look again, so many at a time
    that no more than `entries` distances are held. copies: the first row of each vector and the vector of each row,
    where x holds different vectors only.
    """
    if copies is None:
        of, first = _same_rows(x)
        x = x[first]
    else:
        first, of = copies
    n = len(of)
    zero = ~x.any(1)  # zero vectors are at distance 1 of all, each other included
    own = first[of]
    own[zero[of]] = np.flatnonzero(zero[of])
    alone = np.flatnonzero(own == np.arange(n))
    mean, size = x[of[alone]], np.bincount(own, minlength=n)[alone].astype(float)
    m, live = len(alone), np.ones(len(alone), bool)
    best, arg = np.full(m, np.inf), np.full(m, -1)
    merges = np.zeros((max(m - 1, 0), 2), np.int64)
    at = np.zeros(len(merges))

    def look(rows: np.ndarray) -> None:
        block = min(256, max(1, entries // max(m, 1)))
        for s in range(0, len(rows), block):
            r = rows[s : s + block]
            lo = int(r.min())
            d = mean[r] @ mean[lo:].T
            np.subtract(1, d, out=d)
            np.round(d, 12, out=d)
            d[:, ~live[lo:]] = np.inf
            d[np.arange(lo, m)[None] <= r[:, None]] = np.inf
            arg[r] = d.argmin(1) + lo
            best[r] = d[np.arange(len(r)), arg[r] - lo]

    look(np.arange(m))
    for step in range(m - 1):
        i = int(best.argmin())
        j = int(arg[i])
        at[step], merges[step] = best[i], (alone[i], alone[j])
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        live[j], best[j] = False, np.inf
        again = np.flatnonzero(live & ((arg == i) | (arg == j)))
        look(np.union1d(again, [i]))
        d = np.round(1 - mean[:i] @ mean[i], 12)
        nearer = live[:i] & ((d < best[:i]) | ((d == best[:i]) & (i < arg[:i])))
        best[:i][nearer], arg[:i][nearer] = d[nearer], i
    # copies merge at distance 0, in the order of rows, among other merges at 0; the rest keeps its order
    at_zero = own
    at_zero[merges[at <= 0, 1]] = merges[at <= 0, 0]
    at_zero = _roots(at_zero)
    moved = np.flatnonzero(at_zero != np.arange(n))
    moved = moved[np.argsort(at_zero[moved], kind="stable")]
    into, moved = np.concatenate([at_zero[moved], merges[at > 0, 0]]), np.concatenate([moved, merges[at > 0, 1]])
    cuts = {}
    for k in levels:
        owner = np.arange(n)
        left = max(n - max(k, 1), 0)
        owner[moved[:left]] = into[:left]
        cuts[k] = _roots(owner)
    return cuts


def _roots(own: np.ndarray) -> np.ndarray:
    own = own.copy()
    while (own[own] != own).any():
        own = own[own]
    return own
