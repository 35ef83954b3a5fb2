"""As-of, theta and neighbour joins, all through equi-keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(rows: DataFrame, at: str, steps: DataFrame, step_at: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with the value of the last step at or before `at`, by a union and one window."""
    a = rows.withColumn("_t", F.col(at)).withColumn("_v", F.lit(None).cast(steps.schema[value].dataType)).withColumn("_row", F.lit(1))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in keys]
    s = steps.select(*keys, *missing, F.col(step_at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_row"))
    both = a.select(*rows.columns, "_t", "_v", "_row").unionByName(s.select(*rows.columns, "_t", "_v", "_row"))
    last = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_row"))
    return both.withColumn(value, last).where("_row = 1").drop("_t", "_v", "_row")


def first_reaching(steps: DataFrame, at: str, value: str, level: float) -> DataFrame:
    """The first step whose value reaches the level."""
    return steps.where(F.col(value) >= level).agg(F.min(at).alias(at))


def near_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], x: str, y: str, radius: float, cell: float | None = None) -> DataFrame:
    """Pairs (b's columns prefixed o_) of equal keys within `radius` (Euclidean, closed).

    a looks into the 3 x 3 cells round its own on a grid as wide as the radius, so the join is on cells; the distance decides.
    """
    size = cell or radius
    grid = lambda c: F.floor(F.col(c) / size)
    around = F.explode(F.flatten(F.transform(F.sequence(grid(x) - 1, grid(x) + 1), lambda i: F.transform(F.sequence(grid(y) - 1, grid(y) + 1), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    left = a.withColumn("_c", around)
    right = b.select(*(F.col(c).alias(f"o_{c}") for c in b.columns)).withColumn("_i", F.floor(F.col(f"o_{x}") / size)).withColumn("_j", F.floor(F.col(f"o_{y}") / size))
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    on = (F.col("_c.i") == F.col("_i")) & (F.col("_c.j") == F.col("_j"))
    for s in same:
        on = on & s
    dx, dy = F.col(x) - F.col(f"o_{x}"), F.col(y) - F.col(f"o_{y}")
    return left.join(right, on).where(dx * dx + dy * dy <= radius * radius).drop("_c", "_i", "_j")


def line_links(rows: DataFrame, key: str, x: str, radius: float) -> DataFrame:
    """Edges (a, b) that connect what the pairs with |x - x'| <= radius connect, at most one for each row and three for each cell.

    Cells are half a radius wide: all rows of one are linked, so each goes to its cell's smallest key, and the nearest
    ends of two cells decide for both. Rows whose x is null or not finite link with nothing.
    """
    placed = rows.where(F.abs(F.col(x)) < float("inf")).select(F.col(key).alias("k"), F.col(x).alias("x"), F.floor(F.col(x) / (radius / 2)).alias("c"))
    cells = placed.groupBy("c").agg(F.min("k").alias("b"), F.min("x").alias("low"), F.max("x").alias("high"))
    inner = placed.select("k", "c").join(cells.select("c", "b"), "c").where("k <> b").select(F.col("k").alias("a"), "b")
    left = cells.select(F.col("b").alias("a"), "high", F.explode(F.array(*(F.col("c") + i for i in (1, 2, 3)))).alias("c"))
    return inner.union(left.join(cells.select("c", "b", "low"), "c").where(F.col("low") - F.col("high") <= radius).select("a", "b"))


def viewport_neighbours(rows: DataFrame, key: str, x: str, y: str, width: str, lo: float = 1 / 1.5, hi: float = 1.5, shift: float = 0.5) -> DataFrame:
    """Pairs key < o_key whose widths' ratio lies in [lo, hi] and whose distance is at most shift x the smaller width.

    Rows of like scale meet: scales are binned by the ratio, and each scale has a grid of its own.
    """
    scale = F.floor(F.log(F.col(width)) / F.log(F.lit(hi)))
    a = rows.where(F.col(width) > 0).withColumn("_s", F.explode(F.sequence(scale - 1, scale + 1)))
    size = lambda s: F.pow(F.lit(hi), s + 2) * shift
    a = a.withColumn("_g", size(F.col("_s"))).withColumn("_i", F.explode(F.sequence(F.floor(F.col(x) / F.col("_g")) - 1, F.floor(F.col(x) / F.col("_g")) + 1))).withColumn("_j", F.explode(F.sequence(F.floor(F.col(y) / F.col("_g")) - 1, F.floor(F.col(y) / F.col("_g")) + 1)))
    b = rows.where(F.col(width) > 0).select(*(F.col(c).alias(f"o_{c}") for c in (key, x, y, width)))
    b = b.withColumn("_os", F.floor(F.log(F.col(f"o_{width}")) / F.log(F.lit(hi)))).withColumn("_og", size(F.col("_os"))).withColumn("_oi", F.floor(F.col(f"o_{x}") / F.col("_og"))).withColumn("_oj", F.floor(F.col(f"o_{y}") / F.col("_og")))
    ratio = F.col(width) / F.col(f"o_{width}")
    dx, dy = F.col(x) - F.col(f"o_{x}"), F.col(y) - F.col(f"o_{y}")
    near = F.sqrt(dx * dx + dy * dy) <= shift * F.least(F.col(width), F.col(f"o_{width}"))
    on = (F.col("_s") == F.col("_os")) & (F.col("_i") == F.col("_oi")) & (F.col("_j") == F.col("_oj")) & (F.col(key) < F.col(f"o_{key}"))
    return a.join(b, on).where(ratio.between(lo, hi) & near).select(key, f"o_{key}").distinct()


def count_within(cloud: DataFrame, key: str, x: str, y: str, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """key and the number of other members within radius."""
    pairs = near_pairs(cloud.select(key, *keys, x, y), cloud.select(key, *keys, x, y), keys, x, y, radius).where(F.col(key) != F.col(f"o_{key}"))
    n = pairs.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n_near"))
    return cloud.join(n, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n_near", F.lit(0)).alias("n_near"))


def feasible_grid(observed: DataFrame, *axes: tuple[str, Sequence[str]]) -> DataFrame:
    """Each observed row with each combination of the fixed axes, by exploding their values."""
    out = observed.distinct()
    for name, values in axes:
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def sweep(rows: DataFrame, x: str, y: str, width: str, offsets: Sequence[float], scales: Sequence[float]) -> DataFrame:
    """Windows round each row: offsets x offsets (in widths) x scales, in decimal arithmetic."""
    dec = lambda v: F.lit(str(v)).cast("decimal(10,4)")
    out = rows.withColumn("_dx", F.explode(F.array(*map(dec, offsets)))).withColumn("_dy", F.explode(F.array(*map(dec, offsets)))).withColumn("_k", F.explode(F.array(*map(dec, scales))))
    w = F.col(width).cast("decimal(18,4)")
    return out.select(*rows.columns, (F.col(x).cast("decimal(18,4)") + F.col("_dx") * w).alias("wx"), (F.col(y).cast("decimal(18,4)") + F.col("_dy") * w).alias("wy"), (F.col("_k") * w).alias("ww"))


def covering_prefix(rows: DataFrame, path: str, registry: Sequence[tuple[str, str]]) -> Column:
    """Owner of the longest registered prefix of a path; null if none covers it. The registry is a fixed small list."""
    hits = F.array(*(F.when(F.col(path).startswith(p), F.struct(F.lit(len(p)).alias("n"), F.lit(o).alias("o"))) for p, o in registry))
    return F.array_max(F.array_compact(hits))["o"]


def nearest_by_cosine(rows: DataFrame, key: str, vec: str, k: int, block: int = 512, groups: Sequence[str] = ()) -> DataFrame:
    """key, neighbour, similarity and rank of the k most similar other rows, over rows of equal groups, exactly.

    Rows are dealt to blocks by a hash; each pair of blocks is one task's matrix product, of which only each row's k best
    leave, so no task holds more than two blocks and all pairs are never emitted. Work is quadratic in a group; beyond
    what that allows, narrow `groups` (for example to k-means cells).
    """
    import numpy as np
    import pandas as pd

    n = max(1, -(-rows.count() // block))
    own = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    base = rows.select(F.col(key).cast("long").alias("_k"), F.concat_ws("|", *groups, F.lit("")).alias("_g"), F.col(vec).cast("array<double>").alias("_v"), own.alias("_b"))
    pairs = base.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.least("_b", i.cast("int")).alias("a"), F.greatest("_b", i.cast("int")).alias("b")))))
    dealt = pairs.select("_k", "_g", "_v", "_b", "_p.a", "_p.b")

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["_v"].tolist())
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        ids, b, a1, b1 = frame["_k"].to_numpy(), frame["_b"].to_numpy(), frame["a"].iloc[0], frame["b"].iloc[0]
        left, right = np.flatnonzero(b == a1), np.flatnonzero(b == b1)
        out = []
        for l, r in ((left, right), (right, left)) if a1 != b1 else ((left, right),):
            s = x[l] @ x[r].T
            s[ids[l][:, None] == ids[r][None, :]] = -np.inf
            order = np.argsort(-s, 1, kind="stable")[:, :k]
            for i, js in enumerate(order):
                out += [(ids[l[i]], ids[r[j]], s[i, j]) for j in js if np.isfinite(s[i, j])]
        return pd.DataFrame(out, columns=["k", "neighbour", "similarity"])

    found = dealt.groupBy("_g", "a", "b").applyInPandas(best, "k long, neighbour long, similarity double")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.round("similarity", 9).desc(), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("k", key)


def cosine_distances(rows: DataFrame, key: str, vec: str, group: str, block: int = 1024) -> DataFrame:
    """a < b (keys) and distance (1 - cosine, both rounded to 6 digits) of all pairs of rows of equal groups.

    Rows of a group are dealt to blocks by a hash; each pair of blocks is one task's matrix product. Null where a vector
    or a component is null, a vector has no length, or the two have unlike sizes.
    """
    import numpy as np
    import pandas as pd

    given = rows.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(group).alias("g"), F.when(F.forall(vec, lambda x: x.isNotNull()), F.col(vec)).alias("v"))
    sizes = given.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    own = given.join(sizes, F.col("g") == F.col("_g")).withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least("own", i).alias("i"), F.greatest("own", i).alias("j")))
    dealt = own.withColumn("p", F.explode(other)).select("k", "g", "v", "own", "p.i", "p.j")

    def six(x: np.ndarray) -> np.ndarray:
        return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = [None if v is None else np.asarray(v, float) for v in frame["v"]]
        size = np.array([-1 if v is None else len(v) for v in vectors])
        x = np.zeros((len(vectors), max(1, int(size.max()))))
        for i, v in enumerate(vectors):
            if v is not None:
                x[i, : len(v)] = v
        norm, keys, part = np.sqrt((x * x).sum(1)), frame["k"].to_numpy(), frame["own"].to_numpy()
        one, two = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        l, r = np.flatnonzero(part == one), np.flatnonzero(part == two)
        with np.errstate(all="ignore"):
            product = norm[l][:, None] * norm[r][None]
            distance = six(1 - six((x[l] @ x[r].T) / product))
        known = (product != 0) & (size[l][:, None] == size[r][None]) & (size[l][:, None] >= 0)
        a, b = np.broadcast_to(keys[l][:, None], known.shape), np.broadcast_to(keys[r][None], known.shape)
        take = a < b if one == two else a != b
        a, b = a[take], b[take]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": pd.arrays.FloatingArray(distance[take], ~known[take])})

    return dealt.groupBy("g", "i", "j").applyInPandas(run, "a long, b long, distance double")
