"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Table, components, lean, sorted_chunks
from quarry.llm.simhash_dedup import local_star


def unit_rows(vectors: list) -> np.ndarray:
    """Rows in double precision, of length 1; scaled by the largest entry first, so that squares neither overflow nor vanish."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit rows; a cell that runs empty keeps its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[s : s + 4096] @ c.T, 1) for s in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    cell_rows: int = 1024, most_cells: int = 4096, sample: int = 16_384, rounds: int = 5, block_rows: int = 512, margin: float = 1.0,
) -> DataFrame:
    """id, n_links, component_id and kept of each vector.

    Vectors link if their labels are equal and not null and their cosine, in double precision, is `threshold` or more.
    Spherical k-means, fitted on at most `sample` vectors, gives each vector a home cell, so that the cells of the most
    frequent label hold about `cell_rows`. A vector also visits each later cell j where a linked vector could live: if y lives in j and
    |x - y| <= sqrt(2 - 2 threshold), then x.(c_i - c_j) <= sqrt(2 - 2 threshold) |c_i - c_j| for each centroid i. So no
    link is lost at margin 1; a smaller margin visits fewer cells. Cells are compared in blocks of `block_rows` rows.
    Of a block's links only counts and the edges that connect its rows leave the task.

    Null or zero vectors, and those that hold null or non-finite entries, link with nothing; vectors of different length
    do not link. A row without id stays, with 0 links and a null component. Rows that repeat an id count as one vector
    that links wherever any of them does; n_links counts rows. Ties: the home cell is the first of the best.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    valid = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(sound, F.lit(False)))
    total, most = valid.groupBy("label").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    keep = int(min(1.0, 2 * sample / max(total, 1)) * 1_000_000)
    mixed = F.xxhash64("vec", F.lit(5))  # equal vectors, however many, are one
    some = valid.where(F.pmod(F.xxhash64("vec"), F.lit(1_000_000)) < keep).select("vec").distinct().withColumn("mixed", mixed).orderBy("mixed").limit(sample).toPandas()
    dims = some["vec"].map(len)
    dim = int(dims.mode().iloc[0]) if len(some) else 0
    fitted = some["vec"][dims == dim].tolist()
    k = max(1, min(most_cells, -(-most // cell_rows), len(fitted)))
    centroids = spherical_kmeans(unit_rows(fitted), k, rounds) if fitted else np.zeros((0, 0))
    reach = margin * np.sqrt(2 - 2 * threshold)
    placed_schema = pa.schema([("label", pa.string()), ("cell", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()), ("unit", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
        for batch in batches:
            ids, labels, vecs = batch.column("id").to_numpy(), batch.column("label"), batch.column("vec").to_pylist()
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes):
                for s in range(0, len(at := np.flatnonzero(sizes == size)), 1000):
                    rows = at[s : s + 1000]
                    x = unit_rows([vecs[r] for r in rows])
                    if size == dim:
                        sim = x @ centroids.T
                        home = np.argmax(sim, 1)
                        # a visit must be possible against the home's centroid, and then against each other one
                        own = sim[np.arange(len(x)), home][:, None]
                        guest, cell = np.nonzero((np.arange(k)[None, :] > home[:, None]) & (own - sim <= reach * apart[home] + 1e-9))
                        for t in range(0, len(guest), 4096):
                            g, c = guest[t : t + 4096], cell[t : t + 4096]
                            possible = (sim[g] - sim[g, c][:, None] <= reach * apart[c] + 1e-9).all(1)
                            cell[t : t + 4096][~possible] = -1
                        guest, cell = guest[cell >= 0], cell[cell >= 0]
                    else:  # another length: one cell of its own
                        home, guest, cell = np.full(len(rows), -1 - size), np.zeros(0, int), np.zeros(0, int)
                    who = np.concatenate([np.arange(len(rows)), guest])
                    for t in range(0, len(who), 4096):
                        w = who[t : t + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [labels.take(pa.array(rows[w])), pa.array(np.concatenate([home, cell])[t : t + 4096].astype(np.int32)), pa.array(np.arange(t, t + len(w)) < len(rows)), pa.array(ids[rows[w]]), pa.array([v.tobytes() for v in x[w]], pa.binary())],
                            schema=placed_schema,
                        )

    narrow = valid.withColumn("label", F.col("label").cast("string"))
    placed = narrow.mapInArrow(lean(place), "label string, cell int, home boolean, id long, unit binary")
    sizes = placed.groupBy("label", "cell", "home").count().groupBy("label", "cell").agg(
        F.sum(F.when(F.col("home"), F.col("count")).otherwise(0)).alias("homes"), F.sum(F.when(~F.col("home"), F.col("count")).otherwise(0)).alias("guests")
    )
    blocks = Table(sizes.select("label", "cell", F.ceil(F.col("homes") / block_rows).cast("int").alias("nh"), F.ceil(F.col("guests") / block_rows).cast("int").alias("ng")).where("nh > 0"), narrow=True)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng"))).cast("int")
    # q >= 0: home blocks p <= q; q < 0: home block p against guest block -1 - q
    pairs = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda q: F.struct(F.least(F.col("own"), q).alias("p"), F.greatest(F.col("own"), q).alias("q")))
    against = F.transform(F.sequence(F.lit(0), F.col("ng")), lambda g: F.struct(F.col("own").alias("p"), (F.lit(0) - g).alias("q")))
    as_home = F.concat(pairs, F.slice(against, 2, F.greatest(F.col("ng"), F.lit(0))))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda p: F.struct(p.alias("p"), (F.lit(-1) - F.col("own")).alias("q")))
    units = placed.join(blocks.df, ["label", "cell"]).withColumn("own", own).withColumn("unit_of", F.explode(F.when(F.col("home"), as_home).otherwise(as_guest)))
    keys = ["label", "cell", "p", "q"]
    dealt = units.select("label", "cell", "unit_of.p", "unit_of.q", "home", "own", "id", "unit").repartition(*keys).sortWithinPartitions(*keys)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_chunks(batches, ["cell", "p", "q", "label"], 4096):
            frame: pd.DataFrame = table.to_pandas()
            for (_, _, p, q), rows in frame.groupby(["label", "cell", "p", "q"], sort=False):
                ids, x = rows["id"].to_numpy(), np.stack([np.frombuffer(u, np.float64) for u in rows["unit"]])
                left = np.flatnonzero(rows["home"].to_numpy() & (rows["own"].to_numpy() == p))
                right = left if p == q else np.flatnonzero(rows["home"].to_numpy() & (rows["own"].to_numpy() == q)) if q >= 0 else np.flatnonzero(~rows["home"].to_numpy())
                link = x[left] @ x[right].T >= threshold
                link &= ids[left][:, None] != ids[right][None, :]
                if p == q:
                    np.fill_diagonal(link, False)
                i, j = np.nonzero(link)
                if not len(i):
                    continue
                count = np.bincount(left[i], minlength=len(ids)) + (0 if p == q else np.bincount(right[j], minlength=len(ids)))
                linked = np.flatnonzero(count)
                a, b = local_star(len(ids), left[i], right[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[linked], ids[a]])), pa.array(np.concatenate([np.full(len(linked), -1), ids[b]]), mask=np.arange(len(linked) + len(a)) < len(linked)), pa.array(np.concatenate([count[linked], np.zeros(len(a), np.int64)]).astype(np.int64))],
                    schema=schema,
                )

    found = Table(dealt.mapInArrow(lean(compare), "a long, b long, n long"))
    counts = found.df.where("b is null").groupBy(F.col("a").alias("_n_id")).agg(F.sum("n").alias("n"))
    comps = components(found.df.where("b is not null").select("a", "b"))
    ids = base.select("id")
    out = ids.where("id is not null").distinct().join(counts, F.col("id") == F.col("_n_id"), "left").join(comps, F.col("id") == F.col("node"), "left")
    out = out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = out.union(ids.where("id is null").select("id", F.lit(0).cast("long"), F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
