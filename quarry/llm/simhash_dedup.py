"""SimHash near-duplicates: fingerprints within a radius by a generalised pigeonhole index, similar texts by prefixes of their sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Table, components, expanded, lean, local_roots, run_starts, settled, small_batches, sorted_chunks, texts_of, unused

BITS = 64
#: So many ids (two longs each) at most are sent to each task; more meet their rows by a shuffle.
SENT_IDS = 500_000
#: A task holds about so many pairs (24 bytes each) at once before it chooses among them.
HELD_PAIRS = 300_000
#: Keys that are split among blocks, at most; a key is split from block_rows rows on, or from its share of so many.
SPLIT_KEYS = 100_000
_GOLDEN, _MIX = 0x9E3779B97F4A7C15, 2**64 - 1


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; words end at ASCII white space, A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(k, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none. As a signed 64-bit number."""
    n, votes = len(hashes), np.zeros(BITS, np.int64)
    for s in range(0, n, 65_536):
        part = np.ascontiguousarray(hashes[s : s + 65_536])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0]) if n else 0


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes in signed order."""
    return np.unique(shingle_hashes(text, k).view(np.int64))


def set_id(distinct: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set; texts of equal sets share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), 7)).view(np.int64))


def remixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Hashes whose bits are independent of the given ones and of other turns'; turn 0 leaves them as they are."""
    x = hashes.view(np.uint64)
    if turn:
        x = x + np.uint64(turn * _GOLDEN & _MIX)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp of each row, over its shingles with repeats."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(text, words)) for text in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], schema=schema)

    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bare.mapInArrow(lean(run), "doc_id long, fp long")


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number for each row: the same each time, as long as docs is a table (or another fixed plan over one)."""
    return docs.withColumn(row, F.monotonically_increasing_id())


def common_shingles(docs: DataFrame, words: int, sample: int, most: int = 200_000) -> dict[int, int]:
    """Shingles that several of about `sample` rows of docs(row, text) hold, the most frequent `most` of them, with their counts.

    They only order shingles (see prefix), so what the sample misses costs time and no link.
    """
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1_000_000)) < int(min(1.0, sample / max(total, 1)) * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.int64), *(shingle_set(t, words) for t in texts_of(batch.column("text")))])
            for at in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 50_000])], names=["h"])

    counted = some.select("text").mapInArrow(lean(run), "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(most)
    return {r["h"]: r["count"] for r in counted.toLocalIterator()}


def prefix(distinct: np.ndarray, similarity: float, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The n - ceil(similarity * n) + 1 first of a set's n hashes, in one order for all sets: rare ones first.

    Two sets whose Jaccard similarity is that or more share at least one of these, whatever the order.
    """
    n = len(distinct)
    keep = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if not len(known) or not n:
        return distinct[:keep]
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    often = np.where(known[at] == distinct, counts[at], 0)
    return distinct[np.argsort(often, kind="stable")[:keep]]


def set_prints(docs: DataFrame, words: int, tables: int, similarity: float, common: dict[int, int]) -> DataFrame:
    """row, doc_id, node (a name of the row's shingle set; null: no words), n (its size), `tables` fingerprints of the set,
    fp0, fp1, ..., its prefix and its three smallest hashes (least), for docs(row, doc_id, text)."""
    small_batches(docs.sparkSession)
    names = ["row", "doc_id", "node", "n", *(f"fp{i}" for i in range(tables))]
    known = np.array(sorted(common), np.int64)
    counts = np.array([common[h] for h in known.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in texts_of(batch.column("text"))]
            made = [pa.array([set_id(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
            made += [pa.array([fingerprint(remixed(x, turn)) for x in sets], pa.int64()) for turn in range(tables)]
            made += [lists([prefix(x, similarity, known, counts) for x in sets]), lists([x[:3] for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *made], names=[*names, "prefix", "least"])

    return docs.select("row", "doc_id", "text").mapInArrow(lean(run), ", ".join(f"{n} long" for n in names) + ", prefix array<long>, least array<long>")


@dataclass(frozen=True)
class Plan:
    """Bit positions of each partition, its threshold (-1: never probed), and blocks of keys expected to be large."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]
    radius: int
    blocks: dict[int, int]

    def value(self, fps: np.ndarray, i: int) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for k, bit in enumerate(self.parts[i]):
            out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        return out

    def keys(self, fps: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and key of each probe in partition i: the value with up to limits[i] of its set bits cleared.

        Two values at distance d <= limit meet at their AND, which each reaches by clearing its own extra bits.
        """
        v, width = self.value(fps, i), len(self.parts[i])
        rows, keys = [np.arange(len(fps))], [v]
        for n in range(1, self.limits[i] + 1):
            for bits in combinations(range(width), n):
                mask = np.uint64(sum(1 << b for b in bits))
                has = np.flatnonzero((v & mask) == mask)
                rows.append(has)
                keys.append(v[has] & ~mask)
        return np.concatenate(rows), (np.concatenate(keys) | np.uint64(i << 48)).astype(np.int64)


def correlated_parts(bits: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m partitions of nearly equal width; each gathers the bits most correlated with those it has."""
    x = bits - bits.mean(0)
    scale = np.sqrt((x * x).sum(0)) + 1e-9
    r = np.abs(x.T @ x / np.outer(scale, scale))
    np.fill_diagonal(r, 0)
    left, parts = list(range(BITS)), []
    for i in range(m):
        width = BITS * (i + 1) // m - BITS * i // m
        part = [max(left, key=lambda b: r[b, left].sum())]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: r[b, part].sum()))
            left.remove(part[-1])
        parts.append(tuple(part))
    return tuple(parts)


def make_plan(sample: np.ndarray, total: int, radius: int, block_rows: int = 2048, probe_cost: float = 4000.0) -> Plan:
    """Partitions and thresholds with the least estimated work, such that any pair within radius is probed.

    Generalised pigeonhole: if sum(limit_i + 1) = radius + 1, two fingerprints within radius are within limit_i in
    some partition i. For 2 to 8 partitions, dynamic programming spreads radius + 1 over them; the work of (i, limit) is
    its probes, each as costly as `probe_cost` comparisons (it is shuffled and sorted, and takes disk), plus the candidate
    pairs, estimated from all pairs of the sample scaled to `total` rows.
    """
    some = sample[:1024].astype(np.uint64)
    if len(some) < 2:
        some = np.arange(2, dtype=np.uint64)
    bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    scale = (total / len(some)) ** 2
    best: tuple[float, tuple, tuple] | None = None
    upper = np.triu_indices(len(some), 1)
    for m in range(2, 9):
        parts = correlated_parts(bits, m)
        table = []
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            near = np.bincount(np.bitwise_count((some[:, None] ^ some[None, :]) & mask)[upper], minlength=BITS)
            cost = [0.0]
            probes = 0.0
            for t in range(0, radius + 1):
                probes += comb(len(part) // 2 + 1, t)
                if probes > 400:
                    break
                cost.append(total * probes * probe_cost + (near[: t + 1].sum() + 0.5) * scale)
            table.append(cost)
        done: list[tuple[float, tuple[int, ...]] | None] = [(0.0, ())] + [None] * (radius + 1)
        for cost in table:
            after: list[tuple[float, tuple[int, ...]] | None] = [None] * (radius + 2)
            for used, was in enumerate(done):
                if was is not None:
                    for more, c in enumerate(cost):
                        if used + more <= radius + 1 and ((was[0] + c) < (after[used + more] or (np.inf,))[0]):
                            after[used + more] = (was[0] + c, (*was[1], more - 1))
            done = after
        if (end := done[radius + 1]) and (best is None or end[0] < best[0]):
            best = (end[0], parts, end[1])
    assert best is not None
    return Plan(best[1], best[2], radius, {})


def split_keys(classes: DataFrame, plan: Plan, total: int, block_rows: int) -> Plan:
    """The plan with the number of blocks of each key that many of the classes probe, by their measured counts.

    Keys are counted over a share of the classes, chosen by hash, so large that a key to be split has about 64 rows in it.
    """
    some = classes.select("fp").limit(1000).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    each = sum(len(plan.keys(some, i)[0]) for i, limit in enumerate(plan.limits) if limit >= 0) / max(1, len(some))
    least = int(max(block_rows, each * total / SPLIT_KEYS))
    share = min(1.0, 64 / least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i, limit in enumerate(plan.limits):
                if limit >= 0:
                    keys, n = np.unique(plan.keys(fps, i)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    chosen = classes.select("fp").where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = chosen.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least * share)
    return Plan(plan.parts, plan.limits, plan.radius, {r["key"]: int(-(-r["n"] // (least * share))) for r in counted.toLocalIterator()})


PROBE = "key long, pair long, fp long, more long, node long, off long"


def probes(classes: DataFrame, plan: Plan) -> DataFrame:
    """key, block pair, fp, more, node and off (root XOR node) of each probe of classes(fp, more, node, root). A key expected
    to be large is cut into blocks by node; its rows go to each pair of blocks that holds theirs, so that no task gets
    the whole key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = np.array(sorted(plan.blocks), np.int64)
        sizes = np.array([plan.blocks[k] for k in large.tolist()], np.int64)
        for batch in batches:
            fp, more, node, off = (batch.column(c).to_numpy() for c in ("fp", "more", "node", "root"))
            off = off ^ node
            for i, limit in enumerate(plan.limits):
                if limit < 0:
                    continue
                rows, keys = plan.keys(fp.view(np.uint64), i)
                pairs = np.zeros(len(keys), np.int64)
                if len(large):
                    near = np.minimum(np.searchsorted(large, keys), len(large) - 1)
                    hot = large[near] == keys
                    at = np.flatnonzero(hot)
                    n = sizes[near[at]]
                    item, other = expanded(n)
                    own = ((node[rows[at]].astype(np.uint64) * np.uint64(_GOLDEN)) >> np.uint64(33)).astype(np.int64)[item] % n[item]
                    pairs = np.concatenate([pairs[~hot], np.minimum(own, other) * 1_000_000 + np.maximum(own, other)])
                    rows, keys = np.concatenate([rows[~hot], rows[at][item]]), np.concatenate([keys[~hot], keys[at][item]])
                for s in range(0, len(keys), 50_000):
                    r = rows[s : s + 50_000]
                    cols = [keys[s : s + 50_000], pairs[s : s + 50_000], fp[r], more[r], node[r], off[r]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "pair", "fp", "more", "node", "off"])

    dealt = classes.select("fp", "more", "node", "root").mapInArrow(lean(run), PROBE)
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "node")


def linked(sorted_probes: DataFrame, plan: Plan, nearest: int | None = None, both: int = 2 * BITS) -> DataFrame:
    """Links (a, b) between nodes of different roots whose fp are within the radius and whose fp and more within `both` bits.

    nearest = None: of each run of equal keys, edges that connect what its links connect (not each link); n says how many
    links they stand for. nearest = k: links only, for each node those to its k nearest others in the run (k = 0: all).
    ra and rb are the roots of a and b.
    """

    def chosen(node: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        n = np.ones(len(a), np.int64)
        if nearest is None:
            times = np.bincount(np.concatenate([a, b]), minlength=len(node))
            a, b = local_star(len(node), a, b)
            n = times[a]
        elif nearest:
            take = np.zeros(len(a), bool)
            for end in (a, b):
                order = np.lexsort((dist, end))
                first = np.r_[True, end[order][1:] != end[order][:-1]]
                place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                take[order[place < nearest]] = True
            a, b, n = a[take], b[take], n[take]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], root[a], root[b], n)], names=["a", "b", "ra", "rb", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [np.uint64(sum(1 << b for b in p)) for p in plan.parts]
        for table in sorted_chunks(batches, ["key", "pair"], 100_000):
            key, pair, node = (table.column(c).to_numpy() for c in ("key", "pair", "node"))
            root = table.column("off").to_numpy() ^ node
            fp, more = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "more"))
            part = key >> 48
            masked = (key & ((1 << 48) - 1)).astype(np.uint64)
            found, held = [], 0
            for x, y in close_pairs(fp, run_starts(table, ["key", "pair"]), plan.radius):
                ok = root[x] != root[y]
                x, y = x[ok], y[ok]
                diff = fp[x] ^ fp[y]
                dist = np.bitwise_count(diff).astype(np.int64)
                ok = dist + np.bitwise_count(more[x] ^ more[y]) <= both
                x, y, diff, dist = x[ok], y[ok], diff[ok], dist[ok]
                common = fp[x] & fp[y]
                ok = np.ones(len(x), bool)
                for i, limit in enumerate(plan.limits):  # only where it is the first partition that finds the pair, by the key that both reach
                    own = part[x] == i
                    ok[own] &= plan.value(common[own], i) == masked[x[own]]
                    near = np.bitwise_count(diff & masks[i]).astype(np.int64)
                    ok &= np.where(own, near <= limit, (near > limit) | (part[x] < i))
                found.append(np.stack([x[ok], y[ok], dist[ok]], 1))
                held += int(ok.sum())
                if held > HELD_PAIRS:
                    yield chosen(node, root, *np.concatenate(found).T)
                    found, held = [], 0
            if held:
                yield chosen(node, root, *np.concatenate(found).T)

    return sorted_probes.mapInArrow(lean(run), "a long, b long, ra long, rb long, n long")


def close_pairs(fp: np.ndarray, starts: np.ndarray, radius: int, short: int = 32, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same run (starts: where each begins) whose fingerprints differ in `radius` bits at most.

    Runs of up to `short` rows are compared together, at one distance after the other; each longer one in squares of about
    `cells` pairs. Each part yielded holds at most so many, or short * the number of rows.
    """
    sizes = np.diff(np.append(starts, len(fp)))
    end = np.repeat(starts + sizes, sizes)
    idx = np.flatnonzero(np.repeat(sizes <= short, sizes))
    for d in range(1, short):
        idx = idx[idx + d < end[idx]]
        if not len(idx):
            break
        hit = idx[np.bitwise_count(fp[idx] ^ fp[idx + d]) <= radius]
        if len(hit):
            yield hit, hit + d
    for lo, n in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        run, step = fp[lo : lo + n], max(1, cells // n)
        for i in range(0, n - 1, step):
            block = run[i : i + step]
            x, y = np.nonzero(np.bitwise_count(block[:, None] ^ run[None, i + 1 :]) <= radius)
            later = y >= x  # y counts from i + 1
            if later.any():
                yield x[later] + (lo + i), y[later] + (lo + i + 1)


def local_star(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node to the smallest one that its links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def planned(fps: DataFrame, total: int, radius: int, sample: int) -> Plan:
    """The plan for a column fp of `total` rows, from at most about `sample` of them."""
    keep = int(min(1.0, sample / max(total, 1)) * 1_000_000)
    some = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < keep).toPandas()["fp"].sort_values().to_numpy().astype(np.int64)
    return make_plan(np.random.default_rng(7).permutation(some).view(np.uint64), total, radius)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, sample: int = 8192, block_rows: int = 2048) -> DataFrame:
    """doc_id, fp and component_id of each row of docs(doc_id, text).

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest doc_id reachable, itself included.

    A null text counts as empty; a text without words has fingerprint 0, linked like any other. Repeated rows and equal
    fingerprints fall into one class before anything is compared. Rows that share a doc_id but not the fingerprint are
    linked only if their fingerprints are. A row without doc_id stays, and does not lend its id; where no row of a
    component has one, component_id is null. Other columns are ignored; an empty table gives an empty result. `sample`
    bounds the fingerprints from which the index is planned; any plan gives the same links.
    """
    prints = Table(fingerprints(docs, words))
    classes = Table(prints.df.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", "least", F.lit(0).cast("long").alias("more"), F.col("fp").alias("node"), F.col("fp").alias("root")), narrow=True).df
    total = classes.count()
    plan = split_keys(classes, planned(classes, total, radius, sample), total, block_rows)
    return with_least(prints.df, "fp", classes.select("fp", "least"), components(linked(probes(classes, plan), plan)))


def with_least(rows: DataFrame, by: str, classes: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the smallest id (`least` of classes) of the component of its class, named by column `by`."""
    in_one = Table(classes.join(found, F.col(by) == F.col("node"), "left").select(F.col(by).alias("_by"), F.coalesce("root", by).alias("_root"), "least"), narrow=True).df
    roots = in_one.groupBy(F.col("_root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = in_one.select("_by", "_root").join(roots, F.col("_root") == F.col("_r")).select("_by", "component_id")
    return rows.join(named, F.col(by) == F.col("_by")).select(*rows.columns, "component_id")


def sets_of(rows: DataFrame, classes: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """node and its whole set, for the nodes of `asked`. rows: row and text; classes: node and the row of a text that has the
    set. Few names are sent to the texts; beyond SENT_IDS texts and names are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists(sets)], names=["node", "set"])

    found = Table(asked.select("node").distinct().join(classes.select("node", "row"), "node"), narrow=True).df
    few = F.broadcast(found) if found.count() <= SENT_IDS else found
    return Table(rows.join(few, "row").select("node", "text").mapInArrow(lean(run), "node long, set array<long>")).df


def similar_pairs(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of `similarity` or more, decided on the whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("sum"))
    return met.where(F.col("common") >= similarity * (F.col("sum") - F.col("common"))).select("a", "b")


def in_blocks(members: DataFrame, block_rows: int, block_hashes: int) -> tuple[DataFrame, DataFrame]:
    """members (node, root, family, n) with key (of its group) and block, and the units: pairs of a family's blocks to be compared.

    Members of one root, if they fill a block, are a group of their own, and need not be compared with each other; the
    other members of a family are group -1. A block has about `block_rows` members and `block_hashes` hashes in all.
    """
    own = members.groupBy(F.col("family").alias("f"), F.col("root").alias("r")).count().where(F.col("count") >= block_rows).select("f", "r")
    grouped = members.join(own, (F.col("family") == F.col("f")) & (F.col("root") == F.col("r")), "left")
    grouped = grouped.select("family", "node", "root", "n", F.coalesce("r", F.lit(-1)).alias("key"))  # a root of this name is compared within, too
    blocks = F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n") / block_hashes)).alias("blocks")
    sized = grouped.groupBy(F.col("family").alias("f"), F.col("key").alias("k")).agg(blocks)
    dealt = grouped.join(sized, (F.col("family") == F.col("f")) & (F.col("key") == F.col("k"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    each = sized.select("f", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    x, y = each.alias("x"), each.alias("y")
    later = F.struct("x.k", "x.b") <= F.struct("y.k", "y.b")
    units = x.join(y, (F.col("x.f") == F.col("y.f")) & later & ((F.col("x.k") != F.col("y.k")) | (F.col("x.k") == -1)))
    return dealt.select("family", "node", "root", "n", "key", "block"), units.select(F.col("x.f").alias("f"), F.col("x.k").alias("k1"), F.col("x.b").alias("b1"), F.col("y.k").alias("k2"), F.col("y.b").alias("b2"))


def similar_in_units(dealt: DataFrame, units: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect what the links between members of different roots connect, unit by unit, on the whole sets."""
    named = units.withColumn("unit", F.xxhash64("f", "k1", "b1", "k2", "b2"))
    sides = named.select("f", "unit", F.explode(F.array_distinct(F.array(F.struct(F.col("k1").alias("k"), F.col("b1").alias("b")), F.struct(F.col("k2").alias("k"), F.col("b2").alias("b"))))).alias("side"))
    sides = sides.select("f", "unit", "side.k", "side.b")
    placed = dealt.join(sides, (F.col("family") == F.col("f")) & (F.col("key") == F.col("k")) & (F.col("block") == F.col("b"))).select("unit", "node", "root")
    dealt_out = placed.join(sets, "node").select("unit", "node", "root", "set").repartition("unit").sortWithinPartitions("unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_chunks(batches, ["unit"], 256):
            cuts = [*run_starts(table, ["unit"]).tolist(), table.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = table.slice(lo, hi - lo).combine_chunks()
                node, root = part.column("node").to_numpy(), part.column("root").to_numpy()
                links = links_of(part.column("set").combine_chunks(), root, similarity)
                a, b = local_star(len(node), *links)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return dealt_out.mapInArrow(lean(run), "a long, b long")


def links_of(sets: pa.ListArray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different roots whose sets are that similar: hashes that occur once say nothing, the others are bits."""
    sizes = np.diff(sets.offsets.to_numpy())
    flat, owner = sets.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    ok = shared[at]
    owner, column = owner[ok], column[at[ok]]
    bits = np.zeros((len(sizes), -(-int(shared.sum()) // 64)), np.uint64)
    np.bitwise_or.at(bits, (owner, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    a, b = [], []
    for i in range(len(sizes) - 1):
        rest = np.flatnonzero((root[i + 1 :] != root[i]) & (sizes[i + 1 :] >= similarity * sizes[i]) & (similarity * sizes[i + 1 :] <= sizes[i])) + i + 1
        common = np.bitwise_count(bits[rest] & bits[i]).sum(1, dtype=np.int64)
        hit = rest[common >= similarity * (sizes[i] + sizes[rest] - common)]
        a.append(np.full(len(hit), i))
        b.append(hit)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def meetings(classes: DataFrame, keys: str, *order: str) -> DataFrame:
    """A row for each hash in column `keys` of classes(node, root, n, fp, more), those of one hash together."""
    rows = classes.select(F.explode(keys).alias("key"), "node", "root", "fp", "more", "n")
    return rows.repartition("key").sortWithinPartitions("key", *order)


def met(rows: DataFrame, radius: int, both: int, similarity: float, how: str, tile: int = 512) -> DataFrame:
    """Pairs (a, b) of nodes of different roots (ra, rb) that share a key, of sizes as similar as that, whose fp are within
    `radius` bits and whose fp and more are within `both`.

    how = "next": of each run of equal keys only the pairs of neighbours in its order. "all": all pairs; "stars": edges
    that connect what all pairs connect. n says how many pairs an edge stands for. For the latter two, rows are in the
    order of key and root; a long run is compared in squares of `tile` rows, and rows of one root not with each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_chunks(batches, ["key"], 100_000):
            node, root, n = (table.column(c).to_numpy() for c in ("node", "root", "n"))
            fp, more = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "more"))
            starts = run_starts(table, ["key"])
            found: list[np.ndarray] = []

            def chosen() -> pa.RecordBatch:
                a, b = np.concatenate(found, 1)
                times = np.ones(len(a), np.int64)
                if how == "stars":
                    linked_to = np.bincount(np.concatenate([a, b]), minlength=len(node))
                    a, b = local_star(len(node), a, b)
                    times = linked_to[a]
                found.clear()
                a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
                one = pd.DataFrame({"a": node[a], "b": node[b], "ra": root[a], "rb": root[b], "n": times}).groupby(["a", "b", "ra", "rb"], as_index=False, sort=False).max()
                return pa.RecordBatch.from_pandas(one, preserve_index=False)

            held = 0
            for x, y in pairs_of_runs(root, starts, how == "next", tile):
                ok = (root[x] != root[y]) & (n[x] >= similarity * n[y]) & (n[y] >= similarity * n[x])
                x, y = x[ok], y[ok]
                off = np.bitwise_count(fp[x] ^ fp[y])
                ok = (off <= radius) & (off.astype(np.int64) + np.bitwise_count(more[x] ^ more[y]) <= both)
                if ok.any():
                    found.append(np.stack([x[ok], y[ok]]))
                    held += int(ok.sum())
                if held > HELD_PAIRS:
                    yield chosen()
                    held = 0
            if held:
                yield chosen()

    return rows.mapInArrow(lean(run), "a long, b long, ra long, rb long, n long").groupBy("a", "b", "ra", "rb").agg(F.max("n").alias("n"))


def pairs_of_runs(root: np.ndarray, starts: np.ndarray, neighbours: bool, tile: int, short: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same run (starts: where each begins), in parts; of a run of over `short` rows, sorted by root, only
    those of different roots. neighbours: only pairs of rows that follow each other."""
    sizes = np.diff(np.append(starts, len(root)))
    end = np.repeat(starts + sizes, sizes)
    idx = np.flatnonzero(np.repeat((sizes <= short) | neighbours, sizes))
    for d in range(1, 2 if neighbours else short):
        idx = idx[idx + d < end[idx]]
        if not len(idx):
            break
        yield idx, idx + d
    if neighbours:
        return
    for lo, n in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        after = np.searchsorted(root[lo : lo + n], root[lo : lo + n], "right")  # where the rows of the next root begin
        for i in range(0, n, tile):
            rows = np.arange(i, min(i + tile, n))
            for j in range(int(after[i]), n, tile):
                x, y = np.nonzero(np.arange(j, min(j + tile, n))[None] >= after[rows][:, None])
                if len(x):
                    yield x + (lo + i), y + (lo + j)


def similar_classes(rows: DataFrame, classes: DataFrame, words: int, radius: int, both: int, similarity: float, tables: int, block_rows: int, unit_rows: int, unit_hashes: int) -> DataFrame:
    """(node, root) of the classes that are linked; classes: node, row, n (its set's size), fp0, fp1, ..., prefix, least."""
    spark = rows.sparkSession
    kept = classes.select("node", "n", F.col("fp0").alias("fp"), (F.col("fp1") if tables > 1 else F.lit(0).cast("long")).alias("more"), "prefix", "least")
    test = {"radius": radius, "both": both, "similarity": similarity, "tile": block_rows}
    # neighbours among those that share one of their smallest hashes come first: large groups become one, at a cost in proportion to their size
    close = Table(met(meetings(kept.withColumn("root", F.col("node")), "least", "fp", "node"), how="next", **test).select("a", "b"), narrow=True).df
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("node"))
    first = Table(similar_pairs(sets_of(rows, classes, ends(close), words), close, similarity), narrow=True).df
    known = components(first).withColumnRenamed("node", "_n")
    rooted = Table(kept.join(known, F.col("node") == F.col("_n"), "left").select("node", "n", "fp", "more", "prefix", F.coalesce("root", "node").alias("root"))).df
    settled(spark)
    found = Table(met(meetings(rooted, "prefix", "root", "node"), how="stars", **test), narrow=True).df
    settled(spark)
    families = components(found, "ra", "rb").select(F.col("node").alias("_r"), F.col("root").alias("family"))
    touched = found.select(F.col("a").alias("node"), F.col("ra").alias("root")).union(found.select("b", "rb")).distinct()
    members = Table(touched.join(families, F.col("root") == F.col("_r")).join(classes.select("node", "n"), "node").select("node", "root", "family", "n"), narrow=True).df
    sets = sets_of(rows, classes, members, words)
    dealt, units = in_blocks(members, unit_rows, unit_hashes)
    dealt, units = Table(dealt, narrow=True).df, Table(units, narrow=True).df
    # a family goes by units if these move fewer sets than its links one by one would
    moved = dealt.groupBy("family").agg(F.count("*").alias("members")).join(units.groupBy(F.col("f").alias("family")).agg(F.count("*").alias("units")), "family")
    n_links = found.join(families, F.col("ra") == F.col("_r")).groupBy("family").agg(F.sum("n").alias("links"))
    sparse = Table(moved.join(n_links, "family").where(F.col("units") * 2 * unit_rows > F.greatest(2 * F.col("members"), F.col("links"))).select("family"), narrow=True).df
    edges = first.union(Table(similar_in_units(dealt.join(sparse, "family", "left_anti"), units.join(sparse, units["f"] == sparse["family"], "left_anti"), sets, similarity), narrow=True).df)
    if not sparse.isEmpty():
        alone = Table(members.join(sparse, "family").select(F.col("node").alias("_m")), narrow=True).df
        now = rooted.join(alone, F.col("node") == F.col("_m"), "left_semi")
        pairs = Table(met(meetings(now, "prefix", "root", "node"), how="all", **test).select("a", "b"), narrow=True).df
        edges = edges.union(Table(similar_pairs(sets, pairs, similarity), narrow=True).df)
    settled(spark)
    return components(edges)


def _similar(docs: DataFrame, words: int, tables: int, sample: int, similarity: float, **how) -> tuple[DataFrame, DataFrame]:
    """row, doc_id and node of docs(row, doc_id, text), and the classes linked."""
    tables = min(tables, 2)
    prints = Table(set_prints(docs, words, tables, similarity, common_shingles(docs.select("row", "text"), words, sample))).df
    worded = prints.where("node is not null")
    stand = worded.groupBy("node").agg(F.min("row").alias("row")).select("row")
    classes = Table(worded.join(stand, "row", "left_semi").select("node", "row", "n", *(f"fp{i}" for i in range(tables)), "prefix", "least")).df
    return prints.select("row", "doc_id", F.coalesce("node", F.lit(0)).alias("node")), similar_classes(docs.select("row", "text"), classes, words, tables=tables, similarity=similarity, **how)


def bare(docs: DataFrame) -> DataFrame:
    return numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")


def similar_texts(
    docs: DataFrame, words: int = 5, radius: int = 24, both: int = 40, similarity: float = 0.8, tables: int = 2, sample: int = 8192, block_rows: int = 512, unit_rows: int = 256, unit_hashes: int = 100_000
) -> DataFrame:
    """doc_id, set_id and component_id of each row of docs(doc_id, text).

    Two rows link if the Jaccard similarity of their sets of `words`-word shingles is `similarity` or more, decided on
    the whole sets. Candidates are pairs of which a fingerprint of these sets differs in `radius` bits at most, and with
    a second, independent one (tables = 2; further ones are not used) in `both` at most: of pairs at 0.8 itself fewer
    than 1 in 1,000 differ in more. Fingerprints are compared where two sets share a shingle of their prefixes, which
    loses no pair that similar. Rows of equal sets are one class; component_id is the smallest doc_id reachable, itself
    included. `sample` rows tell which shingles are frequent; any answer gives the same links.

    Each class is first held against its neighbours among those that share one of its three smallest hashes, so that
    large groups become one. Classes that candidates connect with others not yet in their component form a family; its
    members' sets meet in units, pairs of blocks of about `unit_rows` members (`unit_hashes` hashes), in which all pairs
    of different components are decided. A family with few candidates for its size goes pair by pair instead. No
    candidate is left out either way. `block_rows` rows of a long run are compared with as many at a time.

    A null text counts as empty; texts without words are one class, which links with no other. Rows that share a doc_id
    but not the text are linked only if their texts are. A row without doc_id stays, and does not lend its id; where no
    row of a component has one, component_id is null. Other columns are ignored; an empty table gives an empty result.
    """
    rows, found = _similar(bare(docs), words, tables, radius=radius, both=both, similarity=similarity, sample=sample, block_rows=block_rows, unit_rows=unit_rows, unit_hashes=unit_hashes)
    prints = rows.select("doc_id", F.col("node").alias("set_id"))
    classes = prints.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    return with_least(prints, "set_id", classes, found)


def without_near_copies(
    docs: DataFrame, words: int = 5, radius: int = 24, both: int = 40, similarity: float = 0.8, tables: int = 2, sample: int = 8192, block_rows: int = 512, unit_rows: int = 256, unit_hashes: int = 100_000
) -> DataFrame:
    """One row of each group of near copies (see similar_texts), as it stands: the one with the smallest doc_id.

    Rows without doc_id come last; of rows that tie, that is share the id or have none, the first in the order of input
    stays. Texts without words are one group. Rows that share a doc_id and do not resemble each other all stay. Any
    columns, whatever their names, are kept. docs is read several times and its rows are told apart by their place, so
    it must be a table or a fixed plan over one.
    """
    rows, found = _similar(bare(docs), words, tables, radius=radius, both=both, similarity=similarity, sample=sample, block_rows=block_rows, unit_rows=unit_rows, unit_hashes=unit_hashes)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("order")
    best = Table(rows.select("node", order).groupBy("node").agg(F.min("order").alias("order")), narrow=True).df
    roots = best.join(found.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(F.coalesce("root", "node").alias("root"), "order")
    row, kept = unused(docs.columns, "row", "kept")
    first = roots.groupBy("root").agg(F.min("order").alias("order")).select(F.col("order.row").alias(kept))
    return numbered(docs, row).join(first, F.col(row) == F.col(kept), "left_semi").select(*docs.columns)


def hex_fingerprint(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
