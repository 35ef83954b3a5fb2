"""Literal vectors, invariants over random inputs, and numeric kernels."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import color, columns, fields, vectors
from quarry.operators import aggregate, apportion, cluster, dedup, greedy, joins, metrics, overlay
from quarry.sources import jsonl, logs, palettes, sinks
from quarry.streaming.replay import Budget, DeficitTracker, ProbeGovernor

RNG = np.random.default_rng(5)


def takes(spark, sizes, n, pre=None):
    df = spark.createDataFrame([(k, s, (pre or {}).get(k, 0)) for k, s in sizes.items()], "cell string, size long, pre long")
    return {r["cell"]: r["take"] for r in apportion.deal(df, "cell", "size", n, "pre" if pre else None).collect()}


def greedy_deal(sizes, n, pre):
    take = dict.fromkeys(sizes, 0)
    for _ in range(min(n, sum(sizes.values()))):
        k = min((k for k in sizes if take[k] < sizes[k]), key=lambda k: (take[k] + pre.get(k, 0), -sizes[k], k))
        take[k] += 1
    return take


def test_deal_vectors(spark):
    assert takes(spark, {"tiny": 1, "big": 200}, 50) == {"tiny": 1, "big": 49}
    assert takes(spark, {"a": 100, "b": 100, "c": 100}, 20, {"a": 10}) == {"a": 0, "b": 10, "c": 10}
    assert takes(spark, {"a": 100, "b": 100}, 10, {"a": 40}) == {"a": 0, "b": 10}
    assert takes(spark, {"small": 1, "large": 9}, 1) == {"small": 0, "large": 1}


@pytest.mark.parametrize("seed", range(12))
def test_deal_is_the_greedy_rule(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"c{i}": int(s) for i, s in enumerate(rng.integers(0, 30, rng.integers(1, 9)))}
    pre = {k: int(p) for k, p in zip(sizes, rng.integers(0, 12, len(sizes)), strict=True)} if seed % 2 else {}
    n = int(rng.integers(0, 120))
    assert takes(spark, sizes, n, pre or None) == greedy_deal(sizes, n, pre)


def test_webster_prefixes(spark):
    sizes = {"a": 43, "b": 36, "c": 290, "d": 48, "e": 98}
    cells = spark.createDataFrame(list(sizes.items()), "cell string, size long")
    seq = apportion.sequence_by_deficit(cells, "cell", "size")
    assert seq.groupBy("cell").count().collect() and {r["cell"]: r["count"] for r in seq.groupBy("cell").count().collect()} == sizes
    assert apportion.prefix_deviation(seq, "cell", "pos").first()[0] < 1.0


def test_floor_shares():
    got = apportion.floor_shares({"a": 0, "b": 10, "c": 10, "d": 10}, dict.fromkeys("abcd", 1.0), 0.05)
    assert got["a"] == 0.05 and sum(got.values()) == pytest.approx(1)
    for seed in range(50):
        r = np.random.default_rng(seed)
        k = int(r.integers(1, 9))
        out = apportion.floor_shares({str(i): float(x) for i, x in enumerate(r.exponential(1, k))}, {str(i): float(x) for i, x in enumerate(r.uniform(0.1, 3, k))}, 0.05)
        assert sum(out.values()) == pytest.approx(1) and min(out.values()) >= 0.05 - 1e-12


def test_mode_budget_is_half_even():
    assert apportion.mode_budget(10, 3) == (2, 0) and apportion.mode_budget(14, 1) == (4, 1)


def test_overlay(spark):
    rows = spark.createDataFrame([("A", 3), ("B", 3), ("C", 3), ("P", None)], "k string, own int")
    amend = spark.createDataFrame([("A", 4), ("B", 2)], "k string, value int")
    side = spark.createDataFrame([("P", 1), ("C", 9)], "k string, value int")
    got = {r["k"]: r["score"] for r in overlay.overlay(rows, "k", "own", amend, side).collect()}
    assert got == {"A": 4, "B": 2, "C": 3, "P": 1}


def test_interior_rule(spark):
    rows = spark.createDataFrame([(0.31,), (0.10,), (0.30,), (None,)], "m double")
    assert [r["fate"] for r in overlay.split_three_ways(rows, "m", 0.30).collect()] == ["removed", "kept", "kept", "kept_null"]


def test_rekey_refuses(spark):
    owner = spark.createDataFrame([(1, "x"), (2, "x")], "id long, key string")
    with pytest.raises(Exception, match="unknown id"):
        overlay.rekey(spark.createDataFrame([(3, 1)], "id long, v int"), owner, "id", "key", "v").collect()
    with pytest.raises(Exception, match="conflicting"):
        overlay.rekey(spark.createDataFrame([(1, 1), (2, 2)], "id long, v int"), owner, "id", "key", "v").collect()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    once = overlay.upsert(old, new, "k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, overlay.upsert(once, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_replayed_log(spark):
    log = [(0, 1, False), (1, 2, True), (2, 3, False), (3, 4, False), (4, 3, False), (5, 4, False), (6, None, False)]
    out = dedup.last_wins(spark.createDataFrame(log, "pos long, node long, adm boolean"), "node", "pos")
    assert sorted((r["node"], r["pos"], r["first_position"]) for r in out.collect() if r["node"]) == [(1, 0, 0), (2, 1, 1), (3, 4, 2), (4, 5, 3)] and out.count() == 5


def test_guards(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="stamped"):
        one.select(columns.stamped_cut(F.lit(1.0), 0.5, "v2", "v1")).collect()
    with pytest.raises(Exception, match="not current"):
        one.select(columns.require_current(F.lit("v1"), "v2")).collect()
    with pytest.raises(Exception, match="both eras"):
        one.select(columns.schema_era(F.lit(1), F.lit(1))).collect()
    with pytest.raises(ValueError):
        dedup.namespaced_union([("a", one), ("A", one)], "id", ["id"])


def test_wilson_and_currency(spark):
    r = spark.range(1).select(*columns.wilson(F.lit(5), F.lit(10))).first()
    assert (r[0], r[1]) == (0.2366, 0.7634)
    rows = spark.createDataFrame([("p", 4), ("p", 3), ("p", 1)], "part string, k int")
    assert aggregate.currency(rows, "part", "k", {4: 1.0, 3: 0.1}).first()["currency"] == pytest.approx(1.1)


#: Published test pairs of the CIEDE2000 difference.
PAIRS = [
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
    ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_ciede2000(spark):
    df = spark.createDataFrame([(*map(float, a), *map(float, b), e) for a, b, e in PAIRS], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    for r in color.ciede2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").collect():
        assert r["de"] == pytest.approx(r["want"], abs=1e-4)


def test_ap_and_auc_brute(spark):
    y, s = RNG.integers(0, 2, 200), RNG.integers(0, 30, 200) / 30
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    ap = sum((y[s >= t].mean()) * ((y[s >= t].sum() - y[s > t].sum()) / y.sum()) for t in sorted(set(s)))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(ap)
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    none = spark.createDataFrame([(0, 0.5), (0, float("nan"))], "y int, s double")
    assert metrics.average_precision(none, "y", "s").first()[0] is None and metrics.roc_auc(none, "y", "s").first()[0] is None


def test_logistic_separates(spark):
    x = RNG.normal(size=300)
    rows = [(i, float(v), int(v + RNG.normal() * 0.3 > 0), i % 3) for i, v in enumerate(x)]
    p = metrics.out_of_fold_logistic(spark.createDataFrame(rows, "k long, x double, y int, fold int"), "k", ["x"], "y", "fold").collect()
    assert len(p) == 300 and np.mean([(r["p"] > 0.5) == bool(rows[r["k"]][2]) for r in p]) > 0.85


def test_bootstrap_covers(spark):
    df = spark.createDataFrame([(i // 3, float(v)) for i, v in enumerate(RNG.normal(5, 1, 600))], "g long, v double")
    r = metrics.bootstrap(df, "g", "v", 300).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 0.4


def test_neighbours_against_all_pairs(spark):
    pts = [(i, float(a), float(b), float(w)) for i, (a, b, w) in enumerate(zip(RNG.normal(0, 3, 150), RNG.normal(0, 3, 150), RNG.uniform(0.5, 4, 150), strict=True))]
    df = spark.createDataFrame(pts, "k long, x double, y double, w double")
    got = {(r["k"], r["o_k"]) for r in joins.viewport_neighbours(df, "k", "x", "y", "w").collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and 1 / 1.5 <= a[3] / b[3] <= 1.5 and math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.5 * min(a[3], b[3])}
    near = {(r["k"], r["o_k"]) for r in joins.near_pairs(df, df, [], "x", "y", 1.0).collect()}
    assert near == {(a[0], b[0]) for a in pts for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_long_chains(spark, few):
    """Chains in random order of keys, longer than rounds of neighbours' minima can follow, and a hub."""
    order = np.random.default_rng(1).permutation(5000).tolist()
    edges = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(9000, 9000 + i) for i in range(1, 500)] + [(9000, 9000), (None, 3)]
    nodes = spark.createDataFrame([(k,) for k in [*range(5000), *range(9000, 9500), 20000]], "k long")
    got = {r["k"]: r["component"] for r in cluster.components(nodes, spark.createDataFrame(edges, "a long, b long"), "k", few).collect()}
    assert got == {k: 0 if k < 5000 else 9000 if k < 9500 else k for k in got} and len(got) == 5501


def test_line_links_connect_what_pairs_connect(spark):
    x = [*np.random.default_rng(2).uniform(-500, 500, 150).round(2).tolist(), *(40.0 * i for i in range(30, 40)), 4000.0, 4040.01, None, float("nan"), float("inf"), float("inf")]
    x += x[:50]
    df = spark.createDataFrame(list(enumerate(x)), "k long, x double")
    got = {r["k"]: r["component"] for r in cluster.components(df, joins.line_links(df, "k", "x", 9.0), "k").collect()}
    want = dict(enumerate(range(len(x))))
    for _ in x:
        want = {i: min([want[i], *(want[j] for j in range(len(x)) if x[i] is not None and x[j] is not None and abs(x[i] - x[j]) <= 9.0)]) for i in want}
    assert got == want
    assert joins.line_links(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1.5).alias("x")), "k", "x", 9.0).count() == 19_999


def matrix_linkage(x, levels):
    d, n = 1 - x @ x.T, len(x)
    np.fill_diagonal(d, np.inf)
    size, own, cuts = np.ones(n), np.arange(n), {}
    for left in range(n, 0, -1):
        if left in levels:
            cuts[left] = own.copy()
        if left > 1:
            i, j = sorted(np.unravel_index(np.argmin(np.round(d, 12)), d.shape))
            d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i, i] = d[j] = d[:, j] = np.inf
            size[i] += size[j]
            own[own == j] = i
    return {k: cuts[min(k, n)] for k in levels if min(k, n) in cuts}


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_is_the_matrix_rule(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rng.integers(2, 60), 8))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x = x[rng.integers(0, len(x), 90)] if seed % 2 else x  # copies
    if seed == 3:
        x[[4, 9]] = 0
    levels = [1, 2, 3, 5, 10, 40, 70, 85]
    got = cluster.average_linkage(x, levels)
    for k, owners in matrix_linkage(x, levels).items():
        assert got[k].tolist() == owners.tolist(), k


def test_average_linkage_of_many_copies():
    """20,000 rows whose matrix would take 3.2 GB."""
    x = np.eye(40)[np.random.default_rng(1).integers(0, 40, 20_000)] + 0.1
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    assert [len(np.unique(o)) for o in cluster.average_linkage(x, [2, 5, 40]).values()] == [2, 5, 40]


def test_cuts_of_copies_nest(spark):
    """Copies under other keys do not change the cuts, whose finer clusters lie within the coarser ones."""
    v = np.random.default_rng(4).normal(size=(40, 6)).tolist()
    df = spark.createDataFrame([(i + 1000 * c, 0, x) for c in range(50) for i, x in enumerate(v)], "k long, g int, v array<double>")
    cuts = cluster.agglomerate(df, "g", "k", "v", [2, 5])
    assert cuts.groupBy("cut_5").agg(F.countDistinct("cut_2").alias("n")).agg(F.max("n"), F.count("*")).first() == (1, 5)
    assert cuts.withColumn("k", F.col("k") % 1000).distinct().count() == 40


def test_linkage_holds_few_distances():
    """Memory stays within a few MB beside the vectors, whether they differ or are copies."""
    import tracemalloc

    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(6000, 4)), np.tile(rng.normal(size=(40, 8)), (2000, 1))):
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        tracemalloc.start()
        try:
            cuts = cluster.average_linkage(x, [2, 5])
            assert tracemalloc.get_traced_memory()[1] < 20_000_000
        finally:
            tracemalloc.stop()
        assert [len(np.unique(o)) for o in cuts.values()] == [2, 5]


def test_cosine_distances_of_odd_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 2.0]), (3, 0, [1.0, 1.0]), (4, 0, [0.0, 0.0]), (5, 0, None), (6, 0, [1.0, None]), (7, 0, [1.0, 0.0, 0.0]), (8, 1, [1.0, 0.0]), (9, None, [1.0, 0.0]), (10, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, g int, v array<float>")
    for block in (1024, 2):
        got = {(r["a"], r["b"]): r["distance"] for r in joins.cosine_distances(df, "k", "v", "g", block).collect()}
        assert set(got) == {(a, b) for a in range(1, 8) for b in range(a + 1, 8)}
        assert {p: x for p, x in got.items() if x is not None} == {(1, 2): 1.0, (1, 3): 0.292893, (2, 3): 0.292893}


def test_permutations_meet_without_broadcast(spark):
    df = spark.range(50).select(F.when(F.col("id") != 9, F.col("id")).alias("x"), (F.col("id") * 7 % 11).alias("y"))
    p = metrics.permutation_p(df, "x", "y", 20)
    assert "Join" not in p._jdf.queryExecution().executedPlan().toString()
    own = sorted((-1 if i == 9 else i, i * 7 % 11) for i in range(50))
    turns = [sorted(range(50), key=lambda k, r=r: (int(hashlib.md5(f"0|{r}|{k + 1}".encode()).hexdigest()[:7], 16), k)) for r in range(1, 21)]
    s = [sum(own[k][0] * own[t][1] for k, t in enumerate(turn) if own[k][0] >= 0) for turn in [range(50), *turns]]
    assert p.first()[0] == pytest.approx((sum(v >= s[0] for v in s[1:]) + 1) / 21)


def test_components_and_hamming(spark):
    nodes = spark.range(60).select(F.col("id").alias("k"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 50)], "a long, b long")
    got = {r["k"]: r["component"] for r in cluster.components(nodes, edges, "k").collect()}
    assert got[30] == 0 and got[31] == 31 and got[50] == 40
    codes = [int(x) for x in RNG.integers(-(2**63), 2**63 - 1, 30)]
    codes += [c ^ (1 << int(b)) for c in codes for b in RNG.integers(0, 62, 2)]
    pairs = {(r["a"], r["b"]) for r in cluster.hamming_pairs(spark.createDataFrame(list(enumerate(codes)), "k long, h long"), "k", "h", 3).collect()}
    mask = (1 << 64) - 1
    assert pairs == {(i, j) for i in range(90) for j in range(i + 1, 90) if ((codes[i] ^ codes[j]) & mask).bit_count() <= 3}


def test_linkage_over_many_blocks(spark):
    """Components with blocks far below the row count, against all pairs."""
    rng = np.random.default_rng(11)
    for least in (0.9, 0.97):
        x = rng.normal(size=(240, 4))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        link, own = x @ x.T >= least, np.arange(240)
        while True:
            after = np.where(link, own[None, :], 240).min(1)
            if (after == own).all():
                break
            own = after
        rows = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "k long, g string, v array<double>")
        for block in (16, 512):
            got = cluster.single_linkage(rows, "k", "v", least, ["g"], block)
            assert [r["component"] for r in got.orderBy("k").collect()] == own.tolist()


def test_greedy_results_keep_apart(spark):
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(RNG.uniform(0, 10, (200, 2)))], "k long, x double, y double")
    kept = [r["k"] for r in greedy.spatial_dedup(pts, [], [], "k", "x", "y", 1.0).collect()]
    at = {r["k"]: (r["x"], r["y"]) for r in pts.collect()}
    assert all(math.dist(at[a], at[b]) >= 1 for i, a in enumerate(kept) for b in kept[:i])
    assert all(k in kept or min(math.dist(at[k], at[q]) for q in kept if q < k) < 1 for k in at)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 1.0], [0.0, 1.0, 0.0, 0.0], [1.2, 3.7, float("nan"), 0.1])], "a array<double>, b array<double>, c array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.emd_1d(F.col("a"), F.col("b")), vectors.arc_length(F.col("a"), True), vectors.crossings(F.col("c")), vectors.finite_std(F.col("c")), vectors.interior_fraction(F.col("c"))).first()
    assert r[0] == pytest.approx(2 / math.sqrt(22)) and r[1] == pytest.approx(1 + 2 + 6 + 7) and r[2] == 1 + 2 + 3 + 0 and r[3] == 2 and r[4] == pytest.approx(np.std([1.2, 3.7, 0.1])) and r[5] == 0.25


def test_quantile_edges_rise(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 3, 9]], "x double")
    edges = [r["edge"] for r in aggregate.quantile_edges(df, "x", 6).orderBy("k").collect()]
    assert len(edges) == 5 and all(b > a for a, b in zip(edges, edges[1:], strict=False))


def test_fields():
    assert np.isnan(fields.smooth_count(np.array([[0j, -1 + 0j]]), 50)).all() and fields.iterate(np.array([2 + 2j]), 50)[0][0] < 10
    c = fields.plane(-0.6, 0.3, 2.0, 24, 32)
    direct = fields.iterate(c, 80)[0]
    assert (fields.perturbed(-0.5 + 0.2j, c - (-0.5 + 0.2j), 80) == direct).mean() > 0.99
    assert np.allclose(fields.smooth_count(c, 60), fields.smooth_count(c.conj(), 60), equal_nan=True)
    assert (fields.iterate(c, 60, degree=3)[0] == fields.iterate(-c, 60, degree=3)[0]).mean() > 0.99
    a, b = fields.orbit_fields(c, 60, ("smooth", "stripe", "trap")), fields.orbit_fields(c, 60, ("trap",))
    assert np.array_equal(a["trap"], b["trap"]) and set(b) == {"trap"}
    assert np.allclose(fields.resample(np.ones((12, 12)), 3, "lanczos"), 1) and fields.pool(np.arange(16.0).reshape(4, 4), 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    v = np.zeros((30, 30))
    v[10, 12] = v[22, 5] = 5
    assert {tuple(p[:2].astype(int)) for p in fields.foci(v, (1,), 3, 2)} == {(10, 12), (22, 5)}


def test_exact_kernels():
    polys = fields.period_polynomials(5)
    assert polys[0] == [0, 1] and polys[1] == [1, 1] and polys[2] == [1, 1, 2, 1] and [len(p) - 1 for p in polys] == [1, 1, 3, 6, 15]
    x, y = fields.newton_nucleus(("-1.75", "0"), 3, 40)
    r = np.roots(polys[2][::-1])
    assert abs(float(x) - min(r.real)) < 1e-12 and abs(float(y)) < 1e-30
    assert fields.splitmix64(0)[1] == 0xE220A8397B1DCDAF
    assert abs(fields.skeleton_point(0.0, "cardioid") - 0.25) < 1e-12 and abs(fields.skeleton_point(0.5, "circle") + 1.25) < 1e-12


def test_loops_and_palettes():
    t = np.linspace(0, 2 * np.pi, 50, endpoint=False)
    ring = np.stack([np.cos(t), np.sin(t), 0 * t], 1)
    assert np.allclose(np.linalg.norm(np.diff(fields.resample_closed(ring, 20), axis=0), axis=1), 2 * math.pi / 20, rtol=0.02)
    assert fields.loop_coverage(ring, ring * 1.01, 0.05) == 1 and np.abs(fields.smooth_closed(ring, 2)).max() <= 1
    line = np.stack([np.arange(9.0), np.zeros(9), np.zeros(9)], 1)
    assert sorted(fields.mst_diameter(line)) == list(range(9)) and fields.extract_palette(ring, 16).shape == (16, 3)
    table = fields.cyclic_table([(0.0, (0, 0, 0)), (0.5, (1, 1, 1))], 8)
    assert table[4].tolist() == [1, 1, 1] and np.allclose(fields.lookup(table, np.array([1.0, 0.0])), 0)


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    jsonl.write(df, str(tmp_path / "x"))
    jsonl.append(df, str(tmp_path / "x"))
    (tmp_path / "x" / "part-z.json").write_text('{"id": 3, "name": "c"}\n\n{"id": 4, "na')
    rows, torn = jsonl.read_torn(spark, str(tmp_path / "x"), df.schema)
    assert rows.count() == 5 and torn.first()["torn"] == 1
    (tmp_path / "doc.json").write_text('[\n{"id": 7,\n "name": "q"}\n]')
    assert jsonl.read_document(spark, str(tmp_path / "doc.json"), df.schema).collect()[0]["id"] == 7
    np.array([1.0, np.nan], "<f4").tofile(tmp_path / "grid.bin")
    v = jsonl.read_field(spark, str(tmp_path / "grid.bin")).first()["values"]
    assert v[0] == 1 and math.isnan(v[1])
    text = spark.createDataFrame([(0, "x-one {"), (1, " index=0 color=255"), (2, " index=9 color=65536"), (3, "}"), (4, "y {"), (5, "index=3 color=256")], "n long, line string")
    assert {(r["title"], r["index"], r["r"], r["g"], r["b"]) for r in palettes.gradient_blocks(text, "n", "line").collect()} == {("x-one", 0, 255, 0, 0), ("x-one", 9, 0, 0, 1), ("y", 3, 0, 1, 0)}
    line = spark.createDataFrame([("12 300 7 note",), ("none",)], "l string").select(palettes.map_line(F.col("l")).alias("c")).collect()
    assert tuple(line[0]["c"]) == (12, 255, 7) and line[1]["c"] is None
    assert logs.files(spark, str(tmp_path / "*.bin")).first()["length"] == 8
    with pytest.raises(FileNotFoundError):
        logs.require_registered(spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([("b",)], "s string"), "s")
    one = spark.createDataFrame([("p", [(0.0, [1, 2, 3])])], "name string, stops array<struct<pos:double,rgb:array<int>>>")
    assert palettes.unify({"x": one, "y": one}).groupBy("source").count().count() == 2


def test_sinks(spark, tmp_path):
    policy = sinks.SinkPolicy({k: str(tmp_path / k) for k in sinks.CLASSES})
    assert policy.write(spark.range(3), "durable", "t").endswith("durable/t")
    for bad in ("/abs", "../up"):
        with pytest.raises(PermissionError):
            policy.path("bulk", bad)
    sheet = sinks.contact_sheet([np.ones((2, 3, 3))] * 3, 2)
    assert sheet.shape == (5, 7, 3) and sinks.png(sheet)[:4] == b"\x89PNG"
    df = spark.createDataFrame([(1, [0.0, 1.0, 0.5, 0.2])], "k long, v array<double>")
    assert bytes(sinks.images(df, "k", "v", 2).first()["png"])[:4] == b"\x89PNG"


def test_trackers():
    t = DeficitTracker([0.5, 0.5])
    t.ingest(0, 3)
    assert t.deficit() == [-0.5, 0.5] and t.gain([0.0, 1.0]) == 0.5
    g = ProbeGovernor(2, 10, 100)
    assert [g.allow(c, n) for c, n in (("a", 0), ("a", 1), ("b", 2), ("c", 3), ("c", 12), ("a", 200))] == [True, False, True, False, True, True]
    b = Budget(10)
    for cost in (4, 4):
        assert b.fits()
        b.charge(cost)
    assert not b.fits()


@pytest.mark.parametrize("name, key", [("guided_descents", "walk"), ("maneuvers", "view")])
def test_every_supplier_is_used(spark, name, key):
    from quarry import catalog

    data = "/root/testdata/sf0.01"
    want = {r[0] for r in spark.read.parquet(f"{data}/supplier.parquet").select("s_suppkey").collect()}
    assert len(want) > 40 and {r[0] for r in catalog.QUERIES[name](spark, data).select(key).collect()} == want
