"""Stores, resumable state, backends and budgets beyond what the registered queries show."""

import itertools

import pytest
from pyspark.sql import functions as F

from quarry.functions import backends, fields
from quarry.operators import cluster, greedy
from quarry.plans import state as P
from quarry.sources import stores


def test_field_store_keeps_first_and_refuses_another_policy(spark, tmp_path):
    root = str(tmp_path / "store")
    store = stores.FieldStore(spark, root, "raw", buckets=4)
    rows = spark.createDataFrame([("a", [1.0]), ("a", [0.5]), ("b", [2.0]), (None, [9.0])], "key string, values array<double>")
    store.append(rows)
    store.append(rows.withColumn("values", F.array(F.lit(7.0))))
    again = stores.FieldStore(spark, root, "raw", buckets=4)
    assert {r["key"]: r["values"] for r in again.fields().collect()} == {"a": [0.5], "b": [2.0]}
    assert [r["key"] for r in again.missing(spark.createDataFrame([("b",), ("c",)], "key string")).collect()] == ["c"]
    with pytest.raises(ValueError, match="policy"):
        stores.FieldStore(spark, root, "other", buckets=4)


def test_state_ignores_what_was_not_committed(spark, tmp_path):
    state = P.RunState(spark, str(tmp_path / "run"))
    assert state.load() is None
    state.save(0, {"t": spark.range(3)})
    state.save(1, {"t": spark.range(9)}, commit=False)
    round_, tables = state.load()
    assert round_ == 0 and tables["t"].count() == 3
    state.save(1, {"t": spark.range(5)})
    assert state.load()[0] == 1 and state.load()[1]["t"].count() == 5


def test_pool_goes_on_from_its_state_and_stops_at_its_target(spark, tmp_path):
    calls = []

    def expand(df):
        calls.append(1)
        return df.select((F.col("id") % 7).alias("atom"))

    state, seeds = P.RunState(spark, str(tmp_path / "pool")), spark.range(12).withColumn("wave", F.col("id") % 4)
    assert P.enumerate_pool(state, seeds, "wave", 1, expand, "atom", 100).count() == 3
    assert P.enumerate_pool(state, seeds, "wave", 4, expand, "atom", 5).count() >= 5
    before = len(calls)
    P.enumerate_pool(state, seeds, "wave", 4, expand, "atom", 5)
    assert len(calls) == before < 4


def test_harvest_watermark_stops_at_the_first_failure(spark):
    ledger = spark.createDataFrame([(c, 10 * c + i, i == 0) for c in range(4) for i in range(3)], "cycle long, position long, harvested boolean")
    tries = spark.createDataFrame([(0, 0, True), (1, 0, False), (1, 1, True), (2, 0, False), (2, 1, False), (2, 2, True)], "cycle long, attempt int, ok boolean")
    got = [(r["state"], r["tries"], r["deferred"], r["watermark"]) for r in P.harvest_cycles(ledger, tries).orderBy("cycle").collect()]
    assert got == [("ok", 1, 0, 2), ("ok", 2, 0, 12), ("failed", 2, 2, 12), ("failed", 2, 2, 12)]


def test_looks_beyond_the_budget_stay(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [2.0, 0.0]), (3, [1.0, 0.0])], "k long, v array<double>").withColumn("g", F.lit(1))
    got = {r["k"]: r["status"] for r in greedy.embedded_looks(rows, ["g"], "k", "v", greedy.budgeted(3)).collect()}
    assert got == {0: "kept", 1: "unembeddable", 2: "removed", 3: "not_reached"}


def test_elites_are_those_of_an_unfiltered_walk(spark):
    rows = [(k, k * 7 % 5, k * 3 % 4, k * 5 % 6, float(k * 11 % 13)) for k in range(200)]
    got = {r["k"] for r in greedy.map_elites(spark.createDataFrame(rows, "k long, c long, p long, i long, s double"), ["c"], "k", "s", "p", 2, "i").collect()}
    cells, ids, used, want = set(), set(), {}, set()
    for k, c, p, i, _ in sorted(rows, key=lambda r: (-r[4], r[0])):
        if c not in cells and i not in ids and used.get(p, 0) < 2:
            cells.add(c)
            ids.add(i)
            used[p] = used.get(p, 0) + 1
            want.add(k)
    assert got == want


def test_backends_are_named_once_and_unknown_ones_fail(spark):
    with pytest.raises(ValueError, match="registered"):
        backends.backend("square")(backends.square)
    view = spark.createDataFrame([(1, "none", 0.0, 0.0, 1.0)], "k long, backend string, cx double, cy double, width double")
    with pytest.raises(Exception, match="none"):
        backends.sample(view, "k", 2, 4).collect()


def test_scorer_tells_bad_rows(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0])], "k long, v array<double>")
    got = {r["k"]: (r["p"], r["why"]) for r in backends.batch_score(rows, "k", "v", backends.linear_scorer([1.0, 1.0], 0.0), 2).collect()}
    assert got == {1: (0.5, None), 2: (None, "no features"), 3: (None, "bad features"), 4: (None, "bad features")}


def test_hash_and_draw_of_nulls(spark):
    rows = spark.createDataFrame([(1, [float(x) for x in range(16)]), (2, None), (3, [1.0])], "k long, g array<double>")
    got = {r["k"]: r["h"] for r in cluster.dct_hash(rows, "k", "g", 4, 2).collect()}
    assert got[1] is not None and got[2] is got[3] is None
    state, first = fields.splitmix64(2**53 + 1)
    draws = spark.createDataFrame([(2**53 + 1,), (None,)], "s long").select(fields.first_draw("s").alias("d")).collect()
    assert {r["d"] for r in draws} == {str(first), None}


def test_governor_and_budget_by_hand(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 2, 3, 4, 5])], "k long, c long").withColumn("g", F.lit(0))
    got = [r["allowed"] for r in greedy.governed(rows, "g", "k", "c", rate=2, window=3, ttl=2).orderBy("k").collect()]
    assert got == [True, False, True, True, False, True]
    costs = spark.createDataFrame(list(enumerate([4.0, 4.0, 4.0, 4.0])), "k long, c double").withColumn("g", F.lit(0))
    spent = [r["spent"] for r in greedy.within_budget(costs, "g", "k", "c", 10.0).orderBy("k").collect()]
    assert spent == list(itertools.accumulate([4.0, 4.0]))
