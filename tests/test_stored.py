"""Stores, fitted tables and streams with state against plain readings, with restarts, replays and other writers."""

import datetime
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.panel import KEYS
from panelforge.operators import book, frozen, vector_index
from panelforge.operators.signals import horizon_returns
from panelforge.plans import flows
from panelforge.sources import io
from panelforge.sources.npy import NpySource
from panelforge.sources.store import GraphStore
from panelforge.streaming import stream, upsert

FACT = "ticker string, quarter string, metric string, value double, reason string"


def facts(spark, n, seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([*x, None])
    return spark.createDataFrame([(pick("A", "B"), pick("2020-Q1", "2020-Q2"), pick("m", "n"), pick(1.0, 2.0, 3.0), pick("r")) for _ in range(n)], FACT)


def state(store):
    return sorted(map(tuple, store.table("nodes").collect()), key=repr), sorted(map(tuple, store.table("edges").collect()), key=repr)


def test_a_graph_is_the_same_for_any_order_of_batches_and_for_replays(spark, tmp_path):
    batches = {str(k): facts(spark, 12, k).cache() for k in range(3)}
    stores = []
    for i, order in enumerate(("012", "20110")):
        store = GraphStore(spark, f"file://{tmp_path}/{i}", 4)
        done = [store.merge(b, batches[b]) for b in order]
        assert done == [order.index(b) == k for k, b in enumerate(order)]
        stores.append(state(store))
    assert stores[0] == stores[1]
    from panelforge.operators.facts import graph_tables

    whole = graph_tables(batches["0"].unionByName(batches["1"]).unionByName(batches["2"]))
    assert stores[0] == tuple(sorted({tuple(r) for r in df.collect()}, key=repr) for df in whole)


def test_a_writer_that_comes_second_merges_again(spark, tmp_path):
    a, b = GraphStore(spark, f"file://{tmp_path}", 4), GraphStore(spark, f"file://{tmp_path}", 4)
    first, second = facts(spark, 10, 1).cache(), facts(spark, 10, 2).cache()
    stale = a.manifest()
    b.merge("b", second)
    real, answers = a.manifest, iter([stale, stale])
    a.manifest = lambda: next(answers, None) or real()  # a still sees the version before b's
    assert a.merge("a", first)
    both = GraphStore(spark, f"file://{tmp_path}/other", 4)
    both.merge("a", first), both.merge("b", second)
    assert state(a)[0] == state(both)[0] and state(a)[1] == state(both)[1]
    assert real()["applied"] == ["b", "a"]


def test_upserts_survive_restarts_and_late_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(5), i, f"v{i}") for i in range(60)]
    schema = "k string, ver long, id long, v string"
    for go in range(3):
        spark.createDataFrame(rows[go::3], schema).write.mode("append").parquet(f"{tmp_path}/feed")
        feed = stream.read_events(spark, f"{tmp_path}/feed", spark.createDataFrame([], schema).schema)
        upsert.upsert(feed, "k", F.col("ver"), F.col("id"), f"{tmp_path}/log", f"{tmp_path}/state")
    log = spark.read.schema(upsert.CHANGE).parquet(f"{tmp_path}/log")
    got = {r["k"]: (r["ver"], r["id"], r["v"]) for r in upsert.current(log, schema).collect()}
    assert got == {k: max((r[1:] for r in rows if r[0] == k), key=lambda r: r[:2]) for k in "abc"}
    assert log.filter("NOT replaced").count() == 3
    items = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r["k"] for r in upsert.pending(items, "k", log).collect()] == ["z"]


def test_two_writers_of_a_log_lose_no_row(spark, tmp_path):
    write = lambda a: io.append_log(spark.range(a, a + 50), f"{tmp_path}/log")
    threads = [threading.Thread(target=write, args=(a,)) for a in (0, 50, 100)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == list(range(150))


def test_running_errors_go_on_from_their_state_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(90)]
    for go in range(3):
        spark.createDataFrame(rows[30 * go : 30 * go + 30], "y double, p double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        feed = stream.read_events(spark, f"{tmp_path}/feed", spark.createDataFrame([], "y double, p double").schema)
        stream.errors_by_batch(feed, "y", "p", f"{tmp_path}/out", f"{tmp_path}/state")
        seen = rows[: 30 * go + 30]
        got = {r["batch"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
        assert sorted(got) == list(range(go + 1)) and got[go]["n"] == len(seen)
        assert got[go]["mse"] == pytest.approx(np.mean([(p - y) ** 2 for y, p in seen]))


def test_frozen_ranks_agree_with_sorting(spark):
    rng = random.Random(3)
    train = [(rng.choice("ab"), rng.choice([None, *map(float, range(40))])) for _ in range(400)]
    new = [(rng.choice("abc"), rng.choice([None, -1.0, 99.0, rng.uniform(0, 40), float(rng.randrange(40))])) for _ in range(200)]
    df = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, g string, v double")
    got = {r["i"]: (r["below"], r["same"], r["total"]) for r in frozen.placed(df(new), frozen.frozen_counts(df(train), "v", ["g"], each=7), "v", ["g"]).collect()}
    for i, (g, v) in enumerate(new):
        own = [x for h, x in train if h == g and x is not None]
        assert got[i] == ((None, None, len(own) or None) if v is None or not own else (sum(x < v for x in own), sum(x == v for x in own), len(own)))
    empty = frozen.placed(df(new), frozen.frozen_counts(df([]), "v"), "v").collect()
    assert all(r["below"] is None for r in empty) and len(empty) == len(new)


def test_probed_search_finds_what_lies_close_and_all_lists_are_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    spots = rng.normal(size=(20, 16))
    rows = [(i, [float(v) for v in spots[i % 20] + 0.3 * rng.normal(size=16)]) for i in range(600)] + [(600, None), (601, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    centres = vector_index.fitted_centres(df, 20)
    index = vector_index.build(df, centres, f"{tmp_path}/index")
    assert index.count() == len(rows)
    asked = df.filter("vec_id % 20 = 0 AND vec_id < 600").withColumnRenamed("vec_id", "query")
    exact = vector_index.search(index, centres, asked, 10, len(centres), -2.0)
    x = np.array([r[1] for r in rows[:600]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(j)) for q in range(0, 600, 20) for j in np.argsort(-(x @ x[q]), kind="stable")[:10]}
    assert {(r["query"], r["vec_id"]) for r in exact.collect()} == want
    found = vector_index.search(index, centres, asked, 10, 3, -2.0)
    assert vector_index.recall(found, exact).first()["recall"] >= 0.9
    odd = vector_index.search(index, centres, asked, 10, len(centres), -2.0, F.col("vec_id") % 2 == 1)
    assert odd.filter("vec_id % 2 = 0").count() == 0 and odd.count() == 300


def test_npy_files_of_other_types_and_shapes(spark, tmp_path):
    spark.dataSource.register(NpySource)
    np.save(tmp_path / "a.npy", np.arange(21, dtype=np.int16).reshape(7, 3))
    np.save(tmp_path / "b.npy", np.array([1.5, 2.5], np.float32))
    df = spark.read.format("npy").option("rows", 3).load(str(tmp_path))
    got = sorted((r["file"], r["row"], tuple(r["values"])) for r in df.collect())
    assert got == [*(("a.npy", i, (3.0 * i, 3.0 * i + 1, 3.0 * i + 2)) for i in range(7)), ("b.npy", 0, (1.5,)), ("b.npy", 1, (2.5,))]
    assert df.rdd.getNumPartitions() == 4
    two = spark.read.format("npy").option("columns", "2,0").load(f"{tmp_path}/a.npy").filter("row = 6").first()
    assert two["values"] == [20.0, 18.0]


def test_a_leak_report_is_one_job_and_keeps_what_it_cannot_judge(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(9)]
    panel = spark.createDataFrame([(t, d, float(i * 3 % 7 + 1)) for t in "ab" for i, d in enumerate(days)], "ticker string, ts date, close double")
    factors = {"own": lambda df, new: df.withColumn(new, F.col("close")), "next": lambda df, new: df.withColumn(new, F.lead("close").over(KEYS.series())), "broken": lambda df, new: df.withColumn(new, F.col("nothing"))}
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("leaks", "leaks")
    got = {r["factor"]: (r["status"], r["changes"]) for r in flows.leak_report(panel, factors, ["close"], [days[3], days[8]], tolerance=0.0).collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {"own": ("clean", 0), "next": ("leak", 2), "broken": ("error", None)}
    assert len(tracker.getJobIdsForGroup("leaks")) <= 4  # adaptive execution runs each shuffle as a job: as many for any number of factors
    assert set(flows.without_leaks(panel, factors, ["close"], [days[3]])) == {"own", "broken"}


def test_horizons_over_gaps_losses_and_ends(spark):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    at = lambda h: start + datetime.timedelta(hours=h)
    series = {"a": {0: 0.1, 1: 0.2, 2: None, 3: -0.5, 5: 0.1}, "b": {0: 0.0, 4: -1.0, 5: 3.0}, "c": {h: -1.5 for h in (0, 1, 2, 3, 4, 5)}}
    returns = spark.createDataFrame([(k, at(h), r) for k, own in series.items() for h, r in own.items()], "k string, hour timestamp, r double")
    calls = [(k, at(h)) for k in ("a", "b", "c", "zz") for h in (-3, 0, 0.5, 1, 2.2, 5, 7)]
    got = sorted(map(tuple, horizon_returns(spark.createDataFrame(calls, "k string, t timestamp"), returns, "k", "t", "hour", "r", [1, 3]).select("k", "t", "T_timestamp", "return_1", "return_3").collect()), key=repr)
    want = []
    for k, t in calls:
        h = (t - start) / datetime.timedelta(hours=1)
        pos = next((i for i in range(6) if i >= h), None)
        plain = [None if k not in series or pos is None or pos + n >= 6 else float(np.prod([1 + (series[k].get(i) or 0) for i in range(pos + 1, pos + n + 1)]) - 1) for n in (1, 3)]
        want.append((k, t.replace(tzinfo=None), at(pos).replace(tzinfo=None) if k in series and pos is not None else None, *plain))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=repr)]
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[3:] == tuple(None if x is None else pytest.approx(x) for x in w[3:])


def test_day_blocks_leave_short_series_out(spark):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)
    rows = [("a", day(2 * i)) for i in range(10)] * 2 + [("b", day(i)) for i in range(3)]
    got = {(r["k"], r["d"]): (r["block"], r["split"]) for r in book.day_blocks(spark.createDataFrame(rows, "k string, d date"), "d", "k", 4).collect()}
    edges = np.linspace(0, 10, 5, dtype=int)
    want = {("a", day(2 * i)): int(np.searchsorted(edges, i, side="right") - 1) for i in range(10)}
    assert {k: b for k, (b, _) in got.items()} == want
    assert {b: s for b, s in got.values()} == {0: "valid", 1: "train", 2: "test", 3: "train"}
