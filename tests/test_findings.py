"""Inputs on which a query or an operator once failed."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from panelforge.functions import text as X
from panelforge.operators import facts as G
from panelforge.plans import registry


def checked(spark, name, folder, **tables):
    """The query and its SQL over ``tables`` (pyarrow), as sorted rows with NaN and null apart."""
    import pyarrow.parquet as pq

    c = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def events(n, value, step=datetime.timedelta(minutes=7), kinds=("click", "view")):
    """An events table: ``value`` of the row number, rows ``step`` apart."""
    import pyarrow as pa

    start = datetime.datetime(2024, 1, 1)
    return pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([start + step * i for i in range(n)], pa.timestamp("us")), "user_id": pa.array([i % 5 for i in range(n)], pa.int64()),
        "event_type": [kinds[i % len(kinds)] for i in range(n)], "value": pa.array([value(i) for i in range(n)], pa.float64()), "props": ["{}"] * n,
    })


def test_common_chunks_can_be_planned_again_and_again(spark):
    words = ["aa"] * 100 + ["bbbbb"] * 100 + ["c"] * 50
    rows = [(0, " ".join(words), "bbbbb " * 100), (1, "a b\tc\n", None), (2, None, "x"), (3, "same text here", "same  text\x0bhere"), (4, "", "")]
    want = {0: " ".join(words[:100] + words[200:]), 1: "a b c", 2: "", 3: "", 4: ""}
    df = spark.createDataFrame(rows, "i long, a string, b string")
    for _ in range(8):
        got = X.without_common_chunks(df, "a", "b", "fresh").select("i", "fresh", F.length("fresh").alias("n")).collect()
        assert {r["i"]: (r["fresh"], r["n"]) for r in got} == {i: (t, len(t)) for i, t in want.items()}


def test_returns_after_a_price_of_zero_are_those_of_the_sql(spark, tmp_path):
    prices = [0.0, 1.0, 0.0, 2.0, 3.0, 0.0, 0.0, 4.0, 5.0, 6.0]
    got, want = checked(spark, "forward_return_by_day", tmp_path, events=events(40, lambda i: prices[i % 10]))
    assert repr(got) == repr(want) and "nan" in repr(got) and "inf" in repr(got)


def test_links_of_facts_whose_values_differ_when_worked_out_again(spark):
    value = F.udf(random.random, "double").asNondeterministic()
    rows = spark.range(20).select(F.col("id").cast("string").alias("ticker"), F.lit("2024-Q1").alias("quarter"), F.lit("m").alias("metric"), value().alias("value"), F.lit(None).cast("string").alias("reason"))
    _, edges = G.graph_tables(rows)
    out = G.optional_links(edges.select("fact").distinct(), edges, {"Ticker": "ticker", "Value": "value"}).collect()
    assert len(out) == 20 and all(r["ticker"] and r["value"] for r in out)


def brute_best(rows, asked, k, least):
    import numpy as np

    dot = lambda a, b: float(np.cumsum(np.array(a, float) * np.array(b, float))[-1])
    out = []
    for q, v in asked:
        found = [(-dot(u, v) / dot(u, u) ** 0.5 / dot(v, v) ** 0.5, i) for i, u in rows if u and len(u) == len(v) and None not in u and any(u)]
        out += [(q, i, round(-s, 9)) for s, i in sorted(found)[:k] if -s > least]
    return sorted(out)


def test_blocks_of_products_find_the_nearest_with_copies_ties_and_odd_vectors(spark, monkeypatch):
    from panelforge.operators import best_pairs as P

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(200)] + [(2000 + i, [2 * x for x in rows[8][1]]) for i in range(20)]  # copies, and the same direction
    rows += [(3000, None), (3001, []), (3002, [0.0] * 5), (3003, [1.0, 2.0]), (3004, [1.0, None, 1.0, 1.0, 1.0])]
    asked = [(i, v) for i, v in rows if i % 20 == 0 and v and any(v)]
    df = lambda r, name: spark.createDataFrame(r, f"{name} long, embedding array<double>")
    want = brute_best(rows, asked, 4, 0.3)
    for sizes in ((1 << 15, 1 << 13), (40, 7)):
        monkeypatch.setattr(P, "ROWS", sizes[0])
        monkeypatch.setattr(P, "QUERIES", sizes[1])
        got = G.nearest(df(rows, "vec_id"), df(asked, "query"), 4, 0.3)
        assert sorted((r["query"], r["vec_id"], round(r["score"], 9)) for r in got.collect()) == want
    text = G.nearest(df(rows, "vec_id"), df(asked, "query"), 4, 0.3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_an_index_search_without_condition_joins_no_pairs(spark):
    from panelforge.operators import vector_index as V

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query")
    centres = V.fitted_centres(vectors, 6)
    from panelforge.sources.scratch import shared_folder

    found = V.search(V.build(vectors, centres, shared_folder(spark)), centres, asked, 5, len(centres), -2.0)
    assert sorted((r["query"], r["vec_id"], round(r["score"], 9)) for r in found.collect()) == brute_best(rows, [(i, v) for i, v in rows if i % 20 == 0], 5, -2.0)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_range_scores_by_slices_of_time_match_the_sql_on_edges_flat_and_empty_windows(spark, tmp_path):
    from panelforge.operators import book

    rng = random.Random(5)
    value = lambda i: None if i % 11 == 0 else 0.1 if i % 90 < 30 else 1e6 + rng.random()
    for step in (datetime.timedelta(seconds=37), datetime.timedelta(minutes=30), datetime.timedelta(minutes=10), datetime.timedelta(0)):
        rng.seed(5)
        got, want = checked(spark, "range_zscore", tmp_path, events=events(240, value, step))
        assert got == want
    text = book.range_zscores(spark.range(3).select(F.lit("a").alias("ticker"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("x")), ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rangeframe, -" not in text.lower()  # no frame that slides: it would be gone through for every row


def test_sliding_counts_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    from panelforge.operators import ranks

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(60), rng.choice([7.0, 7.0, round(rng.random() * 20, 1)])) for _ in range(500)] + [("c", 1, 2.0), (None, 1, 1.0), ("a", None, 1.0), ("a", 3, None)]
    df = spark.createDataFrame(rows, "g string, t long, v double")
    full = [r for r in rows if None not in r]
    want = sorted({(g, t, v, sum(w < v for h, u, w in full if h == g and t - 9 <= u <= t), sum(1 for h, u, _ in full if h == g and t - 9 <= u <= t)) for g, t, v in full})
    for bits in (18, 5, 1):
        monkeypatch.setattr(ranks, "BLOCK_BITS", bits)
        got = ranks.sliding_below(df, "v", ["g"], "t", 9, 13)
        assert sorted((r["g"], r["t"], r["v"], r["below"], r["held"]) for r in got.collect()) == want
    assert ranks.sliding_below(df.filter("g = 'zz'"), "v", ["g"], "t", 9, 13).count() == 0


def test_frozen_ranges_are_looked_up_by_halving(spark):
    from panelforge.operators import frozen

    rng = random.Random(7)
    train = [("ab"[i % 2], round(rng.random() * 500, 1)) for i in range(3000)] + [("n", float("nan")), ("n", 1.0), ("a", None)]
    asked = [(g, v) for g in ("a", "b", "n", "none") for v in (-1.0, 0.0, 3.3, 250.0, 499.9, 1e9, float("nan"), None)]
    df = lambda rows: spark.createDataFrame(rows, "g string, v double")
    for each in (1, 40, 10_000):
        found = frozen.placed(df(asked), frozen.frozen_counts(df(train), "v", ["g"], each=each), "v", ["g"])
        order = lambda v: (v != v, v if v == v else 0)  # noqa: E731  NaN is above all
        own = {g: [order(v) for h, v in train if h == g and v is not None] for g in ("a", "b", "n")}
        want = {(g, repr(v)): (None, None, len(own[g]) if g in own else None) if v is None or g not in own else (sum(x < order(v) for x in own[g]), sum(x == order(v) for x in own[g]), len(own[g])) for g, v in asked}
        assert {(r["g"], repr(r["v"])): (r["below"], r["same"], r["total"]) for r in found.collect()} == want
    assert "filter(__lows" not in found._jdf.queryExecution().toString() and "filter(__values" not in found._jdf.queryExecution().toString()


def test_a_streamed_average_gives_out_frames_of_bounded_size(monkeypatch):
    import pandas as pd

    from panelforge.streaming import stream

    class State:
        exists, kept = True, None
        get = (2.0,)

        def update(self, kept):
            self.kept = kept

    monkeypatch.setattr(stream, "FRAME", 4)
    times = pd.to_datetime(["2024-01-02", "2024-01-01", "2024-01-01", "2024-01-03", "2024-01-01", "2024-01-05"])
    rows = pd.DataFrame({"k": "a", "t": times, "v": [1.0, None, 4.0, 8.0, 16.0, 0.5]})
    for tie in ([5, 3, 2, 1, 1, 0], ["e", "d", "c", "b", "a", None]):
        state = State()
        frames = list(stream._averaged("k", "t", "v", 0.5, "tie")(("a",), iter([rows.assign(tie=tie)[:4], rows.assign(tie=tie)[4:]]), state))
        assert [len(f) for f in frames] == [4, 2]
        got = pd.concat(frames)
        assert got["average"].tolist() == [9.0, 6.5, 6.5, 3.75, 5.875, 3.1875] and state.kept == (3.1875,)
        assert got["t"].tolist() == sorted(times) and got["k"].tolist() == ["a"] * 6
