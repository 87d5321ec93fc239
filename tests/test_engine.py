from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import text as X
from panelforge.operators import kernels, portfolio
from panelforge.operators.asof import as_of, as_of_by_slices
from panelforge.plans.expr import ExpressionError, compiled, distinct_factors, tree_hash, unique_names, validated


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame([(f"T{k}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float(np.round(rng.normal(10, 2), 1)) if rng.random() > 0.1 else None, float(rng.integers(1, 9))) for k in range(5) for i in range(60)], columns=["ticker", "ts", "x", "y"])
    return pdf, spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), "ticker string, ts timestamp, x double, y double")


def call(op, *args):
    return {"call": op, "args": list(args)}


def result(panel, tree):
    got = compiled(panel[1], {"v": tree}).toPandas().sort_values(["ticker", "ts"])["v"].to_numpy(float)
    return got, panel[0].sort_values(["ticker", "ts"])


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        (call("ts_mean", "x", 5), lambda g: g.x.rolling(5).mean()),
        (call("ts_std", "x", 5), lambda g: g.x.rolling(5).std()),
        (call("ts_median", "y", 4), lambda g: g.y.rolling(4).median()),
        (call("ts_pctile", "y", 6, 0.3), lambda g: g.y.rolling(6).quantile(0.3)),
        (call("ts_argmax", "y", 5), lambda g: g.y.rolling(5).apply(lambda a: len(a) - 1 - np.argmax(a), raw=True)),
        (call("ts_argmin", "y", 5), lambda g: g.y.rolling(5).apply(lambda a: len(a) - 1 - np.argmin(a), raw=True)),
        (call("corr_ts", "y", "x", 8), lambda g: g.y.rolling(8).corr(g.x)),
        (call("ema", "x", 3), lambda g: g.x.ewm(span=3, adjust=False).mean()),
        (call("wma", "y", 3), lambda g: g.y.rolling(3).apply(lambda a: np.dot(a, [1, 2, 3]) / 6, raw=True)),
        (call("ts_rank", "y", 5), lambda g: g.y.rolling(5).apply(lambda a: (a[:-1] < a[-1]).mean(), raw=True)),
        (call("fillna_ts", "x"), lambda g: g.x.ffill()),
    ],
)
def test_series_operators_agree_with_pandas(panel, tree, want):
    got, pdf = result(panel, tree)
    np.testing.assert_allclose(got, pdf.groupby("ticker", group_keys=False)[["x", "y"]].apply(want).to_numpy(float), rtol=1e-9, atol=1e-9)


def test_cross_section_rank_and_scale(panel):
    got, pdf = result(panel, call("cs_rank", "y"))
    np.testing.assert_allclose(got, pdf.groupby("ts").y.rank(pct=True).to_numpy())
    scaled, _ = result(panel, call("cs_rank", call("mul", "y", 7.0)))
    np.testing.assert_allclose(got, scaled)


@pytest.mark.parametrize("tree", [call("ts_mean", "x", 5), call("ts_zscore", call("diff", "x", 1), 5), call("ema", "y", 4), call("cs_zscore", call("ts_rank", "y", 5)), call("pct_change", "x", 2)])
def test_nothing_looks_ahead(panel, spark, tree):
    """Changing everything after a time leaves all values up to it as they were."""
    cut = pd.Timestamp("2024-01-02 06:00")
    pdf = panel[0].copy()
    pdf.loc[pdf.ts > cut, ["x", "y"]] += 10
    other = spark.createDataFrame(pdf.astype({"x": object}).where(pdf.notna(), None), panel[1].schema)
    a, b = (compiled(df, {"v": tree}).filter(F.col("ts") <= F.lit(cut)).toPandas().sort_values(["ticker", "ts"])["v"].to_numpy(float) for df in (panel[1], other))
    np.testing.assert_allclose(a, b)


def test_expressions_are_checked():
    for bad in (call("nope", "x"), call("ts_mean", "x"), call("ts_mean", "x", 301), call("delay", "x", -1), call("pow", "x", 9), "z", {"call": "add", "args": ["x", "y"], "kwargs": {"a": 1}}, call("ts_mean", "x", "y")):
        with pytest.raises(ExpressionError):
            validated(bad, {"x", "y"})


def test_equal_trees_share_a_hash():
    assert tree_hash(call("adv", "x", 5)) == tree_hash({"call": "ts_mean", "args": [{"symbol": "x"}, {"const": 5}]})
    assert list(distinct_factors({"a": call("adv", "x", 5), "b": call("ts_mean", "x", 5), "c": "x"})) == ["a", "c"]
    assert unique_names(["My Factor", "my-factor", "?"]) == ["my_factor", "my_factor__v2", "factor"]


def test_text_columns(spark):
    df = spark.createDataFrame([("Acme (ACM) Q1", "NYSE: XYZ reports", "score: 11 Direction: 7", "2024-07-01 12:00:00 GMT", "a\n```json\n{\"ticker\":\"A\",\"date\":\"d\",\"scores\":[1,2]}\n```"), (None, "ACME Inc. announces", "nothing", "N/A", "no json")], "title string, body string, note string, ts string, reply string")
    a, b = X.ticker(F.col("title"), F.col("body"))
    r = df.select(a.alias("t"), b.alias("w"), X.directional_score(F.col("note")).alias("s"), X.to_eastern(F.col("ts")).cast("string").alias("e"), X.scored_reply(F.col("reply"), 2).alias("j"), F.size(X.numbered_scores(F.lit("1. 12\n2. 3"))).alias("n")).collect()
    assert [r[0].t, r[0].w, r[0].s, r[0].e, r[0].j.scores, r[0].n] == ["ACM", "title", 7, "2024-07-01 08:00:00", [1.0, 2.0], 50]
    assert [r[1].t, r[1].w, r[1].s, r[1].e, r[1].j] == ["ACME", "transcript", None, None, None]


def test_optimisers():
    rng = np.random.default_rng(0)
    alpha, variance = rng.normal(size=12), rng.uniform(0.5, 2, 12)
    w = portfolio.constrained_weights(alpha, variance, budget=0.1)
    assert abs(w.sum()) < 1e-8 and np.abs(w).sum() <= 2 + 1e-6 and (variance * w * w).sum() ** 0.5 <= 0.1 + 1e-6
    nu = (alpha / variance).sum() / (1 / variance).sum()
    best = (alpha - nu) / variance
    best *= 0.1 / np.sqrt((variance * best * best).sum())
    assert alpha @ w >= 0.99999 * (alpha @ best)
    for _ in range(20):
        n = int(rng.integers(2, 6))
        b = rng.normal(size=(n, n))
        c, al = b @ b.T + 0.05 * np.eye(n), rng.normal(size=n)
        budget, penalty, gross, box = [(0.5, 0.0, 1.0, 0.4), (None, 0.3, 1.0, 1.0), (None, 0.1, 1.0, 0.3)][int(rng.integers(3))]
        w = portfolio.constrained_weights(al, c, budget, penalty, gross, box)
        risk = lambda x, c=c: np.sqrt(np.maximum(np.einsum("...i,ij,...j", x, c, x), 0))
        assert abs(w.sum()) < 1e-7 and np.abs(w).sum() <= gross + 1e-7 and np.abs(w).max() <= box + 1e-7 and (budget is None or risk(w) <= budget + 1e-7)
        x = rng.normal(size=(20000, n))
        x = np.concatenate([x - x.mean(axis=1, keepdims=True), w + 0.02 * (x - x.mean(axis=1, keepdims=True))])
        fit = np.maximum(np.abs(x).sum(axis=1) / gross, np.abs(x).max(axis=1) / box)
        fit = fit if budget is None else np.maximum(fit, risk(x) / budget)
        x = np.concatenate([x / fit[:, None], x / np.maximum(fit, 1)[:, None]])
        assert al @ w - penalty * risk(w) >= (x @ al - penalty * risk(x)).max() - 2e-4
    assert not portfolio.constrained_weights(al, -c).any()
    a = rng.normal(size=(6, 6))
    assert np.linalg.eigvalsh(portfolio.nearest_psd(a)).min() >= -1e-9
    v, f, d = portfolio.factor_model(a @ a.T, 6)
    np.testing.assert_allclose((v * f) @ v.T + np.diag(d), a @ a.T, atol=1e-6)


def test_neutralised_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"ticker": [f"T{i}" for i in range(20)], "ts": 1, "f": rng.normal(size=20), "a": rng.normal(size=20), "b": rng.normal(size=20), "c": rng.normal(size=20)})
    out = kernels.neutralized(spark.createDataFrame(pdf), "f", ["a", "b", "c"], "r").toPandas()
    assert np.abs(out[["a", "b", "c"]].T @ out["r"]).max() < 1e-9


def test_leaks_are_caught(panel):
    from panelforge.plans import flows

    df = panel[1].filter("x is not null").select("ticker", "ts", "y", "x")
    times = [pd.Timestamp("2024-01-01 20:00"), pd.Timestamp("2024-01-02 10:00")]
    assert flows.leaks(df, call("ts_mean", "x", 3), ["x", "y"], times).isEmpty()
    kept = flows.without_leaks(df, {"mean": call("ts_mean", "y", 3)}, ["x", "y"], times)
    assert list(kept) == ["mean"]
    # A factor that holds the next row's value is caught wherever there is a next row.
    from panelforge.functions.panel import KEYS

    peeking = lambda d, new: d.withColumn(new, F.lead("y", 1).over(KEYS.series()))
    caught = flows.leaks(df, peeking, ["x", "y"], times, tolerance=0.0)
    assert caught.count() == peeking(df, "z").filter(F.col("ts").isin(times) & F.col("z").isNotNull()).count() > 0
    assert list(flows.without_leaks(df, {"mean": call("ts_mean", "y", 3), "peek": peeking}, ["x", "y"], times)) == ["mean"]


def test_report_counts_equal_factors_once(panel):
    from panelforge.operators import bars
    from panelforge.plans import flows

    df = bars.forward_return(panel[1].na.fill(10.0, ["x"]), "x", 1)
    r = {x["factor"]: x for x in flows.factor_report(df, {"a": call("cs_rank", "y"), "b": call("cs_rank", "y"), "c": call("neg", "y")}, "r", 52).collect()}
    assert set(r) == {"a", "c"} and r["a"]["mean_ic"] * r["c"]["mean_ic"] < 0
    one = flows.combined(panel[1], ["x", "y"], n=10, least=5).select("alpha").toPandas()["alpha"]
    assert one.notna().all() and one.abs().max() < 4


def test_text_udfs(spark):
    df = spark.createDataFrame([('{a: 1, "b": [1, 2,', "aaa bbb ccc ddd"), ("nope", None)], "j string, t string")
    got = df.select(X.repaired_json("j").alias("j"), X.char_chunks("t", F.lit(7)).alias("c"), X.compatible_text(F.lit("ﬁ​x")).alias("n"), X.first_words(F.lit("a  b c"), 2).alias("w")).collect()
    assert [got[0].j, got[0].c, got[0].n, got[0].w, got[1].j, got[1].c] == ['{"a": 1, "b": [1, 2]}', ["aaa bbb", "ccc ddd"], "fix", "a b", None, None]


def test_streams_agree_with_tables(spark, tmp_path):
    from panelforge.streaming import stream as R

    pdf = pd.DataFrame({"k": ["a", "b"] * 50, "ts": pd.date_range("2024-01-01", periods=100, freq="7min"), "v": np.arange(100.0)})
    spark.createDataFrame(pdf).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = R.read_events(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    for _ in range(2):  # the second run has nothing left to do
        R.into_table(R.streaming_average(rows, "k", "ts", "v", 0.5), f"{tmp_path}/out", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values("ts")["average"].to_numpy()
    np.testing.assert_allclose(got, pdf.groupby("k")["v"].transform(lambda v: v.ewm(alpha=0.5, adjust=False).mean()).to_numpy())


def test_sources_and_logs(spark, tmp_path):
    from panelforge.sources import io

    for name in ("AAA", "BBB"):
        (tmp_path / "bars").mkdir(exist_ok=True)
        (tmp_path / "bars" / f"{name}.csv").write_text("ts,open,high,low,close,volume\n2024-01-01 09:30:00,1,2,0.5,1.5,10\n2024-01-01 09:31:00,1,2,0.5,oops,10\n")
    got = io.read_series_files(spark, f"{tmp_path}/bars/*.csv").collect()
    assert sorted({r["ticker"] for r in got}) == ["AAA", "BBB"] and sum(r["close"] is None for r in got) == 2
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, s string")
    io.append_log(log, f"{tmp_path}/log")
    io.append_log(log.limit(0), f"{tmp_path}/log")
    assert {(r["k"], r["s"]) for r in io.upserted(spark.read.parquet(f"{tmp_path}/log"), ["k"], "v").collect()} == {("a", "y"), ("b", "z")}


def test_penalised_weights_are_feasible():
    rng = np.random.default_rng(2)
    n = 30
    alpha, loadings = rng.normal(size=n) * 0.1, rng.normal(size=(n, 3))
    neutral = rng.normal(size=(2, n))
    w = portfolio.penalised_weights(alpha, loadings, np.array([0.2, 0.1, 0.05]), rng.uniform(0.01, 0.1, n), neutral=neutral, penalty=0.1)
    assert np.abs(w).max() <= 0.01 + 1e-6 and abs(w.sum()) < 1e-6 and np.abs(neutral @ w).max() < 1e-6 and np.abs(w).sum() <= 1 + 1e-6
    assert alpha @ w > 0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 40_000_000])
def test_as_of_by_slices_is_as_of_whatever_the_width(spark, strict, tolerance):
    rng = np.random.default_rng(3)
    at = lambda n: [(pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(s))).to_pydatetime() for s in rng.integers(0, 300, n)]
    key = lambda n: [["hot", "hot", "a", "b"][int(k)] for k in rng.integers(0, 4, n)]
    left = spark.createDataFrame([*zip(range(200), key(200), at(200), strict=True), (200, "hot", None), (201, "none", at(1)[0]), (200, "hot", None)], "id long, k string, t timestamp")
    right = spark.createDataFrame([*zip(key(90), at(90), range(90), strict=True), ("hot", None, 99), ("a", at(1)[0], None)], "k string, u timestamp, v long")
    want = sorted(map(tuple, as_of(left, right, "k", "t", "u", ["v"], strict=strict, tolerance=tolerance, tie=["v"]).collect()), key=repr)
    for width in (1, 7_000_000, 100_000_000, 10**15):
        got = as_of_by_slices(left, right, "k", "t", "u", ["v"], width, strict, tolerance, ["v"])
        assert sorted(map(tuple, got.collect()), key=repr) == want
    nulls = spark.createDataFrame([(1, None, at(1)[0])], "id long, k string, t timestamp")
    assert as_of_by_slices(nulls, right.union(spark.createDataFrame([(None, at(1)[0], 5)], right.schema)), "k", "t", "u", ["v"], 10**9).first()["v"] is None
    assert as_of_by_slices(left, right.limit(0), "k", "t", "u", ["v"], 10**9).filter("v is not null").count() == 0
    assert as_of_by_slices(left.limit(0), right, "k", "t", "u", ["v"], 10**9).count() == 0


def test_firm_rank_counts_in_slices_as_lists_of_the_window_do(spark):
    """Against the values of every window, with ties, repeated rows, nulls and one firm that has most of the rows."""
    from panelforge.operators.signals import firm_rank

    rng = np.random.default_rng(7)
    day = datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.8 else f"f{rng.integers(3)}", day + timedelta(days=int(rng.integers(400))), float(rng.integers(60))) for _ in range(700)]
    rows += rows[:20] + [("hot", day, None), (None, day, 3.0), ("hot", None, 3.0), ("alone", day, 1.0)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, firm string, ts timestamp, x double")
    got = {r["id"]: r["rank"] for r in firm_rank(df, "firm", "ts", "x", 90).collect()}

    def want(firm, ts, x):
        if firm is None or ts is None or x is None:
            return None
        held = [v for _, f, t, v in rows if f == firm and t is not None and v is not None and ts - timedelta(days=90) <= t <= ts]
        return sum(v < x for v in held) / len(held) if len(held) >= 2 else None

    assert got == {i: want(f, t, x) for i, f, t, x in rows}
    assert firm_rank(df.limit(0), "firm", "ts", "x", 90).count() == 0


@pytest.mark.parametrize(("length", "stride"), [(5, 5), (7, 3), (2, 4), (1, 1)])
def test_windows_from_blocks_are_those_of_the_rows(panel, length, stride):
    from panelforge.operators.book import windows

    got = {(r["ticker"], r["ts"]): ([list(x) for x in r["window"]], r["label"]) for r in windows(panel[1], ["x", "y"], "y", length, stride).collect()}
    want = {}
    for name, g in panel[0].groupby("ticker"):
        g = g.sort_values("ts")
        for end in range(length, len(g) + 1, stride):
            w = g.iloc[end - length : end]
            if w[["x", "y"]].notna().all().all():
                want[name, w.ts.iloc[-1].to_pydatetime()] = (w[["x", "y"]].to_numpy().tolist(), w.y.iloc[-1])
    assert got == want and want


def test_smoothing_without_gathered_series(spark):
    from panelforge.functions.panel import Keys
    from panelforge.operators.signals import smoothed

    rows = [("a", 1, 2, 3.0), ("a", 1, 1, 5.0), ("a", 2, 0, None), ("a", 9, 0, 1.0), ("b", 4, 0, 2.0), ("c", 1, 0, None)]
    df = spark.createDataFrame(rows, "k string, t int, i int, x double")
    got = {r["k"]: r["s"] for r in smoothed(df, "x", 0.3, "s", ["i"], Keys("k", "t")).collect()}
    assert got == pytest.approx({"a": 0.3 * 1 + 0.7 * (0.3 * 3 + 0.7 * 5), "b": 2.0})
