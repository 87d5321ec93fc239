"""More queries next to their SQL: sources and sinks, single functions over whole tables, and the rarer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import text as X
from panelforge.operators import asof as A
from panelforge.operators import bars as B
from panelforge.operators import book as O
from panelforge.operators import evaluate as E
from panelforge.operators import facts as G
from panelforge.operators import labels as L
from panelforge.operators import portfolio as P
from panelforge.operators import signals as S
from panelforge.plans import flows
from panelforge.plans.catalogue import (
    BARS_SQL, BINS_SQL, CALLS_SQL, CROSS, DAY, EVENTS_SQL, EWMA_SQL, FACTS_SQL, GAUSS, LAGGED_SQL, PANEL_SQL, PNL_SQL, SERIES,
    call, compiled, events, factor_panel, facts, frame, query, r6, stamp, table, weekly_bars,
)
from panelforge.plans.catalogue import MOMENTUM, REPORTED, QUERIES, ORACLES  # noqa: F401
from panelforge.sources import io
from panelforge.sources.scratch import shared_folder
from panelforge.streaming import stream as T

# ---- sources and sinks: each table goes out in one form and comes back ------------------------


@query("csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, sf_dir):
    path = shared_folder(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.csv(path, header=True)
    return io.read_csv(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING")


@query("csv_columns", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def csv_columns(spark, sf_dir):
    """Two columns of a wider CSV: the scan parses no others."""
    path = shared_folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").write.csv(path, header=True)
    rows = io.read_csv(spark, path, "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderpriority STRING")
    return rows.groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("csv_series_files", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, close, volume FROM bars")
def csv_series_files(spark, sf_dir):
    """One folder of files for each ticker, the ticker read from the path."""
    path = shared_folder(spark)
    weekly_bars(spark, sf_dir).select("ticker", F.expr(DAY), "close", "volume").write.partitionBy("ticker").csv(path, header=True)
    rows = io.read_series_files(spark, f"{path}/*/*.csv", "ts STRING, close DOUBLE, volume DOUBLE", "file")
    return rows.select(F.url_decode(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"ticker=([^/]+)/", 1))).alias("ticker"), "ts", "close", "volume")


@query("parquet_partitions", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def parquet_partitions(spark, sf_dir):
    path = shared_folder(spark)
    io.write_partitioned(table(spark, sf_dir, "events"), path, ["event_type"])
    return io.read_parquet(spark, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("matrix_files", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, close AS value FROM bars")
def matrix_files(spark, sf_dir):
    """A wide matrix written as CSV and read back in long form."""
    path, bars = shared_folder(spark), weekly_bars(spark, sf_dir).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close")
    names = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    io.write_matrix(bars, path, "ts", "ticker", "close", names)
    return io.read_matrix(spark, path, "ts", names).select("ticker", F.to_date("ts").cast("string").alias("ts"), "value")


@query("matrix_long_form", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, close FROM bars")
def matrix_long_form(spark, sf_dir):
    names = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    return B.from_matrix(B.to_matrix(weekly_bars(spark, sf_dir), "close", names), "close").select("ticker", F.expr(DAY), "close")


@query("json_scan", "SELECT event_id, event_type, value FROM events")
def json_scan(spark, sf_dir):
    path = shared_folder(spark)
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(path)
    return io.read_json(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE", multiline=False)


@query("text_scan", "SELECT r_regionkey, r_name AS text FROM region")
def text_scan(spark, sf_dir):
    path = shared_folder(spark)
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    rows = io.read_texts(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("path", r"r_regionkey=(\d+)/", 1).cast("int").alias("r_regionkey"), F.trim(F.regexp_replace("text", r"\n$", "")).alias("text"))


@query("binary_scan", "SELECT r_regionkey, length(r_name) + 1 AS bytes FROM region")
def binary_scan(spark, sf_dir):
    path = shared_folder(spark)
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    rows = io.read_binary(spark, f"{path}/*/*.txt")
    return rows.select(F.regexp_extract("path", r"r_regionkey=(\d+)/", 1).cast("int").alias("r_regionkey"), F.col("length").alias("bytes"))


@query("append_log", "SELECT o_orderpriority AS k, max(o_orderkey) AS version, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def append_log(spark, sf_dir):
    """Two appends to a log, then its latest row for each key."""
    path, rows = shared_folder(spark), table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    io.append_log(rows.filter("version % 2 = 0"), path)
    io.append_log(rows.filter("version % 2 <> 0"), path)
    return io.upserted(io.read_parquet(spark, path), ["k"], "version")


@query("top_names_of_log", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS name FROM customer ORDER BY c_custkey LIMIT 20")
def top_names_of_log(spark, sf_dir):
    path = shared_folder(spark)
    lines = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.concat(F.col("c_custkey").cast("string"), F.lit("_stitched.csv "), F.col("c_acctbal").cast("string")).alias("value"))
    lines.coalesce(1).write.text(path)
    return io.top_names(spark, path, 20)


# ---- joins, samples, alignment --------------------------------------------------------------------


@query("rounded_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON CAST(round(c_acctbal / 10) AS BIGINT) = CAST(round(s_acctbal / 10) AS BIGINT)")
def rounded_join(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return A.rounded_join(c, s, "c_acctbal", "s_acctbal", -1).select("c_custkey", "s_suppkey")


@query("sampled_names", BARS_SQL + "SELECT ticker FROM (SELECT DISTINCT ticker FROM bars) ORDER BY md5(ticker || '#42') LIMIT 10")
def sampled_names(spark, sf_dir):
    return B.sampled_names(weekly_bars(spark, sf_dir), 10, 42)


@query("union_distinct", "SELECT user_id FROM events WHERE event_type = 'signup' UNION SELECT user_id FROM events WHERE value > 400")
def union_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'signup'").select("user_id").union(e.filter("value > 400").select("user_id")).distinct()


@query("lagged_alignment", BINS_SQL + f", w AS (SELECT x.ticker, x.bin, least(greatest(y.price / x.price - 1, -0.5), 0.5) AS r FROM b x JOIN b y ON x.ticker = y.ticker AND y.bin = x.bin + INTERVAL 30 MINUTES), l AS ({LAGGED_SQL.format(1)} UNION ALL {LAGGED_SQL.format(3)} UNION ALL {LAGGED_SQL.format(5)}) SELECT lag, l.ticker, strftime(l.bin, '%Y-%m-%d %H:%M:%S') AS bin, f, round(r + 1e-8, 6) + 0.0 AS r FROM l JOIN w ON l.ticker = w.ticker AND l.bin = w.bin")
def lagged_alignment(spark, sf_dir):
    """Factors at several lags next to the forward returns of their bins."""
    e = events(spark, sf_dir)
    returns = B.bin_forward_return(B.time_bins(e, 30, "price", ["event_id"]), 30).filter("forward_return is not null").select("ticker", "bin", "forward_return")
    lagged = B.lagged_factors(e.withColumn("f", F.col("price")), "f", 30, [1, 3, 5], ["event_id"])
    return B.aligned(lagged, returns).select("lag", "ticker", stamp("bin").alias("bin"), "f", r6("forward_return").alias("r"))


@query("lag_sharpe_of_bins", BINS_SQL + f", w AS (SELECT x.ticker, x.bin, least(greatest(y.price / x.price - 1, -0.5), 0.5) AS r FROM b x JOIN b y ON x.ticker = y.ticker AND y.bin = x.bin + INTERVAL 30 MINUTES), l AS ({LAGGED_SQL.format(1)} UNION ALL {LAGGED_SQL.format(3)}), d AS (SELECT lag, l.bin, sum(f * r) AS pnl FROM l JOIN w ON l.ticker = w.ticker AND l.bin = w.bin GROUP BY ALL) SELECT lag, count(pnl) AS n, round(avg(pnl) / stddev_samp(pnl) * sqrt(3276.0) + 1e-8, 5) + 0.0 AS sharpe FROM d GROUP BY lag")
def lag_sharpe_of_bins(spark, sf_dir):
    """Sharpe by minute lag: factors resampled at each lag, dotted with the returns of their bins."""
    e = events(spark, sf_dir)
    returns = B.bin_forward_return(B.time_bins(e, 30, "price", ["event_id"]), 30).filter("forward_return is not null").select("ticker", "bin", "forward_return")
    both = B.aligned(B.lagged_factors(e.withColumn("f", F.col("price")), "f", 30, [1, 3], ["event_id"]), returns)
    dots = both.groupBy("lag", "bin").agg(F.sum(F.col("f") * F.col("forward_return")).alias("pnl"))
    return E.sharpe(dots, "pnl", 3276, ["lag"]).select("lag", "n", (F.round(F.col("sharpe") + 1e-8, 5) + F.lit(0.0)).alias("sharpe"))


@query("features_and_targets", BARS_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, close AS feature, lead(close, 1) OVER {SERIES} / close - 1 AS target FROM bars QUALIFY target IS NOT NULL")
def features_and_targets(spark, sf_dir):
    rows = B.forward_return(weekly_bars(spark, sf_dir), "close", 1, "target")
    return rows.filter("target is not null").select("ticker", F.expr(DAY), F.col("close").alias("feature"), "target")


# ---- evaluation and flows ----------------------------------------------------------------------------


@query("year_length", BARS_SQL + "SELECT count(DISTINCT ts) AS periods, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last FROM bars WHERE year(ts) = 1996")
def year_length(spark, sf_dir):
    return E.periods_in_year(weekly_bars(spark, sf_dir), 1996).select("periods", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


REPORT_SQL = PANEL_SQL.replace("panel AS (", "flagship AS (", 1).replace("FROM panel WHERE f IS NOT NULL", "FROM flagship WHERE f IS NOT NULL") + f""", ranked AS (SELECT ticker, ts, (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(*) OVER {CROSS} AS level FROM bars),
panel AS (SELECT 'momentum' AS factor, ticker, ts, f, r FROM flagship
  UNION ALL SELECT 'level', ticker, ts, level, r FROM ranked JOIN flagship USING (ticker, ts)
  UNION ALL SELECT 'reversal', ticker, ts, -z, r FROM z JOIN flagship USING (ticker, ts)),
each_ic AS (SELECT factor, ts, CASE WHEN count(*) > 2 AND NOT isnan(corr(f, r)) THEN corr(f, r) END AS x FROM panel WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY ALL),
dev AS (SELECT factor, ts, x, x - avg(x) OVER (PARTITION BY factor) AS e FROM each_ic WHERE x IS NOT NULL),
lags AS (SELECT *, {", ".join(f"lag(e, {k}) OVER (PARTITION BY factor ORDER BY ts) AS e{k}" for k in range(1, 6))} FROM dev),
hac AS (SELECT factor, count(*) AS n, avg(x) AS mean_ic, sum(e * e) + 2 * ({" + ".join(f"(1 - {k} / 6.0) * coalesce(sum(e * e{k}), 0)" for k in range(1, 6))}) AS v FROM lags GROUP BY factor),
m AS (SELECT *, avg(f) OVER w AS mean, stddev_samp(f) OVER w AS sd FROM panel WHERE f IS NOT NULL WINDOW w AS (PARTITION BY factor, ts)),
c AS (SELECT factor, ts, r, CASE WHEN sd > 1e-6 THEN least(greatest((f - mean) / sd, -3), 3) END AS s FROM m),
d AS (SELECT *, s - avg(s) OVER (PARTITION BY factor, ts) AS w FROM c WHERE s IS NOT NULL AND r IS NOT NULL),
pnl AS (SELECT factor, ts, CASE WHEN count(*) >= 10 THEN sum(w * r) / nullif(sum(abs(w)), 0) END AS pnl FROM d GROUP BY ALL),
shaped AS (SELECT factor, count(p) AS times, avg(p) / stddev_samp(p) * sqrt(52.0) AS sharpe FROM (SELECT factor, CASE WHEN abs(pnl) <= 0.5 THEN pnl END AS p FROM pnl) GROUP BY factor),
report AS (SELECT factor, times, mean_ic, mean_ic / (sqrt(v) / n) AS t_stat, sharpe FROM shaped JOIN hac USING (factor))
"""


def _report(spark, sf_dir):
    return flows.factor_report(B.forward_return(weekly_bars(spark, sf_dir), "close", 1), REPORTED, "r", 52)


@query("factor_report", REPORT_SQL + "SELECT factor, times, " + ", ".join(f"round({c} + 1e-8, 5) + 0.0 AS {c}" for c in ("mean_ic", "t_stat", "sharpe")) + " FROM report")
def factor_report(spark, sf_dir):
    return _report(spark, sf_dir).select("factor", "times", *[(F.round(F.col(c) + 1e-8, 5) + F.lit(0.0)).alias(c) for c in ("mean_ic", "t_stat", "sharpe")])


@query("best_factors", REPORT_SQL + "SELECT factor, round(sharpe + 1e-8, 5) + 0.0 AS sharpe FROM report ORDER BY report.sharpe DESC LIMIT 2")
def best_factors(spark, sf_dir):
    return flows.best_factors(_report(spark, sf_dir), "sharpe", 2).select("factor", (F.round(F.col("sharpe") + 1e-8, 5) + F.lit(0.0)).alias("sharpe"))


@query("significance", REPORT_SQL + "SELECT count(*) AS factors, count(*) FILTER (abs(t_stat) > 1.96) AS at_5, count(*) FILTER (abs(t_stat) > 2.576) AS at_1 FROM report")
def significance(spark, sf_dir):
    return flows.significance(_report(spark, sf_dir))


#: Gaussian ranks, variances of the rows before, long-short weights of yesterday, times the return.
BACKTEST_SQL = PANEL_SQL + EWMA_SQL + f""", va AS (SELECT ticker, ts, greatest(CASE WHEN len(list_filter(x, lambda v: v IS NOT NULL)) > 1 THEN var * 52 END, 1e-10) AS v FROM q),
rk AS (SELECT ticker, ts, 2 * rank() OVER (PARTITION BY ts ORDER BY f) + count(*) OVER (PARTITION BY ts, f) - 1 AS k, count(*) OVER {CROSS} AS n FROM panel WHERE f IS NOT NULL),
ga AS (SELECT ticker, ts, CASE WHEN rk.n <= 1 THEN 0 ELSE g.z END AS alpha FROM rk LEFT JOIN {GAUSS} ON rk.n = g.n AND rk.k = g.k),
al AS (SELECT panel.ticker, panel.ts, panel.r, ga.alpha, lag(va.v) OVER (PARTITION BY panel.ticker ORDER BY panel.ts) AS v FROM panel JOIN va USING (ticker, ts) LEFT JOIN ga USING (ticker, ts)),
ok AS (SELECT *, CASE WHEN alpha IS NOT NULL AND v > 0 THEN v END AS vv FROM al WHERE v IS NOT NULL),
dd AS (SELECT *, (alpha - sum(alpha / vv) OVER {CROSS} / nullif(sum(1 / vv) OVER {CROSS}, 0)) / vv AS d FROM ok),
we AS (SELECT *, coalesce(d * least(0.1 / nullif(sqrt(sum(d * d * vv) OVER {CROSS}), 0), 2.0 / nullif(sum(abs(d)) OVER {CROSS}, 0), 1.0 / nullif(max(abs(d)) OVER {CROSS}, 0)), 0) AS w FROM dd)
"""


@query("backtest", BACKTEST_SQL + f", pl AS (SELECT ts, lag(w, 1) OVER {SERIES} * r AS p FROM we) SELECT CAST(ts AS VARCHAR) AS ts, round(sum(p) + 1e-8, 6) + 0.0 AS pnl FROM pl GROUP BY ts")
def backtest(spark, sf_dir):
    return flows.backtest(factor_panel(spark, sf_dir), "f", "r", 1, 16.0, 52).select(F.expr(DAY), r6("pnl").alias("pnl"))


@query("sweep", " UNION ALL ".join(f"SELECT * FROM ({BACKTEST_SQL.replace('/ 16.0', f'/ {h}.0')}, pl AS (SELECT ts, lag(w, {k}) OVER {SERIES} * r AS p FROM we), fin AS (SELECT ts, sum(p) AS p FROM pl GROUP BY ts) SELECT {h}.0::DOUBLE AS half_life, {k} AS lag, round(avg(p) / stddev_samp(p) * sqrt(52.0) + 1e-8, 5) + 0.0 AS sharpe FROM fin)" for h in (8, 16) for k in (1, 2)))
def sweep(spark, sf_dir):
    out = flows.sweep(factor_panel(spark, sf_dir), "f", "r", [8.0, 16.0], [1, 2], 52)
    return out.select("half_life", "lag", (F.round(F.col("sharpe") + 1e-8, 5) + F.lit(0.0)).alias("sharpe"))


@query("smoothed_alpha", PANEL_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(list_reduce(list(f) FILTER (f IS NOT NULL) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: a * (1 - pow(2, -1 / 8.0)) + b * pow(2, -1 / 8.0)) + 1e-8, 6) + 0.0 AS alpha FROM panel WHERE f IS NOT NULL")
def smoothed_alpha(spark, sf_dir):
    panel = factor_panel(spark, sf_dir).filter("f is not null")
    return P.smoothed_alpha(panel, "f", 8.0, "alpha").select("ticker", F.expr(DAY), r6("alpha").alias("alpha"))


@query("loose_zscore", BARS_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(coalesce(CASE WHEN count(close) OVER {frame(20)} >= 5 THEN (close - avg(close) OVER {frame(20)}) / nullif(stddev_samp(close) OVER {frame(20)}, 0) END, 0) + 1e-8, 6) + 0.0 AS z FROM bars")
def loose_zscore(spark, sf_dir):
    return weekly_bars(spark, sf_dir).select("ticker", F.expr(DAY), r6(flows.loose_zscore(F.col("close"), 20, 5)).alias("z"))


@query("filled_values", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, coalesce(gap, 0) AS gap FROM bars")
def filled_values(spark, sf_dir):
    return weekly_bars(spark, sf_dir).select("ticker", F.expr(DAY), flows.filled(F.col("gap")).alias("gap"))


@query("combined_factors", BARS_SQL + f", y AS (SELECT ticker, ts, {' , '.join(f'coalesce(CASE WHEN count({c}) OVER {frame(20)} >= 5 THEN ({c} - avg({c}) OVER {frame(20)}) / nullif(stddev_samp({c}) OVER {frame(20)}, 0) END, 0) AS {c}' for c in ('close', 'volume'))} FROM bars), k AS (SELECT ticker, ts, (close + volume) / 2 AS c FROM y) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(coalesce(CASE WHEN count(c) OVER {frame(20)} >= 5 THEN (c - avg(c) OVER {frame(20)}) / nullif(stddev_samp(c) OVER {frame(20)}, 0) END, 0) + 1e-8, 5) + 0.0 AS alpha FROM k")
def combined_factors(spark, sf_dir):
    out = flows.combined(weekly_bars(spark, sf_dir), ["close", "volume"], n=20, least=5)
    return out.select("ticker", F.expr(DAY), (F.round(F.col("alpha") + 1e-8, 5) + F.lit(0.0)).alias("alpha"))


@query("streamed_errors", PANEL_SQL + ", y AS (SELECT r AS t, f AS p FROM panel WHERE f IS NOT NULL AND r IS NOT NULL) SELECT count(*) AS n, round(avg((p - t) * (p - t)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae, round(avg(CAST((t > 0) = (p > 0) AS DOUBLE)), 6) AS sign_accuracy, round((avg(CAST(p > 0 AS DOUBLE)) FILTER (t > 0) + avg(CAST(NOT p > 0 AS DOUBLE)) FILTER (NOT t > 0)) / 2, 6) AS balanced_accuracy FROM y")
def streamed_errors(spark, sf_dir):
    """The last running row of a stream over the panel, which is fed in two goes with a restart between them."""
    base = shared_folder(spark)
    scored = factor_panel(spark, sf_dir).filter("f is not null and r is not null").select("ticker", "r", "f")
    for half in (0, 1):
        scored.filter(F.pmod(F.xxhash64("ticker"), F.lit(2)) == half).repartition(2).write.mode("append").parquet(f"{base}/feed")
        T.errors_by_batch(T.read_events(spark, f"{base}/feed", scored.schema, 1), "r", "f", f"{base}/out", f"{base}/state")
    rows = spark.read.parquet(f"{base}/out")
    last = rows.orderBy(F.col("batch").desc()).limit(1)
    return last.select("n", *[F.round(c, 6).alias(c) for c in ("mse", "mae", "sign_accuracy", "balanced_accuracy")])


@query("normalised_forward_return", BARS_SQL + """, c AS (SELECT event_id, 'Brand#' || (user_id % 25 + 1) AS ticker, DATE '1995-01-01' + CAST(event_id % 2500 AS INTEGER) AS at FROM events WHERE event_type = 'signup'),
dt AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM bars)), g AS (SELECT n.ticker, dt.ts, dt.k, b.close FROM (SELECT DISTINCT ticker FROM bars) n CROSS JOIN dt LEFT JOIN bars b ON b.ticker = n.ticker AND b.ts = dt.ts),
h AS (SELECT *, lag(close) OVER w AS p0, lead(close) OVER w AS p1, close / lag(close) OVER w - 1 AS ret FROM g WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
s AS (SELECT *, CASE WHEN k >= 21 AND count(ret) OVER w >= 5 THEN nullif(stddev_samp(ret) OVER w, 0) END AS sd FROM h WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT c.event_id, c.ticker, (SELECT min(k) FROM dt WHERE dt.ts >= c.at) AS k FROM c)
SELECT event_id, CASE WHEN (SELECT max(k) FROM dt) - s.k >= 5 THEN round(coalesce((p1 - p0) / p0 / sd, (p1 - p0) / p0) + 1e-8, 6) + 0.0 END AS r FROM f LEFT JOIN s ON f.ticker = s.ticker AND f.k = s.k""")
def normalised_forward_return(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    calls = e.select("event_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("ticker"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 2500).cast("int")).cast("timestamp").alias("at"))
    bars = weekly_bars(spark, sf_dir).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close")
    return S.normalised_forward_return(bars, calls, "event_id", "at", "close", 5, 21).select("event_id", r6("r").alias("r"))


@query("leaking_factor", BARS_SQL + f", n AS (SELECT *, lead(ts) OVER {SERIES} AS after FROM bars) SELECT test, count(*) AS names FROM n JOIN (VALUES (0, DATE '1996-01-01'), (1, DATE '1997-06-02'), (2, DATE '1999-03-01')) v(test, day) ON n.ts = v.day WHERE after IS NOT NULL GROUP BY test")
def leaking_factor(spark, sf_dir):
    """A factor that peeks at the next close: every name with a later row is caught at every test time."""
    import datetime

    peeking = lambda df, new: df.withColumn(new, F.lead("close").over(B.KEYS.series()))
    times = [datetime.date(1996, 1, 1), datetime.date(1997, 6, 2), datetime.date(1999, 3, 1)]
    return flows.leaks(weekly_bars(spark, sf_dir), peeking, ["close"], times, tolerance=0.0).groupBy("test").agg(F.count(F.lit(1)).alias("names"))


# ---- labels -----------------------------------------------------------------------------------------------

P3 = "[0.2 + (event_id % 3) * 0.1, 0.3, 0.5 - (event_id % 3) * 0.1]"


def _probabilities():
    shift = (F.col("event_id") % 3) * 0.1
    return F.array(F.lit(0.2) + shift, F.lit(0.3), F.lit(0.5) - shift)


@query("expected_values", f"WITH p AS (SELECT event_id, {P3} AS p FROM events) SELECT event_id, round(p[1] * -0.05 + p[3] * 0.05 + 1e-8, 6) + 0.0 AS plain, round((exp(p[1]) * -0.05 + exp(p[3]) * 0.05) / (exp(p[1]) + exp(p[2]) + exp(p[3])) + 1e-8, 6) + 0.0 AS soft FROM p")
def expected_values(spark, sf_dir):
    centres = F.array(*[F.lit(x) for x in (-0.05, 0.0, 0.05)])
    return table(spark, sf_dir, "events").select("event_id", r6(L.expected_value(_probabilities(), centres)).alias("plain"), r6(L.expected_value(_probabilities(), centres, True)).alias("soft"))


@query("ordinal_head", "SELECT event_id, round(1 - s + 1e-8, 6) AS p0, round(s - s / 2 + 1e-8, 6) AS p1, round(s / 2 + 1e-8, 6) AS p2 FROM (SELECT event_id, (event_id % 10) / 10.0 AS s FROM events)")
def ordinal_head(spark, sf_dir):
    s = (F.col("event_id") % 10) / 10.0
    p = L.ordinal_probabilities(F.array(s, s / 2))
    return table(spark, sf_dir, "events").select("event_id", *[F.round(p[i] + 1e-8, 6).alias(f"p{i}") for i in range(3)])


@query("log_loss", f"SELECT round(avg(-ln(p[event_id % 3 + 1])) + 1e-8, 6) AS loss FROM (SELECT event_id, {P3} AS p FROM events)")
def log_loss(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(L.log_loss(F.col("event_id") % 3, _probabilities()) + 1e-8, 6).alias("loss"))


# ---- text ------------------------------------------------------------------------------------------------------


@query("visible_text", "SELECT doc_id, length(text) AS n, md5(text) AS held FROM documents")
def visible_text(spark, sf_dir):
    """Control and zero-width characters put in, at both ends and at every space, come out again."""
    noisy = F.concat(F.lit("\x01\u200b"), F.replace("text", F.lit(" "), F.lit("\u200d \x08")), F.lit("\ufeff\x7f"))
    seen = X.visible_text(noisy)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(seen).alias("n"), F.md5(seen.cast("binary")).alias("held"))


@query("units", "SELECT s_suppkey, floor(s_acctbal) AS x, 'million USD' AS unit, floor(s_acctbal) * 10000.0 AS in_unit FROM supplier")
def units(spark, sf_dir):
    note = F.concat(F.floor("s_acctbal").cast("string"), F.lit(" million USD"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("x"), X.number_unit(note).alias("unit"), X.in_unit(X.first_number(note), F.lit("Hundred million"), F.lit("Ten thousand")).alias("in_unit"))


@query("ticker_heads", "SELECT c_custkey, 'T' || c_custkey AS head FROM customer")
def ticker_heads(spark, sf_dir):
    note = F.concat(F.lit(" T"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.lit(".US (x)")).otherwise(F.lit(" (NYSE)")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.ticker_head(note).alias("head"))


@query("zone_labels", "SELECT event_id, event_id % 3 <> 2 AS eastern, 'at 10:00 ' || ['ET', 'ET', 'GMT'][event_id % 3 + 1] AS label FROM events")
def zone_labels(spark, sf_dir):
    note = F.concat(F.lit("at 10:00 "), F.element_at(F.array(*[F.lit(z) for z in ("EST", "EDT", "GMT")]), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", X.has_eastern_zone(note).alias("eastern"), X.eastern_label(note).alias("label"))


@query("directions", "SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE -1 END AS direction FROM events")
def directions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.direction(F.col("value"), 100).alias("direction"))


@query("reply_json", "SELECT event_id, event_type AS ticker, event_id % 4 <> 3 AS whole, event_id % 4 IN (0, 3) AS scored FROM events")
def reply_json(spark, sf_dir):
    """Replies with fenced, bare and cut JSON: what can be read from each."""
    body = F.concat(F.lit('{"ticker": "'), F.col("event_type"), F.lit('", "date": "2024-01-05", "scores": [1, '), F.when(F.col("event_id") % 4 == 1, F.lit("11")).otherwise(F.lit("2")), F.when(F.col("event_id") % 4 == 2, F.lit(", 3")).otherwise(F.lit("")), F.lit("]}"))
    fenced = F.when(F.col("event_id") % 8 < 4, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure. "), body))
    cut = F.when(F.col("event_id") % 4 == 3, F.concat(F.lit('{"ticker": "'), F.col("event_type"), F.lit('", "scores": [1'))).otherwise(body)
    ticker = F.get_json_object(X.json_body(F.when(F.col("event_id") % 4 == 3, X.repaired_json(cut)).otherwise(fenced)), "$.ticker")
    return table(spark, sf_dir, "events").select("event_id", ticker.alias("ticker"), X.looks_complete(cut).alias("whole"), X.scored_reply(fenced, 2).isNotNull().alias("scored"))


@query("task_sections", "SELECT event_id, event_type AS first, 'user ' || user_id AS second FROM events")
def task_sections(spark, sf_dir):
    reply = F.concat(F.lit("Task 1: "), F.col("event_type"), F.lit("\nTask 2:\n user "), F.col("user_id").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "events").select("event_id", X.task_section(reply, 1).alias("first"), X.task_section(reply, 2).alias("second"))


@query("list_items", "SELECT o_orderkey, o_orderstatus AS metric, o_orderpriority AS reason, 2 AS items FROM orders")
def list_items(spark, sf_dir):
    note = F.concat(F.lit("### Item 1\n- **Metric:** "), F.col("o_orderstatus"), F.lit("\n- Reason: "), F.col("o_orderpriority"), F.lit("\n### Item 2\n- **Metric:** x\n"))
    parts = X.sections(note, r"### Item \d+")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fields(parts[0])["metric"].alias("metric"), X.fields(parts[0])["reason"].alias("reason"), F.size(parts).alias("items"))


@query("lexicon_table", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(upper(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents), s AS (SELECT upper(w) AS word, sign FROM (VALUES ('the', 1), ('de', -1), ('of', 1), ('and', -1)) v(w, sign)) SELECT doc_id, count(*) AS words, coalesce(sum(sign), 0) AS polarity FROM w LEFT JOIN s USING (word) GROUP BY doc_id")
def lexicon_table(spark, sf_dir):
    signs = spark.createDataFrame([("the", 1), ("de", -1), ("of", 1), ("and", -1)], "word string, sign int")
    return X.lexicon_scores(table(spark, sf_dir, "documents"), "doc_id", "text", signs)


CHUNKS_SQL = r"""WITH RECURSIVE c(conv_id, turn, i, chunk, rest) AS (
  SELECT conv_id, turn, 0, CAST(NULL AS VARCHAR), trim(text) FROM conversations WHERE text IS NOT NULL
  UNION ALL
  SELECT conv_id, turn, i + 1, rtrim(rest[1:cut]), ltrim(rest[cut + 1:])
  FROM (SELECT *, CASE WHEN length(rest) <= 40 THEN 40 WHEN spaced > 1 THEN spaced - 1 ELSE 40 END AS cut
        FROM (SELECT *, length(regexp_extract(rest[1:41], '^(?s:.*) ')) AS spaced FROM c WHERE rest <> '')))
SELECT conv_id, turn, max(i) AS chunks, coalesce(string_agg(chunk, '|' ORDER BY i), '') AS held FROM c GROUP BY ALL"""


@query("char_chunks", CHUNKS_SQL)
def char_chunks(spark, sf_dir):
    chunks = X.char_chunks("text", F.lit(40))
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("c", chunks)
    return turns.select("conv_id", "turn", F.size("c").alias("chunks"), F.array_join("c", "|").alias("held"))


@query("first_words", "SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')[1:7], ' ') AS head FROM documents")
def first_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_words(F.col("text"), 7).alias("head"))


@query("report_fields", "SELECT o_orderkey, ['ABC', 'XY'] AS tickers, strftime(o_orderdate, '%Y-%m-%d') AS date, ['Jane Roe', 'John Smith'] AS analysts, floor(o_totalprice) AS price_target_mid, 12.5 AS price_target_bull, 7.0 AS price_target_bear, CASE WHEN o_orderkey % 2 = 0 THEN 1.25 END AS eps_target_mid, '+5%' AS revenue, 'flows' AS kind FROM orders")
def report_fields(spark, sf_dir):
    note = F.concat(
        F.lit("Roe Inc note on (ABC) and XY US, "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(". author: John Smith. Mail jane.roe@broker.com. Price target: $"),
        F.floor("o_totalprice").cast("string"), F.lit(". Bull case: $12.5. Bear case: 7. "), F.when(F.col("o_orderkey") % 2 == 0, F.lit("EPS: 1.25. ")).otherwise(F.lit("")), F.lit("Revenue: +5% and net flows: 3."),
    )
    f = X.report_fields(note)
    return table(spark, sf_dir, "orders").select("o_orderkey", f["tickers"].alias("tickers"), f["date"].alias("date"), f["analysts"].alias("analysts"), *[f[c].alias(c) for c in ("price_target_mid", "price_target_bull", "price_target_bear", "eps_target_mid")], f["estimates"]["% Change YoY"].alias("revenue"), F.when(F.map_contains_key(f["estimates"], "Flows"), "flows").alias("kind"))


@query("masked_entities", "SELECT event_id, '[PERSON] did ' || event_type || ' at [ORG].' AS text FROM events")
def masked_entities(spark, sf_dir):
    """Spans of a tagger masked: persons and places, other labels left."""
    name, place = F.concat(F.lit("User"), F.col("user_id").cast("string")), F.concat(F.lit("Shop"), (F.col("event_id") % 7).cast("string"))
    text = F.concat(name, F.lit(" did "), F.col("event_type"), F.lit(" at "), place, F.lit("."))
    start = F.length(name) + 5 + F.length("event_type") + 4
    span = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    spans = F.array(span(F.lit(0), F.length(name), "PERSON"), span(start, start + F.length(place), "GPE"), span(F.length(name) + 1, F.length(name) + 4, "VERB"))
    return table(spark, sf_dir, "events").select("event_id", X.masked(text, spans, {"PERSON": "[PERSON]", "ORG": "[ORG]", "GPE": "[ORG]"}).alias("text"))


@query("series_files", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '_transformed.parquet' AS file FROM customer")
def series_files(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.series_file(F.concat(X.exchange_code(F.col("c_custkey")), F.lit(".csv"))).alias("file"))


# ---- facts ----------------------------------------------------------------------------------------------------------


@query("optional_links", FACTS_SQL + "SELECT ticker, quarter, metric, round(value, 2) AS value, CAST(NULL AS VARCHAR) AS reason FROM f")
def optional_links(spark, sf_dir):
    rows = facts(spark, sf_dir).withColumn("reason", F.lit(None).cast("string"))
    _, edges = G.graph_tables(rows)
    found = edges.select("fact").distinct()
    out = G.optional_links(found, edges, {"Ticker": "ticker", "Quarter": "quarter", "Metric": "metric", "Value": "value", "Reason": "reason"})
    return out.select("ticker", "quarter", "metric", F.round(F.col("value").cast("double"), 2).alias("value"), "reason")


@query("facts_by_tool", "SELECT event_type AS tool, list_sort(list(DISTINCT user_id)) AS facts FROM events GROUP BY 1")
def facts_by_tool(spark, sf_dir):
    return G.by_tool(table(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("tools")), "user_id", "tools")


@query("quarters_of_history", FACTS_SQL + "SELECT DISTINCT quarter, CAST((q - 4) // 4 AS VARCHAR) || '-Q' || (q % 4 + 1) AS year_before, CAST((q - 2) // 4 AS VARCHAR) || '-Q' || ((q - 2) % 4 + 1) AS third FROM k")
def quarters_of_history(spark, sf_dir):
    q = F.col("quarter")
    return facts(spark, sf_dir).select("quarter").distinct().select("quarter", G.year_before(q).alias("year_before"), G.quarters_back(q, 3)[2].alias("third"))


@query("preferred_statements", FACTS_SQL + "SELECT ticker, quarter, min(CASE metric WHEN 'O' THEN 'a' WHEN 'F' THEN 'b' ELSE 'c' END) AS kind FROM f GROUP BY ALL")
def preferred_statements(spark, sf_dir):
    rows = facts(spark, sf_dir).select("ticker", "quarter", F.lit("total").alias("metric"), F.col("metric").alias("kind"))
    out = G.preferred(rows, "kind", ["O", "F", "P"])
    return out.select("ticker", "quarter", G.mapped(F.col("kind"), {"O": "a", "F": "b", "P": "c"}).alias("kind"))


@query("statement_rows", "SELECT n_nationkey, d AS date, n_nationkey * i AS value FROM nation, (VALUES ('1996-03-31', 2), ('1996-06-30', 3), ('1996-09-30', 4)) v(d, i)")
def statement_rows(spark, sf_dir):
    """The latest three date columns before a day, of a wide statement with five."""
    days = ["1995-12-31", "1996-03-31", "1996-06-30", "1996-09-30", "1996-12-31"]
    wide = table(spark, sf_dir, "nation").select("n_nationkey", *[(F.col("n_nationkey") * F.lit(i + 1)).alias(d) for i, d in enumerate(days)])
    out = G.statement_rows(wide, ["n_nationkey"], F.lit("1996-12-01").cast("date"), 3)
    return out.select("n_nationkey", F.col("date").cast("string").alias("date"), "value")


# ---- order book --------------------------------------------------------------------------------------------------------


@query("moving_average", BARS_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(avg(close) OVER {frame(5)} + 1e-8, 6) AS sma FROM bars")
def moving_average(spark, sf_dir):
    return weekly_bars(spark, sf_dir).select("ticker", F.expr(DAY), r6(O.moving_average("close", 5)).alias("sma"))


@query("book_columns", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, high AS price_ask_1_mean, low AS price_bid_1_mean FROM bars")
def book_columns(spark, sf_dir):
    df = weekly_bars(spark, sf_dir).select("ticker", F.expr(DAY), F.col("high").alias("vwap_ask_1"), F.col("low").alias("vwap_bid_1"))
    return O.without_level_prices(O.renamed_levels(df).withColumn("vwap_ask_2", F.lit(1.0)))


@query("book_accumulated", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(close * 0.006 * 2 + 1e-8, 5) AS price, round(volume * 6 - trades * 6 + 1e-8, 5) + 0.0 AS volume FROM bars")
def book_accumulated(spark, sf_dir):
    from panelforge.plans.catalogue import book

    out = O.accumulated_differences(book(spark, sf_dir), 3)
    return out.select("ticker", F.expr(DAY), F.round(F.col("accumulated_price") + 1e-8, 5).alias("price"), (F.round(F.col("accumulated_volume") + 1e-8, 5) + F.lit(0.0)).alias("volume"))


# ---- factor language ------------------------------------------------------------------------------------------------------


@query("equal_factors", BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(close + open + 1e-8, 6) AS a FROM bars")
def equal_factors(spark, sf_dir):
    """Two trees that differ in order only count as one; their names are told apart first."""
    from panelforge.plans.expr import distinct_factors, unique_names

    names = unique_names(["a", "a"])
    kept = distinct_factors(dict(zip(names, [call("add", "close", "open"), call("add", "close", "open")], strict=True)))
    out = compiled(weekly_bars(spark, sf_dir), kept)
    return out.select("ticker", F.expr(DAY), *[r6(n).alias("a") for n in kept])


# ---- skewed keys ---------------------------------------------------------------------------------


@query(
    "sale_terms",
    """WITH c AS (SELECT * FROM (SELECT client_id, valid_at, change_id, segment, city, row_number() OVER (PARTITION BY client_id, valid_at ORDER BY seq DESC NULLS LAST, change_id DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST) AS k FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL) WHERE k = 1)
SELECT s.sale_id, s.client_id, c.change_id, c.segment, c.city FROM sales s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at >= c.valid_at""",
)
def sale_terms(spark, sf_dir):
    """Every sale with its client's segment and city as last changed at or before it, by slices of a day: one client may
    have a third of all sales."""
    changes = table(spark, sf_dir, "client_changes").select("client_id", "valid_at", "seq", "change_id", "segment", "city")
    sales = table(spark, sf_dir, "sales").select("sale_id", "client_id", "sold_at")
    out = A.as_of_by_slices(sales, changes, "client_id", "sold_at", "valid_at", ["change_id", "segment", "city"], 86_400_000_000, tie=["seq", "change_id", "segment", "city"])
    return out.select("sale_id", "client_id", "change_id", "segment", "city")
