"""Queries over the base tables, each a call of the library next to the SQL that gives the same rows.

Bars: ticker = p_brand, ts = week of l_shipdate, price = l_extendedprice / l_quantity,
opened and closed by a total order. Values are rounded to six places on both
sides, after a step of 1e-8 that keeps exact halves from falling either way;
adding 0.0 turns -0.0 into 0.0.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import text as X
from panelforge.functions.panel import Keys, nonzero
from panelforge.operators import asof as A
from panelforge.operators import bars as B
from panelforge.operators import book as O
from panelforge.operators import evaluate as E
from panelforge.operators import facts as G
from panelforge.operators import kernels as K
from panelforge.operators import labels as L
from panelforge.operators import portfolio as P
from panelforge.operators import ranks as R
from panelforge.operators import signals as S
from panelforge.plans.expr import compiled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BARS_SQL = f"""WITH trades AS (
  SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS q, {', '.join(ORDER)}
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT ticker, ts, first(price ORDER BY {', '.join(ORDER)}, price) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {', '.join(ORDER)}, price) AS close, sum(q) AS volume, count(*) AS trades,
         CASE WHEN count(*) > 2 THEN last(price ORDER BY {', '.join(ORDER)}, price) END AS gap
  FROM trades GROUP BY ALL)
"""
#: Times leave a query as text: the same in every zone and client.
DAY = "CAST(ts AS STRING) AS ts"
SERIES = "(PARTITION BY ticker ORDER BY ts)"


def frame(n: int, extra: str = "") -> str:
    return f"(PARTITION BY ticker{extra} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(value: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {value} OVER {frame(n)} END"


def r6(x: Column | str) -> Column:
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-8), 6) + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of the catalogue, with ``gap``: the close, missing where a week has two trades or fewer."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    rows = table(spark, sf_dir, "lineitem").select(*ORDER, "l_extendedprice", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("price", F.try_divide("l_extendedprice", "l_quantity"))
    out = B.bars(rows, F.date_trunc("week", "l_shipdate").cast("date"), "price", "l_quantity", ORDER)
    return out.withColumn("gap", F.when(F.col("trades") > 2, F.col("close")))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def bar_query(name: str, sql: str, *columns: str):
    """A query of bars: ``f(bars)`` gives ticker, ts and ``columns``; ``sql`` selects from the view bars."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(weekly_bars(spark, sf_dir))
        ORACLES[name] = BARS_SQL + sql
        return f

    return add


def factor(name: str, tree, sql: str, before: str = "") -> None:
    """A query that compiles ``tree`` over the bars; ``sql`` is the value's expression over bars (or ``before``'s last view x)."""
    QUERIES[name] = lambda spark, sf_dir: compiled(weekly_bars(spark, sf_dir), {"value": tree}).select("ticker", F.expr(DAY), r6("value").alias("value"))
    ORACLES[name] = BARS_SQL + before + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round({sql} + 1e-8, 6) + 0.0 AS value FROM {'x' if before else 'bars'}"


def call(op: str, *args):
    return {"call": op, "args": list(args)}


# ---- time series operators ------------------------------------------------------------

bar_query("bars_weekly", "SELECT ticker, CAST(ts AS VARCHAR) AS ts, open, high, low, close, volume, trades FROM bars")(
    lambda b: b.select("ticker", F.expr(DAY), "open", "high", "low", "close", "volume", "trades")
)

LAG = f"lag(close, 1) OVER {SERIES}"
RET = f"CASE WHEN close / {LAG} > 0 THEN ln(close / {LAG}) END"
LAGGED = f", x AS (SELECT *, {LAG} AS prev, {RET} AS r, last_value(gap IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled, lag(high, 1) OVER {SERIES} AS prev_high FROM bars) "
LISTED = "list({0}) OVER " + frame(8)

factor("delay", call("delay", "close", 3), f"lag(close, 3) OVER {SERIES}")
factor("diff", call("diff", "close", 2), f"close - lag(close, 2) OVER {SERIES}")
factor("ret", call("ret", "close", 1), RET)
factor("ts_mean", call("ts_mean", "close", 8), full("avg(close)", "close", 8))
factor("ts_mean_gap", call("ts_mean", "gap", 4), full("avg(gap)", "gap", 4))
factor("ts_std", call("ts_std", "close", 8), full("stddev_samp(close)", "close", 8))
factor("ts_sum", call("ts_sum", "volume", 8), full("sum(volume)", "volume", 8))
factor("ts_min", call("ts_min", "low", 8), full("min(low)", "low", 8))
factor("ts_max", call("ts_max", "high", 8), full("max(high)", "high", 8))
factor("ts_argmin", call("ts_argmin", "volume", 8), f"CASE WHEN count(volume) OVER {frame(8)} = 8 THEN 8 - list_position({LISTED.format('volume')}, min(volume) OVER {frame(8)}) END")
factor("ts_argmax", call("ts_argmax", "volume", 8), f"CASE WHEN count(volume) OVER {frame(8)} = 8 THEN 8 - list_position({LISTED.format('volume')}, max(volume) OVER {frame(8)}) END")
factor("wma", call("wma", "close", 4), f"(4 * close + 3 * lag(close, 1) OVER {SERIES} + 2 * lag(close, 2) OVER {SERIES} + lag(close, 3) OVER {SERIES}) / 10")
factor("ts_zscore", call("ts_zscore", "close", 8), f"CASE WHEN count(close) OVER {frame(8)} = 8 THEN (close - avg(close) OVER {frame(8)}) / nullif(stddev_samp(close) OVER {frame(8)}, 0) END")
factor("ts_pctile", call("ts_pctile", "close", 8, 0.25), full("quantile_cont(close, 0.25)", "close", 8))
factor("ts_median", call("ts_median", "close", 7), full("quantile_cont(close, 0.5)", "close", 7))
factor("ts_prod", call("ts_prod", call("div", "close", "open", 0.0), 4), f"CASE WHEN count(close) OVER {frame(4)} = 4 THEN (close / open) * lag(close / open, 1) OVER {SERIES} * lag(close / open, 2) OVER {SERIES} * lag(close / open, 3) OVER {SERIES} END")
factor("ts_rank", call("ts_rank", "close", 8), f"CASE WHEN count(close) OVER {frame(8)} = 8 THEN len(list_filter({LISTED.format('close')}, lambda v: v < close)) / 7.0 END")
factor("corr_ts", call("corr_ts", "close", "volume", 12), full("corr(close, volume)", "close", 12))
factor("cov_ts", call("cov_ts", call("div", "close", 1000.0, 0.0), call("div", "open", 1000.0, 0.0), 12), full("covar_samp(close / 1000.0, open / 1000.0)", "close", 12))
factor("beta_ts", call("beta_ts", "close", "open", 12), f"CASE WHEN count(close) OVER {frame(12)} = 12 THEN covar_samp(close, open) OVER {frame(12)} / nullif(var_samp(open) OVER {frame(12)}, 0) END")
factor("volatility", call("volatility", "close", 8), full("stddev_samp(r)", "r", 8), LAGGED)
factor("true_range", call("true_range", "high", "low", call("delay", "close", 1)), "greatest(high - low, abs(high - prev), abs(low - prev))", LAGGED)
factor("atr", call("atr", "high", "low", "close", 6), full("avg(greatest(high - low, abs(high - prev), abs(low - prev)))", "high", 6), LAGGED)
factor("breakout", call("breakout", "close", 5, "up"), f"CASE WHEN count(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) = 5 AND close > max(close) OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) THEN 1.0 ELSE 0.0 END")
factor("persist", call("persist", call("gt", "gap", "open"), 5), f"sum(CASE WHEN coalesce(gap > open, false) THEN 1.0 ELSE 0.0 END) OVER {frame(5)}")
factor("turnover", call("turnover", "volume", 6), f"CASE WHEN count(volume) OVER {frame(6)} = 6 THEN volume / nullif(avg(volume) OVER {frame(6)}, 0) END")
factor("adv", call("adv", "volume", 6), full("avg(volume)", "volume", 6))
factor("amihud", call("amihud", call("ret", "close", 1), "volume", 6), full("avg(abs(r) / volume)", "r", 6), LAGGED)
factor("pct_change", call("pct_change", "gap", 1), f"filled / lag(filled, 1) OVER {SERIES} - 1", LAGGED)
factor("crossover", call("crossover", "close", "open"), f"CASE WHEN lag(close, 1) OVER {SERIES} <= lag(open, 1) OVER {SERIES} AND close > open THEN 1.0 ELSE 0.0 END")
factor("crossunder", call("crossunder", "close", "open"), f"CASE WHEN lag(close, 1) OVER {SERIES} >= lag(open, 1) OVER {SERIES} AND close < open THEN 1.0 ELSE 0.0 END")
factor("demean_ts", call("demean_ts", "close", 8), f"CASE WHEN count(close) OVER {frame(8)} = 8 THEN close - avg(close) OVER {frame(8)} END")
factor("smooth_ts", call("smooth_ts", "close", 5, "median"), full("quantile_cont(close, 0.5)", "close", 5))
factor("fillna_ts", call("fillna_ts", "gap"), "filled", LAGGED)
EMA = "list_reduce(list(close) OVER {w}, lambda a, b: a * {keep!r} + b * {alpha!r})"
factor("ema", call("ema", "close", 10), EMA.format(w=SERIES, keep=1 - 2 / 11, alpha=2 / 11))

# ---- cross-section operators ------------------------------------------------------------

CROSS = "(PARTITION BY ts)"
RANK = "(rank() OVER (PARTITION BY ts ORDER BY {0}) + (count(*) OVER (PARTITION BY ts, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY ts)"
factor("cs_rank", call("cs_rank", "volume"), RANK.format("volume"))
factor("cs_zscore", call("cs_zscore", "close"), f"(close - avg(close) OVER {CROSS}) / nullif(stddev_samp(close) OVER {CROSS}, 0)")
factor("cs_winsor", call("cs_winsor", "close", 0.1), f"least(greatest(close, quantile_cont(close, 0.1) OVER {CROSS}), quantile_cont(close, 0.9) OVER {CROSS})")
factor("cs_neutralize", call("cs_neutralize", "close", "open"), f"close - open * (sum(close * open) OVER {CROSS} / nullif(sum(open * open) OVER {CROSS}, 0))")
factor("cs_rescale_l1", call("cs_rescale", "close", "l1"), f"close / nullif(sum(abs(close)) OVER {CROSS}, 0)")
factor("cs_rescale_l2", call("cs_rescale", "close", "l2"), f"close / nullif(sqrt(sum(close * close) OVER {CROSS}), 0)")
factor("cs_rescale_minmax", call("cs_rescale", "close", "minmax"), f"2 * (close - min(close) OVER {CROSS}) / nullif(max(close) OVER {CROSS} - min(close) OVER {CROSS}, 0) - 1")
factor("debias_cs", call("debias_cs", "close"), f"close - avg(close) OVER {CROSS}")
QUERIES["cs_neutralize_multi"] = lambda spark, sf_dir: compiled(weekly_bars(spark, sf_dir), {"value": call("cs_neutralize_multi", "close", "open", "volume")}).select("ticker", F.expr(DAY), F.round("value", 3).alias("value"))
ORACLES["cs_neutralize_multi"] = BARS_SQL + ", g AS (SELECT ts, sum(open * open) AS aa, sum(volume * volume) AS bb, sum(open * volume) AS ab, sum(open * close) AS ax, sum(volume * close) AS bx FROM bars GROUP BY ts) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(close - open * (ax * bb - bx * ab) / nullif(aa * bb - ab * ab, 0) - volume * (bx * aa - ax * ab) / nullif(aa * bb - ab * ab, 0), 3) AS value FROM bars JOIN g USING (ts)"

# ---- row-wise operators, all in one pass each ---------------------------------------------

ALGEBRA = {
    "add": (call("add", "close", "open"), "close + open"), "sub": (call("sub", "close", "open"), "close - open"), "mul": (call("mul", "close", 0.5), "close * 0.5"),
    "div": (call("div", "close", "volume"), "close / (volume + 1e-8)"), "abs": (call("abs", call("sub", "close", "open")), "abs(close - open)"),
    "sign": (call("sign", call("sub", "close", "open")), "CAST(sign(close - open) AS DOUBLE)"), "clip": (call("clip", "close", 1000, 1500), "CASE WHEN close IS NOT NULL THEN least(greatest(close, 1000), 1500) END"),
    "pow": (call("pow", call("div", "close", 1000.0, 0.0), 1.5), "pow(close / 1000.0, 1.5)"), "log1p": (call("log1p", call("sub", "close", "open")), "ln(1 + greatest(close - open, 0))"),
    "sqrt": (call("sqrt", call("sub", "close", "open")), "sqrt(greatest(close - open, 0))"), "tanh": (call("tanh", call("div", call("sub", "close", "open"), 1000.0, 0.0)), "tanh((close - open) / 1000.0)"),
    "neg": (call("neg", "close"), "-close"), "inv": (call("inv", "close"), "1 / (nullif(close, 0) + sign(close) * 1e-12)"), "emin": (call("emin", "close", "open"), "least(close, open)"),
    "emax": (call("emax", "gap", "open"), "greatest(gap, open)"), "signed_pow": (call("signed_pow", call("sub", "close", "open"), 0.5), "sign(close - open) * pow(abs(close - open), 0.5)"),
    "safe_log": (call("safe_log", "close"), "ln(greatest(close, 1e-12))"), "hl_range": (call("hl_range", "high", "low", "open"), "(high - low) / open"),
    "spread": (call("spread", "high", "low"), "high - low"), "rel_spread": (call("rel_spread", "high", "low"), "(high - low) / ((high + low) / 2)"),
    "order_imb": (call("order_imb", "volume", "trades"), "(volume - trades) / nullif(volume + trades, 0)"), "ohlc_return": (call("ohlc_return", "open", "close"), "ln(close / open)"),
}
LOGIC = {
    "gt": (call("gt", "gap", "open"), "gap > open", False), "lt": (call("lt", "gap", "open"), "gap < open", False), "ge": (call("ge", "gap", "open"), "gap >= open", False),
    "le": (call("le", "gap", "open"), "gap <= open", False), "eq": (call("eq", "gap", "close"), "gap = close", False), "ne": (call("ne", "gap", "close"), "gap <> close", True),
    "between": (call("between", "gap", 1000, 1500), "gap BETWEEN 1000 AND 1500", False), "land": (call("land", "gap", call("gt", "close", "open")), "coalesce(gap, 1) <> 0 AND close > open", False),
    "lor": (call("lor", call("sub", "gap", "gap"), call("gt", "close", "open")), "coalesce(gap - gap, 1) <> 0 OR close > open", False), "lnot": (call("lnot", "gap"), "NOT (coalesce(gap, 1) <> 0)", False),
}


def _columns(names: dict) -> Callable:
    return lambda spark, sf_dir: compiled(weekly_bars(spark, sf_dir), {n: t[0] for n, t in names.items()}).select("ticker", F.expr(DAY), *[r6(n).alias(n) for n in names])


QUERIES["scalar_algebra"] = _columns(ALGEBRA)
ORACLES["scalar_algebra"] = BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, " + ", ".join(f"round({sql} + 1e-8, 6) + 0.0 AS {n}" for n, (_, sql) in ALGEBRA.items()) + " FROM bars"
QUERIES["scalar_logic"] = _columns(LOGIC)
ORACLES["scalar_logic"] = BARS_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, " + ", ".join(f"CASE WHEN coalesce({sql}, {missing}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" for n, (_, sql, missing) in LOGIC.items()) + " FROM bars"
factor("cond", call("cond", call("sub", "gap", "gap"), "close", "open"), "CASE WHEN gap IS NULL THEN close ELSE open END")
factor("coalesce", call("coalesce", "gap", "open"), "coalesce(gap, open)")

# ---- factor evaluation ------------------------------------------------------------------

MOMENTUM = call("cs_zscore", call("ts_zscore", "close", 8))
PANEL_SQL = BARS_SQL + f""", z AS (SELECT *, CASE WHEN count(close) OVER {frame(8)} = 8 THEN (close - avg(close) OVER {frame(8)}) / nullif(stddev_samp(close) OVER {frame(8)}, 0) END AS z FROM bars),
panel AS (SELECT ticker, ts, close, (z - avg(z) OVER {CROSS}) / nullif(stddev_samp(z) OVER {CROSS}, 0) AS f, lead(close, 1) OVER {SERIES} / close - 1 AS r FROM z),
ic AS (SELECT ts, CASE WHEN count(*) > 2 AND NOT isnan(corr(f, r)) THEN corr(f, r) END AS ic, count(*) AS n FROM panel WHERE f IS NOT NULL AND r IS NOT NULL GROUP BY ts)
"""
PNL_SQL = PANEL_SQL + f""", s AS (SELECT *, avg(f) OVER {CROSS} AS m, stddev_samp(f) OVER {CROSS} AS sd FROM panel WHERE f IS NOT NULL),
w AS (SELECT *, CASE WHEN sd > 1e-6 THEN least(greatest((f - m) / sd, -3), 3) END AS z FROM s),
v AS (SELECT * FROM w WHERE z IS NOT NULL AND r IS NOT NULL),
u AS (SELECT *, z - avg(z) OVER {CROSS} AS w FROM v),
pnl AS (SELECT ts, CASE WHEN count(u.w) >= 10 THEN sum(u.w * u.r) / nullif(sum(abs(u.w)), 0) END AS pnl FROM (SELECT DISTINCT ts FROM panel) LEFT JOIN u USING (ts) GROUP BY ts)
"""


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, close, f, r): the flagship factor and the next week's return."""
    df = compiled(weekly_bars(spark, sf_dir), {"f": MOMENTUM})
    return B.forward_return(df, "close", 1).select("ticker", "ts", "close", "f", "r")


def pnl_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.row_pnl(factor_panel(spark, sf_dir))


def small_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a ten-thousandth of the exposure: the synthetic prices jump too much to compound."""
    return pnl_series(spark, sf_dir).withColumn("pnl", F.col("pnl") / 10000)


@query("factor_momentum", PANEL_SQL + "SELECT CAST(ts AS VARCHAR) AS ts, round(ic + 1e-8, 6) + 0.0 AS ic, n FROM ic")
def factor_momentum(spark, sf_dir):
    return E.information_coefficients(factor_panel(spark, sf_dir)).select(F.expr(DAY), r6("ic").alias("ic"), "n")


RANKED_SQL = PANEL_SQL + f", k AS (SELECT ts, {RANK.format('f')} AS a, {RANK.format('r')} AS b FROM panel WHERE f IS NOT NULL AND r IS NOT NULL) "


@query("rank_ic", RANKED_SQL + "SELECT CAST(ts AS VARCHAR) AS ts, CASE WHEN count(*) > 2 THEN round(corr(a, b) + 1e-8, 6) + 0.0 END AS ic, count(*) AS n FROM k GROUP BY ts")
def rank_ic(spark, sf_dir):
    return E.rank_information_coefficients(factor_panel(spark, sf_dir)).select(F.expr(DAY), r6("ic").alias("ic"), "n")


HAC = "SELECT n, round(mean, 6) AS mean, round(CASE WHEN n < 10 THEN 0 ELSE mean / sqrt((g0 + 2 * (" + " + ".join(f"{1 - k / 6!r} * g{k}" for k in range(1, 6)) + ")) / n / n) END, 6) AS t_stat FROM h"


@query("ic_summary_hac", PANEL_SQL + ", e AS (SELECT ts, ic - (SELECT avg(ic) FROM ic) AS e FROM ic WHERE ic IS NOT NULL), l AS (SELECT e, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY ts) AS e{k}" for k in range(1, 6)) + " FROM e), h AS (SELECT (SELECT count(ic) FROM ic) AS n, (SELECT avg(ic) FROM ic) AS mean, sum(e * e) AS g0, " + ", ".join(f"sum(e * e{k}) AS g{k}" for k in range(1, 6)) + " FROM l) " + HAC)
def ic_summary_hac(spark, sf_dir):
    return E.hac_tstat(E.information_coefficients(factor_panel(spark, sf_dir)), "ic", "ts").select("n", F.round("mean", 6).alias("mean"), F.round("t_stat", 6).alias("t_stat"))


@query("pnl_rowwise", PNL_SQL + "SELECT CAST(ts AS VARCHAR) AS ts, round(pnl + 1e-8, 6) + 0.0 AS pnl, CASE WHEN abs(pnl) <= 0.5 THEN round(pnl + 1e-8, 6) + 0.0 END AS clean FROM pnl")
def pnl_rowwise(spark, sf_dir):
    return pnl_series(spark, sf_dir).select(F.expr(DAY), r6("pnl").alias("pnl"), r6(E.without_spikes(F.col("pnl"))).alias("clean"))


@query("sharpe_ci", PNL_SQL + ", g AS (SELECT avg(pnl) AS mean, stddev_samp(pnl) AS std, count(pnl) AS n FROM pnl) SELECT n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean * sqrt(3276.0) / std, 6) AS sharpe, round(mean * sqrt(3276.0) / std - 1.959963984540054 / sqrt(n), 6) AS low, round(mean * sqrt(3276.0) / std + 1.959963984540054 / sqrt(n), 6) AS high FROM g")
def sharpe_ci(spark, sf_dir):
    return E.sharpe(pnl_series(spark, sf_dir), "pnl").select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "sharpe", "low", "high")])


@query("drawdown", PNL_SQL + ", c AS (SELECT ts, list_reduce(list(1 + coalesce(pnl / 10000, 0)) OVER (ORDER BY ts), lambda a, b: a * b) AS equity FROM pnl), p AS (SELECT *, max(equity) OVER (ORDER BY ts) AS peak FROM c) SELECT CAST(ts AS VARCHAR) AS ts, round(equity, 6) AS equity, round(peak, 6) AS peak, round(equity / peak - 1 + 1e-8, 6) + 0.0 AS drawdown FROM p")
def drawdown(spark, sf_dir):
    return E.equity(small_pnl(spark, sf_dir), "pnl", "ts").select(F.expr(DAY), F.round("equity", 6).alias("equity"), F.round("peak", 6).alias("peak"), r6("drawdown").alias("drawdown"))


@query("performance", PNL_SQL + ", s2 AS (SELECT ts, pnl / 10000 AS pnl FROM pnl WHERE pnl IS NOT NULL), c AS (SELECT ts, pnl, list_reduce(list(1 + pnl) OVER (ORDER BY ts), lambda a, b: a * b) AS equity FROM s2), d AS (SELECT *, equity / max(equity) OVER (ORDER BY ts) - 1 AS dd FROM c) SELECT count(*) AS n, round(last(equity ORDER BY ts) - 1, 6) AS total_return, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(min(dd), 6) AS max_drawdown, round(avg(pnl) * sqrt(52.0) / stddev_samp(pnl), 6) AS sharpe, round(pow(last(equity ORDER BY ts), 52.0 / count(*)) - 1, 6) AS annual_return FROM d")
def performance(spark, sf_dir):
    return E.performance(small_pnl(spark, sf_dir), "pnl", "ts", 52).select("n", *[F.round(c, 6).alias(c) for c in ("total_return", "win_rate", "max_drawdown", "sharpe", "annual_return")])


@query("lag_sharpe", PANEL_SQL + ", lags AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, ts, lag(f, {k}) OVER {SERIES} * r AS d FROM panel" for k in range(4)) + "), p AS (SELECT lag, ts, sum(d) AS pnl FROM lags GROUP BY lag, ts) SELECT lag, count(pnl) AS n, round(avg(pnl) * sqrt(52.0) / stddev_samp(pnl), 6) AS sharpe FROM p GROUP BY lag")
def lag_sharpe(spark, sf_dir):
    return E.sharpe(E.lagged_dot(factor_panel(spark, sf_dir), "f", "r", [0, 1, 2, 3]), "pnl", 52, ["lag"]).select("lag", "n", F.round("sharpe", 6).alias("sharpe"))


POOLED = "(rank() OVER (PARTITION BY lag ORDER BY {0}) + (count(*) OVER (PARTITION BY lag, {0}) - 1) / 2.0)"


@query("cross_lag_ic", PANEL_SQL + ", lags AS (" + " UNION ALL ".join(f"SELECT {k} AS lag, {'lag' if k >= 0 else 'lead'}(f, {abs(k)}) OVER {SERIES} AS f, r FROM panel" for k in range(-2, 3)) + f"), k AS (SELECT lag, {POOLED.format('f')} AS a, {POOLED.format('r')} AS b FROM lags WHERE f IS NOT NULL AND r IS NOT NULL) SELECT lag, round(corr(a, b) + 1e-8, 6) + 0.0 AS ic, count(*) AS n FROM k GROUP BY lag")
def cross_lag_ic(spark, sf_dir):
    return E.cross_lag_rank_ic(factor_panel(spark, sf_dir), "f", "r", list(range(-2, 3))).select("lag", r6("ic").alias("ic"), "n")


@query("coverage_start", PANEL_SQL + "SELECT CAST(min(ts) AS VARCHAR) AS start FROM (SELECT ts, count(f) AS n FROM panel GROUP BY ts) WHERE n >= 0.5 * (SELECT count(DISTINCT ticker) FROM panel)")
def coverage_start(spark, sf_dir):
    return E.coverage_start(factor_panel(spark, sf_dir), "f").select(F.col("start").cast("string").alias("start"))


@query("coverage_months", PANEL_SQL + "SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(f) AS n FROM panel GROUP BY 1 HAVING count(f) < 110")
def coverage_months(spark, sf_dir):
    return E.thin_months(factor_panel(spark, sf_dir), "f", 110).select(F.date_format("month", "yyyy-MM").alias("month"), "n")


@query("quantile_portfolio", PANEL_SQL + f", k AS (SELECT *, CASE WHEN f IS NOT NULL THEN {RANK.format('f')} END AS k FROM panel), p AS (SELECT *, CASE WHEN k > 0.8 THEN 1.0 WHEN k < 0.2 THEN -1.0 ELSE 0.0 END AS p FROM k), h AS (SELECT ts, r, lag(p, 1) OVER {SERIES} AS h FROM p) SELECT CAST(ts AS VARCHAR) AS ts, round(avg(h * r) + 1e-8, 6) + 0.0 AS pnl, round(avg(abs(h)), 6) AS gross FROM h GROUP BY ts")
def quantile_portfolio(spark, sf_dir):
    return E.quantile_portfolio(factor_panel(spark, sf_dir), "f", "r").select(F.expr(DAY), r6("pnl").alias("pnl"), F.round("gross", 6).alias("gross"))


# ---- portfolio ---------------------------------------------------------------------------

#: Exact quantiles of (rank - 0.5) / n for average ranks of up to 25 names, from the standard library.
GAUSS = "(VALUES " + ", ".join(f"({n}, {k}, {max(-3.0, min(3.0, NormalDist().inv_cdf((k / 2 - 0.5) / n)))!r})" for n in range(2, 26) for k in range(2, 2 * n + 1)) + ") g(n, k, z)"


@query("gaussianize", BARS_SQL + f", k AS (SELECT ticker, ts, 2 * rank() OVER (PARTITION BY ts ORDER BY volume) + count(*) OVER (PARTITION BY ts, volume) - 1 AS k, count(*) OVER (PARTITION BY ts) AS n FROM bars) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN k.n <= 1 THEN 0 ELSE g.z END + 1e-8, 6) + 0.0 AS z FROM k LEFT JOIN {GAUSS} ON k.n = g.n AND k.k = g.k")
def gaussianize(spark, sf_dir):
    return P.gaussianised(weekly_bars(spark, sf_dir), "volume", "z").select("ticker", F.expr(DAY), r6("z").alias("z"))


FORWARD = [0.5 ** (d / 4) for d in range(6)]


@query("forward_ewma", PANEL_SQL + f", n AS (SELECT *, row_number() OVER {SERIES} AS i, count(*) OVER (PARTITION BY ticker) AS n FROM panel) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN i + 7 <= n THEN " + " + ".join(f"coalesce(lead(r, {1 + d}) OVER {SERIES}, 0) * {w / sum(FORWARD)!r}" for d, w in enumerate(FORWARD)) + " ELSE 0 END + 1e-8, 6) + 0.0 AS alpha FROM n")
def forward_ewma(spark, sf_dir):
    return P.forward_decay(factor_panel(spark, sf_dir), "r", 1, 6, 4.0).select("ticker", F.expr(DAY), r6("alpha").alias("alpha"))


@query("long_only", PANEL_SQL + f", v AS (SELECT *, var_samp(r) OVER {frame(12)} AS v FROM panel), w AS (SELECT *, coalesce(greatest(f / nullif(v, 0), 0), 0) AS w FROM v) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(coalesce(w / nullif(sum(w) OVER {CROSS}, 0), 0), 6) AS weight FROM w")
def long_only(spark, sf_dir):
    df = factor_panel(spark, sf_dir).withColumn("v", F.var_samp("r").over(B.KEYS.rows(12)))
    return P.long_only(df, "f", "v").select("ticker", F.expr(DAY), F.round("weight", 6).alias("weight"))


@query("shifted_weights", PANEL_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(coalesce(lag(f, 2) OVER {SERIES}, 0) + 1e-8, 6) + 0.0 AS weight FROM panel")
def shifted_weights(spark, sf_dir):
    return compiled(factor_panel(spark, sf_dir), {"weight": call("coalesce", call("delay", "f", 2), 0.0)}).select("ticker", F.expr(DAY), r6("weight").alias("weight"))


@query("jump_clean", PANEL_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN r IS NULL OR abs(r) > 1 THEN 0 ELSE r END + 1e-8, 6) + 0.0 AS r FROM panel")
def jump_clean(spark, sf_dir):
    return factor_panel(spark, sf_dir).select("ticker", F.expr(DAY), r6(E.without_jumps(F.col("r"))).alias("r"))


@query("long_short", PANEL_SQL + f", v AS (SELECT *, var_samp(r) OVER {frame(12)} AS v FROM panel), k AS (SELECT * FROM v WHERE f IS NOT NULL AND v > 0), d AS (SELECT *, (f - sum(f / v) OVER {CROSS} / sum(1 / v) OVER {CROSS}) / v AS d FROM k), e AS (SELECT *, least(0.1 / nullif(sqrt(sum(d * d * v) OVER {CROSS}), 0), 2.0 / nullif(sum(abs(d)) OVER {CROSS}, 0), 1.0 / nullif(max(abs(d)) OVER {CROSS}, 0)) AS c FROM d) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(d * c + 1e-8, 6) + 0.0 AS weight FROM e")
def long_short(spark, sf_dir):
    df = factor_panel(spark, sf_dir).withColumn("v", F.var_samp("r").over(B.KEYS.rows(12))).filter("f is not null and v > 0")
    return P.long_short(df, "f", "v").select("ticker", F.expr(DAY), r6("weight").alias("weight"))


@query("optimised_weights")
def optimised_weights(spark, sf_dir):
    """Long-short weights within a risk budget under the full covariance; tested against a search over feasible points."""
    panel = factor_panel(spark, sf_dir)
    out = P.optimised_full(panel, "f", K.ewma_covariance(panel.filter("r is not null"), "r", 16.0, 52))
    return out.select("ticker", F.expr(DAY), F.round("weight", 6).alias("weight"))


@query("multi_period_weights")
def multi_period_weights(spark, sf_dir):
    """Weights of all periods with a risk penalty under a factor covariance, at gross exposure 1."""
    panel = factor_panel(spark, sf_dir)
    out = P.optimised_full(panel, "f", K.ewma_covariance(panel.filter("r is not null"), "r", 16.0, 52), budget=None, penalty=0.1, gross=1.0, factors=20)
    return out.select("ticker", F.expr(DAY), F.round("weight", 6).alias("weight"))


@query("optimised_pnl")
def optimised_pnl(spark, sf_dir):
    from panelforge.plans import flows

    return flows.optimised_pnl(factor_panel(spark, sf_dir), "f", "r").select(F.expr(DAY), F.round("pnl", 5).alias("pnl"))


#: Weighted sums over all earlier rows: list x of values (nulls count as gaps) with weights that halve every 16 rows.
EWMA_SQL = """, l AS (SELECT *, list(r) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x FROM panel),
k AS (SELECT *, list_transform(x, lambda v, i: CASE WHEN v IS NOT NULL THEN CASE WHEN i = 1 THEN 1 ELSE 1 - pow(2, -1 / 16.0) END * pow(2, -(len(x) - i) / 16.0) END) AS w FROM l),
s AS (SELECT *, list_sum(w) AS w1, list_sum(list_transform(w, lambda v: v * v)) AS w2, list_sum(list_transform(x, lambda v, i: v * w[i])) / list_sum(w) AS m FROM k),
q AS (SELECT *, list_sum(list_transform(x, lambda v, i: w[i] * (v - m) * (v - m))) / w1 * w1 * w1 / nullif(w1 * w1 - w2, 0) AS var FROM s)
"""


@query("ewma_variance", PANEL_SQL + EWMA_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(greatest(CASE WHEN len(list_filter(x, lambda v: v IS NOT NULL)) > 1 THEN var * 52 END, 1e-10), 6) AS v FROM q")
def ewma_variance(spark, sf_dir):
    return K.ewma_variance(factor_panel(spark, sf_dir), "r", "v", 16.0, 52).select("ticker", F.expr(DAY), F.round("v", 6).alias("v"))


@query("ewma_covariance", PANEL_SQL + """, p AS (SELECT * FROM panel WHERE r IS NOT NULL), n AS (SELECT DISTINCT ticker FROM p), t AS (SELECT DISTINCT ts FROM p),
x AS (SELECT n.ticker, t.ts, coalesce(p.r, 0) AS r FROM n CROSS JOIN t LEFT JOIN p USING (ticker, ts)),
e AS (SELECT a.ticker AS a, b.ticker AS b, a.ts, list_reduce(list(a.r * b.r) OVER (PARTITION BY a.ticker, b.ticker ORDER BY a.ts ROWS UNBOUNDED PRECEDING), lambda s, v: s * pow(2, -1 / 16.0) + v * (1 - pow(2, -1 / 16.0))) AS c FROM x a JOIN x b ON a.ts = b.ts AND a.ticker <= b.ticker)
SELECT CAST(ts AS VARCHAR) AS ts, a, b, round(c * 52 + CASE WHEN a = b THEN 1e-10 ELSE 0 END + 1e-8, 6) + 0.0 AS covariance FROM e""")
def ewma_covariance(spark, sf_dir):
    c = K.ewma_covariance(factor_panel(spark, sf_dir).filter("r is not null"), "r", 16.0, 52)
    cells = c.select("ts", F.col("ticker").alias("a"), F.explode(F.arrays_zip("names", "covariance")).alias("z")).filter("a <= z.names")
    return cells.select(F.expr(DAY), "a", F.col("z.names").alias("b"), r6("z.covariance").alias("covariance"))


MACD = "m AS (SELECT ticker, ts, " + EMA.format(w=SERIES, keep=1 - 2 / 13, alpha=2 / 13) + " - " + EMA.format(w=SERIES, keep=1 - 2 / 27, alpha=2 / 27) + " AS macd FROM bars), g AS (SELECT *, " + EMA.format(w=SERIES, keep=1 - 2 / 10, alpha=2 / 10).replace("list(close)", "list(macd)") + " AS signal FROM m) "


@query("macd", BARS_SQL + ", " + MACD + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(macd + 1e-8, 6) + 0.0 AS macd, round(signal + 1e-8, 6) + 0.0 AS macd_signal, round(macd - signal + 1e-8, 6) + 0.0 AS macd_hist FROM g")
def macd(spark, sf_dir):
    return K.macd(weekly_bars(spark, sf_dir), "close").select("ticker", F.expr(DAY), *[r6(c).alias(c) for c in ("macd", "macd_signal", "macd_hist")])


@query("ppo", BARS_SQL + ", " + MACD.replace(" AS macd FROM bars)", " AS d, " + EMA.format(w=SERIES, keep=1 - 2 / 27, alpha=2 / 27) + " AS slow FROM bars), p AS (SELECT ticker, ts, d / slow * 100 AS macd FROM m)").replace("AS signal FROM m", "AS signal FROM p") + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(macd + 1e-8, 6) + 0.0 AS ppo, round(signal + 1e-8, 6) + 0.0 AS ppo_signal, round(macd - signal + 1e-8, 6) + 0.0 AS ppo_hist FROM g")
def ppo(spark, sf_dir):
    return K.macd(weekly_bars(spark, sf_dir), "close", percent=True).select("ticker", F.expr(DAY), *[r6(c).alias(c) for c in ("ppo", "ppo_signal", "ppo_hist")])


@query("decay_fill", BARS_SQL + f", v AS (SELECT *, last_value(gap IGNORE NULLS) OVER w AS v, last_value(CASE WHEN gap IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS t FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING)), h AS (SELECT *, floor((epoch_us(ts) - epoch_us(t)) / 3600000000) AS h FROM v) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(coalesce(gap, CASE WHEN h <= 400 THEN v * pow(0.5, h / 168.0) END), 6) AS gap FROM h")
def decay_fill(spark, sf_dir):
    return S.decay_filled(weekly_bars(spark, sf_dir), "gap", 168.0, 400).select("ticker", F.expr(DAY), F.round("gap", 6).alias("gap"))


# ---- bars of events, sessions, as-of and history joins ------------------------------------

STAMP = "CAST({0} AS STRING)"


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker = event_type, ts as an instant read as UTC wall time, price = value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "user_id")


EVENTS_SQL = "WITH e AS (SELECT event_id, event_type AS ticker, ts, value AS price, user_id FROM events)"
BINS_SQL = EVENTS_SQL + ", b AS (SELECT ticker, time_bucket(INTERVAL 30 MINUTES, ts) AS bin, last(price ORDER BY ts, event_id) AS price FROM e GROUP BY ALL)"


@query("bars_30m", BINS_SQL + " SELECT ticker, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, price FROM b")
def bars_30m(spark, sf_dir):
    return B.time_bins(events(spark, sf_dir), 30, "price", ["event_id"]).select("ticker", stamp("bin").alias("bin"), "price")


@query("forward_return_30m", BINS_SQL + " SELECT x.ticker, strftime(x.bin, '%Y-%m-%d %H:%M:%S') AS bin, x.price, round(CASE WHEN y.price IS NOT NULL THEN least(greatest(y.price / x.price - 1, -0.5), 0.5) END + 1e-8, 6) + 0.0 AS forward_return FROM b x LEFT JOIN b y ON x.ticker = y.ticker AND y.bin = x.bin + INTERVAL 30 MINUTES")
def forward_return_30m(spark, sf_dir):
    out = B.bin_forward_return(B.time_bins(events(spark, sf_dir), 30, "price", ["event_id"]), 30)
    return out.select("ticker", stamp("bin").alias("bin"), "price", r6("forward_return").alias("forward_return"))


@query("session_events", EVENTS_SQL + " SELECT event_id, ticker FROM e WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:30:00' AND '16:00:00'")
def session_events(spark, sf_dir):
    return B.regular_session(events(spark, sf_dir)).select("event_id", "ticker")


@query("split_session_events", EVENTS_SQL + " SELECT event_id FROM e WHERE strftime(ts, '%H:%M:%S') >= '09:30:00' AND strftime(ts, '%H:%M:%S') < '11:30:00' OR strftime(ts, '%H:%M:%S') >= '13:00:00' AND strftime(ts, '%H:%M:%S') < '14:57:00'")
def split_session_events(spark, sf_dir):
    return B.sessions(events(spark, sf_dir), [("09:30:00", "11:30:00"), ("13:00:00", "14:57:00")]).select("event_id")


@query("forward_return_by_day", EVENTS_SQL + " SELECT event_id, round(lead(price, 3) OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts, event_id) / price - 1 + 1e-8, 6) + 0.0 AS r FROM e")
def forward_return_by_day(spark, sf_dir):
    return B.forward_return(events(spark, sf_dir), "price", 3, "r", True, tie=["event_id"], guarded=False).select("event_id", r6("r").alias("r"))


def calls_and_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    calls = e.filter("event_type = 'signup'").select(F.col("event_id").alias("call_id"), "user_id", F.col("ts").alias("call_ts"))
    quotes = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("quote_ts"), F.col("value").alias("quote"), F.col("event_id").alias("quote_id"), (F.col("event_id") % 5).alias("analyst"))
    return calls, quotes


CALLS_SQL = "WITH c AS (SELECT event_id AS call_id, user_id, ts AS call_ts FROM events WHERE event_type = 'signup'), q AS (SELECT user_id, ts AS quote_ts, value AS quote, event_id AS quote_id, event_id % 5 AS analyst FROM events WHERE event_type = 'view') "


@query("asof_backward", CALLS_SQL + "SELECT call_id, quote FROM c ASOF LEFT JOIN q ON c.user_id = q.user_id AND c.call_ts >= q.quote_ts")
def asof_backward(spark, sf_dir):
    calls, quotes = calls_and_quotes(spark, sf_dir)
    return A.as_of(calls, quotes, "user_id", "call_ts", "quote_ts", ["quote"], tie=["quote_id"]).select("call_id", "quote")


@query("asof_forward_strict", CALLS_SQL + "SELECT call_id, quote FROM c ASOF LEFT JOIN q ON c.user_id = q.user_id AND c.call_ts < q.quote_ts")
def asof_forward_strict(spark, sf_dir):
    calls, quotes = calls_and_quotes(spark, sf_dir)
    return A.as_of(calls, quotes, "user_id", "call_ts", "quote_ts", ["quote"], "forward", True, tie=["quote_id"]).select("call_id", "quote")


@query("asof_tolerance", CALLS_SQL + "SELECT call_id, CASE WHEN epoch_us(call_ts) - epoch_us(quote_ts) <= 21600000000 THEN quote END AS quote FROM c ASOF LEFT JOIN q ON c.user_id = q.user_id AND c.call_ts >= q.quote_ts")
def asof_tolerance(spark, sf_dir):
    calls, quotes = calls_and_quotes(spark, sf_dir)
    return A.as_of(calls, quotes, "user_id", "call_ts", "quote_ts", ["quote"], tolerance=6 * 3_600_000_000, tie=["quote_id"]).select("call_id", "quote")


@query("asof_offset", CALLS_SQL + ", g AS (SELECT user_id, quote_ts, lead(quote, 2) OVER (PARTITION BY user_id ORDER BY quote_ts) AS quote FROM q) SELECT call_id, quote FROM c ASOF LEFT JOIN g ON c.user_id = g.user_id AND c.call_ts <= g.quote_ts")
def asof_offset(spark, sf_dir):
    calls, quotes = calls_and_quotes(spark, sf_dir)
    return A.at_position(calls, quotes, "user_id", "call_ts", "quote_ts", ["quote"], 2).select("call_id", "quote")


@query("range_before_after", CALLS_SQL + "SELECT call_id, quote_id FROM c JOIN q ON c.user_id = q.user_id AND epoch_us(quote_ts) - epoch_us(call_ts) BETWEEN -172800000000 AND 86400000000")
def range_before_after(spark, sf_dir):
    calls, quotes = calls_and_quotes(spark, sf_dir)
    return A.within(calls, quotes, "user_id", "call_ts", "quote_ts", -2 * S.DAY, S.DAY).select("call_id", "quote_id")


SIDE = "(SELECT call_id, avg(quote) AS m, count(*) AS n FROM (SELECT call_id, analyst, quote FROM c JOIN q ON c.user_id = q.user_id AND {0} QUALIFY row_number() OVER (PARTITION BY call_id, analyst ORDER BY quote_ts DESC, quote DESC) = 1) GROUP BY call_id)"
GAP = "epoch_us(quote_ts) - epoch_us(call_ts)"


@query("consensus_change", CALLS_SQL + f", p AS {SIDE.format(f'{GAP} > -5184000000000 AND {GAP} < 0')}, a AS {SIDE.format(f'{GAP} BETWEEN 0 AND 604800000000')} SELECT c.call_id, round(p.m, 6) AS mean_before, round(a.m, 6) AS mean_after, coalesce(p.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, round((a.m - p.m) / nullif(p.m, 0) * 100 + 1e-8, 6) + 0.0 AS pct_change FROM c LEFT JOIN p USING (call_id) LEFT JOIN a USING (call_id)")
def consensus_change(spark, sf_dir):
    calls, quotes = calls_and_quotes(spark, sf_dir)
    out = S.consensus_change(calls, quotes, "user_id", "call_id", "call_ts", "analyst", "quote_ts", "quote")
    return out.select("call_id", F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), "n_before", "n_after", r6("pct_change").alias("pct_change"))


@query("latest_per_group", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_group(spark, sf_dir):
    return A.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("last_k_history", "SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ',') AS history FROM events QUALIFY count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) > 0")
def last_k_history(spark, sf_dir):
    out = A.history(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id", 4)
    return out.filter(F.size("history") > 0).select("event_id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("oldest_before", "WITH f AS (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3) SELECT e.event_id, f.event_id AS earlier FROM events e JOIN f ON e.user_id = f.user_id AND f.ts < e.ts")
def oldest_before(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return A.oldest_before(e, "user_id", "ts", ["ts", "event_id"], 3).select("event_id", F.col("earlier.event_id").alias("earlier"))


@query("previous_report", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous_event_id FROM events")
def previous_report(spark, sf_dir):
    return A.previous(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"]).select("event_id", "previous_event_id")


@query("unprocessed_pairs", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def unprocessed_pairs(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return A.unprocessed(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_orderkey")


@query("range_zscore", EVENTS_SQL + " SELECT event_id, round((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0) + 1e-8, 6) + 0.0 AS z FROM e WINDOW w AS (PARTITION BY ticker ORDER BY epoch_us(ts) RANGE BETWEEN 1799999999 PRECEDING AND CURRENT ROW)")
def range_zscore(spark, sf_dir):
    return O.range_zscores(events(spark, sf_dir), ["price"], 30).select("event_id", r6("price_zscore").alias("z"))


# ---- analyst signals ----------------------------------------------------------------------

TARGETS_SQL = "WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS firm, c_mktsegment AS ticker, o_orderdate AS ts, o_totalprice AS target FROM orders JOIN customer ON o_custkey = c_custkey) "


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price targets: firm = o_orderpriority, ticker = c_mktsegment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("firm"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("target"), "o_custkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


@query("tpr_rank", TARGETS_SQL + "SELECT id, round(len(list_filter(h, lambda v: v < target)) * 1.0 / len(h) + 1e-8, 6) AS rank FROM (SELECT id, target, list(target) OVER (PARTITION BY firm, ticker ORDER BY epoch_us(ts) RANGE BETWEEN 5184000000000 PRECEDING AND CURRENT ROW) AS h FROM t) WHERE len(h) >= 2")
def tpr_rank(spark, sf_dir):
    df = targets(spark, sf_dir).withColumn("desk", F.concat_ws("|", "firm", "ticker"))
    return S.firm_rank(df, "desk", "ts", "target", 60).filter("rank is not null").select("id", r6("rank").alias("rank"))


@query("conviction_quintile", TARGETS_SQL + ", m AS (SELECT *, date_trunc('month', ts) AS month FROM t), q AS (SELECT firm, month, quantile_cont(target, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM m GROUP BY firm, month HAVING count(*) >= 5) SELECT id, CAST(greatest(len(list_filter(list_distinct(e), lambda v: v < target)), 1) - 3 AS DOUBLE) AS weight FROM m LEFT JOIN q USING (firm, month)")
def conviction_quintile(spark, sf_dir):
    df = targets(spark, sf_dir).withColumn("month", F.date_trunc("month", "ts"))
    return S.conviction(df, ["firm", "month"], "target").select("id", "weight")


@query("signal_grid", TARGETS_SQL + ", m AS (SELECT ticker, date_trunc('month', ts) AS month, avg(target) AS signal FROM t GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT date_trunc('month', ts) AS month FROM t), (SELECT DISTINCT ticker FROM t)) SELECT ticker, strftime(month, '%Y-%m') AS month, round(coalesce(signal, 0) + 1e-8, 4) AS signal FROM g LEFT JOIN m USING (ticker, month)")
def signal_grid(spark, sf_dir):
    df = targets(spark, sf_dir).withColumn("ts", F.date_trunc("month", "ts"))
    return S.signal_grid(df, "target", df, df).select("ticker", F.date_format("ts", "yyyy-MM").alias("month"), F.round(F.col("signal") + 1e-8, 4).alias("signal"))


@query("target_ratio", TARGETS_SQL + ", s AS (SELECT ticker, CAST(ts AS DATE) AS d, min(target) AS price FROM t GROUP BY ALL), x AS (SELECT id, target, ts, s.d, s.price FROM t ASOF LEFT JOIN s ON t.ticker = s.ticker AND t.ts > s.d) SELECT id, CASE WHEN epoch_us(ts) - epoch_us(d) <= 432000000000 THEN round(target / price + 1e-8, 6) END AS ratio FROM x")
def target_ratio(spark, sf_dir):
    t = targets(spark, sf_dir)
    prices = t.groupBy("ticker", F.to_date("ts").alias("d")).agg(F.min("target").alias("price")).withColumn("d", F.col("d").cast("timestamp"))
    return S.target_ratios(t, prices, "ticker", "ts", "d", "target", "price").select("id", r6("ratio").alias("ratio"))


@query("smoothing", "WITH h AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda s, x: 0.3 * x + 0.7 * s) + 1e-8, 6) AS s FROM h")
def smoothing(spark, sf_dir):
    out = S.smoothed(table(spark, sf_dir, "events"), "value", 0.3, "s", ["event_id"], Keys("user_id", "ts"))
    return out.select("user_id", r6("s").alias("s"))


@query("event_window_return", PANEL_SQL + "SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN count(r / 100) OVER w = 4 THEN product(1 + r / 100) OVER w - 1 END + 1e-8, 6) + 0.0 AS fwd FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)")
def event_window_return(spark, sf_dir):
    return S.compounded(factor_panel(spark, sf_dir).withColumn("r", F.col("r") / 100), "r", 1, 4, "fwd").select("ticker", F.expr(DAY), r6("fwd").alias("fwd"))


@query("trailing_volatility", PANEL_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN count(r) OVER {frame(20)} >= 10 THEN greatest(stddev_samp(r) OVER {frame(20)}, 1e-6) END + 1e-8, 6) AS v FROM panel")
def trailing_volatility(spark, sf_dir):
    return S.trailing_volatility(factor_panel(spark, sf_dir), "r", 20, 10, new="v").select("ticker", F.expr(DAY), r6("v").alias("v"))


# ---- labels, splits, metrics ------------------------------------------------------------------

POSITIVE = ["the", "of", "and", "die", "que"]
NEGATIVE = ["idiot", "clown", "scum", "trash", "moron", "worthless"]
SCORED_SQL = "WITH s AS (SELECT doc_id, regexp_extract_all(upper(coalesce(text, '')), '\\b([0-9A-Z_]+)\\b', 1) AS w FROM documents), p AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({0}))) AS positive, len(list_filter(w, lambda x: x IN ({1}))) AS negative, len(w) AS words FROM s)".format(*(", ".join(f"'{w.upper()}'" for w in ws) for ws in (POSITIVE, NEGATIVE)))


def ascii_words(c: str) -> Column:
    """Words of ASCII letters, digits and underscores, as both engines' regular expressions see them."""
    return F.regexp_extract_all(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(r"\b([0-9A-Z_]+)\b"), 1)


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = tokens.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_")).withColumn("w", ascii_words("text"))
    return tokens.select("doc_id", *[c.alias(n) for n, c in X.lexicon_counts(F.col("w"), [w.upper() for w in POSITIVE], [w.upper() for w in NEGATIVE]).items()])


LEXICON_SQL = SCORED_SQL.replace("upper(coalesce(text, ''))", "upper(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '_', 'g'))")


@query("lexicon_sentiment", LEXICON_SQL + " SELECT doc_id, positive, negative, words, positive - negative AS polarity, CASE WHEN positive > negative THEN 'Positive' WHEN positive < negative THEN 'Negative' ELSE 'Neutral' END AS label, round(coalesce((positive - negative) / nullif(words, 0), 0) + 1e-8, 6) + 0.0 AS ratio FROM p")
def lexicon_sentiment(spark, sf_dir):
    return lexicon(spark, sf_dir).withColumn("ratio", r6("ratio"))


CONFUSION_SQL = LEXICON_SQL + ", d AS (SELECT toxic AS t, CASE WHEN negative > 0 THEN 1 ELSE 0 END AS p FROM labels JOIN p USING (doc_id)), c AS (SELECT sum(CASE WHEN t = 1 AND p = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN t <> 1 AND p = 1 THEN 1.0 ELSE 0 END) AS fp, sum(CASE WHEN t = 1 AND p <> 1 THEN 1.0 ELSE 0 END) AS fn, sum(CASE WHEN t <> 1 AND p <> 1 THEN 1.0 ELSE 0 END) AS tn FROM d)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = lexicon(spark, sf_dir).select("doc_id", (F.col("negative") > 0).cast("int").alias("p"), "ratio")
    return table(spark, sf_dir, "labels").join(marks, "doc_id")


@query("class_metrics", CONFUSION_SQL + " SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST((tp + fp) AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c")
def class_metrics(spark, sf_dir):
    m = L.binary_metrics(labelled(spark, sf_dir), "toxic", "p")
    return m.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc")])


@query("multiclass_metrics", "WITH m AS (SELECT quality + toxic AS t, CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END + toxic AS p FROM labels JOIN documents USING (doc_id)), k AS (SELECT x.k, (SELECT count(*) FROM m WHERE t = x.k) AS t, (SELECT count(*) FROM m WHERE p = x.k) AS p, (SELECT count(*) FROM m WHERE t = x.k AND p = x.k) AS c FROM (SELECT t AS k FROM m UNION SELECT p FROM m) x), f AS (SELECT *, coalesce(2.0 * c / nullif(t + p, 0), 0) AS f1 FROM k) SELECT round(sum(c) * 1.0 / sum(t), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * t) / sum(t), 6) AS weighted_f1, round((sum(c) * CAST(sum(t) AS DOUBLE) - sum(t * p)) / sqrt((CAST(sum(t) AS DOUBLE) * sum(t) - sum(p * p)) * (CAST(sum(t) AS DOUBLE) * sum(t) - sum(t * t))), 6) AS mcc FROM f")
def multiclass_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    df = table(spark, sf_dir, "labels").join(d, "doc_id").select((F.col("quality") + F.col("toxic")).alias("t"), ((F.col("n") > 2000).cast("int") + F.col("toxic")).alias("p"))
    return L.multiclass_metrics(df, "t", "p").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "mcc")])


@query("regression_metrics", "WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS p FROM lineitem) SELECT count(*) AS n, round(avg((p - y) * (p - y)), 4) AS mse, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(1 - avg((p - y) * (p - y)) / var_pop(y), 5) AS r2, round(corr(y, p), 5) AS correlation, round(avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0 END), 6) AS sign_accuracy FROM d")
def regression_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("p"))
    return L.regression_metrics(df, "y", "p").select("n", *[F.round(c, 4).alias(c) for c in ("mse", "rmse", "mae")], F.round("r2", 5).alias("r2"), F.round("correlation", 5).alias("correlation"), F.round("sign_accuracy", 6).alias("sign_accuracy"))


@query("quantile_labels", "WITH q AS (SELECT quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM events WHERE ts < TIMESTAMP '2024-01-20') SELECT event_id, greatest(len(list_filter(e, lambda x: x < value)), 1) AS label FROM events, q")
def quantile_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    edges = e.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    edges = R.quantiles(edges, "value", [k / 5 for k in range(6)]).withColumnRenamed("edges", "e")
    return e.crossJoin(F.broadcast(edges)).select("event_id", S.bucket(F.col("value"), F.col("e"), False).alias("label"))


@query("three_classes", PANEL_SQL + "SELECT CASE WHEN r IS NULL OR r < -0.01 THEN 0 WHEN r > 0.01 THEN 2 ELSE 1 END AS label, count(*) AS n, round(avg(r) + 1e-8, 6) + 0.0 AS centre FROM panel GROUP BY 1")
def three_classes(spark, sf_dir):
    df = factor_panel(spark, sf_dir).withColumn("label", L.three_classes(F.col("r")))
    return L.class_centres(df, "r", "label").select("label", "n", r6("centre").alias("centre"))


@query("chrono_split", "SELECT CASE WHEN ts <= TIMESTAMP '2024-01-10' THEN 'train' WHEN ts BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-18' THEN 'valid' WHEN ts >= TIMESTAMP '2024-01-20' THEN 'test' END AS split, count(*) AS n FROM events GROUP BY 1")
def chrono_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(L.chronological(F.col("ts"), "2024-01-10", ("2024-01-12", "2024-01-18"), "2024-01-20").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("embargo_split", "WITH e AS (SELECT event_id, ts, ts + INTERVAL 1 DAY AS done FROM events), u AS (SELECT *, done < TIMESTAMP '2024-01-22' - INTERVAL 80 HOURS AS usable FROM e), b AS (SELECT quantile_cont(epoch_us(ts) / 1e6, 0.8) AS b FROM u WHERE usable AND ts < TIMESTAMP '2024-01-22') SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-22' THEN 'test' WHEN usable AND epoch_us(ts) / 1e6 >= b THEN 'valid' WHEN usable AND epoch_us(done) / 1e6 < b THEN 'train' END AS split FROM u, b")
def embargo_split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("done", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return L.embargo_split(e, "ts", "done", "2024-01-22", 80).select("event_id", "split")


@query("rolling_folds", """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT min(day) AS a, max(day) AS b FROM o),
f AS (SELECT CAST(k AS INTEGER) AS fold, CAST(a + to_months(48 + 3 * CAST(k AS INTEGER)) AS DATE) AS x, CAST(a + to_months(51 + 3 * CAST(k AS INTEGER)) AS DATE) AS y FROM e, range(0, 400) r(k) WHERE CAST(a + to_months(48 + 3 * CAST(k AS INTEGER)) AS DATE) <= b)
SELECT fold, strftime(x, '%Y-%m-%d') AS test_start, strftime(y, '%Y-%m-%d') AS test_end, count(day) FILTER (day < x) AS train_rows, count(day) FILTER (day >= x AND day < y) AS test_rows FROM f CROSS JOIN o GROUP BY ALL""")
def rolling_folds(spark, sf_dir):
    out = L.rolling_folds(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.select("fold", F.date_format("test_start", "yyyy-MM-dd").alias("test_start"), F.date_format("test_end", "yyyy-MM-dd").alias("test_end"), "train_rows", "test_rows")


@query("winsorised", "WITH q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events) SELECT event_id, round(least(greatest(value, a), b) + 1e-8, 6) AS value FROM events, q")
def winsorised(spark, sf_dir):
    return L.winsorised(table(spark, sf_dir, "events"), "value", 0.05, 0.95).select("event_id", r6("value").alias("value"))


@query("train_scaled", "WITH q AS (SELECT stddev_pop(value) AS s FROM events WHERE event_id % 2 = 0) SELECT event_id, round(value / s + 1e-8, 6) AS value FROM events, q")
def train_scaled(spark, sf_dir):
    return L.scaled(table(spark, sf_dir, "events"), ["value"], F.col("event_id") % 2 == 0).select("event_id", r6("value").alias("value"))


@query("stratified_folds", "SELECT quality, f AS fold, (n - f + 4) // 5 AS n FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1), (SELECT unnest(range(5)) AS f) WHERE n > f")
def stratified_folds(spark, sf_dir):
    return L.stratified_folds(table(spark, sf_dir, "labels"), "quality", "doc_id", 5).groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("matrix_profile", "WITH c AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT dim, round(avg(CAST(x AS DOUBLE)) + 1e-8, 6) + 0.0 AS mean, round(stddev_samp(CAST(x AS DOUBLE)) + 1e-8, 6) AS std, count(*) FILTER (x IS NULL) AS missing FROM c GROUP BY dim")
def matrix_profile(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("embedding"))
    return L.matrix_profile(e, "embedding").select("dim", r6("mean").alias("mean"), r6("std").alias("std"), "missing")


# ---- text, JSON, timestamps -----------------------------------------------------------------------


@query("json_props", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("first_numbers", "SELECT doc_id, TRY_CAST(nullif(regexp_extract(replace(text, ',', ''), '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) AS x FROM documents")
def first_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_number(F.col("text")).alias("x"))


@query("word_chunks", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w FROM documents) SELECT doc_id, CAST(ceil(len(w) / 100.0) AS INTEGER) AS chunks, md5(array_to_string(list_transform(range(0, len(w), 100), lambda i: array_to_string(w[i + 1:i + 100], ' ')), '|')) AS held FROM w")
def word_chunks(spark, sf_dir):
    chunks = X.word_chunks(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunks).alias("chunks"), F.md5(F.array_join(chunks, "|").cast("binary")).alias("held"))


@query("plain_text", "SELECT doc_id, length(t) AS n, md5(t) AS plain FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)")
def plain_text(spark, sf_dir):
    plain = X.plain_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(plain).alias("n"), F.md5(plain.cast("binary")).alias("plain"))


TITLES = "SELECT s_suppkey, s_name || ' (' || upper(substr(s_name, 1, 3)) || ') reports' AS title FROM supplier"


@query("regex_ticker", f"SELECT s_suppkey, nullif(regexp_extract(title, '\\(([A-Z]{{1,5}})\\)', 1), '') AS ticker FROM ({TITLES})")
def regex_ticker(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" ("), F.upper(F.substring("s_name", 1, 3)), F.lit(") reports")).alias("title"))
    return s.select("s_suppkey", X.ticker(F.col("title"), F.lit(None).cast("string"))[0].alias("ticker"))


@query("transcript_ticker")
def transcript_ticker(spark, sf_dir):
    """The ticker that a text names, by the seven patterns, of every document; tested against brute force."""
    found, where = X.ticker(F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("ticker"), where.alias("found_in"))


@query("et_timestamp", "SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS eastern FROM events")
def et_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT")).alias("s"))
    return e.select("event_id", F.date_format(X.to_eastern(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("eastern"))


@query("directional_score", "SELECT event_id, CASE WHEN CAST(value AS INTEGER) % 20 <= 10 THEN CAST(value AS INTEGER) % 20 END AS score FROM (SELECT event_id, floor(value) AS value FROM events)")
def directional_score(spark, sf_dir):
    note = F.concat(F.lit("Summary. Direction: "), (F.floor("value") % 20).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.directional_score(note).alias("score"))


@query("exchange_codes", "SELECT c_custkey, CASE WHEN substr(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 1, 1) IN ('6', '9') THEN 'SH.' ELSE 'SZ.' END || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer")
def exchange_codes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.exchange_code(F.col("c_custkey")).alias("code"))


@query("numbered_scores", "SELECT event_id, least(floor(value) % 14, 10) + 3.5 + 48 * 5 AS total FROM events")
def numbered_scores(spark, sf_dir):
    reply = F.concat(F.lit("1. "), (F.floor("value") % 14).cast("string"), F.lit("\n2. 3.5"))
    return table(spark, sf_dir, "events").select("event_id", F.aggregate(X.numbered_scores(reply), F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("common_chunks")
def common_chunks(spark, sf_dir):
    from pyspark.sql.window import Window

    turns = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return X.without_common_chunks(turns, "text", "before", "fresh").select("conv_id", "turn", F.length("fresh").alias("n"))


# ---- facts and vectors --------------------------------------------------------------------------------

FACTS_SQL = "WITH f AS (SELECT o_orderpriority AS ticker, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, o_orderstatus AS metric, sum(o_totalprice) AS value FROM orders GROUP BY ALL), k AS (SELECT *, CAST(substr(quarter, 1, 4) AS INTEGER) * 4 + CAST(substr(quarter, 7, 1) AS INTEGER) - 1 AS q FROM f) "


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), q.alias("quarter"), F.col("o_orderstatus").alias("metric")).agg(F.sum("o_totalprice").alias("value"))


@query("quarter_changes", FACTS_SQL + "SELECT a.ticker, a.quarter, a.metric, round(a.value - b.value + 1e-8, 2) + 0.0 AS change FROM k a JOIN k b ON a.ticker = b.ticker AND a.metric = b.metric AND a.q = b.q + 1")
def quarter_changes(spark, sf_dir):
    return G.quarter_changes(facts(spark, sf_dir)).select("ticker", "quarter", "metric", (F.round(F.col("change") + 1e-8, 2) + F.lit(0.0)).alias("change"))


@query("year_over_year", FACTS_SQL + "SELECT a.ticker, a.quarter, a.metric, round(a.value - b.value + 1e-8, 2) + 0.0 AS change FROM k a JOIN k b ON a.ticker = b.ticker AND a.metric = b.metric AND a.q = b.q + 4")
def year_over_year(spark, sf_dir):
    return G.quarter_changes(facts(spark, sf_dir), 4).select("ticker", "quarter", "metric", (F.round(F.col("change") + 1e-8, 2) + F.lit(0.0)).alias("change"))


@query("decumulated", FACTS_SQL + "SELECT ticker, quarter, metric, round(value - coalesce(lag(value) OVER (PARTITION BY ticker, metric, substr(quarter, 1, 4) ORDER BY q), 0) + 1e-8, 2) + 0.0 AS single FROM k")
def decumulated(spark, sf_dir):
    return G.decumulated(facts(spark, sf_dir)).select("ticker", "quarter", "metric", (F.round(F.col("single") + 1e-8, 2) + F.lit(0.0)).alias("single"))


@query("graph_tables", FACTS_SQL + ", v AS (SELECT CAST(ticker AS VARCHAR) AS t, quarter, metric, value FROM f) SELECT * FROM (SELECT 'Ticker' AS label, count(DISTINCT t) AS nodes, count(*) AS edges FROM v UNION ALL SELECT 'Quarter', count(DISTINCT quarter), count(*) FROM v UNION ALL SELECT 'Metric', count(DISTINCT metric), count(*) FROM v UNION ALL SELECT 'Value', count(DISTINCT value), count(*) FROM v UNION ALL SELECT 'Fact', count(*), NULL FROM v)")
def graph_tables(spark, sf_dir):
    nodes, edges = G.graph_tables(facts(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")))
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("nodes")).join(edges.groupBy("label").agg(F.count(F.lit(1)).alias("edges")), "label", "left")


@query("vector_topk", "WITH u AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings), p AS (SELECT q.vec_id AS query, u.vec_id, list_sum(list_transform(list_zip(u.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / u.n / q.n AS score, u.label <> q.label AS other FROM u, u q WHERE q.vec_id % 20 = 0), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10) SELECT query, vec_id, round(score + 1e-8, 5) + 0.0 AS score FROM t WHERE score > 0.3 AND other")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding", "label")
    out = G.nearest(e, queries, 10, 0.3, condition=F.col("label") != F.col("q_label"))
    return out.select("query", "vec_id", (F.round(F.col("score") + 1e-8, 5) + F.lit(0.0)).alias("score"))


@query("usage_cost", "SELECT event_type AS agent, count(*) AS calls, sum(event_id) AS input_tokens, sum(user_id) AS output_tokens, round(sum(event_id * 0.15 + user_id * 0.6) / 1e6 + 1e-8, 6) AS cost FROM events GROUP BY 1")
def usage_cost(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("agent"), F.lit("small").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return G.usage_cost(log, {"small": (0.15, 0.6)}).withColumn("cost", r6("cost"))


# ---- order book ---------------------------------------------------------------------------------------------


def book(spark: SparkSession, sf_dir: str, levels: int = 3) -> DataFrame:
    """A deterministic book around the weekly close."""
    df = weekly_bars(spark, sf_dir)
    cols = {}
    for i in range(1, levels + 1):
        cols |= {f"price_ask_{i}": F.col("close") * (1 + i * 0.001), f"price_bid_{i}": F.col("close") * (1 - i * 0.001), f"volume_ask_{i}": F.col("volume") * i, f"volume_bid_{i}": F.col("trades").cast("double") * (levels + 1 - i)}
    return df.select("ticker", "ts", *[c.alias(n) for n, c in cols.items()])


BOOK_SQL = BARS_SQL + ", k AS (SELECT ticker, ts, " + ", ".join(f"close * (1 + {i} * 0.001) AS a{i}, close * (1 - {i} * 0.001) AS b{i}, volume * {i} AS va{i}, CAST(trades * {4 - i} AS DOUBLE) AS vb{i}" for i in (1, 2, 3)) + " FROM bars) "


@query("book_features", BOOK_SQL + f"SELECT ticker, CAST(ts AS VARCHAR) AS ts, round((vb1 - va1) / nullif(vb1 + va1, 0) + 1e-8, 6) + 0.0 AS imbalance_1, round((vb1 + vb2 + vb3 - va1 - va2 - va3) / nullif(vb1 + vb2 + vb3 + va1 + va2 + va3, 0) + 1e-8, 6) + 0.0 AS cum_imbalance, round(a2 - b2 + 1e-8, 5) AS spread_2, round(abs(a3 - a2) + 1e-8, 5) AS ask_diff_2, round(a3 - a1 + 1e-8, 5) AS ask_span, round((a1 + a2 + a3) / 3 + 1e-8, 5) AS mean_price_ask, round((lead((a1 + b1) / 2, 2) OVER {SERIES} - (a1 + b1) / 2) / ((a1 + b1) / 2) + 1e-8, 6) + 0.0 AS target_2 FROM k")
def book_features(spark, sf_dir):
    df = book(spark, sf_dir)
    for step in (O.imbalances, O.spreads_and_mids, O.price_differences, O.level_means, O.accumulated_differences):
        df = step(df, 3)
    df = O.targets(df, [1, 2])
    return df.select("ticker", F.expr(DAY), *[r6(c).alias(c) for c in ("imbalance_1", "cum_imbalance", "target_2")], *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("spread_2", "ask_diff_2", "ask_span", "mean_price_ask")])


@query("book_pipeline", BOOK_SQL + f", t AS (SELECT ticker, ts, (vb1 + vb2 + vb3 - va1 - va2 - va3) / nullif(vb1 + vb2 + vb3 + va1 + va2 + va3, 0) AS close, (lead((a1 + b1) / 2, 5) OVER {SERIES} - (a1 + b1) / 2) / ((a1 + b1) / 2) AS t5 FROM k), u AS (SELECT * FROM t WHERE t5 IS NOT NULL) SELECT ticker, CAST(ts AS VARCHAR) AS ts, round(" + EMA.format(w=SERIES, keep=1 - 2 / 6, alpha=2 / 6) + " - " + EMA.format(w=SERIES, keep=1 - 2 / 21, alpha=2 / 21) + " + 1e-8, 6) + 0.0 AS momentum, round(t5 + 1e-8, 6) + 0.0 AS target_5 FROM u")
def book_pipeline(spark, sf_dir):
    return O.features(book(spark, sf_dir), 3, 5).select("ticker", F.expr(DAY), r6("cum_imbalance_momentum").alias("momentum"), r6("target_5").alias("target_5"))


@query("training_windows", BARS_SQL + f", n AS (SELECT ticker, ts, close, row_number() OVER {SERIES} AS n, lag(volume, 19) OVER {SERIES} AS first, sum(close * volume) OVER {frame(20)} AS turned FROM bars) SELECT ticker, CAST(ts AS VARCHAR) AS ts, 20 AS rows, round(close, 6) AS label, first AS first_volume, round(turned + 1e-8, 3) AS turned FROM n WHERE n >= 20 AND (n - 20) % 5 = 0")
def training_windows(spark, sf_dir):
    w = O.windows(weekly_bars(spark, sf_dir), ["close", "volume"], "close", 20, 5)
    turned = F.aggregate("window", F.lit(0.0), lambda s, x: s + x[0] * x[1])
    return w.select("ticker", F.expr(DAY), F.size("window").alias("rows"), F.round("label", 6).alias("label"), F.col("window")[0][1].alias("first_volume"), F.round(turned + 1e-8, 3).alias("turned"))


@query("month_split", BARS_SQL + ", s AS (SELECT ticker, ts, row_number() OVER w AS i, count(*) OVER (PARTITION BY ticker, date_trunc('month', ts)) AS n FROM bars WINDOW w AS (PARTITION BY ticker, date_trunc('month', ts) ORDER BY ts)) SELECT ticker, CAST(ts AS VARCHAR) AS ts, CASE WHEN month(ts) % 2 = 1 THEN 'train' WHEN i * 2 <= n THEN 'valid' ELSE 'test' END AS split FROM s")
def month_split(spark, sf_dir):
    return O.month_split(weekly_bars(spark, sf_dir)).select("ticker", F.expr(DAY), "split")


@query("rank_transform", "SELECT event_id, round((SELECT count(*) FROM events t WHERE t.event_id % 3 = 0 AND t.value < e.value) * 1.0 / (SELECT count(*) FROM events WHERE event_id % 3 = 0) + 1e-8, 6) AS p FROM events e")
def rank_transform(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return O.rank_transform(e, "value", e.filter("event_id % 3 = 0"), "p").select("event_id", r6("p").alias("p"))


# ---- streams ---------------------------------------------------------------------------------------------------


def drained(spark: SparkSession, sf_dir: str, build, mode: str = "append", after: str | None = None) -> DataFrame:
    """What a stream over the events table has written once all its input is read; ``after`` adds a closing event."""
    from panelforge.sources.scratch import shared_folder
    from panelforge.streaming import stream as R

    base = shared_folder(spark)
    events = table(spark, sf_dir, "events")
    rows = R.read_events(spark, f"{sf_dir}/event[s].parquet", events.schema)
    if after:
        R.closing_event(events, "ts", after).write.parquet(f"{base}/closing")
        rows = rows.unionByName(R.read_events(spark, f"{base}/closing", events.schema))
    R.into_table(build(R, rows.withColumn("ts", F.col("ts").cast("timestamp"))), f"{base}/out", f"{base}/state", mode)
    return spark.read.parquet(f"{base}/out")


@query("stream_bars", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS bin, first(value ORDER BY ts, value) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, value) AS close, count(*) AS n FROM events GROUP BY event_type, date_trunc('day', ts)")
def stream_bars(spark, sf_dir):
    return drained(spark, sf_dir, lambda R, e: R.streaming_bars(e, "event_type", "ts", "value", "1 day"), after="2 DAYS").select("event_type", stamp("bin").alias("bin"), "open", "high", "low", "close", "n")


@query("stream_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM g GROUP BY user_id, g")
def stream_sessions(spark, sf_dir):
    return drained(spark, sf_dir, lambda R, e: R.streaming_sessions(e, "user_id", "ts", "6 hours"), after="1 DAY").select("user_id", stamp("start").alias("start"), stamp("end").alias("end"), "n")


@query("stream_average", "SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(list_reduce(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 200 PRECEDING), lambda a, b: a * 0.8 + b * 0.2) + 1e-8, 6) AS average FROM events")
def stream_average(spark, sf_dir):
    return drained(spark, sf_dir, lambda R, e: R.streaming_average(e, "event_type", "ts", "value", 0.2, "event_id")).select("event_type", stamp("ts").alias("ts"), r6("average").alias("average"))


# ---- relational operators as the flows use them ------------------------------------------------------------------


@query("value_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_join(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("common_names", "SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def common_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type = 'signup'").select("user_id").intersect(e.filter("event_type = 'view'").select("user_id"))


@query("missing_names", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def missing_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("top_customers", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10")
def top_customers(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return g.orderBy(F.desc("t"), "o_custkey").limit(10).select("o_custkey", F.round("t", 2).alias("total"))


@query("brand_volume_rank", "WITH v AS (SELECT p_brand, sum(l_quantity) / count(DISTINCT CAST(l_shipdate AS DATE)) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, round(v + 1e-8, 6) AS mean_volume, rank() OVER (ORDER BY v DESC) AS r FROM v")
def brand_volume_rank(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = rows.groupBy("p_brand").agg((F.sum("l_quantity") / F.count_distinct(F.to_date("l_shipdate"))).alias("v"))
    return g.select("p_brand", r6("v").alias("mean_volume"), F.rank().over(Window.orderBy(F.desc("v"))).alias("r"))


@query("single_segment_days", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, min(o_orderstatus) AS status FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def single_segment_days(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.min("o_orderstatus").alias("status"), F.count_distinct("o_orderstatus").alias("k"))
    return g.filter("k = 1").select(F.col("d").cast("string").alias("day"), "status")


@query("return_matrix_all", BARS_SQL + "SELECT CAST(ts AS VARCHAR) AS ts, " + ", ".join(f"max(CASE WHEN ticker = 'Brand#{k}' THEN close END) AS brand_{k}" for k in range(1, 26)) + " FROM bars GROUP BY ts")
def return_matrix_all(spark, sf_dir):
    """The matrix of all tickers and weeks; the names are those of the table."""
    names = [r[0] for r in table(spark, sf_dir, "part").select("p_brand").filter("p_brand IS NOT NULL").distinct().orderBy("p_brand").collect()]
    wide = B.to_matrix(weekly_bars(spark, sf_dir), "close", names)
    return wide.select(F.expr(DAY), *[F.col(f"`{n}`").alias(n.lower().replace("#", "_")) for n in names])


LAGGED_SQL = "SELECT {0} AS lag, ticker, time_bucket(INTERVAL 30 MINUTES, ts) + INTERVAL 30 MINUTES AS bin, last(f ORDER BY ts, event_id) AS f FROM (SELECT *, lag(price, {0}) OVER (PARTITION BY ticker ORDER BY ts, event_id) AS f FROM e) WHERE f IS NOT NULL GROUP BY ALL"


@query("aligned_factor", EVENTS_SQL + f" SELECT ticker, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, f FROM ({LAGGED_SQL.format(1)})")
def aligned_factor(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("f", F.col("price"))
    return B.lagged_factor(rows, "f", 30, tie=["event_id"]).select("ticker", stamp("bin").alias("bin"), "f")


# ---- whole flows ---------------------------------------------------------------------------------------------------

REPORTED = {"momentum": MOMENTUM, "level": call("cs_rank", "volume"), "twin": call("cs_rank", "volume"), "reversal": call("neg", call("ts_zscore", "close", 8))}


@query("leakage_check")
def leakage_check(spark, sf_dir):
    """How many (week, ticker) values of the flagship change when only later rows do: none."""
    import datetime

    from panelforge.plans import flows

    panel = weekly_bars(spark, sf_dir)
    times = [datetime.date(1996, 1, 1), datetime.date(1997, 6, 2), datetime.date(1999, 3, 1)]
    return flows.leaks(panel, MOMENTUM, ["close"], times).agg(F.count(F.lit(1)).alias("n"))


@query("mean_vectors", "WITH c AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, count(*) / 64.0 AS n, round(sum(CAST(x AS DOUBLE)) / (count(*) / 64.0) + 1e-8, 5) + 0.0 AS total FROM c GROUP BY label")
def mean_vectors(spark, sf_dir):
    from panelforge.plans import flows

    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    m = flows.mean_vectors(e, ["label"], "v")
    return m.select("label", F.col("n").cast("double").alias("n"), (F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b) + 1e-8, 5) + F.lit(0.0)).alias("total"))
