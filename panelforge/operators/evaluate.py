"""Factor and portfolio statistics over long (ts, ticker, f, r) panels and (ts, value) series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.factor import clip, cs_rank
from panelforge.functions.panel import KEYS, Keys, correlation, nonzero
from panelforge.operators.ranks import average_ranks

PERIODS = 3276
Z95 = 1.959963984540054


def information_coefficients(df: DataFrame, f: str = "f", r: str = "r", keys: Keys = KEYS) -> DataFrame:
    """(time, ic, n): the correlation of factor and return over the names of each time; null for two pairs or fewer."""
    both = F.col(f).isNotNull() & F.col(r).isNotNull()
    g = df.filter(both).groupBy(keys.time).agg(correlation(f, r).alias("c"), F.count(F.lit(1)).alias("n"))
    return g.select(keys.time, F.when(F.col("n") > 2, F.col("c")).alias("ic"), "n")


def rank_information_coefficients(df: DataFrame, f: str = "f", r: str = "r", keys: Keys = KEYS) -> DataFrame:
    both = df.filter(F.col(f).isNotNull() & F.col(r).isNotNull())
    ranked = both.withColumn("__f", cs_rank(F.col(f), keys)).withColumn("__r", cs_rank(F.col(r), keys))
    return information_coefficients(ranked, "__f", "__r", keys)


def hac_tstat(series: DataFrame, value: str, order: str, lags: int = 5) -> DataFrame:
    """One row: n, mean and the Newey-West t-statistic of the mean (Bartlett weights); 0 below ten observations. The
    series is one value for each time, already small next to the panel it came from."""
    x = series.filter(F.col(value).isNotNull()).select(F.col(order).alias("o"), F.col(value).alias("x"))
    mean = x.agg(F.avg("x").alias("mean"), F.count("x").alias("n"))
    e = x.crossJoin(F.broadcast(mean)).withColumn("e", F.col("x") - F.col("mean"))  # one row is broadcast
    w = Window.partitionBy(F.lit(0)).orderBy("o")
    e = e.withColumns({f"e{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    g = e.agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    v = F.col("g0") + 2 * reduce(lambda a, b: a + b, [F.lit(1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)])
    t = F.try_divide(F.col("mean"), nonzero(F.sqrt(nonzero(F.greatest(v, F.lit(0.0))) / F.col("n") / F.col("n"))))
    return g.select("n", "mean", F.when(F.col("n") < 10, 0.0).otherwise(t).alias("t_stat"))


def row_pnl(df: DataFrame, f: str = "f", r: str = "r", cap: float = 3.0, least: int = 10, eps: float = 1e-6, keys: Keys = KEYS) -> DataFrame:
    """(time, pnl): factor z-scored over all names that have one and capped; of the names with a return too, demeaned, at
    unit gross exposure, times the return. Null below ``least`` such names."""
    c = keys.cross()
    df = df.withColumns({"__m": F.avg(f).over(c), "__s": F.stddev_samp(f).over(c)})
    z = F.when(F.col("__s") > eps, clip((F.col(f) - F.col("__m")) / F.col("__s"), F.lit(-cap), F.lit(cap)))
    df = df.withColumn("__z", F.when(F.col(f).isNotNull() & F.col(r).isNotNull(), z))
    df = df.withColumn("__w", F.col("__z") - F.avg("__z").over(c))
    gross = F.sum(F.abs("__w"))
    return df.groupBy(keys.time).agg(F.when(F.count("__z") >= least, F.try_divide(F.sum(F.col("__w") * F.col(r)), nonzero(gross))).alias("pnl"))


def without_jumps(r: Column, most: float = 1.0) -> Column:
    """Returns beyond +-``most`` and missing ones as 0."""
    return F.when(F.abs(r) > most, 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


def without_spikes(x: Column, most: float = 0.5) -> Column:
    return F.when(F.abs(x) > most, None).otherwise(x)


def sharpe(series: DataFrame, value: str, periods: int = PERIODS, by: list[str] | None = None) -> DataFrame:
    """mean, std, n, annualised Sharpe and its 95% interval (+- z / sqrt(n)); 0 for n < 2 or a flat series."""
    g = series.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    s = F.when((F.col("n") >= 2) & (F.col("std") > 1e-12), F.col("mean") * F.sqrt(F.lit(float(periods))) / F.col("std")).otherwise(0.0)
    half = F.try_divide(F.lit(Z95), F.sqrt(nonzero(F.col("n"))))
    return g.withColumn("sharpe", s).withColumn("low", F.col("sharpe") - half).withColumn("high", F.col("sharpe") + half)


def equity(series: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Adds the compounded curve, its running peak and the drawdown."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = series.withColumn("equity", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))
    return df.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.try_divide(F.col("equity"), nonzero(F.col("peak"))) - 1)


def lagged_dot(df: DataFrame, signal: str, returns: str, lags: list[int], keys: Keys = KEYS) -> DataFrame:
    """(lag, time, pnl): sum over names of the signal ``lag`` rows ago times the return, all lags in one pass."""
    s = keys.series()
    dots = df.withColumns({f"__l{k}": F.lag(signal, k).over(s) * F.col(returns) for k in lags})
    sums = dots.groupBy(keys.time).agg(*[F.sum(f"__l{k}").alias(f"__l{k}") for k in lags])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__l{k}").alias("pnl")) for k in lags]))
    return sums.select(keys.time, pairs.alias("p")).select("p.lag", keys.time, "p.pnl")


def cross_lag_rank_ic(df: DataFrame, f: str, r: str, lags: list[int], least: int = 10, keys: Keys = KEYS) -> DataFrame:
    """(lag, ic, n): Spearman correlation of the shifted factor and the return, pooled over all rows. Ranks come from
    counts by value (``ranks.average_ranks``), so no task ranks all rows."""
    s = keys.series()
    wide = df.withColumns({f"__f{k}": F.lag(f, k).over(s) for k in lags})
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__f{k}").alias("f")) for k in lags]))
    rows = wide.select(F.col(r).alias("r"), pairs.alias("p")).select("p.lag", "p.f", "r").filter("f is not null and r is not null")

    for column in ("f", "r"):
        rows = rows.join(average_ranks(rows, column, ["lag"]).withColumnRenamed("rank", f"rank_{column}"), ["lag", column])
    ranked = rows
    g = ranked.groupBy("lag").agg(correlation("rank_f", "rank_r").alias("c"), F.count(F.lit(1)).alias("n"))
    return g.select("lag", F.when(F.col("n") >= least, F.col("c")).otherwise(0.0).alias("ic"), "n")


def coverage_start(df: DataFrame, f: str, share: float = 0.5, keys: Keys = KEYS) -> DataFrame:
    """One row: the first time at which at least ``share`` of all names have a factor."""
    names = df.agg(F.count_distinct(keys.entity).alias("names"))
    by_time = df.groupBy(keys.time).agg(F.count(f).alias("n"))
    return by_time.crossJoin(F.broadcast(names)).filter(F.col("n") >= share * F.col("names")).agg(F.min(keys.time).alias("start"))


def thin_months(df: DataFrame, value: str, least: int, keys: Keys = KEYS) -> DataFrame:
    """Months with fewer than ``least`` non-null values."""
    g = df.groupBy(F.date_trunc("month", keys.time).alias("month")).agg(F.count(value).alias("n"))
    return g.filter(F.col("n") < least)


def quantile_portfolio(df: DataFrame, f: str, r: str, high: float = 0.8, low: float = 0.2, keys: Keys = KEYS) -> DataFrame:
    """(time, pnl, gross): mean over names of yesterday's position (+1 above, -1 below the rank limits) times the return."""
    rank = cs_rank(F.col(f), keys)
    df = df.withColumn("__rank", rank)
    df = df.withColumn("__p", F.when(F.col("__rank") > high, 1.0).when(F.col("__rank") < low, -1.0).otherwise(0.0))
    df = df.withColumn("__held", F.lag("__p", 1).over(keys.series()))
    return df.groupBy(keys.time).agg(F.avg(F.col("__held") * F.col(r)).alias("pnl"), F.avg(F.abs("__held")).alias("gross"))


def performance(series: DataFrame, value: str, order: str, periods: int = PERIODS) -> DataFrame:
    """One row: total and annual return, Sharpe, win rate and largest drawdown of a (time, return) series."""
    curve = equity(series.filter(F.col(value).isNotNull()), value, order)
    g = curve.agg(
        (F.product(1 + F.col(value)) - 1).alias("total_return"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"),
        F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), F.min("drawdown").alias("max_drawdown"),
    )
    return g.withColumn("annual_return", F.pow(1 + F.col("total_return"), F.lit(float(periods)) / nonzero(F.col("n"))) - 1).withColumn("sharpe", F.try_divide(F.col("mean") * F.sqrt(F.lit(float(periods))), nonzero(F.col("std"))))


def periods_in_year(df: DataFrame, year: int, keys: Keys = KEYS) -> DataFrame:
    """One row: the number of distinct times in a year, and the first and last of them."""
    rows = df.filter(F.year(keys.time) == year).select(keys.time).distinct()
    return rows.agg(F.count(F.lit(1)).alias("periods"), F.min(keys.time).alias("first"), F.max(keys.time).alias("last"))
