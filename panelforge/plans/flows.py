"""Whole flows: factor reports, leakage checks, backtests and sweeps, composed of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.panel import KEYS, Keys, finite, nonzero
from panelforge.operators import evaluate, kernels, portfolio
from panelforge.plans.expr import compiled, distinct_factors


def loose_zscore(x: Column, n: int = 60, least: int = 30, keys: Keys = KEYS) -> Column:
    """Rolling z-score from ``least`` values up; 0 where there is none."""
    w = keys.rows(n)
    z = F.when(F.count(x).over(w) >= least, F.try_divide(x - F.avg(x).over(w), nonzero(F.stddev_samp(x).over(w))))
    return F.coalesce(z, F.lit(0.0))


def filled(x: Column) -> Column:
    """Missing, NaN and infinite values as 0."""
    return F.coalesce(finite(x), F.lit(0.0))


def combined(df: DataFrame, factors: list[str], new: str = "alpha", how: str = "mean", n: int = 60, least: int = 30, keys: Keys = KEYS) -> DataFrame:
    """The mean or median of the factors' rolling z-scores, scored once more."""
    z = {f"__z{i}": loose_zscore(F.col(f), n, least, keys) for i, f in enumerate(factors)}
    values = F.array(*z)
    middle = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / len(factors)
    if how == "median":
        ranked, k = F.array_sort(values), len(factors)
        middle = (F.element_at(ranked, (k + 1) // 2) + F.element_at(ranked, k // 2 + 1)) / 2
    return df.withColumns(z).withColumn("__c", middle).withColumn(new, loose_zscore(F.col("__c"), n, least, keys)).drop("__c", *z)


def factor_report(panel: DataFrame, factors: dict[str, object], r: str, periods: int = evaluate.PERIODS, lags: int = 5, keys: Keys = KEYS) -> DataFrame:
    """One row for each distinct factor: times, mean IC, its HAC t-statistic, Sharpe. The panel is compiled once and read
    once for all of them: factors are stacked to long form after the windows."""
    kept = distinct_factors(factors)
    wide = compiled(panel.select(*panel.columns), kept, keys)
    stacked = wide.select(keys.time, keys.entity, F.col(r).alias("__r"), F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), finite(F.col(n)).alias("f")) for n in kept])).alias("p"))
    rows = stacked.select(keys.time, keys.entity, "__r", "p.factor", "p.f").filter("f is not null")
    by = Keys(keys.entity, "__at")
    rows = rows.withColumn("__at", F.struct("factor", keys.time))
    ic = evaluate.information_coefficients(rows, "f", "__r", by).select("__at.factor", F.col(f"__at.{keys.time}").alias("t"), "ic")
    pnl = evaluate.row_pnl(rows, "f", "__r", keys=by).select("__at.factor", F.col(f"__at.{keys.time}").alias("t"), evaluate.without_spikes(F.col("pnl")).alias("pnl"))
    stats = evaluate.sharpe(pnl, "pnl", periods, ["factor"]).select("factor", "sharpe", F.col("n").alias("times"))
    return stats.join(hac_by(ic, "factor", "t", "ic", lags), "factor")


def hac_by(series: DataFrame, by: str, order: str, value: str, lags: int = 5) -> DataFrame:
    """``evaluate.hac_tstat`` for many series at once."""
    from pyspark.sql.window import Window

    x = series.filter(F.col(value).isNotNull())
    e = x.withColumn("__e", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    w = Window.partitionBy(by).orderBy(order)
    e = e.withColumns({f"__e{k}": F.lag("__e", k).over(w) for k in range(1, lags + 1)})
    g = e.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ic"), F.sum(F.col("__e") * F.col("__e")).alias("g0"), *[F.coalesce(F.sum(F.col("__e") * F.col(f"__e{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    v = F.col("g0") + 2 * reduce(lambda a, b: a + b, [F.lit(1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)])
    t = F.try_divide(F.col("mean_ic"), nonzero(F.sqrt(nonzero(F.greatest(v, F.lit(0.0))) / F.col("n") / F.col("n"))))
    return g.select(by, "mean_ic", F.when(F.col("n") < 10, 0.0).otherwise(t).alias("t_stat"))


def best_factors(report: DataFrame, by: str, k: int = 10) -> DataFrame:
    return report.orderBy(F.desc_nulls_last(by), "factor").limit(k)


def significance(report: DataFrame) -> DataFrame:
    """One row: factors, and how many are significant at 5 and 1 percent."""
    t = F.abs("t_stat")
    return report.agg(F.count(F.lit(1)).alias("factors"), F.sum((t > 1.96).cast("long")).alias("at_5"), F.sum((t > 2.576).cast("long")).alias("at_1"))


def leaks(panel: DataFrame, factor, columns: list[str], times: list, scale: float = 0.1, tolerance: float = 1e-8, keys: Keys = KEYS) -> DataFrame:
    """(test, entity) whose factor value at a test time changes when only later rows are perturbed. ``factor`` is a tree, or
    a function (table, new column) -> table. All tests run in one job: the panel is copied once for each, the copies
    told apart by the entity; the noise is a hash of the row."""
    tests = F.explode(F.array(*[F.struct(F.lit(i).alias("test"), F.lit(t).alias("at")) for i, t in enumerate(times)]))
    copies = panel.withColumn("__t", tests).select("*", "__t.test", "__t.at").drop("__t")
    noise = lambda c: (F.pmod(F.xxhash64(keys.entity, keys.time, F.lit(c)), F.lit(2001)) - 1000) / 1000.0
    entity = {keys.entity: F.concat_ws("#", F.col(keys.entity).cast("string"), F.col("test").cast("string"))}
    after = F.col(keys.time) > F.col("at")
    shaken = copies.withColumns({c: F.when(after, F.col(c) * (1 + scale * noise(c))).otherwise(F.col(c)) for c in columns})

    def value(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumns(entity)
        out = factor(df, name) if callable(factor) else compiled(df, {name: factor}, keys)
        return out.filter(F.col(keys.time) == F.col("at")).select("test", keys.entity, name)

    both = value(copies, "a").join(value(shaken, "b"), ["test", keys.entity])
    changed = (F.abs(F.col("a") - F.col("b")) > tolerance) | (F.col("a").isNull() != F.col("b").isNull())
    return both.filter(changed).select("test", F.substring_index(keys.entity, "#", 1).alias(keys.entity))


def leak_report(panel: DataFrame, factors: dict[str, object], columns: list[str], times: list, scale: float = 0.1, tolerance: float = 1e-8, keys: Keys = KEYS) -> DataFrame:
    """(factor, status, changes) for every factor, in one job: clean or leak, with the number of (test, entity) values that
    change when only later rows are perturbed; error (changes null) for a factor that cannot be built. The panel is copied
    twice for each test, as it is and perturbed, the copies told apart by the entity; all trees are compiled together."""
    built, failed = {}, []
    for name, factor in factors.items():
        try:
            factor(panel, "__f").schema if callable(factor) else compiled(panel, {"__f": factor}, keys).schema  # noqa: B018
            built[name] = factor
        except Exception:  # whatever a factor does wrong, the others are still judged
            failed.append(name)
    tests = F.explode(F.array(*[F.struct(F.lit(i).alias("test"), F.lit(t).alias("at"), F.lit(side).alias("side")) for i, t in enumerate(times) for side in (0, 1)]))
    copies = panel.withColumn("__name", F.col(keys.entity)).withColumn("__c", tests).withColumns({"__test": F.col("__c.test"), "__at": F.col("__c.at"), "__side": F.col("__c.side")}).drop("__c")
    noise = lambda c: (F.pmod(F.xxhash64(keys.entity, keys.time, F.lit(c)), F.lit(2001)) - 1000) / 1000.0
    shaken = (F.col("__side") == 1) & (F.col(keys.time) > F.col("__at"))
    df = copies.withColumns({c: F.when(shaken, F.col(c) * (1 + scale * noise(c))).otherwise(F.col(c)) for c in columns})
    df = df.withColumn(keys.entity, F.concat_ws("#", F.col(keys.entity).cast("string"), "__test", "__side"))
    own = {n: f"__f{i}" for i, n in enumerate(built)}
    kept = df.columns
    df = compiled(df, {own[n]: f for n, f in built.items() if not callable(f)}, keys)
    for n, f in built.items():
        if callable(f):
            df = f(df, own[n])
    at = df.filter(F.col(keys.time) == F.col("__at")).select(*[c for c in kept if c.startswith("__")], *own.values())
    value = lambda c, side: F.max(F.when(F.col("__side") == side, F.col(c)))
    pairs = at.groupBy("__test", "__name").agg(*[value(c, s).alias(f"{c}_{s}") for c in own.values() for s in (0, 1)])
    changed = lambda c: ((F.abs(F.col(f"{c}_0") - F.col(f"{c}_1")) > tolerance) | (F.col(f"{c}_0").isNull() != F.col(f"{c}_1").isNull())).cast("long")
    sums = pairs.agg(*[F.coalesce(F.sum(changed(c)), F.lit(0)).alias(c) for c in own.values()])
    rows = [F.struct(F.lit(n).alias("factor"), F.when(F.col(c) > 0, "leak").otherwise("clean").alias("status"), F.col(c).alias("changes")) for n, c in own.items()]
    rows += [F.struct(F.lit(n).alias("factor"), F.lit("error").alias("status"), F.lit(None).cast("long").alias("changes")) for n in failed]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def without_leaks(panel: DataFrame, factors: dict[str, object], columns: list[str], times: list, keys: Keys = KEYS) -> dict[str, object]:
    """The factors that pass the leakage check, and those that it could not judge."""
    bad = {r["factor"] for r in leak_report(panel, factors, columns, times, keys=keys).filter("status = 'leak'").collect()}  # a row a factor
    return {n: t for n, t in factors.items() if n not in bad}


def with_tickers(rows: DataFrame, title: str, text: str, stamp: str, path: str) -> DataFrame:
    """Writes the rows that name a ticker and have an Eastern time stamp to ``path``, with the ticker, and gives one row of
    counts, gathered by the same pass: rows, those without ticker, without zone, kept, and found in title or transcript."""
    from pyspark.sql import Observation

    from panelforge.functions import text as X

    found, where = X.ticker(F.col(title), F.col(text))
    rows = rows.withColumns({"__ticker": found, "__where": where, "__zone": X.has_eastern_zone(F.col(stamp))})
    named = F.col("__ticker").isNotNull()
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    seen = Observation()
    counts = {"original_rows": F.count(F.lit(1)), "no_ticker_dropped": n(~named), "non_et_timezone_dropped": n(named & ~F.col("__zone")), "final_rows": n(named & F.col("__zone")), "title_source_count": n(F.col("__where") == "title"), "transcript_source_count": n(F.col("__where") == "transcript")}
    watched = rows.observe(seen, *[c.alias(k) for k, c in counts.items()])
    watched.filter(named & F.col("__zone")).withColumn("ticker", F.col("__ticker")).drop("__ticker", "__where", "__zone").write.parquet(path)
    got = seen.get
    return rows.sparkSession.createDataFrame([tuple(int(got[k]) for k in counts)], ", ".join(f"{k} bigint" for k in counts))


def backtest(df: DataFrame, signal: str, r: str, lag: int = 1, half_life: float = 128.0, periods: int = 2016, how: str = "long_short", keys: Keys = KEYS) -> DataFrame:
    """(time, pnl): signal to Gaussian ranks, exponentially weighted variance, weights, and yesterday's weights times
    the return."""
    df = portfolio.gaussianised(df, signal, "__alpha", keys=keys)
    df = kernels.ewma_variance(df, r, "__v", half_life, periods, keys=keys)
    # The variance known at a time may use returns up to the one before only.
    df = df.withColumn("__v", F.lag("__v", 1).over(keys.series()))
    make = portfolio.long_only if how == "long_only" else portfolio.long_short
    df = make(df.filter("__v is not null"), "__alpha", "__v", "__w", keys=keys)
    return evaluate.lagged_dot(df, "__w", r, [lag], keys).select(keys.time, "pnl")


def optimised_pnl(df: DataFrame, f: str = "f", r: str = "r", lookback: int = 1008, least: int = 10, budget: float = 0.1, gross: float = 2.0, keys: Keys = KEYS) -> DataFrame:
    """(time, pnl): the factor's normal scores over names that have a return too, optimised long-short under the variances
    of the ``lookback`` rows before, times the return; null below ``least`` names."""
    from panelforge.functions.factor import clip, cs_rank

    c = keys.cross()
    before = keys.series().rowsBetween(-lookback, -1)
    df = df.withColumns({"__var": F.var_samp(r).over(before), "__rows": F.count(F.lit(1)).over(before)})
    df = df.filter(F.col(f).isNotNull() & F.col(r).isNotNull())
    n = F.count(F.lit(1)).over(c)
    df = df.withColumns({"__n": n, "__rank": cs_rank(F.col(f), keys)})
    df = portfolio.with_inverse_normal(df, F.col("__rank") * F.col("__n") / (F.col("__n") + 1), "__z")
    score = F.when(F.col("__n") > 2, clip(F.col("__z"), F.lit(-3.0), F.lit(3.0))).otherwise(F.col(f))
    variance = F.when(F.col("__rows") >= 20, F.greatest(F.col("__var"), F.lit(1e-6))).otherwise(F.abs(r) + 1e-6)
    df = df.withColumns({"__score": score, "__v": variance}).select(keys.time, keys.entity, r, "__n", "__score", "__v")
    weights = portfolio.optimised(df, "__score", "__v", "__w", budget, 0.0, gross, keys=keys)
    return weights.groupBy(keys.time).agg(F.when(F.first("__n") >= least, F.sum(F.col("__w") * F.col(r))).alias("pnl"))


def sweep(df: DataFrame, signal: str, r: str, half_lives: list[float], lags: list[int], periods: int = 2016, keys: Keys = KEYS) -> DataFrame:
    """(half_life, lag, sharpe) over a grid of settings, pivoted at a sink. Signal ranks are worked out once, all variances
    in one pass by name, and all lags in one pass over the weights."""
    df = portfolio.gaussianised(df, signal, "__alpha", keys=keys).select(keys.time, keys.entity, r, "__alpha")
    df = kernels.ewma_variances(df, r, {f"__v{i}": h for i, h in enumerate(half_lives)}, periods, keys=keys)
    stacked = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("half_life"), F.col(f"__v{i}").alias("v")) for i, h in enumerate(half_lives)]))
    rows = df.select(keys.time, keys.entity, r, "__alpha", stacked.alias("p")).select(keys.time, r, "__alpha", "p.half_life", "p.v", F.struct("p.half_life", keys.entity).alias("__name"))
    by = Keys("__name", "__at")
    rows = rows.withColumn("__at", F.struct("half_life", keys.time))
    rows = rows.withColumn("__v", F.lag("v", 1).over(by.series())).filter("__v is not null")
    weights = portfolio.long_short(rows, "__alpha", "__v", "__w", keys=by)
    dots = evaluate.lagged_dot(weights, "__w", r, lags, by).select("__at.half_life", "lag", "pnl")
    return evaluate.sharpe(dots, "pnl", periods, ["half_life", "lag"]).select("half_life", "lag", "sharpe")


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """By group: the element-wise mean of an array column and the number of rows."""
    cells = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))
    return cells.groupBy(*by).agg(pairs.alias("p"), F.max("n").alias("n")).select(*by, F.transform("p", lambda c: c["x"]).alias(vector), "n")
