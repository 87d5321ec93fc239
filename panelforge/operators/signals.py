"""Analyst signals: target ratios, ranks within firms, conviction, signal grids, smoothing, decay and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.panel import KEYS, Keys, nonzero
from panelforge.operators.asof import as_of, latest, micros, within
from panelforge.operators.kernels import ewm
from panelforge.operators.ranks import sliding_below, with_below
from panelforge.sources.scratch import written

DAY = 86_400_000_000


def target_ratios(targets: DataFrame, prices: DataFrame, key: str, target_time: str, price_time: str, target: str, price: str, days: int = 5, new: str = "ratio") -> DataFrame:
    """Target over the last positive price in the ``days`` before."""
    positive = prices.filter(F.col(price) > 0)
    return as_of(targets, positive, key, target_time, price_time, [price], "backward", True, days * DAY).withColumn(new, F.try_divide(F.col(target), nonzero(F.col(price))))


def firm_rank(df: DataFrame, firm: str, time: str, value: str, days: int = 365, least: int = 2, new: str = "rank") -> DataFrame:
    """Share of the firm's values strictly below the row's in the ``days`` up to it, same-day peers included. Null where the
    firm, the time or the value is, or with fewer than ``least`` values."""
    at = df.withColumn("__at", micros(time))
    found = sliding_below(at, value, [firm], "__at", days * DAY, 30 * DAY)
    found = found.select(F.col(firm).alias("__f"), F.col("__at").alias("__a"), F.col(value).alias("__v"), "below", "held")
    out = at.join(found, (F.col(firm) == F.col("__f")) & (F.col("__at") == F.col("__a")) & (F.col(value) == F.col("__v")), "left")
    return out.select(*df.columns, F.when(F.col("held") >= least, F.col("below") / F.col("held")).alias(new))


def quantile_edges(values: Column, k: int) -> Column:
    """The k + 1 linear quantiles of a column, as an aggregate."""
    return F.percentile(values, [i / k for i in range(k + 1)])


def bucket(x: Column, edges: Column, distinct: bool = True) -> Column:
    """The 1-based right-closed bucket of x among ``edges``, the lowest edge included; equal edges merge."""
    inner = F.array_distinct(edges) if distinct else edges
    return F.when(x.isNotNull(), F.greatest(F.size(F.filter(inner, lambda e: e < x)), F.lit(1)))


def conviction(df: DataFrame, by: list[str], value: str, least: int = 5, new: str = "weight") -> DataFrame:
    """-2..2 by quintile of the group's values; null below ``least`` rows."""
    edges = df.groupBy(*by).agg(quantile_edges(F.col(value), 5).alias("__edges"), F.count(value).alias("__n")).filter(F.col("__n") >= least)
    return df.join(edges, by, "left").withColumn(new, (bucket(F.col(value), F.col("__edges")) - 3).cast("double")).drop("__edges", "__n")


def signal_grid(df: DataFrame, weight: str, names: DataFrame, times: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Mean weight on the full grid of ``times`` and ``names``, 0 where there is none. Both are small lists of keys; the
    grid itself is the result."""
    mean = df.groupBy(keys.time, keys.entity).agg(F.avg(weight).alias("signal"))
    grid = times.select(keys.time).distinct().crossJoin(names.select(keys.entity).distinct())
    return grid.join(mean, [keys.time, keys.entity], "left").withColumn("signal", F.coalesce("signal", F.lit(0.0)))


def smoothed(df: DataFrame, value: str, alpha: float = 0.3, new: str = "smoothed", tie: list[str] | None = None, keys: Keys = KEYS) -> DataFrame:
    """(entity, new): the exponential smoothing of a series at its last row: s0 = x0, s = alpha x + (1 - alpha) s. Rows without
    a value are left out. A scan over blocks: no series is gathered."""
    rows = df.filter(F.col(value).isNotNull()).select(keys.entity, keys.time, *(tie or []), value)
    run = ewm(rows, {"__s": (value, alpha)}, keys, tie=tie)
    return run.groupBy(keys.entity).agg(F.max_by("__s", F.struct(keys.time, *(tie or []))).alias(new))


def decay_filled(df: DataFrame, value: str, half_life: float, most: float | None = None, keys: Keys = KEYS, new: str | None = None) -> DataFrame:
    """Gaps filled with the last value halved every ``half_life`` hours (whole hours count), up to ``most`` hours."""
    before = keys.series().rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col(value).isNotNull(), micros(keys.time))
    df = df.withColumns({"__v": F.last(value, ignorenulls=True).over(before), "__t": F.last(seen, ignorenulls=True).over(before)})
    hours = F.floor((micros(keys.time) - F.col("__t")) / 3_600_000_000)
    filled = F.col("__v") * F.pow(F.lit(0.5), hours / F.lit(half_life))
    if most is not None:
        filled = F.when(hours <= most, filled)
    return df.withColumn(new or value, F.coalesce(F.col(value), filled)).drop("__v", "__t")


def consensus_change(events: DataFrame, estimates: DataFrame, key: str, event_id: str, event_time: str, analyst: str, estimate_time: str, value: str, before: int = 60, after: int = 7) -> DataFrame:
    """By event: mean of each analyst's latest value in the ``before`` days up to it and in the ``after`` days from it,
    counts, and the percent change."""

    def mean(rows: DataFrame, side: str) -> DataFrame:
        last = latest(rows, [event_id, analyst], [F.col(estimate_time).desc(), F.col(value).desc()])
        return last.groupBy(event_id).agg(F.avg(value).alias(f"mean_{side}"), F.count(F.lit(1)).alias(f"n_{side}"))

    points = events.select(event_id, key, event_time)
    rows = estimates.select(key, analyst, estimate_time, value)
    past = mean(within(points, rows, key, event_time, estimate_time, -before * DAY, 0, open_start=True, open_end=True), "before")
    coming = mean(within(points, rows, key, event_time, estimate_time, 0, after * DAY), "after")
    out = events.join(past, event_id, "left").join(coming, event_id, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_before", "n_after")})
    return out.withColumn("pct_change", F.try_divide(F.col("mean_after") - F.col("mean_before"), nonzero(F.col("mean_before"))) * 100)


def compounded(df: DataFrame, r: str, start: int, end: int, new: str, keys: Keys = KEYS) -> DataFrame:
    """prod(1 + r) - 1 over the rows start..end ahead, null unless all are there."""
    w = keys.series().rowsBetween(start, end)
    return df.withColumn(new, F.when(F.count(r).over(w) == end - start + 1, F.product(1 + F.col(r)).over(w) - 1))


def trailing_volatility(df: DataFrame, r: str, rows: int = 168, least: int = 10, floor: float = 1e-6, new: str = "volatility", keys: Keys = KEYS) -> DataFrame:
    w = keys.rows(rows)
    return df.withColumn(new, F.when(F.count(r).over(w) >= least, F.greatest(F.stddev_samp(r).over(w), F.lit(floor))))


def normalised_forward_return(prices: DataFrame, events: DataFrame, event_id: str, event_time: str, price: str, days: int = 5, window: int = 63, least: int = 5, new: str = "r", keys: Keys = KEYS) -> DataFrame:
    """(event_id, new): for the first price date at or after an event, the return from the date before it to the one after
    it, over the standard deviation of the returns of the ``window`` dates up to it. Unscaled where there are fewer
    dates, fewer than ``least`` returns or a flat window; null without those two prices or with fewer than ``days``
    dates to come. Dates are those of the whole table, as in a wide matrix."""
    one, none = F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("c")
    dates = prices.select(keys.time).filter(F.col(keys.time).isNotNull()).distinct().withColumn("__at", micros(keys.time))
    asked = events.withColumn("__at", micros(event_time))
    # A date's number, and that of the first date at or after an event, is the count of dates below, and one.
    both = dates.select("__at", one).unionByName(asked.select("__at", none).filter("__at is not null").distinct()).groupBy("__at").agg(F.sum("c").alias("c"))
    placed = written(with_below(both, "__at").select("__at", (F.col("below") + 1).alias("__k")))
    dates = dates.join(placed, "__at").drop("__at")
    total = dates.agg(F.max("__k").alias("__dates"))
    grid = dates.crossJoin(prices.select(keys.entity).distinct())  # dates x names, as in a wide matrix
    grid = grid.join(prices.select(*[keys.entity, keys.time], price), [keys.entity, keys.time], "left")
    s = keys.series()
    grid = grid.withColumns({"__p0": F.lag(price).over(s), "__p1": F.lead(price).over(s)})
    grid = grid.withColumn("__ret", F.try_divide(F.col(price), nonzero(F.col("__p0"))) - 1)
    frame = s.rowsBetween(-(window - 2), 0)
    std = F.when((F.col("__k") >= window) & (F.count("__ret").over(frame) >= least), nonzero(F.stddev_samp("__ret").over(frame)))
    raw = F.try_divide(F.col("__p1") - F.col("__p0"), nonzero(F.col("__p0")))
    grid = grid.withColumn("__std", std).crossJoin(F.broadcast(total))  # one row
    grid = grid.withColumn(new, F.when(F.col("__dates") - F.col("__k") >= days, F.coalesce(raw / F.col("__std"), raw)))
    at = asked.join(placed, "__at", "left")
    return at.join(grid.select(keys.entity, "__k", new), [keys.entity, "__k"], "left").select(event_id, new)


def horizon_returns(calls: DataFrame, returns: DataFrame, key: str, time: str, at: str, r: str, horizons: list[int]) -> DataFrame:
    """``calls`` with T_timestamp (T, the first grid hour at or after the call's time, rounded up to the hour) and, for each horizon k,
    return_k: the compounded returns of the call's name over T+1..T+k; missing returns count as 0. Null where the
    name has no returns, T is beyond the grid, or T+k is. The grid is every hour of ``returns`` (key, at, r).

    Positions are counts of grid hours below (no global window); products are differences of prefix sums of log |1 + r|
    with counts of negative and zero factors, so a horizon costs one look-up and not a window."""
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    grid = returns.select(second(at).alias("__s")).filter("__s is not null").distinct().withColumn("c", F.lit(1).cast("long"))
    hours = F.ceil(F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000) * 3600
    asked = calls.withColumn("__s", hours.cast("long"))
    both = grid.unionByName(asked.select("__s", F.lit(0).cast("long").alias("c")).filter("__s is not null").distinct()).groupBy("__s").agg(F.sum("c").alias("c"))
    placed = with_below(both, "__s").select("__s", F.col("below").alias("__pos"), "c")
    hour_at = placed.filter("c = 1").select(F.col("__pos"), F.col("__s").alias("__hour"))
    n = grid.agg(F.count(F.lit(1)).alias("__hours"))
    factor = F.lit(1.0) + F.coalesce(F.col(r), F.lit(0.0))
    w = Window.partitionBy(key).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = returns.withColumn("__s", second(at)).join(placed.select("__s", "__pos"), "__s").select(
        key, "__pos", F.sum(F.when(factor != 0, F.ln(F.abs(factor))).otherwise(0.0)).over(w).alias("__log"),
        F.sum((factor < 0).cast("long")).over(w).alias("__neg"), F.sum((factor == 0).cast("long")).over(w).alias("__zero"),
    )
    asked = asked.withColumn("__call", F.monotonically_increasing_id())
    asked = written(asked.join(placed.select("__s", "__pos"), "__s", "left").crossJoin(F.broadcast(n)))  # one row
    known = returns.select(key).distinct().withColumn("__known", F.lit(True))
    ends = asked.select("__call", key, F.explode(F.array(*[F.struct(F.lit(k).alias("__step"), (F.col("__pos") + k).alias("__to")) for k in (0, *horizons)])).alias("__e"))
    ends = ends.select("__call", key, "__e.__step", F.timestamp_seconds("__e.__to").alias("__at"))
    steps = sums.withColumn("__at", F.timestamp_seconds("__pos"))
    found = as_of(ends, steps, key, "__at", "__at", ["__log", "__neg", "__zero"])
    value = lambda c, k: F.max(F.when(F.col("__step") == k, F.coalesce(c, F.lit(0)))).alias(f"{c}{k}")
    sides = found.groupBy("__call").agg(*[value(c, k) for c in ("__log", "__neg", "__zero") for k in (0, *horizons)])
    out = asked.join(known, key, "left").join(hour_at, "__pos", "left").join(sides, "__call")
    sign = lambda k: F.when((F.col(f"__neg{k}") - F.col("__neg0")) % 2 == 0, 1.0).otherwise(-1.0)
    product = lambda k: F.when(F.col(f"__zero{k}") > F.col("__zero0"), 0.0).otherwise(sign(k) * F.exp(F.col(f"__log{k}") - F.col("__log0")))
    fits = lambda k: F.col("__known") & (F.col("__pos") + k < F.col("__hours"))
    return out.select(*calls.columns, F.when(fits(0), F.timestamp_seconds("__hour")).alias("T_timestamp"), *[F.when(fits(k), product(k) - 1).alias(f"return_{k}") for k in horizons])
