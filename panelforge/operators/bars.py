"""Bars, sessions, resampling and forward returns over long (ticker, ts, price, volume) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.panel import KEYS, Keys, nonzero


def bars(df: DataFrame, bin_: Column, price: str, volume: str, order: list[str], keys: Keys = KEYS) -> DataFrame:
    """Open, high, low, close, volume by entity and bin. ``order`` is a total order of the rows inside a bin."""
    at = F.struct(*order, price)
    rows = df.withColumn("__bin", bin_)
    return rows.groupBy(keys.entity, F.col("__bin").alias(keys.time)).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"), F.count(F.lit(1)).alias("trades"),
    )


def regular_session(df: DataFrame, start: str = "09:30:00", end: str = "16:00:00", zone: str | None = None, keys: Keys = KEYS) -> DataFrame:
    """Rows of the regular session, both ends included; ``zone`` converts UTC times to that zone first."""
    local = F.from_utc_timestamp(keys.time, zone) if zone else F.col(keys.time)
    return df.filter(F.date_format(local, "HH:mm:ss").between(start, end))


def sessions(df: DataFrame, spans: list[tuple[str, str]], keys: Keys = KEYS) -> DataFrame:
    """Rows within any of several [start, end) spans of the day, as for markets with a midday break."""
    clock = F.date_format(keys.time, "HH:mm:ss")
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((clock >= a) & (clock < b))
    return df.filter(inside)


def time_bins(df: DataFrame, minutes: int, price: str, tie: list[str], keys: Keys = KEYS) -> DataFrame:
    """The last price of each left-closed bin."""
    rows = df.withColumn("__w", F.window(keys.time, f"{minutes} minutes"))
    return rows.groupBy(keys.entity, F.col("__w.start").alias("bin")).agg(F.max_by(price, F.struct(keys.time, *tie)).alias("price"))


def bin_forward_return(binned: DataFrame, minutes: int, cap: float = 0.5, keys: Keys = KEYS) -> DataFrame:
    """Return from a bin to the bin right after it; null where that bin is empty, so no session is crossed."""
    after = binned.select(keys.entity, (F.col("bin") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("bin"), F.col("price").alias("__next"))
    r = F.try_divide(F.col("__next"), nonzero(F.col("price"))) - 1
    joined = binned.join(after, [keys.entity, "bin"], "left").withColumn("__r", r)
    capped = F.when(F.col("__r").isNotNull(), F.least(F.greatest(F.col("__r"), F.lit(-cap)), F.lit(cap)))
    return joined.select(keys.entity, "bin", "price", capped.alias("forward_return"))


def lagged_factors(df: DataFrame, factor: str, minutes: int, row_lags: list[int], tie: list[str] | None = None, keys: Keys = KEYS) -> DataFrame:
    """(lag, entity, bin, factor) at bin starts, known by then: shifted by each number of rows, last of its bin, then one
    whole bin later. All lags in one pass; rows of one time are in order of ``tie``."""
    from pyspark.sql.window import Window

    order = [keys.time, *(tie or [])]
    s = Window.partitionBy(keys.entity).orderBy(*order)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__f{k}").alias("f")) for k in row_lags]))
    rows = df.withColumns({f"__f{k}": F.lag(factor, k).over(s) for k in row_lags}).select(keys.entity, *order, pairs.alias("p"))
    rows = rows.select(keys.entity, *order, "p.lag", "p.f").filter("f is not null").withColumn("__w", F.window(keys.time, f"{minutes} minutes"))
    binned = rows.groupBy("lag", keys.entity, F.col("__w.start").alias("bin")).agg(F.max_by("f", F.struct(*order)).alias(factor))
    return binned.withColumn("bin", F.col("bin") + F.expr(f"INTERVAL {minutes} MINUTES"))


def lagged_factor(df: DataFrame, factor: str, minutes: int, row_lag: int = 1, tie: list[str] | None = None, keys: Keys = KEYS) -> DataFrame:
    return lagged_factors(df, factor, minutes, [row_lag], tie, keys).drop("lag")


def sampled_names(df: DataFrame, n: int, seed: int = 42, keys: Keys = KEYS) -> DataFrame:
    """At most ``n`` names, the same ones for a seed wherever the rows lie: those with the least hashes."""
    return df.select(keys.entity).distinct().orderBy(F.md5(F.concat(F.col(keys.entity).cast("string"), F.lit(f"#{seed}")))).limit(n)


def aligned(factor: DataFrame, returns: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Factor and forward return on their common (entity, bin)."""
    return factor.join(returns, [keys.entity, "bin"])


def forward_return(df: DataFrame, price: str, horizon: int, new: str = "r", by_day: bool = False, keys: Keys = KEYS, tie: list[str] | None = None, guarded: bool = True) -> DataFrame:
    """price[t + horizon] / price[t] - 1 by rows, within the day if asked; rows of one time are in order of ``tie``. After a
    price of 0 it is null or, if not ``guarded``, infinite (NaN from 0 to 0)."""
    from pyspark.sql.window import Window

    day = [F.to_date(keys.time)] if by_day else []
    w = Window.partitionBy(keys.entity, *day).orderBy(keys.time, *(tie or []))
    later = F.lead(price, horizon).over(w)
    ratio = F.try_divide(later, nonzero(F.col(price)))
    return df.withColumn(new, (ratio if guarded else F.when(F.col(price) == 0, later * float("inf")).otherwise(ratio)) - 1)


def to_matrix(df: DataFrame, value: str, names: list[str], keys: Keys = KEYS) -> DataFrame:
    """The wide form, for sinks only: one column for each of the given names."""
    return df.groupBy(keys.time).pivot(keys.entity, names).agg(F.first(value))


def from_matrix(df: DataFrame, value: str = "value", keys: Keys = KEYS) -> DataFrame:
    """The long form of a wide time x name table, without missing cells."""
    names = [c for c in df.columns if c != keys.time]
    return df.unpivot([keys.time], names, keys.entity, value).filter(F.col(value).isNotNull())
