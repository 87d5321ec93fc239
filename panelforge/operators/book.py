"""Order-book features over snapshots with ``levels`` price and volume levels a side.

Columns: price_ask_i, price_bid_i, volume_ask_i, volume_bid_i for i in 1..levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.panel import KEYS, Keys, nonzero
from panelforge.operators.asof import micros
from panelforge.operators.kernels import ewm
from panelforge.operators.ranks import counted, with_below

LEVELS = 10


def _c(kind: str, side: str, i: int) -> Column:
    return F.col(f"{kind}_{side}_{i}")


def mid() -> Column:
    return (_c("price", "ask", 1) + _c("price", "bid", 1)) / 2


def spreads_and_mids(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    return df.withColumns({
        **{f"spread_{i}": _c("price", "ask", i) - _c("price", "bid", i) for i in range(1, levels + 1)},
        **{f"mid_{i}": (_c("price", "ask", i) + _c("price", "bid", i)) / 2 for i in range(1, levels + 1)},
    })


def imbalances(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(bid - ask) / (bid + ask) volume of each level and of all levels together."""
    pair = lambda b, a: F.try_divide(b - a, nonzero(b + a))
    each = {f"imbalance_{i}": pair(_c("volume", "bid", i), _c("volume", "ask", i)) for i in range(1, levels + 1)}
    total = lambda side: reduce(lambda x, y: x + y, [_c("volume", side, i) for i in range(1, levels + 1)])
    return df.withColumns({**each, "cum_imbalance": pair(total("bid"), total("ask"))})


def imbalance_momentum(df: DataFrame, levels: int = LEVELS, short: int = 5, long: int = 20, keys: Keys = KEYS) -> DataFrame:
    """EMA(short) - EMA(long) of every imbalance, all averages in one pass."""
    names = [f"imbalance_{i}" for i in range(1, levels + 1)] + ["cum_imbalance"]
    df = ewm(df, {**{f"__s_{n}": (n, 2 / (short + 1)) for n in names}, **{f"__l_{n}": (n, 2 / (long + 1)) for n in names}}, keys)
    return df.withColumns({f"{n}_momentum": F.col(f"__s_{n}") - F.col(f"__l_{n}") for n in names}).drop(*[f"__{k}_{n}" for n in names for k in "sl"])


def price_differences(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Between neighbouring levels and between the last and the first, by side."""
    steps = {f"{s}_diff_{i}": F.abs(_c("price", s, i + 1) - _c("price", s, i)) for s in ("ask", "bid") for i in range(1, levels)}
    spans = {f"{s}_span": _c("price", s, levels) - _c("price", s, 1) for s in ("ask", "bid")}
    return df.withColumns({**steps, **spans})


def level_means(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    mean = lambda k, s: F.aggregate(F.array(*[_c(k, s, i) for i in range(1, levels + 1)]), F.lit(0.0), lambda a, x: a + x) / levels
    return df.withColumns({f"mean_{k}_{s}": mean(k, s) for k in ("price", "volume") for s in ("ask", "bid")})


def accumulated_differences(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    return df.withColumns({f"accumulated_{k}": reduce(lambda x, y: x + y, [_c(k, "ask", i) - _c(k, "bid", i) for i in range(1, levels + 1)]) for k in ("price", "volume")})


def targets(df: DataFrame, horizons: list[int], keys: Keys = KEYS) -> DataFrame:
    """(mid[t + k] - mid[t]) / mid[t] for each horizon."""
    s = keys.series()
    df = df.withColumn("mid", mid())
    return df.withColumns({f"target_{k}": F.try_divide(F.lead("mid", k).over(s) - F.col("mid"), nonzero(F.col("mid"))) for k in horizons})


def moving_average(x: str, n: int, keys: Keys = KEYS) -> Column:
    return F.avg(x).over(keys.rows(n))


def range_zscores(df: DataFrame, columns: list[str], minutes: int = 30, keys: Keys = KEYS) -> DataFrame:
    """z-scores over the (t - minutes, t] window of time, from one row up; a flat window gives null.

    Time is cut into slices as long as the window, which is then the begin of its row's slice and the end of the slice
    before: two running aggregates, put together. No window is gone through row by row, and a task holds no series."""
    span, names = minutes * 60_000_000, list(enumerate(columns))
    made = {"n": F.count, "mean": F.avg, "var": F.var_pop, "low": F.min, "high": F.max}
    running = lambda x, i, tag, w: {f"__{k}{tag}{i}": f(x).over(w) for k, f in made.items()}
    rows = df.withColumn("__at", micros(keys.time))
    rows = rows.withColumn("__slice", F.col("__at") - F.pmod(F.col("__at"), F.lit(span)))
    begin = Window.partitionBy(keys.entity, "__slice").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    data = rows.select(keys.entity, "__slice", F.col("__at").alias("__from"), *[F.col(c).alias(f"__x{i}") for i, c in names])
    asked = rows.withColumns({k: c for i, x in names for k, c in running(x, i, "a", begin).items()})
    asked = asked.withColumns({"__slice": F.col("__slice") - span, "__from": F.col("__at") - span + 1, "__asks": F.lit(True)})
    end = Window.partitionBy(keys.entity, "__slice").orderBy(F.col("__from").desc()).rangeBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(data, allowMissingColumns=True)
    both = both.withColumns({k: c for i, _ in names for k, c in running(f"__x{i}", i, "b", end).items()}).filter("__asks")
    scores = {}
    for i, c in names:
        get = lambda k, i=i: (F.col(f"__{k}a{i}"), F.when(F.col("__at").isNotNull(), F.col(f"__{k}b{i}")))
        (n1, n2), (m1, m2), (v1, v2), low, high = get("n"), get("mean"), get("var"), F.least(*get("low")), F.greatest(*get("high"))
        n2 = F.coalesce(n2, F.lit(0))
        n, none = n1 + n2, F.lit(0.0)
        mean = F.try_divide(F.coalesce(m1 * n1, none) + F.coalesce(m2 * n2, none), n)
        apart = F.coalesce(F.try_divide((m2 - m1) * (m2 - m1) * n1 * n2, n), none)
        spread = F.sqrt(F.try_divide(F.coalesce(v1 * n1, none) + F.coalesce(v2 * n2, none) + apart, n - 1))
        scores[f"{c}_zscore"] = F.when((low != high) | F.isnan(high), F.try_divide(F.col(c) - mean, nonzero(spread)))
    return both.select(*[c for c in df.columns if c not in scores], *[x.alias(c) for c, x in scores.items()])


def carried(df: DataFrame, columns: list[str], keys: Keys = KEYS) -> DataFrame:
    """Zeros as missing, then the last value carried on, in order of time."""
    w = keys.series().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(nonzero(F.col(c)), ignorenulls=True).over(w) for c in columns})


def features(df: DataFrame, levels: int = LEVELS, horizon: int = 10, keys: Keys = KEYS) -> DataFrame:
    """The whole pipeline but the moving z-scores."""
    book = [f"{k}_{s}_{i}" for k in ("price", "volume") for s in ("ask", "bid") for i in range(1, levels + 1)]
    df = targets(carried(df, book, keys), [horizon], keys).filter(F.col(f"target_{horizon}").isNotNull())
    for step in (imbalances, spreads_and_mids, price_differences, level_means, accumulated_differences):
        df = step(df, levels)
    return imbalance_momentum(df, levels, keys=keys)


def windows(df: DataFrame, columns: list[str], label: str, length: int = 100, stride: int = 10, keys: Keys = KEYS) -> DataFrame:
    """(entity, time, window, label): every ``stride``-th full window of rows without missing values, labelled by its
    last row.

    Rows are gathered in blocks that end where a window ends, and a window is put together from the blocks it reaches
    back to: lists are built for the windows asked for and not for every row."""
    n = F.row_number().over(keys.series())
    row = F.struct("__n", F.col(keys.time).alias("time"), F.col(label).alias("label"), F.array(*columns).alias("x"))
    rows = df.withColumn("__n", n).select(keys.entity, F.ceil((F.col("__n") - length) / stride).alias("__block"), row.alias("__row"))
    blocks = rows.groupBy(keys.entity, "__block").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    back = Window.partitionBy(keys.entity).orderBy("__block").rowsBetween(-((length - 1) // stride), 0)
    blocks = blocks.withColumns({"__last": F.element_at("__rows", -1), "__held": F.flatten(F.collect_list("__rows.x").over(back))})
    ends = blocks.filter((F.col("__block") >= 0) & (F.col("__last.__n") == length + F.col("__block") * stride) & F.col("__last.label").isNotNull())
    out = ends.select(keys.entity, F.col("__last.time").alias(keys.time), F.slice("__held", -length, length).alias("window"), F.col("__last.label").alias("label"))
    return out.filter(F.forall("window", lambda x: F.forall(x, lambda v: v.isNotNull())))


def month_split(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Adds split: odd months train; of even months the first half of each series' rows valid, the rest test."""
    month = F.date_trunc("month", keys.time)
    w = Window.partitionBy(keys.entity, month)
    n, position = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(keys.time))
    return df.withColumn("split", F.when(F.month(keys.time) % 2 == 1, "train").when(position * 2 <= n, "valid").otherwise("test"))


def day_blocks(df: DataFrame, time: str, by: str, blocks: int = 60) -> DataFrame:
    """Adds block and split: the days of each series in ``blocks`` runs of about equal length; odd blocks train, of even ones
    the first half valid, the rest test. Series with fewer days are left out. A day's number is the count of the series'
    days below it, by ranges and without a window over them all."""
    day = F.unix_date(F.to_date(time))
    days = df.select(by, day.alias("__day")).filter("__day is not null").distinct().withColumn("c", F.lit(1).cast("long"))
    numbered = with_below(days, "__day", [by]).select(F.col(by).alias("__by"), "__day", F.col("below").alias("__number"))
    totals = days.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__days")).filter(F.col("__days") >= blocks)
    numbered = numbered.join(totals, "__by")
    begun = F.filter(F.sequence(F.lit(0), F.lit(blocks)), lambda i: F.floor(i * (F.col("__days") / F.lit(float(blocks)))) <= F.col("__number"))
    numbered = numbered.withColumn("block", F.size(begun) - 1)
    split = F.when(F.col("block") % 2 == 1, "train").when(F.col("block") / 2 < F.lit(-(-blocks // 2) // 2), "valid").otherwise("test")
    out = df.withColumn("__d", day).join(numbered.withColumn("split", split), (F.col(by) == F.col("__by")) & (F.col("__d") == F.col("__day")))
    return out.select(*df.columns, "block", "split")


def rank_transform(df: DataFrame, column: str, train: DataFrame, new: str) -> DataFrame:
    """Share of the training values strictly below, by counts of the values of both tables; null for a null value."""
    counts = counted(train, column).unionByName(counted(df, column).withColumn("c", F.lit(0).cast("long")))
    counts = counts.groupBy(column).agg(F.sum("c").alias("c"))
    below = with_below(counts, column).select(F.col(column).alias("__v"), F.col("below").alias("__below"))
    n = train.agg(F.count(column).alias("__total"))
    out = df.join(below, F.col(column) == F.col("__v"), "left").crossJoin(F.broadcast(n))  # one row
    return out.select(*df.columns, F.try_divide(F.col("__below"), nonzero(F.col("__total"))).alias(new))


def without_level_prices(df: DataFrame) -> DataFrame:
    """Without the volume-weighted prices of the levels."""
    return df.drop(*[c for c in df.columns if c.startswith(("vwap_ask_", "vwap_bid_"))])


def renamed_levels(df: DataFrame) -> DataFrame:
    """vwap_ask_3 as price_ask_3_mean, and so for all levels and both sides."""
    import re

    return df.withColumnsRenamed({c: f"price_{m[1]}_{m[2]}_mean" for c in df.columns if (m := re.fullmatch(r"vwap_(ask|bid)_(\d+)", c))})
