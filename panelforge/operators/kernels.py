"""Recursive and linear-algebra kernels: what one window expression cannot say.

``ewm`` is a scan over blocks: windows inside blocks of a series, a short recursion over one
row a block, and one join back, so that no task holds a whole series. Covariances run on
Arrow batches. A missing value keeps the last average while the weight of what came
before goes on decaying.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from panelforge.functions.panel import KEYS, Keys, finite
from panelforge.sources.scratch import written


def _added(df: DataFrame, columns: dict[str, str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]])


#: Rows of a block, at most: a block's weights must stay far from the smallest double.
BLOCK = 512


def _carried(alphas: dict[str, float], entity: str):
    """What each block of a series begins with (``in``) and has at its first value (``at``), from the blocks before it. Batches
    come in order of series and block; a series may go on in the next batch."""

    def run(batches):
        other = object()
        series, states, gaps = other, {}, {}
        for pdf in batches:
            names, rows = [None if x is None or x != x else x for x in pdf[entity]], {k: [] for k in alphas}
            values = {k: list(zip(*(pdf[f"{c}{k}"] for c in ("__n", "__lead", "__trail", "__x", "__p", "__l", "__m", "__s")), strict=True)) for k in alphas}
            for i, name in enumerate(names):
                if series is other or name != series:
                    series, states, gaps = name, dict.fromkeys(alphas), dict.fromkeys(alphas, 0)
                for k, alpha in alphas.items():
                    n, lead, trail, x, p, l1, l2, ls = values[k][i]
                    state = states[k]
                    before = state or (math.nan,) * 3
                    if lead != lead:  # no value in the block
                        rows[k].append((*before, *(math.nan,) * 3))
                        gaps[k] += n
                        continue
                    if state is None:
                        first = (x, x * x, 0.0)
                    else:
                        old = (1 - alpha) ** (gaps[k] + lead + 1)
                        c, d = old / (old + alpha), alpha / (old + alpha)
                        first = (c * state[0] + d * x, c * state[1] + d * x * x, c * c * state[2] + 2 * c * d)
                    rows[k].append((*before, *first))
                    states[k], gaps[k] = (p * first[0] + l1, p * first[1] + l2, p * p * first[2] + ls), trail
            out = {c: pdf[c] for c in (entity, "__slice", "__sub")}
            for k in alphas:
                for j, c in enumerate(("in", "in2", "ins", "at", "at2", "ats")):
                    out[f"__{c}{k}"] = [r[j] for r in rows[k]]
            yield pd.DataFrame(out)

    return run


def ewm(df: DataFrame, columns: dict[str, tuple[str, float]], keys: Keys = KEYS, variance: bool = False, tie: list[str] | None = None) -> DataFrame:
    """Adds exponentially weighted means (or unbiased variances): new column -> (column, alpha), all in one pass. Rows of one
    time are in order of ``tie``.

    A value is (old * average + alpha * x) / (old + alpha), old = (1 - alpha) ^ (rows since the last x): an affine map of the
    average before it. Series are cut by calendar quarter and then into blocks; inside a block windows give the
    product P and the sum L of the maps since its first value, and the average is P * (average at that value) + L.
    Blocks of one series are linked by a recursion over their ends, one row for ``BLOCK`` rows."""
    kept, kind = df.columns, df.schema[keys.time].dataType
    slice_ = F.date_trunc("quarter", F.col(keys.time).cast("timestamp")) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(0)
    size = min(BLOCK, *(max(1, int(200 / -math.log(1 - a))) if a < 1 else 1 for _, a in columns.values()))
    rows = df.withColumn("__slice", slice_)
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(keys.entity, "__slice").orderBy(keys.time, *(tie or []))) - 1)
    rows = rows.withColumn("__sub", F.floor(F.col("__rn") / size))
    block = ["__slice", "__sub"]
    w = Window.partitionBy(keys.entity, *block).orderBy("__rn")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    alphas = {str(i): a for i, (_, a) in enumerate(columns.values())}
    own = {k: finite(F.col(old)) for k, (old, _) in zip(alphas, columns.values(), strict=True)}
    rows = rows.withColumns({f"__v{k}": x for k, x in own.items()})
    rows = rows.withColumns({f"__last{k}": F.max(F.when(F.col(f"__v{k}").isNotNull(), F.col("__rn"))).over(before) for k in alphas})
    later = {k: F.col(f"__v{k}").isNotNull() & F.col(f"__last{k}").isNotNull() for k in alphas}
    rows = rows.withColumns({f"__o{k}": F.when(later[k], F.pow(F.lit(1 - a), F.col("__rn") - F.col(f"__last{k}"))) for k, a in alphas.items()})
    rows = rows.withColumns({f"__p{k}": F.exp(F.coalesce(F.sum(F.ln(F.col(f"__o{k}") / (F.col(f"__o{k}") + a))).over(so_far), F.lit(0.0))) for k, a in alphas.items()})
    share = {k: a / (F.col(f"__o{k}") + a) for k, a in alphas.items()}
    p = lambda k: F.col(f"__p{k}")
    total = lambda x: F.coalesce(F.sum(x).over(so_far), F.lit(0.0))
    sums = {f"__l{k}": p(k) * total(share[k] * F.col(f"__v{k}") / p(k)) for k in alphas}
    if variance:
        sums |= {f"__m{k}": p(k) * total(share[k] * F.col(f"__v{k}") * F.col(f"__v{k}") / p(k)) for k in alphas}
        sums |= {f"__s{k}": p(k) * p(k) * total(2 * share[k] * (1 - share[k]) / p(k) / p(k)) for k in alphas}
    else:
        sums |= {f"__{c}{k}": F.lit(0.0) for c in "ms" for k in alphas}
    rows = rows.withColumns(sums | {f"__seen{k}": F.count(f"__v{k}").over(so_far) > 0 for k in alphas})
    rows = written(rows.select(*kept, *block, "__rn", *[f"__{c}{k}" for k in alphas for c in ("v", "p", "l", "m", "s", "seen")]))
    ends, at = [], F.col("__rn")
    for k in alphas:
        there = F.col(f"__v{k}").isNotNull()
        first, last = F.min(F.when(there, at)), F.max(F.when(there, at))
        final = [F.max_by(f"__{c}{k}", at).alias(f"__{c}{k}") for c in ("p", "l", "m", "s")]
        ends += [F.count(F.lit(1)).alias(f"__n{k}"), (first - F.min(at)).cast("double").alias(f"__lead{k}"), (F.max(at) - last).cast("double").alias(f"__trail{k}"), F.min_by(f"__v{k}", F.when(there, at)).alias(f"__x{k}"), *final]
    summary = rows.groupBy(keys.entity, *block).agg(*ends)
    kinds = {f.name: f.dataType.simpleString() for f in summary.schema.fields}
    names = [f"__{c}{k}" for k in alphas for c in ("in", "in2", "ins", "at", "at2", "ats")]
    carried = summary.repartition(F.col(keys.entity)).sortWithinPartitions(keys.entity, *block).mapInPandas(_carried(alphas, keys.entity), ", ".join([f"`{c}` {kinds[c]}" for c in (keys.entity, *block)] + [f"{c} double" for c in names]))
    carried = carried.select(F.col(keys.entity).alias("__e"), *[F.col(c).alias(f"__b{c}") for c in block], *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names])
    same = F.col(keys.entity).eqNullSafe(F.col("__e"))
    for c in block:
        same = same & F.col(c).eqNullSafe(F.col(f"__b{c}"))
    out, made = rows.join(carried, same), []
    for k, new in zip(alphas, columns, strict=True):
        now = lambda start, product, rest, k=k: F.when(F.col(f"__seen{k}"), product * F.col(f"__at{start}{k}") + F.col(f"__{rest}{k}")).otherwise(F.col(f"__in{start}{k}"))
        mean = now("", p(k), "l")
        if variance:
            left = now("s", p(k) * p(k), "s")  # 1 less the sum of the squared weights
            spread = F.greatest(now("2", p(k), "m") - mean * mean, F.lit(0.0))
            mean = F.when(left > 1e-15, spread / left)
        made.append(mean.alias(new))
    return out.select(*[c for c in kept if c not in columns], *made)


def ema(df: DataFrame, column: str, new: str, span: float, keys: Keys = KEYS) -> DataFrame:
    return ewm(df, {new: (column, 2 / (span + 1))}, keys)


def macd(df: DataFrame, column: str, fast: int = 12, slow: int = 26, signal: int = 9, percent: bool = False, keys: Keys = KEYS) -> DataFrame:
    """macd (or ppo), its signal line and histogram."""
    name = "ppo" if percent else "macd"
    df = ewm(df, {"__fast": (column, 2 / (fast + 1)), "__slow": (column, 2 / (slow + 1))}, keys)
    line = F.col("__fast") - F.col("__slow")
    df = df.withColumn(name, F.try_divide(line, F.when(F.col("__slow") != 0, F.col("__slow"))) * 100 if percent else line).drop("__fast", "__slow")
    df = ema(df, name, f"{name}_signal", signal, keys)
    return df.withColumn(f"{name}_hist", F.col(name) - F.col(f"{name}_signal"))


def ewma_variances(df: DataFrame, column: str, half_lives: dict[str, float], periods: int = 2016, floor: float = 1e-10, clip: float | None = None, keys: Keys = KEYS) -> DataFrame:
    """Annualised exponentially weighted variances, floored: new column -> half-life, all in one pass."""
    x = F.col(column) if clip is None else F.least(F.greatest(F.col(column), F.lit(-clip)), F.lit(clip))
    df = ewm(df.withColumn("__r", x), {new: ("__r", 1 - 2 ** (-1 / h)) for new, h in half_lives.items()}, keys, variance=True).drop("__r")
    return df.withColumns({new: F.greatest(F.col(new) * periods, F.lit(floor)) for new in half_lives})


def ewma_variance(df: DataFrame, column: str, new: str, half_life: float = 128.0, periods: int = 2016, floor: float = 1e-10, clip: float | None = None, keys: Keys = KEYS) -> DataFrame:
    return ewma_variances(df, column, {new: half_life}, periods, floor, clip, keys)


def aligned_rows(df: DataFrame, column: str, keys: Keys = KEYS) -> DataFrame:
    """(time, names, x): the values of all names at each time as one array, in order of name; missing ones are 0. The
    names of a panel are its width; times are dealt out."""
    names = df.agg(F.sort_array(F.collect_set(keys.entity)).alias("names"))
    held = df.filter(F.col(column).isNotNull()).groupBy(keys.time).agg(F.map_from_entries(F.collect_list(F.struct(keys.entity, column))).alias("__m"))
    rows = held.crossJoin(F.broadcast(names))  # one row
    return rows.select(keys.time, "names", F.transform("names", lambda n: F.coalesce(F.try_element_at("__m", n), F.lit(0.0))).alias("x"))


def ewma_covariance(df: DataFrame, column: str, half_life: float = 128.0, periods: int = 2016, floor: float = 1e-10, keys: Keys = KEYS) -> DataFrame:
    """(time, entity, names, covariance): one row of the annualised recursive covariance for each time and name. Every
    name's row is a recursion of its own, so names are dealt to tasks."""
    alpha = 1 - 2 ** (-1 / half_life)
    rows = aligned_rows(df, column, keys)
    by_name = rows.select(keys.time, "names", "x", F.posexplode("x").alias("__i", "__x")).withColumn(keys.entity, F.col("names")[F.col("__i")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys.time, kind="stable")
        own, out, s = int(pdf["__i"].iloc[0]), [], None
        for x, xi in zip(pdf["x"], pdf["__x"], strict=True):
            new = xi * np.asarray(x, float)
            s = new if s is None else (1 - alpha) * s + alpha * new
            row = s * periods
            row[own] += floor
            out.append(row)
        return pdf[[keys.time, keys.entity, "names"]].assign(covariance=out)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return by_name.groupBy(keys.entity).applyInPandas(run, f"{keys.time} {kinds[keys.time]}, {keys.entity} {kinds[keys.entity]}, names array<string>, covariance array<double>")


def neutralized(df: DataFrame, column: str, exposures: list[str], new: str, keys: Keys = KEYS) -> DataFrame:
    """Residuals of an OLS without intercept at each time, for any number of exposures; null rows stay null."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf[column].to_numpy(float), pdf[exposures].to_numpy(float)
        whole = np.isfinite(y) & np.isfinite(x).all(axis=1)
        out = np.full(len(y), np.nan)
        if whole.any():
            beta, *_ = np.linalg.lstsq(x[whole], y[whole], rcond=None)
            out[whole] = y[whole] - x[whole] @ beta
        return pdf.assign(**{new: pd.Series(out, index=pdf.index).astype(object).where(np.isfinite(out), None)})

    return df.groupBy(keys.time).applyInPandas(run, _added(df, {new: "double"}))
