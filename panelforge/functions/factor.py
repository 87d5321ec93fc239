"""The factor operators: row-wise, time-series and cross-sectional Column builders.

Every operator takes Columns and numbers and returns a Column. Time-series
operators run over ``Keys.series()`` (one shuffle by entity, shared by all of
them), cross-sectional ones over ``Keys.cross()``. Operators that need a window
inside a window are macros (``MACROS``): the compiler rewrites them to trees of
the others and stages the parts. ``ema`` is the one recursive kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.panel import KEYS, Keys, finite, flag, gated, nonzero, truth

# ---- row-wise -------------------------------------------------------------------


def div(x, y, eps=1e-8):
    return F.try_divide(x, y + F.lit(eps))


def clip(x, a, b):
    return F.when(x.isNotNull(), F.least(F.greatest(x, a), b))


def power(x, alpha):
    return finite(F.pow(x, alpha))


def log1p(x):
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def sqrt(x):
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def cond(mask, a, b):
    return F.when(truth(mask), a).otherwise(b)


def inv(x, eps=1e-12):
    return F.try_divide(F.lit(1.0), nonzero(x) + F.signum(x) * F.lit(eps))


def safe_log(x, eps=1e-12):
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(eps))))


def signed_pow(x, a):
    return F.signum(x) * F.pow(F.abs(x), a)


def true_range(high, low, close_prev):
    return F.greatest(high - low, F.abs(high - close_prev), F.abs(low - close_prev))


def hl_range(high, low, close_prev):
    return F.try_divide(high - low, close_prev)


def rel_spread(ask, bid):
    return F.try_divide(ask - bid, (ask + bid) / 2)


def order_imb(bid_size, ask_size):
    return F.try_divide(bid_size - ask_size, nonzero(bid_size + ask_size))


# ---- time series ------------------------------------------------------------------


def delay(x, k, keys: Keys = KEYS):
    return F.lag(x, k).over(keys.series())


def diff(x, k, keys: Keys = KEYS):
    return x - F.lag(x, k).over(keys.series())


def ret(p, k=1, keys: Keys = KEYS):
    """Log return; null where the ratio is not positive."""
    ratio = F.try_divide(p, nonzero(F.lag(p, k).over(keys.series())))
    return F.when(ratio > 0, F.ln(ratio))


def ohlc_return(start, end):
    """Row-wise log return, as from open to close or from low to high."""
    ratio = F.try_divide(end, nonzero(start))
    return F.when(ratio > 0, F.ln(ratio))


def _rolling(agg: Callable[[Column], Column]):
    def op(x, w, keys: Keys = KEYS):
        return gated(agg(x), x, w, keys.rows(w))

    return op


ts_mean, ts_std, ts_sum = _rolling(F.avg), _rolling(F.stddev_samp), _rolling(F.sum)
ts_min, ts_max, ts_prod = _rolling(F.min), _rolling(F.max), _rolling(F.product)


def _age(extreme):
    def op(x, w, keys: Keys = KEYS):
        frame = keys.rows(w)
        held = F.collect_list(x).over(frame)
        return F.when(F.count(x).over(frame) == w, F.lit(w) - F.array_position(held, extreme(held))).cast("double")

    return op


ts_argmin, ts_argmax = _age(F.array_min), _age(F.array_max)


def wma(x, w, keys: Keys = KEYS):
    """Weights 1..w, the newest heaviest."""
    parts = [x * F.lit(float(w))] + [F.lag(x, k).over(keys.series()) * F.lit(float(w - k)) for k in range(1, w)]
    return reduce(lambda a, b: a + b, parts) / F.lit(w * (w + 1) / 2)


def ts_zscore(x, w, keys: Keys = KEYS):
    frame = keys.rows(w)
    return F.when(F.count(x).over(frame) == w, F.try_divide(x - F.avg(x).over(frame), nonzero(F.stddev_samp(x).over(frame))))


def ts_pctile(x, w, q, keys: Keys = KEYS):
    return gated(F.percentile(x, q), x, w, keys.rows(w))


def ts_median(x, w, keys: Keys = KEYS):
    return ts_pctile(x, w, 0.5, keys)


def ts_rank(x, w, keys: Keys = KEYS):
    """Share of the w - 1 earlier values strictly below the current one."""
    frame = keys.rows(w)
    if w == 1:
        return F.when(x.isNotNull(), F.lit(0.5))
    held = F.slice(F.collect_list(x).over(frame), 1, w - 1)
    return F.when(F.count(x).over(frame) == w, F.size(F.filter(held, lambda v: v < x)) / F.lit(w - 1))


def _pairs(agg):
    def op(x, y, w, keys: Keys = KEYS):
        frame = keys.rows(w)
        both = x.isNotNull() & y.isNotNull()
        a, b = F.when(both, x), F.when(both, y)
        return finite(F.when(F.count(a).over(frame) == w, agg(a, b).over(frame)))

    return op


cov_ts = _pairs(F.covar_samp)


def corr_ts(x, y, w, keys: Keys = KEYS):
    """Built from its parts: the built-in correlation fails on a flat frame under ANSI rules."""
    frame = keys.rows(w)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.when(F.count(a).over(frame) == w, F.try_divide(F.covar_pop(a, b).over(frame), nonzero(spread)))


def beta_ts(y, x, w, keys: Keys = KEYS):
    frame = keys.rows(w)
    return F.try_divide(cov_ts(y, x, w, keys), nonzero(F.var_samp(F.when(y.isNotNull(), x)).over(frame)))


def breakout(x, n, direction="up", keys: Keys = KEYS):
    before = keys.series().rowsBetween(-n, -1)
    full = F.count(x).over(before) == n
    return flag(F.when(full, x > F.max(x).over(before)) if direction == "up" else F.when(full, x < F.min(x).over(before)))


def persist(mask, w, keys: Keys = KEYS):
    return F.sum(truth(mask).cast("double")).over(keys.rows(w))


def crossover(x, y, keys: Keys = KEYS):
    s = keys.series()
    return flag((F.lag(x, 1).over(s) <= F.lag(y, 1).over(s)) & (x > y))


def crossunder(x, y, keys: Keys = KEYS):
    s = keys.series()
    return flag((F.lag(x, 1).over(s) >= F.lag(y, 1).over(s)) & (x < y))


def ffill(x, keys: Keys = KEYS):
    return F.last(x, ignorenulls=True).over(keys.series().rowsBetween(Window.unboundedPreceding, 0))


def fillna_ts(x, method="ffill", keys: Keys = KEYS):
    return ffill(x, keys) if method == "ffill" else F.coalesce(x, F.lit(0.0))


# ---- cross-section ------------------------------------------------------------------


def cs_rank(x, keys: Keys = KEYS):
    """Percentile rank over the names of a time, ties averaged, nulls kept."""
    ordered = keys.cross().orderBy(x.asc_nulls_last())
    below, tied = F.rank().over(ordered), F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (below + (tied - 1) / 2) / F.count(x).over(keys.cross()))


def cs_zscore(x, keys: Keys = KEYS):
    c = keys.cross()
    return F.try_divide(x - F.avg(x).over(c), nonzero(F.stddev_samp(x).over(c)))


def cs_winsor(x, p, keys: Keys = KEYS):
    c = keys.cross()
    return clip(x, F.percentile(x, p).over(c), F.percentile(x, 1 - p).over(c))


def cs_neutralize(x, e, keys: Keys = KEYS):
    c = keys.cross()
    return x - e * F.try_divide(F.sum(x * e).over(c), nonzero(F.sum(e * e).over(c)))


def cs_neutralize_multi(x, *exposures, keys: Keys = KEYS):
    """Residuals of an OLS without intercept on two exposures, by the normal equations as window sums (one exposure:
    ``cs_neutralize``; more: ``operators.kernels.neutralized``)."""
    if len(exposures) == 1:
        return cs_neutralize(x, exposures[0], keys)
    a, b = exposures
    whole = x.isNotNull() & a.isNotNull() & b.isNotNull()
    s = lambda v: F.sum(F.when(whole, v)).over(keys.cross())
    aa, bb, ab, ax, bx = s(a * a), s(b * b), s(a * b), s(a * x), s(b * x)
    det = nonzero(aa * bb - ab * ab)
    return F.when(whole, x - a * F.try_divide(ax * bb - bx * ab, det) - b * F.try_divide(bx * aa - ax * ab, det))


def cs_rescale(x, norm="l2", keys: Keys = KEYS):
    c = keys.cross()
    if norm == "l2":
        return F.try_divide(x, nonzero(F.sqrt(F.sum(x * x).over(c))))
    if norm == "l1":
        return F.try_divide(x, nonzero(F.sum(F.abs(x)).over(c)))
    low, high = F.min(x).over(c), F.max(x).over(c)
    return F.try_divide(2 * (x - low), nonzero(high - low)) - 1


def debias_cs(x, keys: Keys = KEYS):
    return x - F.avg(x).over(keys.cross())


# ---- what the compiler knows ---------------------------------------------------------


@dataclass(frozen=True)
class Op:
    """An operator: its builder, least and most arguments, which arguments are numbers, and those that are windows."""

    build: Callable | None
    least: int
    most: int
    numbers: tuple[int, ...] = ()
    windows: tuple[int, ...] = ()
    keyed: bool = False
    lags: tuple[int, ...] = ()


def _row(build, n, numbers=(), most=None):
    return Op(build, n, most or n, numbers)


def _series(build, n, windows=(), numbers=(), most=None, lags=()):
    return Op(build, n, most or n, tuple(windows) + tuple(numbers) + tuple(lags), tuple(windows), True, tuple(lags))


def _cross(build, n, numbers=(), most=None):
    return Op(build, n, most or n, numbers, (), True)


OPS: dict[str, Op] = {
    "add": _row(lambda x, y: x + y, 2), "sub": _row(lambda x, y: x - y, 2), "mul": _row(lambda x, y: x * y, 2),
    "div": _row(div, 2, (2,), 3), "abs": _row(F.abs, 1), "sign": _row(F.signum, 1), "clip": _row(lambda x, a, b: clip(x, a, b), 3),
    "pow": _row(power, 2), "log1p": _row(log1p, 1), "sqrt": _row(sqrt, 1), "tanh": _row(F.tanh, 1), "cond": _row(cond, 3),
    "gt": _row(lambda x, y: flag(x > y), 2), "lt": _row(lambda x, y: flag(x < y), 2), "ge": _row(lambda x, y: flag(x >= y), 2),
    "le": _row(lambda x, y: flag(x <= y), 2), "eq": _row(lambda x, y: flag(x == y), 2), "ne": _row(lambda x, y: flag(x != y, True), 2),
    "between": _row(lambda x, a, b: flag(x.between(a, b)), 3), "neg": _row(lambda x: -x, 1), "inv": _row(inv, 1, (1,), 2),
    "emin": _row(lambda x, y: F.least(x, y), 2), "emax": _row(lambda x, y: F.greatest(x, y), 2),
    "land": _row(lambda a, b: (truth(a) & truth(b)).cast("double"), 2), "lor": _row(lambda a, b: (truth(a) | truth(b)).cast("double"), 2),
    "lnot": _row(lambda a: (~truth(a)).cast("double"), 1), "coalesce": _row(lambda x, y: F.coalesce(x, y), 2),
    "signed_pow": _row(signed_pow, 2), "safe_log": _row(safe_log, 1, (1,), 2), "true_range": _row(true_range, 3),
    "hl_range": _row(hl_range, 3), "spread": _row(lambda a, b: a - b, 2), "rel_spread": _row(rel_spread, 2), "order_imb": _row(order_imb, 2),
    "try_div": _row(lambda x, y: F.try_divide(x, nonzero(y)), 2), "ohlc_return": _row(ohlc_return, 2),
    "delay": _series(delay, 2, lags=(1,)), "diff": _series(diff, 2, lags=(1,)), "ret": _series(ret, 1, lags=(1,), most=2),
    **{n: _series(f, 2, (1,)) for n, f in {"ts_mean": ts_mean, "ts_std": ts_std, "ts_sum": ts_sum, "ts_min": ts_min, "ts_max": ts_max, "ts_prod": ts_prod, "ts_argmin": ts_argmin, "ts_argmax": ts_argmax, "wma": wma, "ts_zscore": ts_zscore, "ts_median": ts_median, "ts_rank": ts_rank, "persist": persist}.items()},
    "ts_pctile": _series(ts_pctile, 3, (1,), (2,)), "corr_ts": _series(corr_ts, 3, (2,)), "cov_ts": _series(cov_ts, 3, (2,)),
    "beta_ts": _series(beta_ts, 3, (2,)), "breakout": _series(breakout, 2, (1,), (2,), 3), "crossover": _series(crossover, 2),
    "crossunder": _series(crossunder, 2), "ffill": _series(ffill, 1), "fillna_ts": _series(fillna_ts, 1, (), (1,), 2),
    "ema": Op(None, 2, 2, (1,), (1,), True),
    "cs_rank": _cross(cs_rank, 1), "cs_zscore": _cross(cs_zscore, 1), "cs_winsor": _cross(cs_winsor, 2, (1,)), "cs_neutralize": _cross(cs_neutralize, 2),
    "cs_neutralize_multi": _cross(cs_neutralize_multi, 2, (), 3), "cs_rescale": _cross(cs_rescale, 1, (1,), 2), "debias_cs": _cross(debias_cs, 1),
}


def _call(name, *args):
    return {"call": name, "args": list(args)}


def _smooth(x, w, method="ema"):
    return _call({"ema": "ema", "median": "ts_median"}.get(method, "ts_mean"), x, w)


#: Operators made of others: (least, most arguments, rewriting). Numbers stay plain in the arguments.
MACROS: dict[str, tuple[int, int, Callable]] = {
    "adv": (2, 2, lambda v, w: _call("ts_mean", v, w)),
    "volatility": (2, 2, lambda p, w: _call("ts_std", _call("ret", p, 1), w)),
    "atr": (4, 4, lambda h, lo, c, w: _call("ts_mean", _call("true_range", h, lo, _call("delay", c, 1)), w)),
    "turnover": (2, 2, lambda v, w: _call("try_div", v, _call("ts_mean", v, w))),
    "amihud": (3, 3, lambda r, v, w: _call("ts_mean", _call("try_div", _call("abs", r), v), w)),
    "demean_ts": (2, 2, lambda x, w: _call("sub", x, _call("ts_mean", x, w))),
    "smooth_ts": (2, 3, _smooth),
    "pct_change": (1, 2, lambda p, k=1: _call("sub", _call("try_div", _call("ffill", p), _call("delay", _call("ffill", p), k)), 1.0)),
}
