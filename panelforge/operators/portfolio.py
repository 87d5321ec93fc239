"""Signals to weights: Gaussian ranks, forward decay-weighted returns, closed-form and constrained optimisers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelforge.functions.factor import clip
from panelforge.functions.panel import KEYS, Keys, nonzero


# Coefficients of the published rational approximations (algorithm AS 241), constant term first.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# End of the fixed values.


def with_inverse_normal(df: DataFrame, u: Column, new: str) -> DataFrame:
    """Adds the standard normal quantile of ``u`` to 1e-15 (relative): one rational function near the median, two in the
    tails. Each step is a column of its own, so that generated code holds no argument twice."""

    def ratio(x: Column, parts) -> Column:
        top, bottom = (reduce(lambda a, c: a * x + c, reversed(p[:-1]), F.lit(p[-1])) for p in parts)
        return top / bottom

    df = df.withColumn("__iu", u)
    df = df.withColumns({"__iq": F.col("__iu") - 0.5, "__ir": F.sqrt(-F.ln(F.least("__iu", 1 - F.col("__iu"))))})
    df = df.withColumns({"__ic": 0.180625 - F.col("__iq") * F.col("__iq"), "__im": F.col("__ir") - 1.6, "__it": F.col("__ir") - 5})
    df = df.withColumns({"__ic": ratio(F.col("__ic"), CENTRE), "__im": ratio(F.col("__im"), MIDDLE), "__it": ratio(F.col("__it"), TAIL)})
    tail = F.when(F.col("__ir") <= 5, F.col("__im")).otherwise(F.col("__it"))
    return df.withColumn(new, F.when(F.abs("__iq") <= 0.425, F.col("__iq") * F.col("__ic")).otherwise(F.signum("__iq") * tail)).drop("__iu", "__iq", "__ir", "__ic", "__im", "__it")


def gaussianised(df: DataFrame, x: str, new: str, cap: float = 3.0, keys: Keys = KEYS) -> DataFrame:
    """Average ranks of each time as normal quantiles of (rank - 0.5) / n, capped; 0 for a single name."""
    c = keys.cross()
    ordered = c.orderBy(F.col(x).asc_nulls_last())
    rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    df = df.withColumns({"__n": F.count(x).over(c), "__rank": rank})
    u = F.least(F.greatest(F.try_divide(F.col("__rank") - 0.5, nonzero(F.col("__n"))), F.lit(1e-6)), F.lit(1 - 1e-6))
    df = with_inverse_normal(df, u, "__z")
    z = F.when(F.col("__n") <= 1, F.col(x) * 0).otherwise(clip(F.col("__z"), F.lit(-cap), F.lit(cap)))
    return df.withColumn(new, F.when(F.col(x).isNotNull(), z)).drop("__n", "__rank", "__z")


def forward_decay(df: DataFrame, r: str, start: int = 1, horizon: int = 40, half_life: float = 20.0, new: str = "alpha", keys: Keys = KEYS) -> DataFrame:
    """Weighted mean of the returns start..start + horizon - 1 rows ahead, weights halving every ``half_life`` rows; 0
    where the window is not whole. It looks ahead by design: an oracle signal for optimiser studies."""
    weights = [0.5 ** (d / half_life) for d in range(horizon)]
    total = sum(weights)
    s = keys.series()
    terms = [F.coalesce(F.lead(r, start + d).over(s), F.lit(0.0)) * F.lit(weights[d] / total) for d in range(horizon)]
    value = terms[0]
    for t in terms[1:]:
        value = value + t
    position, size = F.row_number().over(s), F.count(F.lit(1)).over(Window.partitionBy(keys.entity))
    return df.withColumn(new, F.when(position + start + horizon <= size, value).otherwise(0.0))


def long_only(df: DataFrame, alpha: str, variance: str, new: str = "weight", keys: Keys = KEYS) -> DataFrame:
    """max(alpha / variance, 0), scaled to sum 1 at each time."""
    raw = F.greatest(F.try_divide(F.col(alpha), nonzero(F.col(variance))), F.lit(0.0))
    df = df.withColumn("__raw", F.coalesce(raw, F.lit(0.0)))
    return df.withColumn(new, F.coalesce(F.try_divide(F.col("__raw"), nonzero(F.sum("__raw").over(keys.cross()))), F.lit(0.0))).drop("__raw")


def long_short(df: DataFrame, alpha: str, variance: str, new: str = "weight", budget: float = 0.1, gross: float = 2.0, box: float = 1.0, keys: Keys = KEYS) -> DataFrame:
    """Weights that sum to 0 and make the most of alpha within a risk budget under diagonal risk, in closed form:
    (alpha - nu) / variance, scaled to the budget. Where the limits on gross exposure or single weights bind first,
    the same direction is scaled down into them (``constrained_weights`` solves that case itself)."""
    c = keys.cross()
    a, v = F.col(alpha), F.when(F.col(variance) > 0, F.col(variance))
    v = F.when(a.isNotNull(), v)
    centre = F.try_divide(F.sum(a / v).over(c), nonzero(F.sum(1 / v).over(c)))
    df = df.withColumns({"__v": v, "__d": (a - centre) / v})
    d = F.col("__d")
    scale = F.least(
        F.try_divide(F.lit(budget), nonzero(F.sqrt(F.sum(d * d * F.col("__v")).over(c)))),
        F.try_divide(F.lit(gross), nonzero(F.sum(F.abs(d)).over(c))), F.try_divide(F.lit(box), nonzero(F.max(F.abs(d)).over(c))),
    )
    return df.withColumn(new, F.coalesce(d * scale, F.lit(0.0))).drop("__v", "__d")


def _limited(v: np.ndarray, gross: float, box: float) -> np.ndarray:
    """The nearest point with sum |x| <= gross and |x| <= box: sizes less a common amount, found by bisection."""
    size = np.abs(v)
    if np.minimum(size, box).sum() <= gross:
        return np.clip(v, -box, box)
    low, high = 0.0, float(size.max())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.clip(size - mid, 0, box).sum() > gross else (low, mid)
    return np.sign(v) * np.clip(size - high, 0, box)


def constrained_weights(alpha: np.ndarray, covariance: np.ndarray, budget: float | None = 0.1, penalty: float = 0.0, gross: float = 2.0, box: float = 1.0, rounds: int = 2000) -> np.ndarray:
    """max alpha'x - penalty * sqrt(x'Cx) with sum x = 0, sum |x| <= gross, |x| <= box and, if ``budget`` is given,
    sqrt(x'Cx) <= budget. The problem is split into an equality-constrained quadratic step with one factorisation, a
    shrinkage of the risk vector and a projection on the limits (alternating directions). A covariance that is not
    positive definite, or a vector of variances with one that is not positive, gives 0."""
    n = len(alpha)
    c = np.diag(covariance) if covariance.ndim == 1 else (covariance + covariance.T) / 2
    try:
        root = np.linalg.cholesky(c).T
    except np.linalg.LinAlgError:
        return np.zeros(n)
    if not np.isfinite(alpha).all() or not np.abs(alpha).max(initial=0.0):
        return np.zeros(n)
    a = alpha / np.abs(alpha).max()
    unit = float(np.sqrt(np.diag(c).mean()))  # risk in units of a typical name, so that both parts weigh alike
    root, limit, cost = root / unit, (np.inf if budget is None else budget / unit), penalty * unit / np.abs(alpha).max()
    inverse = np.linalg.inv(root.T @ root + np.eye(n))
    ones = inverse.sum(axis=1)
    x = z = w = np.zeros(n)
    y = u = np.zeros(n)
    rho = 1.0
    for k in range(rounds):
        b = inverse @ (a / rho + root.T @ (y - u) + z - w)
        x = b - ones * (b.sum() / ones.sum())
        risk = root @ x
        v = risk + u
        size = float(np.linalg.norm(v))
        y = v * (min(max(size - cost / rho, 0.0), limit) / size) if size > 0 else v
        old, z = z, _limited(x + w, gross, box)
        u, w = u + risk - y, w + x - z
        if k % 20 == 19:
            apart, moved = np.abs(x - z).max() + np.abs(risk - y).max(), np.abs(z - old).max()
            if apart < 1e-9 and moved < 1e-9:
                break
            if apart > 10 * rho * moved or moved * rho > 10 * apart:
                factor = 2.0 if apart > 10 * rho * moved else 0.5
                rho, u, w = rho * factor, u / factor, w / factor
    for bound, now in ((gross, np.abs(x).sum()), (box, np.abs(x).max()), (np.inf if budget is None else budget, float(np.linalg.norm(root @ x)) * unit)):
        if now > bound:
            x = x * (bound / now)
    value = lambda v: float(alpha @ v - penalty * np.linalg.norm(root @ v) * unit)
    return x if value(x) > 0 else np.zeros(n)


def nearest_psd(a: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    a = (a + a.T) / 2
    w, v = np.linalg.eigh(a)
    return (v * np.maximum(w, eps)) @ v.T


def factor_model(c: np.ndarray, k: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loadings, factor variances, residual variances) of the top ``k`` principal components of a covariance."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    return v, w, np.maximum(np.diag(c) - (v * v) @ w, 1e-12)


def optimised(df: DataFrame, alpha: str, variance: str, new: str = "weight", budget: float | None = 0.1, penalty: float = 0.0, gross: float = 2.0, box: float = 1.0, keys: Keys = KEYS) -> DataFrame:
    """Constrained weights with diagonal risk, one group of names for each time; names without alpha or risk get 0."""
    from panelforge.operators.kernels import _added

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, v = pdf[alpha].to_numpy(float), pdf[variance].to_numpy(float)
        ok = np.isfinite(a) & np.isfinite(v) & (v > 0)
        w = np.zeros(len(a))
        if ok.sum() >= 2:
            w[ok] = constrained_weights(a[ok], v[ok], budget, penalty, gross, box)
        return pdf.assign(**{new: w})

    return df.groupBy(keys.time).applyInPandas(run, _added(df, {new: "double"}))


def optimised_full(df: DataFrame, alpha: str, covariances: DataFrame, new: str = "weight", budget: float | None = 0.1, penalty: float = 0.0, gross: float = 2.0, box: float = 1.0, factors: int | None = None, keys: Keys = KEYS) -> DataFrame:
    """(time, entity, alpha, new): constrained weights under the covariance rows of ``kernels.ewma_covariance``, one group
    of names for each time; with ``factors`` the covariance is that of its principal factors and residuals. Since no
    limit ties one time to another, the many-period problem with a risk penalty is this one (budget=None)."""
    rows = df.select(keys.time, keys.entity, alpha).join(covariances, [keys.time, keys.entity])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[alpha].notna()]
        where = {n: i for i, n in enumerate(pdf["names"].iloc[0])} if len(pdf) else {}
        at = [where[n] for n in pdf[keys.entity]]
        w = np.zeros(len(pdf))
        if len(pdf) >= 2:
            c = np.stack(pdf["covariance"].to_numpy())[:, at]
            if factors:
                b, f, d = factor_model(nearest_psd(c), factors)
                c = (b * f) @ b.T + np.diag(d)
            w = constrained_weights(pdf[alpha].to_numpy(float), c, budget, penalty, gross, box)
        return pdf[[keys.time, keys.entity, alpha]].assign(**{new: w})

    return rows.groupBy(keys.time).applyInPandas(run, f"{keys.time} {kinds[keys.time]}, {keys.entity} {kinds[keys.entity]}, {alpha} double, {new} double")


def smoothed_alpha(df: DataFrame, alpha: str, half_life: float, new: str, keys: Keys = KEYS) -> DataFrame:
    """Exponentially weighted alpha by series, alpha = 2^(-1 / half_life)."""
    from panelforge.operators.kernels import ewm

    return ewm(df, {new: (alpha, 2 ** (-1 / half_life))}, keys)


def penalised_weights(alpha: np.ndarray, loadings: np.ndarray, factor_variance: np.ndarray, residual_variance: np.ndarray, start: np.ndarray | None = None, neutral: np.ndarray | None = None, penalty: float = 1.0, gross: float = 1.0, box: float = 0.02, trade: float = 0.01, rounds: int = 400) -> np.ndarray:
    """max alpha'x - penalty * sqrt(x'Cx) for a factor covariance C = B diag(f) B' + diag(d), with sum x = 0,
    neutral x = 0 (rows are exposures), |x| <= box, |x - start| <= trade and sum |x| <= gross: subgradient steps, each
    followed by projection on the equalities and the box in turn; the result is feasible to 1e-6."""
    n = len(alpha)
    start = np.zeros(n) if start is None else start
    rows = np.vstack([np.ones((1, n)), *([neutral] if neutral is not None else [])])
    onto = np.eye(n) - np.linalg.pinv(rows) @ rows
    low, high = np.maximum(-box, start - trade), np.minimum(box, start + trade)

    def feasible(x: np.ndarray) -> np.ndarray:
        p, q = np.zeros(n), np.zeros(n)
        for _ in range(200):  # Dykstra between the subspace and the box
            y = onto @ (x + p)
            p = x + p - y
            z = np.clip(y + q, low, high)
            q = y + q - z
            if np.abs(z - x).max() < 1e-12 and np.abs(rows @ z).max() < 1e-9:
                break
            x = z
        x = onto @ x
        return x * min(1.0, gross / max(np.abs(x).sum(), 1e-12))

    def risk(x: np.ndarray) -> tuple[float, np.ndarray]:
        g = loadings @ (factor_variance * (loadings.T @ x)) + residual_variance * x
        r = float(np.sqrt(max(x @ g, 1e-18)))
        return r, g / r

    x = best = feasible(start.copy())
    top = alpha @ best - penalty * risk(best)[0]
    for k in range(rounds):
        grad = alpha - penalty * risk(x)[1]
        x = feasible(x + box / np.sqrt(k + 1) * grad / max(np.abs(grad).max(), 1e-12))
        if (value := alpha @ x - penalty * risk(x)[0]) > top:
            best, top = x, value
    return best
