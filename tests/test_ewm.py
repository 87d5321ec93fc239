"""Exponentially weighted averages by blocks against the plain recursion."""

import datetime
import math
import random

import pytest

from panelforge.operators import kernels


def plain(xs, alpha):
    """(mean, variance) after every value, by the recursion over weights; a missing value only ages them."""
    mean = cov = None
    old, s2, out = 1.0, 1.0, []
    for x in xs:
        if mean is not None:
            old *= 1 - alpha
        if x is not None and x == x:
            if mean is None:
                mean, cov = x, 0.0
            else:
                t, was = old + alpha, mean
                mean = (old * was + alpha * x) / t
                cov = (old * (cov + (was - mean) ** 2) + alpha * (x - mean) ** 2) / t
                s2 = (s2 * old * old + alpha * alpha) / t / t
                old = 1.0
        # after a long gap one value has nearly all the weight, and the variance is a quotient of two small numbers
        out.append((mean, None if mean is None or 1 - s2 <= 1e-15 else cov / (1 - s2) if 1 - s2 > 1e-4 else math.nan))
    return out


@pytest.mark.parametrize("alpha", [0.01, 2 / 11, 0.9, 1.0])
@pytest.mark.parametrize("block", [3, 512])
def test_means_and_variances(spark, monkeypatch, alpha, block):
    monkeypatch.setattr(kernels, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for name, missing in (("a", 0.0), ("b", 0.5), ("c", 0.97), ("d", 1.0), (None, 0.3)):
        day = datetime.date(2023, 11, 1)
        for _ in range(160):
            day += datetime.timedelta(rng.choice([1, 1, 2, 40]))
            rows.append((name, day, None if rng.random() < missing else rng.choice([rng.gauss(0, 1), math.nan, 2.0])))
    df = spark.createDataFrame(rows, "ticker string, ts date, x double")
    mean = {(r["ticker"], r["ts"]): r["m"] for r in kernels.ewm(df, {"m": ("x", alpha)}).collect()}
    spread = {(r["ticker"], r["ts"]): r["v"] for r in kernels.ewm(df, {"v": ("x", alpha)}, variance=True).collect()}
    assert len(mean) == len(rows)
    for name in ("a", "b", "c", "d", None):
        own = [r for r in rows if r[0] == name]
        for (_, day, _), (m, v) in zip(own, plain([r[2] for r in own], alpha), strict=True):
            assert mean[name, day] == (None if m is None else pytest.approx(m, abs=1e-12))
            assert v is None or math.isnan(v) or spread[name, day] == pytest.approx(v, abs=1e-9)
            assert m is not None or spread[name, day] is None
