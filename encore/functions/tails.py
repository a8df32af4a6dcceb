"""Tail probabilities for one-row-per-test tables.

The statistics themselves are Spark aggregates; these Arrow-batched helpers
only turn a few numbers per finished test into a p-value (the JVM functions
hold no t, F or chi-square distribution).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from encore.session import ship_package


def _betacf(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        for _ in range(2000):
            n += 1.0
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return 1.0 - front * total
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_upper(t: float, df: float) -> float:
    half = t_two_sided(t, df) / 2.0
    return half if t >= 0 else 1.0 - half


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def binomial_upper(k: float, n: float, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else beta_inc(k, n - k + 1.0, p)


def _column(fn):
    def evaluate(*cols):
        ship_package(SparkSession.active())

        @F.pandas_udf("double")
        def tail(*series: pd.Series) -> pd.Series:
            rows = zip(*[s.astype("float64") for s in series])
            return pd.Series([fn(*r) if all(np.isfinite(r)) else np.nan for r in rows], dtype="float64")

        return tail(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])

    return evaluate


t_two_sided_col = _column(t_two_sided)
t_upper_col = _column(t_upper)
f_upper_col = _column(f_upper)
chi2_upper_col = _column(chi2_upper)
normal_two_sided_col = _column(normal_two_sided)
binomial_upper_col = _column(binomial_upper)
