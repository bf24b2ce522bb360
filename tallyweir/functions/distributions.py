"""Tail probabilities that Spark lacks, as vectorised helpers for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Degrees of freedom from which Student's t is a corrected normal.
NORMAL_FROM = 1e6


def chi_square_tail(x: float, df: float) -> float:
    """P(X >= x) for a chi-square variable: upper incomplete gamma ratio."""
    if not (df > 0) or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        step = a
        while abs(term) > 1e-16 * abs(total):
            step += 1.0
            term *= z / step
            total += term
        return max(0.0, 1.0 - total * scale)
    return scale * _continued_fraction(lambda k: -k * (k - a), lambda k: z + 2 * k + 1.0 - a)


def _continued_fraction(numerator, denominator) -> float:
    """1 / (b0 + a1 / (b1 + a2 / (b2 + ...))), evaluated from the front."""
    tiny = 1e-300
    d = denominator(0) or tiny
    c = 1.0 / tiny
    d = 1.0 / d
    h = d
    for k in range(1, 10_000):
        a, b = numerator(k), denominator(k)
        d = a * d + b
        d = 1.0 / (d if d else tiny)
        c = b + a / c
        c = c if c else tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return h
    return math.nan  # not converged


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isnan(t) or not (df > 0):
        return float("nan")
    if df > NORMAL_FROM:  # log-gamma differences lose their digits; this is exact to the order of 1 / df ** 2
        return math.erfc(abs(t) * (1.0 - 0.25 / df) / math.sqrt(1.0 + t * t / (2.0 * df)) / math.sqrt(2.0))
    x = df / (df + t * t)
    return _beta_ratio(df / 2.0, 0.5, x)


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_ratio(b, a, 1.0 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )

    def numerator(k: int) -> float:
        m = k // 2
        if k % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    return front / a * _continued_fraction(numerator, lambda k: 1.0)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value per row; used on coefficient tables only."""
    values = zip(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(np.array([student_two_sided(a, b) for a, b in values]))
