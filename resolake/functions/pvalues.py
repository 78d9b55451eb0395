"""Tail probabilities as vectorised functions: no statistics library is assumed."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d or 1e-300)
            c = 1 + k / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def student_two_sided(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def hypergeometric_tail(k: int, drawn: int, marked: int, total: int) -> float:
    """P(at least k marked among the drawn)."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    base = choose(total, drawn)
    low, high = max(k, drawn + marked - total, 0), min(drawn, marked)
    return min(1.0, sum(math.exp(choose(marked, r) + choose(total - marked, drawn - r) - base) for r in range(low, high + 1)))


#: Inverse normal, compiled.
normal_quantile = NormalDist().inv_cdf


def _each(f, *columns: pd.Series) -> pd.Series:
    known = np.logical_and.reduce([c.notna().to_numpy() for c in columns])
    return pd.Series([f(*v) if ok else None for ok, *v in zip(known, *columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda a, b: chi2_tail(a, b) if b > 0 else math.nan, x, df)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation through Student's t."""
    return _each(lambda a, b: 0.0 if abs(a) >= 1 else student_two_sided(a * math.sqrt((b - 2) / (1 - a * a)), b - 2) if b > 2 else math.nan, r, n)


@F.pandas_udf(DoubleType())
def fisher_greater_p(overlap: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    return _each(lambda *v: hypergeometric_tail(*map(int, v)), overlap, drawn, marked, total)


@F.pandas_udf(DoubleType())
def normal_upper_p(z: pd.Series) -> pd.Series:
    return _each(normal_tail, z)


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    return _each(lambda x: normal_quantile(x) if 0 < x < 1 else math.nan, p)
