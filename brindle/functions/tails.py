"""Tail probabilities and quantiles of a handful of aggregated rows.

Plain functions (normal by erfc; Student-t and F by the regularised incomplete
beta function, chi-square by the incomplete gamma function, both as continued
fractions) and Arrow UDFs around them. They are for aggregates, never for raw rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_regular(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regular(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_regular(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_regular(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student-t by bisection on its tail."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def _rows(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*cols, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    return _rows(normal_two_sided, z)


@pandas_udf(DoubleType())
def phi(z: pd.Series) -> pd.Series:
    return _rows(normal_cdf, z)


@pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_two_sided, t, df)


@pandas_udf(DoubleType())
def q_t(p: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_quantile, p, df)


@pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rows(f_upper, f, d1, d2)


@pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(chi2_upper, x, df)


def beta_better(al_a: float, be_a: float, al_b: float, be_b: float, cells: int = 8192) -> float:
    """P(b > a) of two Beta variables, by midpoints over the range where either has mass."""
    def spread(al: float, be: float) -> tuple[float, float]:
        mean, sd = al / (al + be), math.sqrt(al * be / ((al + be) ** 2 * (al + be + 1)))
        return max(0.0, mean - 12 * sd), min(1.0, mean + 12 * sd)

    (la, ha), (lb, hb) = spread(al_a, be_a), spread(al_b, be_b)
    low, high = min(la, lb), max(ha, hb)
    x = low + (np.arange(cells) + 0.5) * (high - low) / cells

    def mass(al: float, be: float) -> np.ndarray:
        log = (al - 1) * np.log(x) + (be - 1) * np.log1p(-x)
        w = np.exp(log - log.max())
        return w / w.sum()

    a, b = mass(al_a, be_a), mass(al_b, be_b)
    return float((b * (np.cumsum(a) - a / 2)).sum())


@pandas_udf(DoubleType())
def p_beta_better(al_a: pd.Series, be_a: pd.Series, al_b: pd.Series, be_b: pd.Series) -> pd.Series:
    return _rows(beta_better, al_a, be_a, al_b, be_b)
