"""Tail probabilities for small aggregated results.

Spark SQL has no chi-square or Student-t distribution. These run as Arrow-batched
functions on result tables of at most (features x flags) rows, never on data.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _build():
    # nested, so that tasks receive the functions themselves and need no installed package
    eps = 1e-15
    tiny = 1e-300

    def gamma_tail(shape: float, x: float) -> float:
        """Regularised upper incomplete gamma Q(shape, x)."""
        if x <= 0:
            return 1.0
        scale = math.exp(-x + shape * math.log(x) - math.lgamma(shape))
        if x < shape + 1:  # power series of the lower tail
            term = total = 1.0 / shape
            k = shape
            while abs(term) > abs(total) * eps:
                k += 1
                term *= x / k
                total += term
            return max(0.0, 1.0 - total * scale)
        b = x + 1 - shape  # continued fraction of the upper tail
        c, d = 1 / tiny, 1 / b
        value = d
        for i in range(1, 10_000):
            a = -i * (i - shape)
            b += 2
            d = 1 / nonzero(a * d + b)
            c = nonzero(b + a / c)
            value *= c * d
            if abs(c * d - 1) < eps:
                break
        return scale * value

    def beta_cdf(x: float, a: float, b: float) -> float:
        """Regularised incomplete beta I_x(a, b)."""
        if x <= 0:
            return 0.0
        if x >= 1:
            return 1.0
        if x > (a + 1) / (a + b + 2):
            return 1.0 - beta_cdf(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1 / nonzero(1 - (a + b) * x / (a + 1))
        value = d
        for m in range(1, 10_000):
            for step in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 / nonzero(1 + step * d)
                c = nonzero(1 + step / c)
                value *= c * d
            if abs(c * d - 1) < eps:
                break
        return front * value

    def nonzero(v: float) -> float:
        return v if abs(v) > tiny else tiny

    def chi_square_p(statistic: float, dof: float) -> float | None:
        if statistic is None or math.isnan(statistic):
            return None
        return 1.0 if dof == 0 else gamma_tail(dof / 2, statistic / 2)

    def correlation_p(r: float, n: float) -> float | None:
        """Two-sided p of a correlation from n pairs (Student t with n - 2 degrees)."""
        if r is None or math.isnan(r) or n < 3:
            return None
        left = (1 - r) * (1 + r)
        return 0.0 if left <= 0 else beta_cdf(left, (n - 2) / 2, 0.5)

    @F.pandas_udf(T.DoubleType())
    def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([chi_square_p(s, d) for s, d in zip(statistic, dof)], dtype="float64")

    @F.pandas_udf(T.DoubleType())
    def correlation_tail(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(x, m) for x, m in zip(r, n)], dtype="float64")

    return gamma_tail, beta_cdf, chi_square_p, correlation_p, chi_square_tail, correlation_tail


gamma_tail, beta_cdf, chi_square_p, correlation_p, chi_square_tail, correlation_tail = _build()
