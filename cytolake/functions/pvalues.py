"""Tail probabilities Spark has no built-in for; applied to one row per feature."""

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@lru_cache(maxsize=256)
def _u_law(small: int, large: int) -> tuple[int, ...]:
    """Exact law of U: coefficients of the Gaussian binomial prod (1-q^(large+i)) / (1-q^i)."""
    size = small * large + 1
    law = [1] + [0] * (size - 1)
    for i in range(1, small + 1):
        for u in range(size - 1, large + i - 1, -1):
            law[u] -= law[u - large - i]
        for u in range(i, size):
            law[u] += law[u - i]
    return tuple(law)


def exact_u_two_sided(u_high: float, n1: int, n2: int) -> float:
    law = _u_law(min(n1, n2), max(n1, n2))
    return min(1.0, 2.0 * (sum(law[math.ceil(u_high):]) / sum(law)))


def student_two_sided(t: float, df: float) -> float:
    """Two-sided Student-t tail: the regularised incomplete beta I_x(df/2, 1/2), x = df/(df+t^2)."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if a * (1.0 - x) > 700.0:  # below e^-700
        return 0.0
    flip = x > 0.5
    p, q, y = (b, a, 1.0 - x) if flip else (a, b, x)
    front = math.exp(
        math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(y) + q * math.log1p(-y)
    )
    # hypergeometric series: I_y(p, q) = front / p * sum_k prod (p+q+k)/(p+1+k) y^k
    term, total, k = 1.0, 1.0, 0
    while term > total * 1e-17:
        term *= (p + q + k) / (p + 1.0 + k) * y
        total += term
        k += 1
    part = front * total / p
    return min(1.0, max(0.0, 1.0 - part if flip else part))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(z: pd.Series, u_high: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    def one(zz, uu, a, b, has_ties):
        if pd.isna(uu):
            return None
        if min(a, b) <= 8 and not has_ties:
            return exact_u_two_sided(uu, int(a), int(b))
        return None if pd.isna(zz) else normal_two_sided(zz)

    return pd.Series([one(*row) for row in zip(z, u_high, n1, n2, ties)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    rows = zip(t, df)
    return pd.Series(
        [None if pd.isna(a) or pd.isna(d) else student_two_sided(a, d) for a, d in rows], dtype="float64"
    )
