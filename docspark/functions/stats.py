"""Tail probabilities as Arrow UDFs over result rows (one row per test)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _kolmogorov(lam: float) -> float:
    if lam < 1e-3:
        return 1.0
    s, sign = 0.0, 1.0
    for k in range(1, 101):
        term = math.exp(-2.0 * (k * lam) ** 2)
        s += sign * term
        sign = -sign
        if term < 1e-16:
            break
    return min(1.0, max(0.0, 2.0 * s))


def _chi2_tail(x: float, dof: int) -> float:
    """Upper tail by the finite sums that hold for integer degrees of freedom.

    Each term is taken from its logarithm, so none vanishes before the large ones are reached.
    """
    if dof <= 0 or x <= 0:
        return 1.0
    h = x / 2.0
    odd = dof % 2
    shift = 0.5 if odd else 0.0
    logs = ((k + shift) * math.log(h) - h - math.lgamma(k + shift + 1.0) for k in range(dof // 2))
    total = math.fsum(math.exp(v) for v in logs if v > -745.0)
    return min(1.0, total + (math.erfc(math.sqrt(h)) if odd else 0.0))


def _over(fn):
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*cols)], dtype="float64")

    return run


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _over(_normal_two_sided)(z)


@F.pandas_udf(T.DoubleType())
def ks_pvalue(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Asymptotic two-sample p-value."""
    return _over(lambda s, a, b: _kolmogorov(s * math.sqrt(a * b / (a + b))))(d, n, m)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _over(lambda s, k: _chi2_tail(s, int(k)))(x, dof)
