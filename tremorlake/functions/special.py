"""Special functions Spark lacks, as vectorised Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_EULER = 0.5772156649015329


def exp1_array(x: np.ndarray) -> np.ndarray:
    """Exponential integral E1 for x > 0: power series, then continued fraction."""
    x = np.asarray(x, dtype=float)
    out = np.full(x.shape, np.nan)
    small = (x > 0) & (x <= 1.0)
    if small.any():
        xs = x[small]
        total, term = np.zeros_like(xs), np.ones_like(xs)
        for k in range(1, 40):
            term = term * (-xs) / k
            total -= term / k
        out[small] = total - _EULER - np.log(xs)
    large = x > 1.0
    if large.any():
        xl = x[large]
        frac = np.zeros_like(xl)
        for k in range(120, 0, -1):
            frac = k / (1.0 + k / (xl + frac))
        with np.errstate(under="ignore"):
            out[large] = np.exp(-xl) / (xl + frac)
    return out


def erf_array(x: np.ndarray) -> np.ndarray:
    """Error function: Taylor series up to 2.5, continued fraction of the complement beyond."""
    x = np.asarray(x, dtype=float)
    a = np.abs(x)
    out = np.full(x.shape, np.nan)
    small = a <= 2.5
    if small.any():
        xs = a[small]
        total, term = xs.copy(), xs.copy()
        for k in range(1, 60):
            term = term * (-xs * xs) / k
            total += term / (2 * k + 1)
        out[small] = total * 2 / np.sqrt(np.pi)
    large = a > 2.5
    if large.any():
        xl = np.minimum(a[large], 30.0)
        frac = np.zeros_like(xl)
        for k in range(60, 0, -1):
            frac = (k / 2) / (xl + frac)
        out[large] = 1 - np.exp(-xl * xl) / np.sqrt(np.pi) / (xl + frac)
    return np.copysign(out, x)


def erf_udf():
    """Column function: error function."""

    @F.pandas_udf("double")
    def erf(x: pd.Series) -> pd.Series:
        return pd.Series(erf_array(x.to_numpy(dtype=float)))

    return erf


def exp1_udf():
    """Column function: exponential integral E1."""

    @F.pandas_udf("double")
    def exp1(x: pd.Series) -> pd.Series:
        return pd.Series(exp1_array(x.to_numpy(dtype=float)))

    return exp1
