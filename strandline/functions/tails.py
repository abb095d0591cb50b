"""Distribution tails that Spark has no function for, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_upper(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the finite sums for even and odd ``df``."""
    if df < 1:
        raise ValueError("degrees of freedom must be positive")
    if math.isnan(x) or x <= 0:
        return math.nan if math.isnan(x) else 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) * math.exp(-half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return min(1.0, total)


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of non-negative numbers: a power series below 3, a continued fraction above."""
    x = np.asarray(x, float)
    near, far = np.minimum(x, 3.0), np.maximum(x, 3.0)
    total = term = 2 / math.sqrt(math.pi) * near * np.exp(-near * near)
    for k in range(1, 80):
        term = term * 2 * near * near / (2 * k + 1)
        total = total + term
    with np.errstate(invalid="ignore"):
        rest = far.copy()
        for k in range(60, 0, -1):
            rest = far + k / 2 / rest
        tail = np.where(np.isinf(far), 0.0, np.exp(-far * far) / (math.sqrt(math.pi) * rest))
    return np.where(x < 3.0, 1 - total, np.where(np.isnan(x), np.nan, tail))


def chi_square_uppers(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """``chi_square_upper`` of arrays: the finite sums run over all elements at once."""
    x, df = np.asarray(x, float), np.asarray(df, np.int64)
    half, odd = np.maximum(x, 0.0) / 2, df % 2 == 1
    with np.errstate(all="ignore"):
        total = np.where(odd, erfc(np.sqrt(half)), np.exp(-half))
        term = np.where(odd, np.sqrt(half) * np.exp(-half) / math.gamma(1.5), np.exp(-half) * half)
        for k in range(1, (int(df.max(initial=1)) + 1) // 2):
            more = k < (df + 1) // 2
            total = np.where(more, total + term, total)
            term = term * half / np.where(odd, k + 0.5, k + 1.0)
    return np.where(np.isnan(x), np.nan, np.where(x <= 0, 1.0, np.minimum(total, 1.0)))


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series(erfc(np.abs(z.to_numpy(float)) / math.sqrt(2))) if len(z) else z.astype("float64")


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi_square_uppers(x.to_numpy(float), df.to_numpy()), dtype="float64")


def normal_quantile(p: float) -> float:
    """Inverse normal distribution by bisection on erfc; for confidence bands on the driver."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if math.erfc(-middle / math.sqrt(2)) / 2 < p else (low, middle)
    return (low + high) / 2


def levinson(acf: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations (lag 0 first) by the Levinson-Durbin recursion."""
    out = np.ones(len(acf))
    phi = np.zeros(len(acf))
    variance = 1.0
    for k in range(1, len(acf)):
        if variance <= 0:
            out[k:] = np.nan
            break
        reflection = (acf[k] - phi[1:k] @ acf[k - 1 : 0 : -1]) / variance
        phi[1:k] = phi[1:k] - reflection * phi[k - 1 : 0 : -1]
        phi[k] = out[k] = reflection
        variance *= 1 - reflection * reflection
    return out
