"""Tail probabilities of test statistics, as Arrow functions over columns."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_tail(x: np.ndarray, a: np.ndarray, b: float) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), b fixed."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    turn = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(turn, 1 - out, out)


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return _beta_tail(df / (df + t * t), df / 2, 0.5)


@lru_cache(maxsize=None)
def _counts(a: int, b: int) -> np.ndarray:
    """In how many orders of a and b values U comes out as 0, 1, ..., a * b: coefficients of a product of quotients."""
    out = np.zeros(a * b + 1)
    out[0] = 1
    for i in range(1, a + 1):
        for j in range(a * b, b + i - 1, -1):
            out[j] -= out[j - b - i]
        for j in range(i, a * b + 1):
            out[j] += out[j - i]
    return out


def u_tail(u: float, a: int, b: int) -> float:
    """Two-sided exact tail of U for untied samples of a and b values."""
    counts = _counts(min(a, b), max(a, b))
    top = max(u, a * b - u)
    return float(min(1.0, 2 * counts[math.ceil(top) :].sum() / counts.sum()))


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    known = t.notna() & df.notna()
    return pd.Series(np.where(known, t_tail(t.fillna(0.0), df.fillna(1.0)), np.nan)).where(known, None)


@pandas_udf(DoubleType())
def t_less(t: pd.Series, df: pd.Series) -> pd.Series:
    """The tail below t."""
    known = t.notna() & df.notna()
    half = t_tail(t.fillna(0.0), df.fillna(1.0)) / 2
    return pd.Series(np.where(t.fillna(0.0) < 0, half, 1 - half)).where(known, None)


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else min(1.0, math.erfc(x / math.sqrt(2))))


@pandas_udf(DoubleType())
def u_two_sided(u: pd.Series, a: pd.Series, b: pd.Series, z: pd.Series, tied: pd.Series) -> pd.Series:
    """Exact for untied samples of which one has at most eight values, else by the normal deviate."""
    rows = zip(u, a, b, z, tied, strict=True)
    return pd.Series([u_tail(x, int(m), int(n)) if min(m, n) <= 8 and not t else min(1.0, math.erfc(y / math.sqrt(2))) for x, m, n, y, t in rows])
