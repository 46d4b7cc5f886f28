"""Quantiles of the beta distribution, on whole columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x = np.asarray(x, "float64")
    if a <= 0 or b <= 0:
        raise ValueError("both parameters of a beta distribution are positive")
    swap = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    inner = (z > 0) & (z < 1)
    z = np.where(inner, z, 0.5)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 1000):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = np.where(inner, front * f, np.where(np.where(swap, 1 - x, x) <= 0, 0.0, 1.0))
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


def beta_quantile(u: np.ndarray, a: float, b: float) -> np.ndarray:
    """Where the distribution has u below it, by halving the interval; exact to the last digits of a double near 0 and to 1e-16 elsewhere."""
    u = np.asarray(u, "float64")
    low, high = np.zeros_like(u), np.ones_like(u)
    for k in range(1100):
        # Halving exponents first finds quantiles that lie very close to 0.
        middle = np.where((low == 0) & (high > 1e-300) & (k % 2 == 1), high * high, (low + high) / 2)
        below = beta_cdf(middle, a, b) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
        if ((high - low) <= 1e-16 * high).all():
            break
    out = (low + high) / 2
    return np.where(u <= 0, 0.0, np.where(u >= 1, 1.0, out))


def beta_from_uniform(u: Column, a: float, b: float) -> Column:
    """A beta-distributed number for each uniform one; NULL stays NULL."""

    @F.pandas_udf("double")
    def quantiles(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), np.nan, beta_quantile(v.fillna(0.5).to_numpy("float64"), a, b)), index=v.index)

    return F.when(u.isNotNull(), quantiles(u))
