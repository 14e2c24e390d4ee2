"""Normal, t and beta distributions on numpy arrays, and as Arrow functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2e-308


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x.ravel()]).reshape(x.shape)


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by its continued fraction on the side where that converges fast."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x, inside = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x), (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(a * np.log(y) + b * np.log1p(-y) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
    floor = 1e-300
    away = lambda v: np.where(np.abs(v) > floor, v, floor)
    # Lentz's evaluation.
    c, d = np.ones_like(y), 1 / away(1 - (a + b) * y / (a + 1))
    out = d.copy()
    for m in range(1, 500):
        for top in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + top * d)
            c = away(1 + top / c)
            out *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    low = np.where(inside, front * out, (x >= 1).astype(float))
    return np.where(flip, 1 - low, low)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantiles of Beta(a, b) by halving, all at once."""
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for _ in range(60):
        mid = (lo + hi) / 2
        less = beta_cdf(a, b, mid) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_cdf(df / 2, np.full_like(t, 0.5), df / (df + t * t))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal."""
    return F.pandas_udf(lambda z_: pd.Series([np.nan if pd.isna(v) else 0.5 * math.erfc(v / math.sqrt(2)) for v in z_], dtype=float), "double")(z)


def signed_z(l_value: Column, p: Column) -> Column:
    """sign(L) times the upper normal quantile of p / 2; 0 for p of 1 or more."""

    def z(sign: pd.Series, p_: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return pd.Series([None if pd.isna(v) else 0.0 if v >= 1 else -s * inv(max(v / 2, TINY)) for s, v in zip(sign, p_, strict=True)], dtype=float)

    return F.pandas_udf(z, "double")(F.signum(l_value), p)


def t_p_value(t: Column, df: Column) -> Column:
    def p(t_: pd.Series, df_: pd.Series) -> pd.Series:
        known = t_.notna().to_numpy()
        out = np.full(len(t_), np.nan)
        out[known] = t_two_sided(t_.to_numpy(float)[known], df_.to_numpy(float)[known])
        return pd.Series(out)

    return F.pandas_udf(p, "double")(t, df.cast("double"))


def beta_interval(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Quantiles of Beta(k + 1, n - k + 1)."""

    def at(q: float) -> Column:
        def f(k_: pd.Series, n_: pd.Series) -> pd.Series:
            a, b = k_.to_numpy(float) + 1, n_.to_numpy(float) - k_.to_numpy(float) + 1
            return pd.Series(beta_quantile(q, a, b))

        return F.pandas_udf(f, "double")(k, n)

    return at((1 - level) / 2), at((1 + level) / 2)
