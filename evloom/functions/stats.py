"""Interval estimates and the few distribution functions that need numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = 1.959963984540054


def wilson(successes: Column, trials: Column) -> tuple[Column, Column, Column]:
    """(estimate, lower, upper) of a binomial proportion; nulls without trials."""
    s, n = successes.cast("double"), F.when(trials > 0, trials.cast("double"))
    p, z2 = s / n, Z975 * Z975
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z975 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    guard = lambda c: F.when(n.isNotNull(), c)
    return p, guard(F.greatest(F.lit(0.0), centre - half)), guard(F.least(F.lit(1.0), centre + half))


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = shift + np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    inv = 1 / y
    series = inv / 12 - inv ** 3 / 360 + inv ** 5 / 1260 - inv ** 7 / 1680 + inv ** 9 / 1188
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta by its continued fraction."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    flip = x > (a + 1) / (a + b + 2)
    p, q, u = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(u) + q * np.log1p(-u)) / p
        tiny = 1e-300
        c, d = np.ones_like(u), 1 / np.where(np.abs(1 - (p + q) * u / (p + 1)) < tiny, tiny, 1 - (p + q) * u / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for numerator in (m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)),
                              -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + numerator * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + numerator / np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-15:
                break
    out = np.where(u <= 0, 0.0, np.where(u >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile for p > 0.5, by bisection on the two-sided tail."""
    df = np.asarray(df, dtype=float)
    low, high = np.zeros_like(df), np.full_like(df, 1e8)
    for _ in range(200):
        mid = np.where(high > 4 * np.maximum(low, 1), np.sqrt(np.maximum(low, 1e-3) * high), (low + high) / 2)
        above = t_two_sided(mid, df) > 2 * (1 - p)
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def chi2_tail(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(chi-square with k degrees of freedom > q)."""
    a, x = np.broadcast_arrays(np.asarray(k, dtype=float) / 2, np.asarray(q, dtype=float) / 2)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(-x + a * np.log(x) - _lgamma(a))
        term = total = 1 / a
        for n in range(1, 2000):
            term = term * x / (a + n)
            total = total + term
            if np.nanmax(np.abs(term / total), initial=0.0) < 1e-16:
                break
        lower = front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if np.nanmax(np.abs(d * c - 1), initial=0.0) < 1e-16:
                break
        upper = front * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - lower, upper))


def _series(fn):
    def wrapped(*cols: pd.Series) -> pd.Series:
        frame = [c.to_numpy(dtype=float, na_value=np.nan) for c in cols]
        ok = ~np.any([np.isnan(c) for c in frame], axis=0)
        out = np.full(len(cols[0]), np.nan)
        if ok.any():
            out[ok] = fn(*[c[ok] for c in frame])
        return pd.Series(out).where(ok, None).astype("Float64")
    return wrapped


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _series(t_two_sided)(a, b)
    return tail(t, df.cast("double"))


def t_critical(df: Column) -> Column:
    """97.5 % quantile of Student's t."""
    @F.pandas_udf("double")
    def quantile(b: pd.Series) -> pd.Series:
        return _series(lambda d: t_quantile(0.975, d))(b)
    return quantile(df.cast("double"))


def chi2_p_value(q: Column, k: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _series(chi2_tail)(a, b)
    return tail(q, k.cast("double"))
