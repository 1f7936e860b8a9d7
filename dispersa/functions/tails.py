"""Tail probabilities as vectorised columns, by regularised incomplete beta and gamma functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 400
_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised I_x(a, b), by its continued fraction on the side where that converges fast."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, ROUNDS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + step / np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
    inside = np.clip(x, _TINY, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)) / a
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.clip(front * h, 0, 1)))
    return np.where(swap, 1 - out, out)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised Q(a, x): a series below a + 1, a continued fraction beyond it."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    safe = np.maximum(x, _TINY)
    front = np.exp(a * np.log(safe) - safe - _lgamma(a))
    term, total = 1 / a, 1 / a
    low = np.minimum(safe, a + 1)
    for n in range(1, ROUNDS):
        term = term * low / (a + n)
        total = total + term
    high = np.maximum(safe, a + 1)
    b = high + 1 - a
    c, d = np.full_like(b, 1 / _TINY), 1 / b
    h = d.copy()
    for n in range(1, ROUNDS):
        step = -n * (n - a)
        b = b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + step / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
    return np.where(x <= 0, 1.0, np.clip(np.where(x < a + 1, 1 - front * total, front * h), 0, 1))


def _of(f, *cols: Column) -> Column:
    """A double column of f over double columns; null where any is null or not a number, or f isn't one."""

    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        values = [p.to_numpy(float) for p in parts]
        ok = np.all([np.isfinite(v) for v in values], axis=0)
        out = np.full(len(ok), np.nan)
        if ok.any():
            with np.errstate(all="ignore"):
                out[ok] = f(*[v[ok] for v in values])
        return pd.Series(out).where(~np.isnan(out), None)

    return run(*[c.cast("double") for c in cols])


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal z."""
    return _of(lambda v: upper_gamma(np.full(len(v), 0.5), v * v / 2), z)


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared."""
    return _of(lambda v, k: np.where(k > 0, upper_gamma(np.maximum(k, 1e-9) / 2, v / 2), np.nan), x, df)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return _of(lambda v, k: np.where(k > 0, incomplete_beta(k / (k + v * v), np.maximum(k, 1e-9) / 2, np.full(len(v), 0.5)), np.nan), t, df)


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of F."""
    return _of(lambda v, a, b: np.where((a > 0) & (b > 0), incomplete_beta(b / (b + a * np.maximum(v, 0)), np.maximum(b, 1e-9) / 2, np.maximum(a, 1e-9) / 2), np.nan), f, df1, df2)


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a correlation by the t approximation; 0 at a correlation of 1 or -1."""
    t = rho * F.sqrt((n - 2) / (1 - rho * rho))
    return F.when(F.abs(rho) >= 1, 0.0).otherwise(student_p(F.when(F.abs(rho) < 1, t), n - 2))


def _phi(z: np.ndarray) -> np.ndarray:
    """Distribution of a standard normal."""
    tail = upper_gamma(np.full(z.size, 0.5), z.ravel() ** 2 / 2).reshape(z.shape) / 2
    return np.where(z > 0, 1 - tail, tail)


def studentised_range(q: np.ndarray, k: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of the range of k standard normals over an independent estimate of their deviation with df degrees of freedom.

    The range's distribution, an integral over its least value, is averaged over the estimate's density; both by Gauss-Legendre nodes.
    """
    x, w = np.polynomial.legendre.leggauss(80)
    z, wz = 8.0 * x, 8.0 * w
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    out = np.empty(len(q))
    for i, (r, m, n) in enumerate(zip(q.tolist(), k.tolist(), df.tolist())):
        n = min(n, 1e6)  # the estimate is exact beyond
        half = min(0.999, 9 / np.sqrt(2 * n))
        s, ws = (1 + half * x, half * w) if half < 0.999 else (2.5 + 2.5 * x, 2.5 * w)
        log = n * np.log(s) - n * s * s / 2
        weight = np.exp(log - log.max() - np.log(s)) * ws
        inside = (_phi(z)[None] - _phi(z[None] - r * s[:, None])) ** (m - 1)
        out[i] = 1 - float(weight / weight.sum() @ (m * inside @ (density * wz)))
    return np.clip(out, 0.0, 1.0)


def tukey_p(q: Column, k: Column, df: Column) -> Column:
    """Upper tail of the studentised range."""
    return _of(lambda v, m, n: studentised_range(v, m, n), q, k, df)
