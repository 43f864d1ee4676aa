"""Tail probabilities of Student t, F and chi-square (one degree).

Spark has no incomplete beta function, so it is evaluated over Arrow batches;
inputs are one row per fitted group, never the measurements themselves.
"""

from __future__ import annotations

from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive values: ten steps up, then Stirling's formula."""
    x = np.asarray(x, float)
    up = x + 10
    with np.errstate(all="ignore"):
        steps = np.log(np.prod([x + i for i in range(10)], axis=0))
        return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + _stirling_rest(up) - steps


def _erfc_values(x: np.ndarray) -> np.ndarray:
    return np.array([erfc(v) for v in np.ravel(x)]).reshape(np.shape(x))


#: Beyond this many degrees of freedom t follows from its expansion around the normal (error below 1e-11).
LARGE_DF = 1e5


def _stirling_rest(x: np.ndarray) -> np.ndarray:
    """log gamma(x) less the leading part of Stirling's formula, x of 10 or more."""
    y = 1 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log B(a, b) without the loss of digits that differences of log gamma have for large arguments."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    with np.errstate(all="ignore"):
        shift = (high - 0.5) * np.log1p(low / high) + low * np.log(low + high) - low
        large = _log_gamma(low) - shift + _stirling_rest(high) - _stirling_rest(low + high)
        small = _log_gamma(low) + _log_gamma(np.minimum(high, 10)) - _log_gamma(low + np.minimum(high, 10))
    return np.where(high >= 10, large, small)


def _fraction(p: np.ndarray, q: np.ndarray, z: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Lentz's steps; a value that has converged is final and leaves, so none waits for the others."""
    out, left = d.copy(), np.arange(len(d))
    c, h = np.ones_like(d), d.copy()
    m = 0
    while len(left):
        m += 1
        if m > 100_000:
            raise ArithmeticError("the incomplete beta function does not converge for these degrees of freedom")
        for step in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
        going = np.abs(d * c - 1) >= 1e-15
        if not going.all():
            out[left[~going]] = h[~going]
            left, p, q, z, c, d, h = (v[going] for v in (left, p, q, z, c, d, h))
    return out


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """I_x(a, b) by the continued fraction (Lentz), symmetric form for large x; ``rest`` is 1 - x with all its digits.

    Arguments that are not above zero give nan. Raises when the fraction does not converge.
    """
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, rest)))
    known = (a > 0) & (b > 0) & ~np.isnan(x)
    a, b, x, rest = (np.where(known, v, w) for v, w in ((a, 1.0), (b, 1.0), (x, 0.5), (rest, 0.5)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, rest, x), np.where(swap, x, rest)
    with np.errstate(all="ignore"):
        log_z, log_y = np.where(z < 0.5, np.log(z), np.log1p(-y)), np.where(y < 0.5, np.log(y), np.log1p(-z))
        front = np.exp(p * log_z + q * log_y - log_beta(p, q))
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        h = d.copy()
        h.flat = _fraction(p.ravel(), q.ravel(), z.ravel(), d.ravel())
        tail = front * h / p
    tail = np.where(z <= 0, 0.0, tail)
    return np.where(known, np.where(swap, 1 - tail, tail), np.nan)


def _normal_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail of t for many degrees of freedom, to the second order in 1 / df."""
    t = np.minimum(np.abs(t), 40.0)
    first = t * (t * t + 1) / 4
    second = t * (3 * t**6 - 7 * t**4 - 5 * t * t - 3) / 96
    density = np.exp(-t * t / 2) / np.sqrt(2 * np.pi)
    return _erfc_values(t / np.sqrt(2)) + 2 * density * (first / df + second / df**2)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """nan for no degrees of freedom."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    few = ~(df > LARGE_DF)
    out = np.empty(t.shape)
    with np.errstate(all="ignore"):
        at, square = df[few], t[few] * t[few]
        out[few] = regularized_beta(at / 2, np.full_like(at, 0.5), at / (at + square), square / (at + square))
        out[~few] = _normal_tail(t[~few], df[~few])
    return out


def f_upper(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    one = a == 1
    with np.errstate(all="ignore"):
        t = t_two_sided(np.sqrt(np.where(one, f, 1.0)), np.where(one, b, 1.0))
        c = np.where(one, 1.0, b)
        rest = regularized_beta(c / 2, np.where(one, 1.0, a) / 2, c / (c + a * f), a * f / (c + a * f))
    return np.where(one, t, rest)


def t_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper quantile for p in (0.5, 1), by bisection on a compact scale down to the last digit."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    low, high = np.zeros_like(df), np.ones_like(df)
    for _ in range(60):
        mid = (low + high) / 2
        t = mid / (1 - mid)
        below = 1 - t_two_sided(t, df) / 2 < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    mid = (low + high) / 2
    return np.where(df > 0, mid / (1 - mid), np.nan)


def _series(values: np.ndarray) -> pd.Series:
    return pd.Series(values).replace({np.nan: None}).astype("Float64")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _f_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _series(f_upper(*(s.to_numpy(float) for s in (f, df1, df2))))


@F.pandas_udf(DoubleType())
def _t_q(p: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_quantile(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return _series(_erfc_values(x.to_numpy(float)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic."""
    return _t_p(t.cast("double"), df.cast("double"))


def t_critical(df: Column, level: float = 0.95) -> Column:
    return _t_q(F.lit((1 + level) / 2), df.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    return _f_p(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_1_p_value(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return _erfc(F.sqrt(F.greatest(x.cast("double"), F.lit(0.0)) / 2))
