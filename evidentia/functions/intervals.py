"""Exact intervals as quantiles of the beta distribution, worked out for whole columns at once.

The distribution function is a continued fraction before a binomial probability, whose logarithm comes
from corrections to Stirling's formula and deviances, so large counts lose no digits. The quantile is found
by Newton steps kept between bounds that close in. All rows of a batch take each step together; the number
of steps grows with the square root of the counts at most, and nothing is summed over them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HALF_LOG = 0.5 * math.log(2 * math.pi)
_SMALL = np.array([0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - _HALF_LOG for i in range(1, 16)])


def _stirling(n: np.ndarray) -> np.ndarray:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2, for whole n."""
    x = np.maximum(n, 1.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return np.where(n <= 15, _SMALL[np.minimum(n, 15).astype(int)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, without cancellation where both are near."""
    v = (x - mean) / (x + mean)
    term, total = 2 * x * v, (x - mean) * v
    for j in range(1, 40):
        term = term * v * v
        total = total + term / (2 * j + 1)
    near = np.abs(v) < 0.1
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / mean), 0.0) + mean - x
    return np.where(near, total, far)


def log_binomial(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln of the probability of k of n at p, for whole 0 <= k <= n and 0 < p < 1."""
    k, n, p = (np.asarray(v, float) for v in (k, n, p))
    inside = (k > 0) & (k < n)
    a, b = np.where(inside, k, 1.0), np.where(inside, n - k, 1.0)
    m = a + b
    mid = _stirling(m) - _stirling(a) - _stirling(b) - _deviance(a, m * p) - _deviance(b, m * (1 - p)) + 0.5 * np.log(m / (a * b)) - _HALF_LOG
    return np.where(inside, mid, np.where(k == 0, n * np.log1p(-p), n * np.log(p)))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's products; quick for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / guard(1 + even * d)
        c = guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / guard(1 + odd * d)
        c = guard(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 4e-16):
            break
    return h


def beta_parts(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper part of the beta distribution at x, for whole a, b >= 1; the smaller one is worked out, the other is the rest."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    part = np.exp(log_binomial(p, p + q - 1, y) + np.log1p(-y)) * _fraction(p, q, y)
    return np.where(swap, 1 - part, part), np.where(swap, part, 1 - part)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray, upper: bool = False) -> np.ndarray:
    """x at which the lower part (or the upper one) of the beta distribution is p, for whole a, b >= 1."""
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    lo, hi = np.zeros_like(p), np.ones_like(p)
    mean = a / (a + b)
    spread = np.sqrt(mean * (1 - mean) / (a + b + 1))
    x = np.clip(mean + (2 if upper else -2) * spread, mean * 1e-3, 1 - (1 - mean) * 1e-3)
    for _ in range(200):
        below, above = beta_parts(a, b, x)
        gap = (p - above) if upper else (below - p)
        hi, lo = np.where(gap > 0, x, hi), np.where(gap <= 0, x, lo)
        density = np.exp(log_binomial(a - 1, a + b - 2, x)) * (a + b - 1)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = x - gap / density
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
        done = np.abs(new - x) <= 2e-16 * np.abs(new)
        x = new
        if np.all(done):
            break
    return x


def clopper_pearson_arrays(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the exact intervals of k of n; 0 and 0 where n is 0."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    low, high = np.zeros_like(n), np.where(n > 0, 1.0, 0.0)
    with np.errstate(divide="ignore"):
        edge = (alpha / 2) ** (1 / np.maximum(n, 1))
    some = (k > 0) & (k < n)
    if some.any():
        low[some] = beta_quantile(alpha / 2, k[some], n[some] - k[some] + 1)
        high[some] = beta_quantile(alpha / 2, k[some] + 1, n[some] - k[some], upper=True)
    all_, none = (k == n) & (n > 0), (k == 0) & (n > 0)
    low[all_], high[none] = edge[all_], 1 - edge[none]
    point = k / np.maximum(n, 1)
    return np.minimum(low, point), np.maximum(high, point)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for k, n in batches:
        low, high = clopper_pearson_arrays(k.to_numpy(), n.to_numpy())
        yield pd.DataFrame({"low": low, "high": high})
