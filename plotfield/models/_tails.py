"""Tail probabilities for test tables: a few dozen numbers per fit, on the driver."""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Modified Lentz evaluation of the incomplete-beta continued fraction."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > TINY else TINY)
    result = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > TINY else TINY)
            c = c if abs(c) > TINY else TINY
            step = c * d
            result *= step
        if abs(step - 1.0) < 1e-15:
            break
    return result


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return 0.0 if math.isinf(t) else math.nan
    if math.isinf(df):
        return normal_two_sided(t)
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(level: float, df: float) -> float:
    """Two-sided critical value: P(|T| > q) = 1 - level."""
    low, high = 0.0, 2.0
    while t_two_sided(high, df) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if t_two_sided(middle, df) > 1.0 - level:
            low = middle
        else:
            high = middle
        if high - low < 1e-14 * high:
            break
    return 0.5 * (low + high)


def f_upper(f: float, df1: float, df2: float) -> float:
    if not math.isfinite(f):
        return 0.0 if math.isinf(f) else math.nan
    if math.isinf(df2):
        return chi2_upper(f * df1, df1)
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    """Regularised upper incomplete gamma Q(df/2, x/2)."""
    if not math.isfinite(x) or df <= 0:
        return 0.0 if math.isinf(x) else math.nan
    a, y = df / 2.0, x / 2.0
    if y <= 0.0:
        return 1.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1.0
            term *= y / k
            total += term
        return 1.0 - front * total
    b = y + 1.0 - a
    c, d = 1.0 / TINY, 1.0 / b
    result = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * result


def _erf(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erf, x.ravel().tolist()), float, x.size).reshape(x.shape)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals < w)."""
    z = 8.0 * _NODES
    density = np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    upper = 0.5 * (1.0 + _erf(z / math.sqrt(2.0)))
    lower = 0.5 * (1.0 + _erf((z[None, :] - w[:, None]) / math.sqrt(2.0)))
    inner = density * np.clip(upper[None, :] - lower, 0.0, 1.0) ** (k - 1)
    return np.clip(8.0 * k * (inner * _WEIGHTS).sum(axis=1), 0.0, 1.0)


def studentised_range_upper(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range for ``k`` means and ``df`` error degrees."""
    if not math.isfinite(q) or k < 2:
        return 0.0 if math.isinf(q) else math.nan
    if q <= 0.0:
        return 1.0
    if math.isinf(df) or df > 25_000:
        return float(1.0 - _range_cdf(np.array([q]), k)[0])
    # s = sqrt(chi2 / df) lies within ten standard deviations of one; few df reach further.
    spread = 10.0 / math.sqrt(2.0 * df)
    low, high = max(1e-8, 1.0 - spread), 1.0 + max(spread, 8.0 / math.sqrt(df))
    s = 0.5 * (high - low) * _NODES + 0.5 * (high + low)
    log_density = (
        math.log(2.0) + 0.5 * df * math.log(df / 2.0) - math.lgamma(df / 2.0)
        + (df - 1.0) * np.log(s) - 0.5 * df * s * s
    )
    weight = np.exp(log_density) * _WEIGHTS * 0.5 * (high - low)
    covered = float((weight * _range_cdf(q * s, k)).sum() / weight.sum())
    return min(max(1.0 - covered, 0.0), 1.0)
