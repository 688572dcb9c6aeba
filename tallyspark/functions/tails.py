"""Tail probabilities and quantiles of the distributions that tests use, without further libraries."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            c = 1 + numerator / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if math.isfinite(t) else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    """The upper tail of chi-squared, by series below the mean and by continued fraction above."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= h / n
            total += term
        return 1 - front * total
    b, c = h + 1 - a, 1e300
    d = 1 / b
    value = d
    for i in range(1, 500):
        numerator = -i * (i - a)
        b += 2
        d = 1 / (numerator * d + b)
        c = b + numerator / c
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """The two-sided critical value: P(|T| > t) = p, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > p else (low, mid)
    return (low + high) / 2


def studentized_range_tail(q: float, groups: int, df: float) -> float:
    """P(Q > q) of the studentised range, by Gauss-Legendre integration over the range and the pooled deviation."""
    if q <= 0:
        return 1.0
    x, w = np.polynomial.legendre.leggauss(96)
    erf = np.vectorize(math.erf)

    def of_range(width: np.ndarray) -> np.ndarray:
        z, zw = 8 * x, 8 * w
        density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        inside = (erf(z / math.sqrt(2))[None, :] - erf((z[None, :] - width[:, None]) / math.sqrt(2))) / 2
        return groups * (zw * density * inside ** (groups - 1)).sum(axis=1)

    if df > 20_000:
        return float(1 - of_range(np.array([q]))[0])
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - spread), 1 + spread
    s = (high + low) / 2 + (high - low) / 2 * x
    sw = (high - low) / 2 * w
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    density = np.exp(log_density)
    return float(np.clip(1 - (sw * density * of_range(q * s)).sum() / (sw * density).sum(), 0.0, 1.0))


def benjamini_hochberg(p: list[float]) -> list[float]:
    """q-values in the order given."""
    order = sorted(range(len(p)), key=lambda k: p[k])
    out, least = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        k = order[rank - 1]
        least = min(least, p[k] * len(p) / rank)
        out[k] = least
    return out
