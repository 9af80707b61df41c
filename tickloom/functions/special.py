"""Tail probabilities of the chi-square, F and t distributions, for a handful of test statistics."""

from __future__ import annotations

from math import exp, inf, isfinite, lgamma, log


def _fraction(b0: float, terms) -> float:
    """b0 + a1 / (b1 + a2 / (b2 + ...)) by Lentz's method."""
    tiny = 1e-300
    f = c = b0 or tiny
    d = 0.0
    for a, b in terms:
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def chi2_sf(x: float, df: float) -> float:
    """P(X > x) for chi-square with ``df`` degrees of freedom."""
    if not x > 0:
        return 1.0
    if x == inf:
        return 0.0
    s, z = df / 2, x / 2
    scale = exp(s * log(z) - z - lgamma(s))
    if z < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - scale * total)
    return scale / _fraction(z + 1 - s, ((-i * (i - s), z + 2 * i + 1 - s) for i in range(1, 500)))


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)

    def terms():
        for m in range(500):
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / (a * _fraction(1.0, terms()))


def f_sf(f: float, a: float, b: float) -> float:
    if not isfinite(f) or f <= 0:
        return 0.0 if f == inf else 1.0
    return beta_cdf(b / (b + a * f), b / 2, a / 2)


def t_sf(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)
