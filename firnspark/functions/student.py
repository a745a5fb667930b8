"""Student's t distribution: tail probabilities and quantiles for small tables of fitted lines."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            out *= step
        if abs(step - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised: from 0 at x = 0 to 1 at x = 1."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def two_sided(t: float | None, dof: float) -> float | None:
    """Probability of a value as far from 0 as ``t``."""
    if t is None or dof <= 0 or math.isnan(t):
        return None
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def quantile(p: float, dof: float) -> float | None:
    """The value below which a share ``p`` of the distribution lies, by bisection."""
    if dof <= 0 or not 0 < p < 1:
        return None
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = 0.5 * incomplete_beta(dof / 2, 0.5, dof / (dof + mid * mid))
        if (1 - tail if mid > 0 else tail) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
