"""Tail probabilities of a few scalars on the driver, from the standard library."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of the t distribution for p over a half, by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def gamma_sf(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * front


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of all 2 x 2 tables with these margins that are no likelier than this one.

    Tables get less likely on both sides of the likeliest one, so each tail is summed outward from its first table until what is left is
    too small to count: some thousand terms for margins of any size.
    """
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - n), min(row, col)
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log = lambda x: choose(col, x) + choose(n - col, row - x) - choose(n, row)
    mode = min(max(low, (row + 1) * (col + 1) // (n + 2)), high)
    most = log(a) + 1e-7
    if log(mode) <= most:
        return 1.0

    def first(inner: int, outer: int) -> int | None:
        """The table nearest to the mode, from there to ``outer``, that is no likelier."""
        if log(outer) > most:
            return None
        while abs(outer - inner) > 1:
            middle = (inner + outer) // 2
            inner, outer = (inner, middle) if log(middle) <= most else (middle, outer)
        return outer

    total = 0.0
    for end, step in ((low, -1), (high, 1)):
        x = first(mode, end)
        while x is not None and low <= x <= high:
            term = math.exp(log(x))
            total += term
            if term < total * 1e-17 or term == 0.0:
                break
            x += step
    return min(1.0, total)
