"""Tail probabilities in plain ``math``, for the few rows that remain after aggregation."""

from __future__ import annotations

import math
from functools import lru_cache


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by the t distribution with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


@lru_cache(maxsize=256)
def _u_counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many arrangements of two samples without ties give each U."""
    ways = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):
        for k in range(n1 * n2, n2 + i - 1, -1):
            ways[k] -= ways[k - n2 - i]
        for k in range(i, n1 * n2 + 1):
            ways[k] += ways[k - i]
    return tuple(ways)


def mann_whitney_p(u: float, n1: int, n2: int, ties: float, alternative: str = "two-sided") -> float | None:
    """p of U of the first sample; ``ties`` is the sum of t^3 - t over tied values.

    Exact when a sample has at most 8 values and nothing is tied, else normal with
    corrections for ties and continuity.
    """
    if not n1 or not n2:
        return None
    if min(n1, n2) <= 8 and not ties:
        ways = _u_counts(n1, n2)
        whole = sum(ways)
        upper = sum(ways[math.ceil(u) :]) / whole
        lower = sum(ways[: math.floor(u) + 1]) / whole
        return {"greater": upper, "less": lower}.get(alternative, min(1.0, 2 * min(upper, lower)))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    top = {"greater": u, "less": n1 * n2 - u}.get(alternative, max(u, n1 * n2 - u))
    p = normal_sf((top - n1 * n2 / 2 - 0.5) / math.sqrt(var))
    return p if alternative in ("greater", "less") else min(1.0, 2 * p)


def fisher_p(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    """Exact p of a 2x2 table with fixed margins, in log space."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + col - n), min(row, col)

    def choose(m: int, k: int) -> float:
        return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)

    log_p = [choose(col, k) + choose(n - col, row - k) - choose(n, row) for k in range(low, high + 1)]
    if alternative == "greater":
        keep = log_p[a - low :]
    elif alternative == "less":
        keep = log_p[: a - low + 1]
    else:
        keep = [x for x in log_p if x <= log_p[a - low] + 1e-7]
    return min(1.0, math.fsum(map(math.exp, keep)))
