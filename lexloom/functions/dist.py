"""Distribution functions in plain Python, for finishing steps on small results."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, _TINY), 1 - 1e-16))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or _TINY)
        c = (b + an / c) or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(dof / 2, x / 2)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def correlation_p(rho: float | None, n: int, controls: int = 0) -> float | None:
    """Two-sided p of a (partial) correlation from n pairs."""
    dof = n - 2 - controls
    if rho is None or dof <= 0:
        return None
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * math.sqrt(dof / (1 - rho * rho)), dof)


def signed_rank_counts(n: int) -> list[int]:
    """Number of sign patterns of ranks 1..n for each positive rank sum."""
    out = [1]
    for r in range(1, n + 1):
        longer = out + [0] * r
        for s, c in enumerate(out):
            longer[s + r] += c
        out = longer
    return out


def signed_rank_p(w_plus: float, w_minus: float, n: int, tie_term: float, plain: bool, greater: bool = False) -> float:
    """p of the signed-rank statistic: exact for n <= 50 without ties or zeros (`plain`), else normal without continuity correction."""
    if n == 0:
        return 1.0
    if plain and n <= 50:
        counts = signed_rank_counts(n)
        w = int(w_minus if greater else min(w_plus, w_minus))
        tail = sum(counts[: w + 1]) / 2**n
        return tail if greater else min(1.0, 2 * tail)
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    if var <= 0:
        return 1.0
    z = (w_plus - n * (n + 1) / 4) / math.sqrt(var)
    return normal_sf(z) if greater else min(1.0, 2 * normal_sf(abs(z)))
