"""Upper tail of the chi-squared distribution."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def chi2_tail(statistic: float, freedom: int) -> float:
    """P(X >= statistic) for X chi-squared: regularised upper incomplete gamma by series or continued fraction."""
    if freedom <= 0 or statistic <= 0:
        return 1.0
    if freedom == 1:
        return erfc(sqrt(statistic / 2))
    a, x = freedom / 2.0, statistic / 2.0
    front = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    # modified Lentz evaluation of the continued fraction
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h
