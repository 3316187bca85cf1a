"""Small numeric helpers: Shapiro-Wilk p-value (Royston 1995) and the normal distribution."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()

# Polynomial coefficients published with Royston's algorithm AS R94 (Applied Statistics 44, 1995),
# constant term first.
_A_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_A_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_MU_SMALL = (0.544, -0.39978, 0.025054, -0.0006714)
_SIGMA_SMALL = (1.3822, -0.77857, 0.062767, -0.0020322)
_MU_LARGE = (-1.5861, -0.31082, -0.083751, 0.0038915)
_SIGMA_LARGE = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def _poly(coefficients, x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def probit(p: np.ndarray) -> np.ndarray:
    return np.array([_NORMAL.inv_cdf(float(x)) for x in p])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.array([_NORMAL.cdf(float(x)) for x in z])


def shapiro_weights(n: int) -> np.ndarray:
    """Approximate Shapiro-Wilk weights for a sorted sample of size ``n``."""
    if n == 3:
        return np.array([-np.sqrt(0.5), 0.0, np.sqrt(0.5)])
    m = probit((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    norm = float(m @ m)
    u = 1.0 / np.sqrt(n)
    a = np.zeros(n)
    last = m[-1] / np.sqrt(norm) + _poly(_A_LAST, u)
    if n <= 5:
        phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / np.sqrt(phi)
    else:
        second = m[-2] / np.sqrt(norm) + _poly(_A_NEXT, u)
        phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / np.sqrt(phi)
        a[1], a[-2] = -second, second
    a[0], a[-1] = -last, last
    return a


def shapiro_p(ordered: np.ndarray) -> float:
    """p-value of normality for an ascending sample of 3 to 5000 values; a constant sample gives 1."""
    n = len(ordered)
    spread = float(((ordered - ordered.mean()) ** 2).sum())
    if spread <= 0.0:
        return 1.0
    w = min(float(shapiro_weights(n) @ ordered) ** 2 / spread, 1.0)
    if n == 3:
        return max(0.0, 6.0 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
    if w >= 1.0:
        return 1.0
    y = np.log1p(-w)
    if n <= 11:
        gamma = _poly(_GAMMA, n)
        if y >= gamma:
            return 0.0
        y = -np.log(gamma - y)
        mu, sigma = _poly(_MU_SMALL, n), np.exp(_poly(_SIGMA_SMALL, n))
    else:
        x = np.log(n)
        mu, sigma = _poly(_MU_LARGE, x), np.exp(_poly(_SIGMA_LARGE, x))
    return float(1.0 - _NORMAL.cdf((y - mu) / sigma))
