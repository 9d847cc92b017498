"""Special functions on numpy arrays, in logarithms where they underflow."""

from __future__ import annotations

import math

import numpy as np


def log_gamma(x) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def log_gamma_q(a: float, x: float) -> float:
    """Logarithm of the regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 0.0
    front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:  # series of P
        term = total = 1 / a
        n = a
        for _ in range(500):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        p = math.exp(front) * total
        return math.log1p(-p) if p < 1 else -math.inf
    tiny = 1e-300  # continued fraction of Q (Lentz)
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front + math.log(h)


def log_beta_i(a: float, b: float, x: float) -> float:
    """Logarithm of the regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + an * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + an / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front + math.log(fraction(a, b, x) / a)
    rest = math.exp(front) * fraction(b, a, 1 - x) / b
    return math.log1p(-rest) if rest < 1 else -math.inf


def digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def hurwitz_zeta(s: float, q: float = 1.0, n: int = 12) -> float:
    """Hurwitz zeta for s > 1 by Euler-Maclaurin summation."""
    total = sum((q + k) ** -s for k in range(n))
    a = q + n
    total += a ** (1 - s) / (s - 1) + 0.5 * a**-s
    term, factor = s * a ** (-s - 1), 1.0
    for j, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1):
        factor *= 1 / ((2 * j - 1) * (2 * j))
        total += b * factor * term
        term *= (s + 2 * j - 1) * (s + 2 * j) / (a * a)
    return total


def polygamma(n: int, x: float) -> float:
    """n-th derivative of digamma."""
    return digamma(x) if n == 0 else (-1) ** (n + 1) * math.factorial(n) * hurwitz_zeta(n + 1, x)


def log_binomial(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def root(f, low: float, high: float, tolerance: float = 1e-12, steps: int = 200) -> float | None:
    """Root of f by bisection between values of opposite sign; None without a change of sign."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if b == 0:
        return high
    if (a > 0) == (b > 0):
        return None
    for _ in range(steps):
        mid = (low + high) / 2
        m = f(mid)
        if m == 0 or high - low < tolerance:
            return mid
        if (m > 0) == (a > 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2
