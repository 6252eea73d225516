"""Special functions that Spark SQL lacks, as Column expressions (no Python on the executors)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.exprs import let


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series at x + 8, shifted back."""
    z = x + 8.0
    tail = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    shift = x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + tail - F.ln(shift)


def _scaled_erfc(z: float) -> float:
    """exp(z^2) erfc(z), by the continued fraction where erfc itself gets small."""
    if z < 3:
        return math.exp(z * z) * math.erfc(z)
    tail = 0.0
    for k in range(120, 0, -1):
        tail = k / 2 / (z + tail)
    return 1 / (math.sqrt(math.pi) * (z + tail))


def _coefficients(n: int = 28) -> list[float]:
    """Chebyshev coefficients of log(exp(z^2) erfc(z) / t) over t = 2 / (2 + z) in (0, 1]."""
    node = np.cos(np.pi * (np.arange(n) + 0.5) / n)
    t = (node + 1) / 2
    f = np.array([math.log(_scaled_erfc(2 / v - 2) / v) for v in t])
    return [float(2 / n * (f * np.cos(np.pi * k * (np.arange(n) + 0.5) / n)).sum()) for k in range(n)]


_CHEBYSHEV = _coefficients()


def erfc(x: Column) -> Column:
    """The complementary error function, to about 1e-14."""
    z = F.abs(x)
    t = 2.0 / (2.0 + z)
    tail = t * F.exp(-z * z + let(2 * (2 * t - 1), _clenshaw))
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def _clenshaw(a: Column) -> Column:
    """The Chebyshev sum at a / 2, as a fold over the coefficients."""
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    step = lambda s, k: F.struct((a * s["b"] - s["c"] + k).alias("b"), s["b"].alias("c"))
    high = F.array(*map(F.lit, _CHEBYSHEV[:0:-1]))
    return F.aggregate(high, start, step, lambda s: 0.5 * a * s["b"] - s["c"] + F.lit(_CHEBYSHEV[0] / 2))


def erf(x: Column) -> Column:
    """The error function."""
    return 1.0 - erfc(x)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    return 0.5 * erfc(-x / math.sqrt(2))


#: Coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of ``normal_cdf`` on (0, 1): a rational approximation and one Halley step. ``p`` is computed once a row."""

    def start(p: Column) -> Column:
        tail = let(F.sqrt(-2 * F.ln(F.least(p, 1 - p))), lambda low: _horner(low, _C) / _horner(low, _D))
        middle = let((p - 0.5) * (p - 0.5), lambda r: (p - 0.5) * _horner(r, _A) / _horner(r, _B))
        return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(middle)

    def refined(p: Column, x: Column) -> Column:
        u = (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return let(u, lambda u: x - u / (1 + x * u / 2))

    return let(p, lambda p: let(start(p), lambda x: refined(p, x)))
