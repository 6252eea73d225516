"""Link functions, sparse activations and vector functions as Column expressions.

Vectors are ``ARRAY<DOUBLE>`` columns. Functions of one number take and return DOUBLE columns; NULL in gives NULL out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    return -softplus(-x)


def total(v: Column) -> Column:
    """The sum of a vector."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def logsumexp(z: Column) -> Column:
    return let(F.array_max(z), lambda top: top + F.ln(total(F.transform(z, lambda x: F.exp(x - top)))))


def softmax(z: Column) -> Column:
    raised = let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return let(raised, lambda e: let(total(e), lambda all_: F.transform(e, lambda x: x / all_)))


def log_softmax(z: Column) -> Column:
    return let(logsumexp(z), lambda norm: F.transform(z, lambda x: x - norm))


def argmax(v: Column) -> Column:
    """The first position (from 0) of the largest component."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(i: Column, width: int) -> Column:
    """A unit vector of ``width``; all zeros for positions outside it."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def argmax_one_hot(v: Column) -> Column:
    """The unit vector of the first largest component."""
    return let(F.array_position(v, F.array_max(v)) - 1, lambda at: F.transform(v, lambda x, k: F.when(k == at, 1.0).otherwise(0.0)))


def sparsemax_threshold(z: Column) -> Column:
    """The tau with sum(max(z - tau, 0)) = 1: the largest k with 1 + k z_(k) > cumulative sum decides it."""
    return _fold_sorted(z, lambda s, x: 1 + s["k"] * x > s["sum"], lambda s: (s["sum"] - 1) / s["k"])


def _fold_sorted(z: Column, holds, value) -> Column:
    """Runs down the sorted vector with count, sum and sum of squares, and keeps the last value for which ``holds``."""
    nothing = F.struct(F.lit(0).cast("double").alias("k"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("squares"), F.lit(0.0).alias("tau"))

    def step(s: Column, x: Column) -> Column:
        new = F.struct((s["k"] + 1).alias("k"), (s["sum"] + x).alias("sum"), (s["squares"] + x * x).alias("squares"))
        return F.struct(new["k"].alias("k"), new["sum"].alias("sum"), new["squares"].alias("squares"), F.when(holds(new, x), value(new)).otherwise(s["tau"]).alias("tau"))

    return F.aggregate(F.sort_array(z, asc=False), nothing, step, lambda s: s["tau"])


def sparsemax(z: Column) -> Column:
    """The Euclidean projection of z on the simplex."""
    return let(sparsemax_threshold(z), lambda tau: F.transform(z, lambda x: F.greatest(x - tau, F.lit(0.0))))


def entmax15(z: Column) -> Column:
    """The 1.5-entmax of z: max(z / 2 - tau, 0)^2 with components that sum to 1."""

    def tau(s: Column) -> Column:
        m = s["sum"] / s["k"]
        return m - F.sqrt(F.greatest((1 - (s["squares"] - s["k"] * m * m)) / s["k"], F.lit(0.0)))

    def of(half: Column) -> Column:
        at = _fold_sorted(half, lambda s, x: tau(s) <= x, tau)
        return let(at, lambda at: F.transform(half, lambda x: F.pow(F.greatest(x - at, F.lit(0.0)), 2)))

    return let(F.array_max(z), lambda top: let(F.transform(z, lambda x: (x - top) / 2), of))


def sparsemoid(x: Column) -> Column:
    """x / 2 + 1 / 2 within 0 and 1."""
    return F.greatest(F.least(0.5 * x + 0.5, F.lit(1.0)), F.lit(0.0))


def entmoid15(x: Column) -> Column:
    """The first component of entmax15 of (x, 0), in closed form."""
    a = F.abs(x)
    tau = (a + F.sqrt(F.greatest(8 - a * a, F.lit(0.0)))) / 2
    tau = F.when(tau <= a, 2.0).otherwise(tau)
    y = 0.25 * F.pow(F.greatest(tau - a, F.lit(0.0)), 2)
    return F.when(x >= 0, 1 - y).otherwise(y)


def temperature(step: int, steps: int, largest: float = 1.0, smallest: float = 0.01) -> float:
    """An annealing schedule that falls from ``largest`` to ``smallest`` evenly in the logarithm; ``smallest`` from ``steps`` on."""
    if step >= steps:
        return smallest
    return 10 ** (math.log10(largest) + (math.log10(smallest) - math.log10(largest)) * step / max(steps, 1))


def _halves(v: Column) -> tuple[Column, Column]:
    n = F.floor(F.size(v) / 2).cast("int")
    return F.slice(v, F.lit(1), n), F.slice(v, n + 1, n)


def glu(v: Column) -> Column:
    """The first half of v times the sigmoid of the second."""
    a, b = _halves(v)
    return F.zip_with(a, b, lambda x, y: x * sigmoid(y))


def reglu(v: Column) -> Column:
    """The first half of v times the positive part of the second."""
    a, b = _halves(v)
    return F.zip_with(a, b, lambda x, y: x * F.greatest(y, F.lit(0.0)))


def rms_norm(v: Column, eps: float = 1e-5, weight: list[float] | None = None) -> Column:
    """v over its root mean square."""
    scale = F.sqrt(mean(F.transform(v, lambda x: x * x)) + eps)
    return scaled(let(scale, lambda s: F.transform(v, lambda x: x / s)), weight)


def layer_norm(v: Column, eps: float = 1e-5, weight: list[float] | None = None) -> Column:
    """v centred and over its standard deviation."""
    centred = let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return scaled(let(centred, lambda c: let(F.sqrt(mean(F.transform(c, lambda x: x * x)) + eps), lambda s: F.transform(c, lambda x: x / s))), weight)


def group_norm(v: Column, groups: int, width: int, eps: float = 1e-5) -> Column:
    """``layer_norm`` of each of ``groups`` equal parts of a vector of ``width``; with as many groups as components, instance norm."""
    n = width // groups
    return F.concat(*(layer_norm(F.slice(v, 1 + g * n, n), eps) for g in range(groups)))


def scaled(v: Column, weight: list[float] | None) -> Column:
    """v times a weight a component (None: as it is)."""
    return v if weight is None else F.zip_with(v, F.array(*map(F.lit, weight)), lambda x, w: x * w)


def batch_norm(v: Column, means: list[float], variances: list[float], eps: float = 1e-5) -> Column:
    """v by the fitted mean and variance of each component."""
    shift = F.zip_with(v, F.array(*map(F.lit, means)), lambda x, m: x - m)
    return scaled(shift, [1 / math.sqrt(s + eps) for s in variances])


def increasing(v: Column) -> Column:
    """(v0, v0 + exp(v1), v0 + exp(v1) + exp(v2), ...): raw values as ordered ones."""
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.exp(x)))
    return F.aggregate(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1), step)


def positive_knots(v: Column) -> Column:
    """Cumulative softplus of v, over their total: increasing knots in (0, 1]."""
    first = F.array().cast("array<double>")
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + softplus(x)))
    return F.aggregate(v, first, step, lambda acc: F.transform(acc, lambda x: x / F.element_at(acc, -1)))


def bin_index(x: Column, inner: list[float]) -> Column:
    """The number of inner edges at or below x."""
    if not inner:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e <= x)))


def interpolate(x: Column, at: list[float], to: list[float]) -> Column:
    """Piecewise linear interpolation through (at, to) with at ascending; constant outside; of equal points the last counts."""
    if len(at) == 1:
        return F.when(x.isNotNull(), F.lit(to[0]))
    points = F.array(*map(F.lit, at))
    values = F.array(*map(F.lit, to))

    def between(x: Column, j: Column) -> Column:
        lo, hi = F.get(points, j - 1), F.get(points, j)
        a, b = F.get(values, j - 1), F.get(values, j)
        return F.when(x.isNull(), None).when(j == 0, F.lit(to[0])).when(j >= len(at), F.lit(to[-1])).otherwise(a + (b - a) * (x - lo) / (hi - lo))

    return let(x, lambda x: let(F.size(F.filter(points, lambda e: e <= x)), lambda j: between(x, j)))
