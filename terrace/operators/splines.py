"""Cubic regression splines: knots, penalties and constraints as small matrices on the driver, bases as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.exprs import let


def curvature(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(F, S): the map from values at the knots to second derivatives of the natural cubic spline there, and its roughness penalty."""
    h = np.diff(knots)
    k = len(knots)
    d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            b[i, i - 1] = b[i - 1, i] = h[i] / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(k), inner, np.zeros(k)]), d.T @ inner


def scale_penalty(penalty: np.ndarray, largest_row: float) -> np.ndarray:
    """The penalty scaled to the basis, whose largest row has that absolute sum, so that smoothing parameters of terms compare."""
    return penalty * largest_row**2 / np.abs(penalty).sum(0).max()


def sum_to_zero(means: np.ndarray) -> np.ndarray:
    """Orthonormal columns Q that are orthogonal to the basis's column means: b Q sums to zero over the rows."""
    return np.linalg.qr(means.reshape(-1, 1), mode="complete")[0][:, 1:]


@dataclass
class CubicSpline:
    """A natural cubic spline basis on given knots; linear beyond them."""

    knots: np.ndarray

    def __post_init__(self) -> None:
        self.knots = np.asarray(self.knots, float)
        if len(self.knots) < 3 or (np.diff(self.knots) <= 0).any():
            raise ValueError("a cubic spline needs three ascending knots or more")
        self.f, self.penalty = curvature(self.knots)
        h, k = np.diff(self.knots), len(self.knots)
        unit = np.eye(k)
        self.slopes = (unit[1] - unit[0]) / h[0] - h[0] / 6 * self.f[1], (unit[-1] - unit[-2]) / h[-1] + h[-1] / 6 * self.f[-2]

    @classmethod
    def over(cls, least: float, most: float, k: int) -> CubicSpline:
        """With k knots from ``least`` to ``most``."""
        return cls(np.linspace(least, most if most > least else least + 1.0, k))

    @property
    def width(self) -> int:
        return len(self.knots)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The basis in numpy."""
        x = np.asarray(x, float)
        inside = np.clip(x, self.knots[0], self.knots[-1])
        j = np.clip(np.searchsorted(self.knots, inside, "left"), 1, self.width - 1)
        h, up, down = self.knots[j] - self.knots[j - 1], self.knots[j] - inside, inside - self.knots[j - 1]
        out = ((up**3 / h - h * up) / 6)[:, None] * self.f[j - 1] + ((down**3 / h - h * down) / 6)[:, None] * self.f[j]
        at = np.arange(len(x))
        out[at, j - 1] += up / h
        out[at, j] += down / h
        beyond = x - inside
        return out + np.minimum(beyond, 0)[:, None] * self.slopes[0] + np.maximum(beyond, 0)[:, None] * self.slopes[1]

    def column(self, x: Column) -> Column:
        """The basis as an array column; NULL for NULL."""
        table = F.array(*(F.array(*map(F.lit, map(float, row))) for row in self.f))
        knots = F.array(*map(F.lit, map(float, self.knots)))
        slopes = [F.array(*map(F.lit, map(float, s))) for s in self.slopes]
        first, last = float(self.knots[0]), float(self.knots[-1])

        def at(v: Column) -> Column:
            inside = F.least(F.greatest(v, F.lit(first)), F.lit(last))
            j = F.greatest(F.lit(1), F.least(F.size(F.filter(knots, lambda e: e < inside)), F.lit(self.width - 1)))
            place = F.struct(j.alias("j"), F.get(knots, j).alias("hi"), F.get(knots, j - 1).alias("lo"), inside.alias("x"), (v - inside).alias("beyond"))
            return let(place, weighted)

        def weighted(p: Column) -> Column:
            h, up, down = p["hi"] - p["lo"], p["hi"] - p["x"], p["x"] - p["lo"]
            parts = F.struct(p["j"].alias("j"), ((up * up * up / h - h * up) / 6).alias("a"), ((down * down * down / h - h * down) / 6).alias("b"), (up / h).alias("c"), (down / h).alias("d"), F.least(p["beyond"], F.lit(0.0)).alias("below"), F.greatest(p["beyond"], F.lit(0.0)).alias("above"))
            return let(parts, summed)

        def summed(p: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(self.width - 1)),
                lambda i: p["a"] * F.get(F.get(table, p["j"] - 1), i) + p["b"] * F.get(F.get(table, p["j"]), i) + F.when(i == p["j"] - 1, p["c"]).when(i == p["j"], p["d"]).otherwise(0.0)
                + p["below"] * F.get(slopes[0], i) + p["above"] * F.get(slopes[1], i),
            )

        return F.when(x.isNotNull(), let(x.cast("double"), at))

    def effect(self, x: Column, values: np.ndarray) -> Column:
        """The spline through ``values`` at the knots, at x: what ``column`` times ``values`` is, by four look-ups instead of a vector."""
        values = np.asarray(values, float)
        bend, first, last = self.f @ values, float(self.knots[0]), float(self.knots[-1])
        table = lambda v: F.array(*map(F.lit, map(float, v)))
        inside = F.least(F.greatest(x.cast("double"), F.lit(first)), F.lit(last))
        steps = np.diff(self.knots)
        if np.allclose(steps, steps[0]):
            j = F.greatest(F.lit(0), F.least(F.floor((inside - first) / float(steps[0])), F.lit(self.width - 2))).cast("int")
        else:
            j = F.size(F.filter(table(self.knots[1:-1]), lambda e: e <= inside))
        h, down = F.get(table(steps), j), inside - F.get(table(self.knots), j)
        b = down / h
        a = 1.0 - b
        curve = F.get(table(values), j) * a + F.get(table(values), j + 1) * b + ((a * a * a - a) * F.get(table(bend), j) + (b * b * b - b) * F.get(table(bend), j + 1)) * h * h / 6.0
        beyond = x - inside
        low, high = (float(s @ values) for s in self.slopes)
        return curve + F.when(beyond < 0, beyond * low).when(beyond > 0, beyond * high).otherwise(0.0)

    def grid(self, spark: SparkSession, points: int = 1000) -> DataFrame:
        """(x, basis) on evenly spaced points over the knots, for plots."""
        a, b = float(self.knots[0]), float(self.knots[-1])
        x = F.lit(a) + F.col("id") * ((b - a) / max(points - 1, 1))
        return spark.range(points).select(x.alias("x")).select("x", self.column(F.col("x")).alias("basis"))

    def knot_distance_penalty(self) -> float:
        """The mean inverse squared distance of neighbouring knots: large if knots meet."""
        return float((1 / np.diff(self.knots) ** 2).mean())
