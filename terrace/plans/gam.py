"""Penalised spline regression from one pass over the data.

Everything after the cross products of the raw bases is algebra on small matrices: identifiability, penalised solutions, generalised
cross-validation, intervals and tests. The residual sum is y'y - 2 b'r + b'Gb, and the trace of the hat matrix is that of (G + P)^-1 G, so
no search step touches the rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.gram import Gram, gram
from terrace.operators.splines import CubicSpline, scale_penalty, sum_to_zero
from terrace.plans.smooths import Cubic, Term, from_state


def gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or tiny), b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    """The probability that a chi-squared variable exceeds x."""
    return gamma_q(df / 2, x / 2)


def _descended(score, x: np.ndarray, most: float, memory: int = 8, steps: int = 100) -> tuple[float, np.ndarray]:  # noqa: ANN001
    """(value, place) of a minimum of ``score`` (value and gradient) within -most to most: two-loop quasi-Newton steps, halved until they descend."""
    value, slope = score(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        at_end = ((x <= -most) & (slope > 0)) | ((x >= most) & (slope < 0))
        g = np.where(at_end, 0.0, slope)
        if np.abs(g).max(initial=0.0) <= 1e-9 * max(abs(value), 1e-300):
            break
        d, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ d / (y @ s)
            d -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            d *= s @ y / (y @ y)
        else:
            d /= np.abs(g).max()
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d += (a - y @ d / (y @ s)) * s
        d = np.where(at_end, 0.0, d)
        if d @ g <= 0:
            d, past = g / np.abs(g).max(), []
        d *= min(1.0, 8.0 / np.abs(d).max())
        size = 1.0
        while size > 1e-10:
            new = np.clip(x - size * d, -most, most)
            now, then = score(new)
            if now <= value - 1e-4 * g @ (x - new):
                break
            size /= 2
        else:
            break
        if (then - slope) @ (new - x) > 1e-14 * abs(value):
            past = [*past, (new - x, then - slope)][-memory:]
        done = value - now <= 1e-13 * abs(value)
        x, value, slope = new, now, then
        if done:
            break
    return value, x


@dataclass
class Gam:
    """y = intercept + sum of smooth terms: a column's name stands for a cubic spline of k knots; ``Plate`` and ``Region`` of ``terrace.plans.smooths`` are the others.

    ``intercept=False`` leaves the intercept out and the covariance unscaled by the residual variance, for comparison with fits made that way.
    """

    columns: list[str | Term]
    k: int = 10
    intercept: bool = True
    terms: list[Term] = field(default_factory=list)
    lambdas: np.ndarray | None = None

    @property
    def splines(self) -> list[CubicSpline]:
        """Those of the cubic terms."""
        return [t.spline for t in self.terms if isinstance(t, Cubic)]

    def fit(self, df: DataFrame, y: str, lambdas: list[float] | None = None) -> Gam:
        """Two jobs (ranges, and cross products) and those that thin plates take. Without ``lambdas`` they are chosen by generalised cross-validation."""
        self.terms = [Cubic(t, self.k) if isinstance(t, str) else t for t in self.columns]
        cubic = sorted({t.column for t in self.terms if isinstance(t, Cubic)})
        ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{m} {c}") for c in cubic for m, f in (("min", F.min), ("max", F.max)))).first().asDict() if cubic else {}
        for t in self.terms:
            t.over(df, ends)
        frame, inputs, parts = df, {}, []
        for j, t in enumerate(self.terms):
            frame, own, rows = t.part(frame, j)
            inputs |= own
            parts.append(rows)
        widths = [t.width for t in self.terms]
        self._use(gram(frame, inputs, sum(widths), F.col(y), blocks=widths, build=lambda batch: np.hstack([rows(batch) for rows in parts])))
        self.lambdas = np.asarray(lambdas, float) if lambdas is not None else self._search()
        self._solve(self.lambdas, keep=True)
        return self

    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where terms begin among the raw columns, and among the centred ones."""
        widths = [t.width for t in self.terms]
        return np.cumsum([0, *widths]), np.cumsum([0, *(w - 1 for w in widths)])

    def _use(self, g: Gram) -> None:
        """Takes the constraints into the statistics: centred columns a term, after the intercept."""
        self.n, self.yy, self.y = g.n, float(g.yy), float(g.y)
        raw, own = self._cuts()
        qs = [sum_to_zero(g.b[a:b] / g.n) for a, b in zip(raw[:-1], raw[1:], strict=True)]
        self.q = np.zeros((raw[-1], own[-1]))
        for j, q in enumerate(qs):
            self.q[raw[j] : raw[j + 1], own[j] : own[j + 1]] = q
        one = int(self.intercept)
        m = own[-1] + one
        self.g, self.r = np.zeros((m, m)), np.zeros(m)
        self.g[one:, one:], self.r[one:] = self.q.T @ g.bb @ self.q, self.q.T @ g.by
        if one:
            self.g[0, 0], self.r[0] = g.n, g.y
            self.g[0, 1:] = self.g[1:, 0] = self.q.T @ g.b
        self.penalties = []
        for j, (t, q) in enumerate(zip(self.terms, qs, strict=True)):
            full = np.zeros((m, m))
            full[self._at(j), self._at(j)] = q.T @ scale_penalty(t.penalty, g.norms[j]) @ q
            self.penalties.append(full)

    def _solve(self, lambdas: np.ndarray, keep: bool = False) -> float:
        """The GCV score of smoothing parameters."""
        a = self.g + sum(lam * s for lam, s in zip(lambdas, self.penalties, strict=True))
        inverse = np.linalg.pinv(a, hermitian=True)
        beta = inverse @ self.r
        hat = inverse @ self.g
        rss = max(self.yy - 2 * beta @ self.r + beta @ self.g @ beta, 0.0)
        if keep:
            self.beta, self.rss, self.hat = beta, float(rss), hat
            self.edf = float(np.trace(hat))
            self.scale = self.rss / max(self.n - self.edf, 1.0)
            self.unscaled = inverse
            self.covariance = inverse * (self.scale if self.intercept else 1.0)
        return float(rss / self.n / (1 - np.trace(hat) / self.n) ** 2)

    def gcv(self, lambdas: list[float] | None = None) -> float:
        return self._solve(np.asarray(lambdas if lambdas is not None else self.lambdas, float))

    def _score(self, log: np.ndarray) -> tuple[float, np.ndarray]:
        """The GCV score and its gradient, by the logarithms of the smoothing parameters.

        With A = G + P, the coefficients b and the hat matrix change by -A^-1 P_j b and -A^-1 P_j A^-1 G where lambda_j P_j does.
        """
        own = [np.exp(v) * s for v, s in zip(log, self.penalties, strict=True)]
        inverse = np.linalg.pinv(self.g + sum(own), hermitian=True)
        beta, hat = inverse @ self.r, inverse @ self.g
        rss, free = max(self.yy - 2 * beta @ self.r + beta @ self.g @ beta, 0.0), 1 - np.trace(hat) / self.n
        slope = np.zeros(len(log))
        for j, p in enumerate(own):
            step = -inverse @ (p @ beta)
            d_rss, d_trace = 2 * step @ (self.g @ beta - self.r), -np.sum((inverse @ p) * hat.T)
            slope[j] = d_rss / self.n / free**2 + 2 * rss / self.n / free**3 * d_trace / self.n
        return float(rss / self.n / free**2), slope

    def _search(self, starts: tuple[float, ...] = (0.0, -6.0, 6.0)) -> np.ndarray:
        """Limited-memory quasi-Newton descent of GCV in the logarithms, within -16 to 16, from a few starts."""
        best = min((_descended(self._score, np.full(len(self.terms), s), 16.0) for s in starts), key=lambda x: x[0])
        return np.exp(best[1])

    def confidence_intervals(self, alpha: float = 0.05) -> list[tuple[float, float]]:
        """beta -+ z standard errors, a pair a coefficient."""
        half = NormalDist().inv_cdf(1 - alpha / 2) * np.sqrt(np.maximum(np.diag(self.covariance), 0))
        return [(float(b - h), float(b + h)) for b, h in zip(self.beta, half, strict=True)]

    def _at(self, j: int) -> slice:
        own = self._cuts()[1] + int(self.intercept)
        return slice(int(own[j]), int(own[j + 1]))

    def values(self, j: int) -> np.ndarray:
        """Term j's coefficients of its own basis, without the constraint."""
        raw, own = self._cuts()
        return self.q[raw[j] : raw[j + 1], own[j] : own[j + 1]] @ self.beta[self._at(j)]

    def wald_test(self, j: int) -> tuple[float, float]:
        """(statistic, p-value) of the hypothesis that spline j is zero."""
        at = self._at(j)
        w = float(self.beta[at] @ np.linalg.pinv(self.covariance[at, at], hermitian=True) @ self.beta[at])
        return w, chi2_sf(w, self.terms[j].width - 1)

    def summary(self, spark: SparkSession) -> DataFrame:
        """A row a term: edf, reference df, F, p-value, lambda; and the model's adjusted R^2, explained deviance, GCV and scale in all rows."""
        total = self.yy - self.y**2 / self.n
        explained = 1 - self.rss / total if total else 0.0
        adjusted = 1 - (self.rss / max(self.n - self.edf, 1)) / (total / max(self.n - 1, 1)) if total else 0.0
        rows = []
        for j, t in enumerate(self.terms):
            w, p = self.wald_test(j)
            rows.append((t.name, float(np.trace(self.hat[self._at(j), self._at(j)])), float(t.width - 1), w / (t.width - 1), p, float(self.lambdas[j]), adjusted, explained, self.gcv(), self.scale, self.n))
        return spark.createDataFrame(rows, "term string, edf double, ref_df double, f double, p_value double, lambda double, r2_adjusted double, deviance_explained double, gcv double, scale double, n long")

    def coefficients(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        """(term, i, estimate, lower, upper)."""
        names = [("intercept", 0)] * self.intercept + [(t.name, i) for t in self.terms for i in range(t.width - 1)]
        rows = [(t, i, float(b), lo, hi) for (t, i), b, (lo, hi) in zip(names, self.beta, self.confidence_intervals(alpha), strict=True)]
        return spark.createDataFrame(rows, "term string, i int, estimate double, lower double, upper double")

    def effect(self, j: int, *x: Column) -> Column:
        """Term j's contribution at x (a column for each of its own)."""
        return self.terms[j].effect(self.values(j), *x)

    def to_json(self) -> str:
        """The statistics of the fit, from which everything else follows."""
        arrays = {k: getattr(self, k).tolist() for k in ("g", "r", "q", "lambdas")}
        return json.dumps({"terms": [t.state() for t in self.terms], "k": self.k, "intercept": self.intercept, "n": self.n, "y": self.y, "yy": self.yy, "penalties": [p.tolist() for p in self.penalties], **arrays})

    @classmethod
    def from_json(cls, text: str) -> Gam:
        got = json.loads(text)
        terms = [from_state(t) for t in got["terms"]] if "terms" in got else [Cubic(c, got["k"], CubicSpline(np.array(k))) for c, k in zip(got["columns"], got["knots"], strict=True)]
        m = cls([t.column if isinstance(t, Cubic) else t for t in terms], got["k"], got["intercept"], terms, np.array(got["lambdas"]))
        m.n, m.y, m.yy, m.penalties = got["n"], got["y"], got["yy"], [np.array(p) for p in got["penalties"]]
        m.g, m.r, m.q = (np.array(got[k]) for k in ("g", "r", "q"))
        m._solve(m.lambdas, keep=True)
        return m

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``f_<term>`` and ``output``, their sum with the intercept."""
        for j, t in enumerate(self.terms):
            df = t.with_effect(df, self.values(j), f"f_{t.name}")
        base = F.lit(float(self.beta[0]) if self.intercept else 0.0)
        return df.withColumn("output", sum((F.col(f"`f_{t.name}`") for t in self.terms), base))
