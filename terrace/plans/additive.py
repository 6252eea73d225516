"""Additive models that are linear in their parameters: linear, spline and Gaussian-process shapes, with interactions, for any family.

Each feature has a block of basis functions; an interaction's block is the product of its features' blocks. For every
parameter of the family the raw output is an intercept and a sum of blocks times coefficients.

* squared error: one job for the cross products, one solve, ridge or spline penalties, smoothing chosen by GCV;
* any other family: local scoring. A round is one job a parameter, in which each row gives the slope and curvature of its own loss
  (central differences of the family's numpy loss, so user families work) and tasks add up weighted cross products; the step is halved until
  the mean loss falls.

Scoring is one projection with a column a term, in closed forms (look-ups and polynomials) rather than vectors wherever the basis has one.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.exprs import dot, one_hot
from terrace.operators import families
from terrace.operators.gram import FAN_IN, Build, Gram, gram
from terrace.operators.rff import RandomFeatures
from terrace.operators.splines import CubicSpline, scale_penalty
from terrace.plans.preprocess import Feature, Preprocessor

SHAPES = ("linear", "spline", "gp")


def _products(left: Column, right: Column) -> Column:
    """All products of components of two blocks, the left one's first."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: a * b)))


@dataclasses.dataclass
class Term:
    """A feature or an interaction ("a:b"): the features' names and the width of the block."""

    name: str
    features: list[str]
    width: int


@dataclasses.dataclass
class AdditiveModel:
    """Parameters, and after ``fit`` terms and coefficients (parameter x (1 + widths))."""

    shape: str = "linear"
    interaction_degree: int | None = None
    knots: int = 12
    random_features: int = 100
    kernel_width: float = 0.2
    ridge: float = 1e-6
    smoothing: float | None = None
    max_iter: int = 25
    tol: float = 1e-6
    seed: int = 101

    def __post_init__(self) -> None:
        if self.shape not in SHAPES:
            raise ValueError(f"shape must be one of {SHAPES}, not {self.shape!r}")
        self.spline = CubicSpline.over(0.0, 1.0, self.knots)
        self.rff = RandomFeatures.draw(self.random_features, self.kernel_width, self.seed)

    def _single(self, f: Feature) -> bool:
        """Whether the shape makes a basis of a feature's one number."""
        return f.kind == "num" and f.width == 1 and f.encoding != "one_hot" and self.shape != "linear"

    def _rows(self, pre: Preprocessor, f: Feature, x: np.ndarray) -> np.ndarray:
        """A feature's basis in numpy, from its source."""
        if not self._single(f):
            return pre.rows(f, x)
        return self.spline.rows(x) if self.shape == "spline" else np.hstack([x[:, None], self.rff.rows(x)])

    def _terms(self, pre: Preprocessor) -> list[Term]:
        width = {f.name: self._rows(pre, f, np.zeros(1)).shape[1] for f in pre.features}
        groups = [[n] for n in width] + [list(c) for d in range(2, (self.interaction_degree or 1) + 1) for c in itertools.combinations(width, d)]
        return [Term(":".join(g), g, math.prod(width[n] for n in g)) for g in groups]

    def _build(self, pre: Preprocessor) -> Build:
        """Rows of the design: 1, blocks, and products of blocks."""
        terms, number = self.terms, {f.name: i for i, f in enumerate(pre.features)}

        def build(batch: pa.RecordBatch) -> np.ndarray:
            own = {n: self._rows(pre, pre.features[i], batch.column(f"x{i}").to_numpy()) for n, i in number.items()}
            parts = [np.ones((batch.num_rows, 1))]
            for t in terms:
                block = own[t.features[0]]
                for n in t.features[1:]:
                    block = (block[:, :, None] * own[n][:, None, :]).reshape(len(block), -1)
                parts.append(block)
            return np.hstack(parts)

        return build

    def _penalty(self, norms: np.ndarray, lam: float) -> np.ndarray:
        size = 1 + sum(t.width for t in self.terms)
        out, at = np.zeros((size, size)), 1
        for t, norm in zip(self.terms, norms, strict=True):
            own = slice(at, at + t.width)
            if self.shape == "spline" and len(t.features) == 1 and t.width == self.spline.width:
                out[own, own] = scale_penalty(self.spline.penalty, norm) * lam
            out[own, own] += self.ridge * np.eye(t.width)
            at += t.width
        return out

    def fit(self, df: DataFrame, y: str, pre: Preprocessor, family: families.Family | None = None, weight: str | None = None) -> AdditiveModel:
        """``df`` holds the features as they are and the target; without a family the loss is squared error. Bases are made in numpy, a batch at a time."""
        self.terms, self.family = self._terms(pre), family
        self.width = sum(t.width for t in self.terms)
        inputs = {f"x{i}": pre.source(f, df.schema[f.name].dataType) for i, f in enumerate(pre.features)}
        src = df.select(*(c.alias(k) for k, c in inputs.items()), F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).dropna()
        self._make = self._build(pre)
        if family is None:
            g = gram(src, {k: F.col(k) for k in inputs}, 1 + self.width, F.col("y"), F.col("w"), [1, *(t.width for t in self.terms)], self._make)
            self.n, self.history = g.n, []
            self.coefficients = self._least_squares(g)[None]
        else:
            self._local_scoring(src, family)
        del self._make
        return self

    def _least_squares(self, g: Gram) -> np.ndarray:
        def solve(lam: float) -> tuple[float, np.ndarray]:
            a = g.bb + self._penalty(g.norms[1:], lam)
            beta = np.linalg.lstsq(a, g.by, rcond=1e-12)[0]
            edf = np.trace(np.linalg.lstsq(a, g.bb, rcond=1e-12)[0])
            rss = max(g.yy - 2 * beta @ g.by + beta @ g.bb @ beta, 0.0)
            return rss / g.n / max(1 - edf / g.n, 1e-9) ** 2, beta

        if self.shape != "spline":
            return solve(0.0)[1]
        grid = [self.smoothing] if self.smoothing is not None else [10.0**k for k in range(-6, 7)]
        return min((solve(lam) for lam in grid), key=lambda r: r[0])[1]

    def _local_scoring(self, src: DataFrame, family: families.Family) -> None:
        width, k = 1 + self.width, family.size
        beta = np.zeros((k, width))
        n, loss = self._loss(src, family, [beta])[0]
        self.n, self.history = n, [loss]
        # without features first: it sets the scale of every parameter
        for steps, free in ((15, 1), (self.max_iter, width)):
            for _ in range(steps):
                before = loss
                for p in range(k):
                    h, r, norms = self._curvature(src, family, beta, p)
                    pen = self._penalty(norms[1:], self.smoothing or 0.0) * (1 if free > 1 else 0)
                    a = h[:free, :free] + pen[:free, :free]
                    move = np.zeros(width)
                    move[:free] = np.linalg.lstsq(a + 1e-9 * np.trace(a) / free * np.eye(free), r[:free] - pen[:free, :free] @ beta[p, :free], rcond=1e-12)[0]
                    tries = []
                    for s in (1.0, 0.5, 0.25, 0.0625, 0.01):
                        t = beta.copy()
                        t[p] += s * move
                        tries.append(t)
                    for t, (_, new) in zip(tries, self._loss(src, family, tries), strict=True):
                        if new < loss:
                            beta, loss = t, new
                            break
                self.history.append(loss)
                if before - loss <= self.tol * max(1.0, abs(loss)):
                    break
        self.coefficients = beta

    def _loss(self, src: DataFrame, family: families.Family, betas: list[np.ndarray]) -> list[tuple[int, float]]:
        """(rows, mean loss) of several coefficients, in one job; rows with a loss that is not finite make it infinite."""
        make = self._make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(betas), 2))
            for batch in batches:
                if batch.num_rows:
                    b, y = make(batch), batch.column("y").to_numpy()
                    w = batch.column("w").to_numpy()
                    with np.errstate(all="ignore"):
                        for i, beta in enumerate(betas):
                            total[i] += len(y), (w * family.numpy_nll(y, b @ beta.T)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(betas))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["i", "n", "s"])

        rows = src.mapInArrow(run, "i long, n double, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
        return [(int(r["n"]), r["s"] / r["n"] if r["n"] and np.isfinite(r["s"]) else float("inf")) for r in rows]

    def _curvature(self, src: DataFrame, family: families.Family, beta: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted cross products for parameter p: sum of curvature b b', minus the slope times b, and largest row sums by block."""
        width, make = 1 + self.width, self._make
        cuts = np.cumsum([0, 1, *(t.width for t in self.terms)])[:-1]

        def pack(h: np.ndarray, r: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (h, r, top)], ["h", "r", "top"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, r, top = np.zeros((width, width)), np.zeros(width), np.zeros(len(cuts))
            for batch in batches:
                if not batch.num_rows:
                    continue
                b, y, w = make(batch), batch.column("y").to_numpy(), batch.column("w").to_numpy()
                raw = b @ beta.T
                step = 1e-4 * np.maximum(1.0, np.abs(raw[:, p]))
                with np.errstate(all="ignore"):
                    mid = family.numpy_nll(y, raw)
                    up, down = raw.copy(), raw.copy()
                    up[:, p] += step
                    down[:, p] -= step
                    hi, lo = family.numpy_nll(y, up), family.numpy_nll(y, down)
                    slope, curve = (hi - lo) / (2 * step), (hi - 2 * mid + lo) / step**2
                slope, curve = (np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0) for v in (slope, curve))
                curve = np.maximum(curve, np.maximum(1e-3, slope * slope * 0.1))
                h += (b * (w * curve)[:, None]).T @ b
                r -= b.T @ (w * slope)
                top = np.maximum(top, np.add.reduceat(np.abs(b), cuts, axis=1).max(0))
            yield pack(h, r, top)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, r, top = np.zeros(width * width), np.zeros(width), np.zeros(len(cuts))
            for batch in batches:
                for row in batch.to_pylist():
                    h += np.frombuffer(row["h"])
                    r += np.frombuffer(row["r"])
                    top = np.maximum(top, np.frombuffer(row["top"]))
            yield pack(h, r, top)

        kinds = "h binary, r binary, top binary"
        rows = src.mapInArrow(run, kinds).repartition(FAN_IN).mapInArrow(merge, kinds).collect()
        return np.sum([np.frombuffer(x["h"]) for x in rows], 0).reshape(width, width), np.sum([np.frombuffer(x["r"]) for x in rows], 0), np.max([np.frombuffer(x["top"]) for x in rows], 0)

    def _effect(self, pre: Preprocessor, f: Feature, kind: T.DataType, weights: np.ndarray) -> Column:
        """A feature's block times weights."""
        if not self._single(f):
            return pre.effect(f, kind, list(map(float, weights)))
        x = pre.source(f, kind)
        return self.spline.effect(x, weights) if self.shape == "spline" else x * float(weights[0]) + self.rff.effect(x, weights[1:])

    def _block(self, pre: Preprocessor, f: Feature, kind: T.DataType) -> Column:
        """A feature's block as an array."""
        if self._single(f):
            x = pre.source(f, kind)
            return self.spline.column(x) if self.shape == "spline" else F.concat(F.array(x), self.rff.column(x))
        return one_hot(pre.source(f, kind).cast("int"), len(f.state["categories"]) + 1) if f.kind == "cat" else pre.column(f, kind)

    def contributions(self, df: DataFrame, pre: Preprocessor, p: int = 0) -> dict[str, Column]:
        """{term: its share of the raw output of parameter p}."""
        by_name, out, at = {f.name: f for f in pre.features}, {}, 1
        for t in self.terms:
            own = self.coefficients[p, at : at + t.width]
            if len(t.features) == 1:
                out[t.name] = self._effect(pre, by_name[t.name], df.schema[t.name].dataType, own)
            else:
                blocks = [self._block(pre, by_name[n], df.schema[n].dataType) for n in t.features]
                out[t.name] = dot(functools.reduce(_products, blocks), F.array(*map(F.lit, map(float, own))))
            at += t.width
        return out

    def transform(self, df: DataFrame, pre: Preprocessor) -> DataFrame:
        """Adds ``raw`` (an output a parameter), ``f_<term>`` of the first parameter, and ``output``, its raw value, to rows as they are."""
        own = self.contributions(df, pre)
        out = df.withColumns({f"f_{t}": c for t, c in own.items()})
        first = sum((F.col(f"`f_{t}`") for t in own), F.lit(float(self.coefficients[0, 0])))
        others = [sum(self.contributions(df, pre, p).values(), F.lit(float(self.coefficients[p, 0]))) for p in range(1, len(self.coefficients))]
        return out.withColumn("output", first).withColumn("raw", F.array("output", *others))

    def to_json(self) -> str:
        return json.dumps({"params": dataclasses.asdict(self), "coefficients": self.coefficients.tolist(), "terms": [dataclasses.asdict(t) for t in self.terms]})

    @classmethod
    def from_json(cls, text: str) -> AdditiveModel:
        got = json.loads(text)
        m = cls(**got["params"])
        m.coefficients, m.terms = np.array(got["coefficients"]), [Term(**t) for t in got["terms"]]
        m.width, m.family = sum(t.width for t in m.terms), None
        return m
