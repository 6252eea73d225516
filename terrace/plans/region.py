"""A penalised GAM with a region term of any number of regions, solved by conjugate gradients over the neighbour table.

With cross products G of the other terms, sums C of their columns by region, counts N by region and the neighbours' Laplacian L, the normal equations are

    [G + P   C'         ] [b]   [r ]
    [C       N + lambda L] [u] = [ry]

The second row is eliminated: conjugate gradients solve (N + lambda L) X = [C, ry] for all columns at once, which leaves a system of the other terms' size for the driver. Vectors over regions stay in written tables; a step is a join
of the neighbour table with them, a sum by region, and a few sums that reach the driver. Regions without rows take the values that their neighbours give them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.gram import gram
from terrace.plans.gam import Gam
from terrace.plans.smooths import Cubic, Region, Term
from terrace.sources.shared import removed, written

#: The residual, of the right-hand side's size, that ends conjugate gradients, and their most steps.
TOLERANCE, STEPS = 1e-10, 2000


@dataclass
class RegionGam:
    """y = intercept + a value a region + sum of smooth terms (as in ``Gam``). Smoothing parameters are given: one for the regions, one a term."""

    region: Region
    others: list[str | Term] = field(default_factory=list)
    k: int = 10
    steps: int = 0
    effects: DataFrame | None = None

    def fit(self, df: DataFrame, y: str, region_lambda: float = 1.0, lambdas: list[float] | None = None) -> RegionGam:
        """Rows with a missing value in any term, region or y do not count."""
        name = self.region.column
        self.smooth = Gam(self.others, self.k)
        self.smooth.terms = terms = [Cubic(t, self.k) if isinstance(t, str) else t for t in self.others]
        frame = df.where(F.col(name).isNotNull() & F.col(y).isNotNull())
        cubic = sorted({t.column for t in terms if isinstance(t, Cubic)})
        ends = frame.agg(*(f(F.col(c).cast("double")).alias(f"{m} {c}") for c in cubic for m, f in (("min", F.min), ("max", F.max)))).first().asDict() if cubic else {}
        inputs, parts = {}, []
        for j, t in enumerate(terms):
            t.over(frame, ends)
            frame, own, rows = t.part(frame, j)
            inputs |= own
            parts.append(rows)
        widths = [t.width for t in terms]
        build = lambda batch: np.hstack([rows(batch) for rows in parts]) if parts else np.ones((batch.num_rows, 1))
        width = sum(widths) if terms else 1
        frame = frame.withColumns({f"_in_{c}": v for c, v in inputs.items()}).dropna(subset=[f"_in_{c}" for c in inputs] or None, how="any") if inputs else frame
        inputs = {c: F.col(f"_in_{c}") for c in inputs}
        g = gram(frame, inputs or {"none": F.lit(0.0)}, width, F.col(y), blocks=widths or [1], build=build)
        if terms:
            self.smooth._use(g)
            q, m = self.smooth.q, self.smooth.q.shape[1]
        else:
            q, m = np.zeros((1, 0)), 0
        cells = self._cells(frame, inputs, name, y, build, q, m)
        self.scale = self._scale()
        solved = self._solve(cells, m, region_lambda * self.scale)
        left = [F.sum(F.col(f"f{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(m + 1) for j in range(m + 1)]
        row = solved.agg(F.sum("n").alias("n"), *left).first() if m else None
        beta = np.zeros(m)
        if m:
            s = np.array([[row[f"s{i}_{j}"] for j in range(m + 1)] for i in range(m + 1)])
            one = 1
            a = self.smooth.g[one:, one:] - s[:m, :m] + sum(lam * p[one:, one:] for lam, p in zip(lambdas or [1.0] * len(terms), self.smooth.penalties, strict=True))
            beta = np.linalg.solve(a, self.smooth.r[one:] - s[:m, m])
        value = sum((F.col(f"x{j}") * float(-b) for j, b in enumerate(beta)), F.col(f"x{m}"))
        u = written(solved.select("region", "n", value.alias("value")), "regions")
        removed(solved)
        total = u.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("s")).first()
        self.n, self.intercept = int(total["n"] or 0), float((total["s"] or 0.0) / max(total["n"] or 1, 1))
        self.effects = u.select("region", "n", (F.col("value") - self.intercept).alias("effect"))
        self.smooth.beta = np.concatenate([[self.intercept], beta])
        self.region_lambda = region_lambda
        return self

    def _scale(self) -> float:
        """What makes the penalty comparable to others': the reciprocal of the Laplacian's largest absolute column sum, as a row of the basis has one 1."""
        most = self.region.edges.where("region_a <> region_b").select("region_a", "region_b").distinct().groupBy("region_a").count().agg(F.max("count")).first()[0]
        return 1.0 / (2.0 * most) if most else 1.0

    def _cells(self, frame: DataFrame, inputs: dict, name: str, y: str, build, q: np.ndarray, m: int) -> DataFrame:  # noqa: ANN001
        """(region, n, f0 .. fm): rows, sums of the centred columns and of y, of every region; summed in tasks first."""
        cols = [f"f{i}" for i in range(m + 1)]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = batch.column("region").dictionary_encode()
                b = build(batch) @ q
                rows = np.column_stack([np.ones(len(b)), b, batch.column("y").to_numpy()])
                at = code.indices.to_numpy()
                out = np.stack([np.bincount(at, rows[:, i], len(code.dictionary)) for i in range(rows.shape[1])], 1) if len(b) else np.zeros((0, m + 2))
                yield pa.RecordBatch.from_arrays([code.dictionary, *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(m + 2))], ["region", "n", *cols])

        kind = frame.schema[name].dataType.simpleString()
        src = frame.select(F.col(name).alias("region"), F.col(y).cast("double").alias("y"), *(c.alias(k) for k, c in inputs.items()))
        sums = src.mapInArrow(partial, f"region {kind}, n double, " + ", ".join(f"{c} double" for c in cols)).groupBy("region").agg(*(F.sum(c).alias(c) for c in ("n", *cols)))
        every = self.region.every(frame)
        return every.join(sums, "region", "left").fillna(0.0, subset=["n", *cols])

    def _solve(self, cells: DataFrame, m: int, lam: float) -> DataFrame:
        """(region, n, f.., x..) with (N + lam L) x = f."""
        at = range(m + 1)
        edges = self.region.edges.select("region_a", "region_b").where("region_a <> region_b").distinct()
        edges = written(edges, "edges")
        degree = edges.groupBy("region_a").agg(F.count("*").cast("double").alias("degree"))
        state = cells.join(degree, F.col("region") == F.col("region_a"), "left").drop("region_a").fillna(0.0, subset=["degree"])
        state = state.withColumn("d", F.when(F.col("n") + lam * F.col("degree") > 0, F.col("n") + lam * F.col("degree")).otherwise(1.0))
        state = state.withColumns({f"x{i}": F.lit(0.0) for i in at} | {f"r{i}": F.col(f"f{i}") for i in at} | {f"p{i}": F.col(f"f{i}") / F.col("d") for i in at})
        state = written(state, "cg")
        sums = lambda df, terms: np.array([v or 0.0 for v in df.agg(*(F.sum(t) for t in terms)).first()])
        rz = start = sums(state, [F.col(f"r{i}") * F.col(f"r{i}") / F.col("d") for i in at])
        for self.steps in range(1, STEPS + 1):
            if (rz <= TOLERANCE**2 * np.maximum(start, 1e-300)).all():
                removed(edges)
                return state
            near = edges.join(state.select(F.col("region").alias("region_b"), *(F.col(f"p{i}").alias(f"q{i}") for i in at)), "region_b").groupBy("region_a").agg(*(F.sum(f"q{i}").alias(f"q{i}") for i in at))
            moved = state.join(near, F.col("region") == F.col("region_a"), "left").withColumns({f"q{i}": (F.col("n") + lam * F.col("degree")) * F.col(f"p{i}") - lam * F.coalesce(F.col(f"q{i}"), F.lit(0.0)) for i in at}).drop("region_a")
            moved = written(moved, "cg")
            pq = sums(moved, [F.col(f"p{i}") * F.col(f"q{i}") for i in at])
            a = [float(z / v) if v > 0 and z > TOLERANCE**2 * s else 0.0 for z, v, s in zip(rz, pq, start, strict=True)]
            moved = moved.withColumns({f"x{i}": F.col(f"x{i}") + a[i] * F.col(f"p{i}") for i in at} | {f"r{i}": F.col(f"r{i}") - a[i] * F.col(f"q{i}") for i in at})
            new = sums(moved, [F.col(f"r{i}") * F.col(f"r{i}") / F.col("d") for i in at])
            b = [float(w / z) if z > 0 else 0.0 for w, z in zip(new, rz, strict=True)]
            moved = moved.withColumns({f"p{i}": F.col(f"r{i}") / F.col("d") + b[i] * F.col(f"p{i}") for i in at}).drop(*(f"q{i}" for i in at))
            old, state, rz = state, written(moved, "cg"), new
            removed(old)
        raise RuntimeError(f"conjugate gradients did not settle in {STEPS} steps")

    def laplacian_effects(self) -> DataFrame:
        """(region, rough): the Laplacian times the effects, which sums to nothing over all regions."""
        edges = self.region.edges.select("region_a", "region_b").where("region_a <> region_b").distinct()
        a, b = self.effects.select(F.col("region").alias("region_a"), F.col("effect").alias("own")), self.effects.select(F.col("region").alias("region_b"), F.col("effect").alias("other"))
        rough = edges.join(a, "region_a").join(b, "region_b").groupBy("region_a").agg(F.sum(F.col("own") - F.col("other")).alias("rough"))
        return self.effects.join(rough, F.col("region") == F.col("region_a"), "left").select("region", F.coalesce("rough", F.lit(0.0)).alias("rough"))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``f_<term>`` for every term and ``output``; a region that is not known has no effect."""
        name = self.region.column
        own = self.effects.select(F.col("region").alias("_region"), F.col("effect").alias(f"f_{name}"))
        df = df.join(own, F.col(name) == F.col("_region"), "left").drop("_region").fillna(0.0, subset=[f"f_{name}"])
        for j, t in enumerate(self.smooth.terms):
            df = t.with_effect(df, self.smooth.values(j), f"f_{t.name}")
        return df.withColumn("output", sum((F.col(f"`f_{t.name}`") for t in (self.region, *self.smooth.terms)), F.lit(self.intercept)))
