"""Terms of a penalised GAM: cubic splines, thin plates of several columns, regions with neighbours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import mrf, thinplate
from terrace.operators.gram import _matrix
from terrace.operators.splines import CubicSpline

#: Regions up to which a term's columns are solved with all others; more go to ``terrace.plans.region``.
DENSE = 500
Part = tuple[DataFrame, dict[str, Column], Callable[[pa.RecordBatch], np.ndarray]]


@dataclass
class Cubic:
    """A cubic spline of one column with k knots over its range."""

    column: str
    k: int = 10
    spline: CubicSpline | None = None

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self) -> list[str]:
        return [self.column]

    @property
    def width(self) -> int:
        return self.k

    @property
    def penalty(self) -> np.ndarray:
        return self.spline.penalty

    def over(self, df: DataFrame, ends: dict[str, Any]) -> None:
        self.spline = CubicSpline.over(ends[f"min {self.column}"], ends[f"max {self.column}"], self.k)

    def part(self, df: DataFrame, j: int) -> Part:
        """The frame, what the basis is made of, and the basis of a batch."""
        spline = self.spline
        return df, {f"x{j}": F.col(self.column).cast("double")}, lambda batch: spline.rows(batch.column(f"x{j}").to_numpy())

    def with_effect(self, df: DataFrame, values: np.ndarray, name: str) -> DataFrame:
        return df.withColumn(name, self.effect(values, F.col(self.column)))

    def effect(self, values: np.ndarray, x: Column) -> Column:
        return self.spline.effect(x, values)

    def state(self) -> dict:
        return {"kind": "cubic", "column": self.column, "k": self.k, "knots": self.spline.knots.tolist()}


@dataclass
class Plate:
    """A thin plate over the distinct rows of one column or more; a fit joins rows with the basis at the distinct rows."""

    columns: list[str]
    k: int = 10
    order: int = 2
    local: int = thinplate.LOCAL
    tile: int = thinplate.TILE
    smooth: thinplate.ThinPlate | thinplate.TiledThinPlate | None = None

    @property
    def name(self) -> str:
        return ":".join(self.columns)

    @property
    def width(self) -> int:
        return self.k

    @property
    def penalty(self) -> np.ndarray:
        return self.smooth.penalty

    def over(self, df: DataFrame, ends: dict[str, Any]) -> None:
        self.smooth = thinplate.fit(df, self.columns, self.k, self.order, self.local, self.tile)

    def part(self, df: DataFrame, j: int) -> Part:
        width = self.width
        return thinplate.at_rows(self.smooth, df, self.columns, f"_basis{j}"), {f"b{j}": F.col(f"_basis{j}")}, lambda batch: _matrix(batch.column(f"b{j}"), width)

    def with_effect(self, df: DataFrame, values: np.ndarray, name: str) -> DataFrame:
        return self.smooth.with_effect(df, [F.col(c) for c in self.columns], values, name)

    def effect(self, values: np.ndarray, *xs: Column) -> Column:
        if not isinstance(self.smooth, thinplate.ThinPlate):
            raise ValueError("knots that stay in a table are evaluated by transform")
        return self.smooth.effect(list(xs), values)

    def uncentred(self, values: np.ndarray) -> Any:
        """Coefficients of the knots' radial functions and of the monomials (a table of them where knots are one)."""
        s = self.smooth
        return s.uncentred(values) if isinstance(s, thinplate.ThinPlate) else (s.knot_coefficients(values), s.free_map @ values)

    def grid(self, df: DataFrame, values: np.ndarray, points: int | None = None) -> DataFrame:
        return thinplate.plot_grid(self.smooth, df, self.columns, values, points)

    def state(self) -> dict:
        s = self.smooth
        if not isinstance(s, thinplate.ThinPlate):
            raise ValueError("a thin plate whose knots stay in a table is saved as its tiles (Parquet), not as JSON")
        return {"kind": "plate", "columns": self.columns, "k": self.k, "order": self.order, "knots": s.knots.tolist(), "counts": None if s.counts is None else np.asarray(s.counts).tolist()}


@dataclass
class Region:
    """A value a region, drawn towards those of its neighbours; ``edges``: (region_a, region_b) both ways round, as ``mrf.neighbours`` gives them."""

    column: str
    edges: DataFrame | None = None
    regions: list = field(default_factory=list)
    laplacian: np.ndarray | None = None

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self) -> list[str]:
        return [self.column]

    @property
    def width(self) -> int:
        return len(self.regions)

    @property
    def penalty(self) -> np.ndarray:
        return self.laplacian

    @classmethod
    def of(cls, column: str, vertices: DataFrame) -> Region:
        """From polygons: (region, vx, vy)."""
        return cls(column, mrf.neighbours(vertices))

    def every(self, df: DataFrame) -> DataFrame:
        """(region): those of the rows and of the neighbours."""
        seen = df.select(F.col(self.column).alias("region"))
        return seen.union(self.edges.select("region_a")).union(self.edges.select("region_b")).where("region IS NOT NULL").distinct()

    def over(self, df: DataFrame, ends: dict[str, Any]) -> None:
        found = [r["region"] for r in self.every(df).limit(DENSE + 1).collect()]
        if len(found) > DENSE:
            raise ValueError(f"more than {DENSE} regions: RegionGam solves them in tables")
        self.regions = sorted(found)
        at = {r: i for i, r in enumerate(self.regions)}
        self.laplacian = np.zeros((len(found), len(found)))
        for r in self.edges.select("region_a", "region_b").where("region_a <> region_b").distinct().collect():  # among at most DENSE regions
            a, b = at[r["region_a"]], at[r["region_b"]]
            self.laplacian[a, b] = -1.0
            self.laplacian[a, a] += 1.0

    def _number(self, x: Column) -> Column:
        return F.create_map(*(F.lit(v) for i, r in enumerate(self.regions) for v in (r, i)))[x]

    def part(self, df: DataFrame, j: int) -> Part:
        width = self.width

        def rows(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((batch.num_rows, width))
            out[np.arange(batch.num_rows), batch.column(f"r{j}").to_numpy()] = 1.0
            return out

        return df, {f"r{j}": self._number(F.col(self.column))}, rows

    def with_effect(self, df: DataFrame, values: np.ndarray, name: str) -> DataFrame:
        return df.withColumn(name, self.effect(values, F.col(self.column)))

    def effect(self, values: np.ndarray, x: Column) -> Column:
        return F.create_map(*(F.lit(v) for r, y in zip(self.regions, map(float, values), strict=True) for v in (r, y)))[x]

    def state(self) -> dict:
        return {"kind": "region", "column": self.column, "regions": self.regions, "laplacian": self.laplacian.tolist()}


Term = Cubic | Plate | Region


def from_state(state: dict) -> Term:
    if state["kind"] == "cubic":
        return Cubic(state["column"], state["k"], CubicSpline(np.array(state["knots"])))
    if state["kind"] == "region":
        return Region(state["column"], None, state["regions"], np.array(state["laplacian"]))
    counts = state["counts"]
    smooth = thinplate.ThinPlate(np.array(state["knots"]), state["k"], state["order"], None if counts is None else np.array(counts))
    return Plate(state["columns"], state["k"], state["order"], smooth=smooth)
