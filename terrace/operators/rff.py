"""Random Fourier features of a Gaussian kernel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class RandomFeatures:
    """sqrt(2 / R) cos(z x / width + c) with z normal and c uniform on [0, 2 pi), the same R pairs for every feature or one set each."""

    z: np.ndarray
    c: np.ndarray
    width: float

    @classmethod
    def draw(cls, count: int = 100, width: float = 0.2, seed: int = 101) -> RandomFeatures:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal(count), rng.uniform(0, 2 * np.pi, count), width)

    def column(self, x: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(float(z / self.width)).alias("z"), F.lit(float(c)).alias("c")) for z, c in zip(self.z, self.c, strict=True)))
        scale = float(np.sqrt(2 / len(self.z)))
        return F.when(x.isNotNull(), F.transform(pairs, lambda p: scale * F.cos(p["z"] * x + p["c"])))

    def effect(self, x: Column, weights: np.ndarray) -> Column:
        """``column`` times weights, as one fold."""
        scale = float(np.sqrt(2 / len(self.z)))
        terms = F.array(*(F.struct(F.lit(float(z / self.width)).alias("z"), F.lit(float(c)).alias("c"), F.lit(float(w) * scale).alias("w")) for z, c, w in zip(self.z, self.c, weights, strict=True)))
        return F.when(x.isNotNull(), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"] * F.cos(t["z"] * x + t["c"])))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.z)) * np.cos(np.outer(x, self.z / self.width) + self.c)
