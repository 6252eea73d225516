"""Encodings of columns with fitted state, as Column expressions.

Fitting is aggregates; every function here takes the state as numbers and returns an expression, so a fitted encoder
is part of a single projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import exprs, special


def standardize(x: Column, mean: float, deviation: float) -> Column:
    """(x - mean) / population standard deviation; a constant column is only centred."""
    return (x - mean) / (deviation or 1.0)


def minmax(x: Column, least: float, most: float) -> Column:
    """x scaled to [0, 1] over the fitted range; no clipping beyond it, and a constant column is only shifted."""
    return (x - least) / ((most - least) or 1.0)


def uniform_edges(least: float, most: float, bins: int) -> list[float]:
    """Edges of equal bins; one bin if the range is empty."""
    return [least, most] if least == most else np.linspace(least, most, bins + 1).tolist()


def distinct_edges(edges: list[float]) -> list[float]:
    """Ascending edges without those within 1e-8 of the one before."""
    out = edges[:1]
    for e in edges[1:]:
        if e - out[-1] > 1e-8:
            out.append(e)
    return out if len(out) > 1 else [*out, *out]


def kmeans_edges(x: np.ndarray, weight: np.ndarray, bins: int, rounds: int = 100) -> list[float]:
    """Edges halfway between one-dimensional centres, from weighted points and centres of equal bins to begin with."""
    order = np.argsort(x)
    x, weight = x[order], weight[order]
    cuts = np.array(uniform_edges(float(x[0]), float(x[-1]), bins))
    centres = (cuts[1:] + cuts[:-1]) / 2
    total_w, total_x = np.append(0, np.cumsum(weight)), np.append(0, np.cumsum(weight * x))
    for _ in range(rounds):
        at = np.concatenate([[0], np.searchsorted(x, (centres[1:] + centres[:-1]) / 2), [len(x)]])
        w = total_w[at[1:]] - total_w[at[:-1]]
        new = np.where(w > 0, (total_x[at[1:]] - total_x[at[:-1]]) / np.where(w > 0, w, 1), centres)
        if np.abs(new - centres).max() < 1e-12:
            break
        centres = np.sort(new)
    return distinct_edges([float(x[0]), *((centres[1:] + centres[:-1]) / 2).tolist(), float(x[-1])])


def k_bin(x: Column, edges: list[float]) -> Column:
    """The bin of x: left-closed, values outside in the end bins."""
    return exprs.bin_index(x, edges[1:-1])


def custom_bin(x: Column, edges: list[float], clip: bool = False) -> Column:
    """The bin of x by given edges: right-closed, the lowest edge included; outside NULL, or the end bins with ``clip``."""
    n = len(edges) - 1
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) - 1
    inside = F.when(x == edges[0], 0).otherwise(at)
    if clip:
        return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(inside, F.lit(n - 1))))
    return F.when((x >= edges[0]) & (x <= edges[-1]), inside)


def quantile_map(x: Column, quantiles: list[float], normal: bool = False) -> Column:
    """x by its place among the fitted quantiles, from 0 to 1, or as a normal value; repeated quantiles count by the middle of their places."""
    n = len(quantiles)
    if n < 2 or quantiles[0] == quantiles[-1]:
        u = F.when(x.isNull(), None).when(x <= quantiles[0], 0.0).otherwise(1.0)
    else:
        r = np.linspace(0, 1, n).tolist()
        up = exprs.interpolate(x, quantiles, r)
        down = exprs.interpolate(-x, [-q for q in reversed(quantiles)], [-v for v in reversed(r)])
        u = F.when(x <= quantiles[0], 0.0).when(x >= quantiles[-1], 1.0).otherwise((up - down) / 2)
    if not normal:
        return u
    return special.normal_quantile(F.least(F.greatest(u, F.lit(1e-7)), F.lit(1 - 1e-7)))


def quantile_noise(x: Column, noise: float, deviation: float, *keys: Column, seed: int = 101) -> Column:
    """x with normal noise of standard deviation noise / max(deviation, noise): what the normal quantile map is fitted to. The noise follows from a hash of the keys, so it is the same in any partitioning."""
    if not noise:
        return x
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return x + F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * np.pi * unit(1)) * (noise / max(deviation, noise))


def polynomial(x: Column, degree: int) -> Column:
    """[x, x^2, ..., x^degree]."""
    powers = [x]
    for _ in range(degree - 1):
        powers.append(powers[-1] * x)
    return F.array(*powers)


def bspline(x: Column, least: float, most: float, knots: int, degree: int = 3, last: bool = False) -> Column:
    """Uniform B-spline basis over the fitted range, constant outside; ``last`` keeps the last function, with which a row sums to 1."""
    h = ((most - least) or 1.0) / (knots - 1)
    count = knots + 2 * degree - 1

    def basis(v: Column) -> Column:
        # in units of the knots' distance, from the outermost knot: knot i is at i
        cell = F.least(F.floor((v - least) / h), F.lit(knots - 2)) + degree
        at = (v - least) / h + degree
        rows = exprs.one_hot(cell, count)
        def raised(d: int):
            return lambda b: F.transform(F.sequence(F.lit(0), F.lit(count - 1 - d)), lambda i: (at - i) / d * F.get(b, i) + (i + d + 1 - at) / d * F.get(b, i + 1))

        for d in range(1, degree + 1):
            rows = exprs.let(rows, raised(d))
        return rows if last else F.slice(rows, 1, knots + degree - 2)

    clamped = F.least(F.greatest(x, F.lit(least)), F.lit(most))
    return F.when(x.isNotNull(), exprs.let(clamped, basis))


def bspline_rows(x: np.ndarray, least: float, most: float, knots: int, degree: int = 3) -> np.ndarray:
    """``bspline`` in numpy, without the last function."""
    h, count = ((most - least) or 1.0) / (knots - 1), knots + 2 * degree - 1
    at = (np.clip(x, least, most) - least) / h
    b = np.zeros((len(x), count))
    b[np.arange(len(x)), np.minimum(np.floor(at), knots - 2).astype(int) + degree] = 1.0
    at = at[:, None] + degree
    for d in range(1, degree + 1):
        i = np.arange(count - d)
        b = (at - i) / d * b[:, :-1] + (i + d + 1 - at) / d * b[:, 1:]
    return b[:, : knots + degree - 2]


def category_table(df: DataFrame, column: str) -> DataFrame:
    """(value, id): the column's values in order, numbered from 1."""
    return df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().withColumn("id", F.row_number().over(Window.orderBy("value")))


def ordinal(x: Column, categories: list[str]) -> Column:
    """The number of x among sorted categories, from 1; 0 for a value that is not one of them, and for NULL."""
    if not categories:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array(*map(F.lit, categories)), x.cast("string")), F.lit(0)).cast("int")


def ordinal_join(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """``ordinal`` as a left join with ``category_table``: for vocabularies too large for a constant of the plan; Spark picks the join by size."""
    key = table.select(F.col("value").alias("_value"), F.col("id").alias("_id"))
    return df.join(key, F.col(column).cast("string") == F.col("_value"), "left").withColumn(out, F.coalesce("_id", F.lit(0))).drop("_value", "_id")


def one_hot_ordinal(code: Column, size: int) -> Column:
    """The unit vector of a category's number; slot 0 is for unknown values."""
    return exprs.one_hot(code, size + 1)


def feature_names(feature: str, width: int) -> list[str]:
    """Names of a feature's output columns."""
    return [f"{feature}_bin_{j}" for j in range(width)]


def as_columns(block: str, feature: str, width: int) -> list[Column]:
    """A block's components as named columns."""
    return [F.get(F.col(block), F.lit(j)).alias(name) for j, name in enumerate(feature_names(feature, width))]
