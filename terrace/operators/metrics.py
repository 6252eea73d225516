"""Metrics as aggregate Columns: any number of them is one job."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import exprs
from terrace.functions.special import normal_cdf

_TINY = 1e-9


def _xlogx(x: Column, ratio: Column) -> Column:
    """x log ratio, 0 at x = 0."""
    return F.when(x == 0, 0.0).otherwise(x * F.ln(ratio))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def poisson_deviance(y: Column, mean: Column) -> Column:
    m = F.greatest(mean, F.lit(_TINY))
    return 2 * F.sum(_xlogx(y, y / m) - (y - m))


def gamma_deviance(y: Column, mean: Column) -> Column:
    y, m = F.greatest(y, F.lit(_TINY)), F.greatest(mean, F.lit(_TINY))
    return 2 * F.sum(F.ln(y / m) + (y - m) / m)


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def dirichlet_error(y: Column, p: Column) -> Column:
    """For vectors."""
    return F.avg(exprs.total(F.zip_with(y, p, lambda a, b: (b - a) * (b - a))))


def student_t_loss(y: Column, loc: Column, scale: Column, df: float = 2.0) -> Column:
    return F.avg((df + 1) * F.ln(1 + (y - loc) * (y - loc) / (df * scale)) / scale)


def negative_binomial_deviance(y: Column, mean: Column, alpha: Column) -> Column:
    return 2 * F.sum(y * F.ln(y / mean + _TINY) + (y + alpha) * F.ln((mean + alpha) / (y + alpha)))


def inverse_gamma_loss(y: Column, shape: Column, scale: Column) -> Column:
    """The mean of (a + 1) log(y / b) + log(b^a / y)."""
    return F.avg((shape + 1) * F.ln(y / scale) + shape * F.ln(scale) - F.ln(y))


def gaussian_crps(y: Column, mean: Column, scale: Column) -> Column:
    z = (y - mean) / scale
    density = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return F.avg(scale * (z * (2 * normal_cdf(z) - 1) + 2 * density - 1 / math.sqrt(math.pi)))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def precision(y: Column, p: Column) -> Column:
    """Of class 1; NULL if it is never predicted."""
    return F.try_divide(F.sum(((y == 1) & (p == 1)).cast("double")), F.sum((p == 1).cast("double")))


def auroc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(auroc): the share of (1, 0) pairs in order, ties half.

    Counts a distinct score come first; their running sum is over sums a range of scores, so no task holds all rows.
    """
    n = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    edge = n.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    cut = n.crossJoin(F.broadcast(edge)).withColumn("part", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 4096)).otherwise(0))
    sums = cut.groupBy("part").agg(F.sum("neg").alias("part_neg")).withColumn("base", F.coalesce(F.sum("part_neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("below", below).join(sums, "part")
    return ranked.agg(F.try_divide(F.sum(F.col("pos") * (F.col("base") + F.col("below") + F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def evaluate(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row with all metrics, in one job."""
    return df.agg(*(c.alias(k) for k, c in metrics.items()))


#: Metrics by family, from a target and the family's parameters.
DEFAULTS: dict[str, dict[str, Callable[..., Column]]] = {
    "normal": {"mse": lambda y, m, s: mse(y, m), "crps": gaussian_crps}, "robustnormal": {"mse": lambda y, m, s: mse(y, m), "crps": gaussian_crps},
    "poisson": {"poisson_deviance": poisson_deviance}, "gamma": {"gamma_deviance": lambda y, a, r: gamma_deviance(y, a / r)}, "beta": {"brier": lambda y, a, b: brier(y, a / (a + b))},
    "studentt": {"student_t_loss": lambda y, df, loc, s: student_t_loss(y, loc, s)}, "negativebinom": {"negative_binomial_deviance": lambda y, m, d: negative_binomial_deviance(y, m, 1.0 / d)},
    "inversegamma": {"inverse_gamma_loss": inverse_gamma_loss}, "bernoulli": {"accuracy": lambda y, z: accuracy(y, (z > 0).cast("int"))},
    "categorical": {"accuracy": lambda y, *z: accuracy(y, exprs.argmax(F.array(*z)))}, "quantile": {"mae": lambda y, *q: mae(y, q[len(q) // 2])},
}
