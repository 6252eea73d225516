"""Feature types, imputation, splits and feature sampling."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative error of the distinct counts that decide first; integers whose share is within ten of them of the cutoff are counted exactly.
_ERROR = 0.01


def missing(c: str, kind: T.DataType) -> Column:
    """``c`` with NaN as NULL."""
    return F.when(~F.isnan(c), F.col(c)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(c)


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) or kind.typeName().endswith("interval")


def detect_column_types(df: DataFrame, cat_cutoff: float | int = 0.03, treat_all_integers_as_numerical: bool = False, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numerical, categorical) columns in order.

    Floats are numerical and everything but numbers is categorical. An integer column is categorical if its distinct values are
    fewer than ``cat_cutoff`` (an int) or make up a smaller share of the rows (a float). One pass with sketches decides all columns but
    those near the cutoff, which a second pass counts exactly.
    """
    if isinstance(cat_cutoff, bool) or not isinstance(cat_cutoff, (int, float)) or cat_cutoff < 0:
        raise ValueError(f"cat_cutoff must be a share or a count, not {cat_cutoff!r}")
    exclude = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in exclude]
    if bad := [f.name for f in fields if _nested(f.dataType)]:
        raise TypeError(f"nested columns cannot be features: {bad}")
    whole = [f.name for f in fields if isinstance(f.dataType, T.IntegralType)]
    few: dict[str, bool] = {}
    if whole and not treat_all_integers_as_numerical:
        row = df.agg(F.count("*").alias("n"), *(F.approx_count_distinct(c, _ERROR).alias(f"d{i}") for i, c in enumerate(whole))).first()
        bound = cat_cutoff if isinstance(cat_cutoff, int) else cat_cutoff * row["n"]
        few = {c: row[f"d{i}"] < bound for i, c in enumerate(whole)}
        near = [c for i, c in enumerate(whole) if abs(row[f"d{i}"] - bound) <= 10 * _ERROR * max(row[f"d{i}"], bound) + 2]
        if near:
            exact = df.agg(*(F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(near))).first()
            few |= {c: exact[f"d{i}"] < bound for i, c in enumerate(near)}
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.FloatType, T.DoubleType)) or f.name in whole and not few.get(f.name, False)]
    return numeric, [f.name for f in fields if f.name not in set(numeric)]


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The mean of each column over rows where it is neither NULL nor NaN; a column without any raises."""
    row = df.agg(*(F.avg(missing(c, df.schema[c].dataType)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    if empty := [c for i, c in enumerate(columns) if row[f"m{i}"] is None]:
        raise ValueError(f"columns without a value: {empty}")
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def impute_mean(df: DataFrame, columns: list[str], means: dict[str, float] | None = None) -> DataFrame:
    """NULL and NaN become the mean of the column."""
    means = means or column_means(df, columns)
    return df.withColumns({c: F.coalesce(missing(c, df.schema[c].dataType).cast("double"), F.lit(means[c])) for c in columns})


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n) of all columns' values as text, in one pass; NULL is not a value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*")
    return long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, n): the most frequent value of each column, the smallest of ties."""
    best = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return category_counts(df, columns).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def impute_most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL becomes the most frequent value of the column, as text."""
    mode = {r["feature"]: r["value"] for r in most_frequent(df, columns).collect()}  # a row a column
    if empty := [c for c in columns if c not in mode]:
        raise ValueError(f"columns without a value: {empty}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(mode[c])) for c in columns})


def impute_constant(df: DataFrame, columns: list[str], value: str = "missing") -> DataFrame:
    """NULL becomes ``value``, as text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


def split_bucket(*keys: Column, seed: int = 101) -> Column:
    """A number from 0 to 9999 that depends on the keys and the seed alone: the same on any cluster and partitioning."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000


def train_validation_split(df: DataFrame, keys: list[str], val_size: float = 0.2, seed: int = 101) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash of the key columns."""
    held = held_out(keys, val_size, seed)
    return df.where(~held), df.where(held)


def held_out(keys: list[str], val_size: float = 0.2, seed: int = 101) -> Column:
    """Whether a row is one of the validation rows of ``train_validation_split``."""
    if not 0 <= val_size < 1:
        raise ValueError(f"val_size must be from 0 to below 1, not {val_size}")
    return split_bucket(*map(F.col, keys), seed=seed) < round(val_size * 10_000)


def feature_masks(n_features: int, n_trees: int, share: float, seed: int = 101) -> np.ndarray:
    """For each tree a random mask with ``share`` of the features, one at least."""
    rng = np.random.default_rng(seed)
    keep = max(1, int(n_features * share))
    out = np.zeros((n_trees, n_features), bool)
    for row in out:
        row[rng.choice(n_features, keep, replace=False)] = True
    return out


def class_log_odds(df: DataFrame, label: str) -> DataFrame:
    """(label, n, bias): the log-odds of each class, the start value of a model without features."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.select(label, "n", F.ln(p / (1 - p)).alias("bias"))
