"""The preprocessor: types, imputation and encodings of all features, fitted in a fixed number of jobs and applied as one projection.

Jobs of a fit: types (one pass over integers), moments of all numerical columns, categories of all categorical columns, and for encodings
that need them percentiles or target tables of all columns. State is plain numbers and can be saved as JSON.
"""

from __future__ import annotations

import dataclasses
import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions import exprs
from terrace.operators import encoders, schema, tree

#: Categories of a column that stand in a plan; more are joined.
LITERALS = 20_000
#: Noise of "quantile_noise", over the deviation, and its percentiles at most.
NOISE, NOISE_POINTS = 1e-3, 2000
NUMERICAL = ("ple", "binning", "one_hot", "standardization", "normalization", "quantile", "quantile_normal", "quantile_noise", "polynomial", "splines", "none")
CATEGORICAL = ("int", "one_hot", "one-hot")
STRATEGIES = ("uniform", "quantile", "kmeans")


def as_frame(spark: SparkSession, data: DataFrame | pd.DataFrame | dict) -> DataFrame:
    """A Spark DataFrame of what callers hold: a DataFrame, a pandas one, or a dict of columns."""
    if isinstance(data, DataFrame):
        return data
    return spark.createDataFrame(data if isinstance(data, pd.DataFrame) else pd.DataFrame(data))


@dataclasses.dataclass
class Feature:
    """A fitted feature: its column, kind ("num" or "cat"), encoding, width of the encoded block and the encoder's numbers."""

    name: str
    kind: str
    encoding: str
    width: int
    state: dict[str, Any]

    @property
    def block(self) -> str:
        """Name of the encoded column."""
        return f"{self.kind}_{self.name}"


@dataclasses.dataclass
class Preprocessor:
    """Parameters, and after ``fit`` the features.

    ``use_decision_tree_bins`` replaces the edges of "binning" and "one_hot" by a tree's (depth 3). ``task`` decides whether trees split on
    the variance or on class counts of the target. Unknown parameters raise, here and in ``set_params``.
    """

    n_bins: int = 50
    numerical_preprocessing: str = "ple"
    categorical_preprocessing: str = "int"
    use_decision_tree_bins: bool = False
    binning_strategy: str = "uniform"
    task: str = "regression"
    cat_cutoff: float | int = 0.03
    treat_all_integers_as_numerical: bool = False
    degree: int = 3
    knots: int = 12
    literals: int = LITERALS
    features: list[Feature] = dataclasses.field(default_factory=list)
    vocabularies: dict[str, DataFrame] = dataclasses.field(default_factory=dict, repr=False)
    row_count: int | None = dataclasses.field(default=None, init=False, repr=False, compare=False)  # of the fit's input, where a job of the fit counts it

    def __post_init__(self) -> None:
        self.numerical_preprocessing, self.categorical_preprocessing = self.numerical_preprocessing.lower(), self.categorical_preprocessing.lower()
        for name, value, allowed in (("numerical_preprocessing", self.numerical_preprocessing, NUMERICAL), ("categorical_preprocessing", self.categorical_preprocessing, CATEGORICAL), ("binning_strategy", self.binning_strategy, STRATEGIES), ("task", self.task, ("regression", "classification"))):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
        for name in ("n_bins", "degree", "knots"):
            if getattr(self, name) < 1 + (name == "knots"):
                raise ValueError(f"{name} is too small: {getattr(self, name)}")

    @classmethod
    def parameters(cls) -> list[str]:
        return [f.name for f in dataclasses.fields(cls) if f.init and f.name not in ("features", "vocabularies")]

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        return {p: getattr(self, p) for p in self.parameters()}

    def set_params(self, **params: Any) -> Preprocessor:
        if unknown := set(params) - set(self.parameters()):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        for k, v in params.items():
            setattr(self, k, v)
        self.__post_init__()
        return self

    def fit(self, df: DataFrame, target: str | None = None, exclude: tuple[str, ...] = ()) -> Preprocessor:
        """Fit to all columns but the target and ``exclude``."""
        num, cat = schema.detect_column_types(df, self.cat_cutoff, self.treat_all_integers_as_numerical, {*exclude, *([target] if target else [])})
        self.row_count = None
        self.features = [*self._fit_numerical(df, num, target), *self._fit_categorical(df, cat)]
        return self

    def _fit_numerical(self, df: DataFrame, num: list[str], target: str | None) -> list[Feature]:
        if not num:
            return []
        kind = self.numerical_preprocessing
        x = {c: schema.missing(c, df.schema[c].dataType).cast("double") for c in num}
        row = df.agg(F.count("*").alias("n"), *(f(x[c]).alias(f"{m}{i}") for i, c in enumerate(num) for m, f in (("count", F.count), ("mean", F.avg), ("var", F.var_pop), ("min", F.min), ("max", F.max)))).first()
        self.row_count = row["n"]
        if empty := [c for i, c in enumerate(num) if not row[f"count{i}"]]:
            raise ValueError(f"columns without a value: {empty}")
        # the mean fills the gaps: it moves neither mean, least nor most, and shrinks the variance by the share of gaps
        base = {c: {"mean": row[f"mean{i}"], "deviation": (row[f"var{i}"] * row[f"count{i}"] / row["n"]) ** 0.5, "min": min(row[f"min{i}"], row[f"mean{i}"]), "max": max(row[f"max{i}"], row[f"mean{i}"])} for i, c in enumerate(num)}
        full = {c: F.coalesce(x[c], F.lit(base[c]["mean"])) for c in num}
        treelike = kind == "ple" or kind in ("binning", "one_hot") and self.use_decision_tree_bins
        cuts: dict[str, list[float]] = {}
        if treelike:
            if target is None:
                raise ValueError(f"{kind} needs a target")
            classes = None
            if self.task == "classification" or isinstance(df.schema[target].dataType, T.BooleanType):
                classes = [r[0] for r in df.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).collect()]  # a row a class
            scaled = {c: encoders.minmax(full[c], base[c]["min"], base[c]["max"]) if kind == "ple" else full[c] for c in num}
            cuts = tree.fit_thresholds(tree.target_tables(df, scaled, F.col(target), classes), **({"max_leaves": self.n_bins} if kind == "ple" else {"max_depth": 3}))
        if kind.startswith("quantile") or kind in ("binning", "one_hot") and self.binning_strategy == "quantile" and not treelike:
            points = min(NOISE_POINTS if kind == "quantile_noise" else self.n_bins, row["n"]) if kind.startswith("quantile") else self.n_bins + 1
            smooth = {c: encoders.quantile_noise(full[c], NOISE, base[c]["deviation"], F.lit(c), *map(F.col, df.columns)) for c in num} if kind == "quantile_noise" else full
            for c, q in tree.quantiles(df, smooth, np.linspace(0, 1, max(points, 2)).tolist()).items():
                base[c]["quantiles"] = q
        if kind in ("binning", "one_hot") and self.binning_strategy == "kmeans" and not treelike:
            tables = tree.target_tables(df, full, F.lit(0.0), max_points=tree.MAX_POINTS).select("feature", F.col("mean").alias("x"), "n").toPandas()  # at most tree.MAX_POINTS a feature
            for c, t in tables.groupby("feature"):
                base[c]["edges"] = encoders.kmeans_edges(t["x"].to_numpy(), t["n"].to_numpy(), self.n_bins)
        out = []
        for c in num:
            s = base[c]
            if kind == "ple":
                s["cuts"] = cuts.get(c, [])
                width = len(s["cuts"]) + 1
            elif kind in ("binning", "one_hot"):
                s["closed"] = "right" if treelike else "left"
                if treelike:
                    s["edges"] = encoders.distinct_edges([s["min"], *cuts.get(c, []), s["max"]])
                elif self.binning_strategy == "quantile":
                    s["edges"] = encoders.distinct_edges(s.pop("quantiles"))
                elif self.binning_strategy == "uniform":
                    s["edges"] = encoders.uniform_edges(s["min"], s["max"], self.n_bins)
                width = len(s["edges"]) - 1 if kind == "one_hot" else 1
            else:
                width = {"polynomial": self.degree, "splines": self.knots + self.degree - 2}.get(kind, 1)
            s |= {"degree": self.degree, "knots": self.knots}
            out.append(Feature(c, "num", kind, width, s))
        return out

    def _fit_categorical(self, df: DataFrame, cat: list[str]) -> list[Feature]:
        if not cat:
            return []
        one_hot = self.categorical_preprocessing != "int"
        values: dict[str, list[tuple[str, int]]] = {c: [] for c in cat}
        counted = schema.category_counts(df, cat).persist()
        try:
            size = {r["feature"]: r["count"] for r in counted.groupBy("feature").count().collect()}  # a row a column
            large = [c for c in cat if size.get(c, 0) > self.literals]
            if large and one_hot:
                raise ValueError(f"one-hot blocks of over {self.literals} categories: {large}")
            for r in counted.where(~F.col("feature").isin(large)).collect():  # at most literals a column
                values[r["feature"]].append((r["value"], r["n"]))
            modes = {r["feature"]: r["m"]["value"] for r in counted.where(F.col("feature").isin(large)).groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).collect()} if large else {}
        finally:
            counted.unpersist()
        n = df.count() if one_hot else 0
        out = []
        for c in cat:
            if c in modes:  # the vocabulary stays a table, which transform joins
                self.vocabularies[c] = encoders.category_table(df, c)
                out.append(Feature(c, "cat", "int", 1, {"fill": modes[c], "categories": None, "size": size[c]}))
                continue
            if not values[c] and not one_hot:
                raise ValueError(f"columns without a value: {[c]}")
            fill = "missing" if one_hot else min(values[c], key=lambda v: (-v[1], v[0]))[0]
            found = {v for v, _ in values[c]} | ({"missing"} if one_hot and sum(k for _, k in values[c]) < n else set())
            out.append(Feature(c, "cat", "one_hot" if one_hot else "int", len(found) + 1 if one_hot else 1, {"fill": fill, "categories": sorted(found)}))
        return out

    def column(self, f: Feature, kind: T.DataType) -> Column:
        """The encoded block of a feature, an array or (ordinal) an integer."""
        s = f.state
        if f.kind == "cat" and s["categories"] is None:
            raise ValueError(f"{f.name} has {s['size']} categories: only transform encodes it, by a join")
        if f.kind == "cat":
            code = encoders.ordinal(F.coalesce(F.col(f.name).cast("string"), F.lit(s["fill"])), s["categories"])
            return encoders.one_hot_ordinal(code, len(s["categories"])) if f.encoding == "one_hot" else code
        x = F.coalesce(schema.missing(f.name, kind).cast("double"), F.lit(s["mean"]))
        if f.encoding == "ple":
            scaled = encoders.minmax(x, s["min"], s["max"])
            return tree.ple(scaled, s["cuts"], 1.0 if s["max"] > s["min"] else 0.0)
        if f.encoding in ("binning", "one_hot"):
            bin_ = encoders.custom_bin(x, s["edges"], clip=True) if s["closed"] == "right" else encoders.k_bin(x, s["edges"])
            return exprs.one_hot(bin_, f.width) if f.encoding == "one_hot" else F.array(bin_.cast("double"))
        if f.encoding == "standardization":
            return F.array(encoders.standardize(x, s["mean"], s["deviation"]))
        if f.encoding == "normalization":
            return F.array(encoders.minmax(x, s["min"], s["max"]))
        if f.encoding in ("quantile", "quantile_normal", "quantile_noise"):
            return F.array(encoders.quantile_map(x, s["quantiles"], f.encoding != "quantile"))
        if f.encoding == "polynomial":
            return encoders.polynomial(x, s["degree"])
        if f.encoding == "splines":
            return encoders.bspline(x, s["min"], s["max"], s["knots"], s["degree"])
        return F.array(x)

    def source(self, f: Feature, kind: T.DataType) -> Column:
        """The number that a feature's block depends on: a category's number, a bin, or x, scaled as the encoding takes it."""
        s = f.state
        if f.kind == "cat":
            return encoders.ordinal(F.coalesce(F.col(f.name).cast("string"), F.lit(s["fill"])), s["categories"]).cast("double")
        x = F.coalesce(schema.missing(f.name, kind).cast("double"), F.lit(s["mean"]))
        if f.encoding == "ple":
            return encoders.minmax(x, s["min"], s["max"])
        if f.encoding in ("binning", "one_hot"):
            return (encoders.custom_bin(x, s["edges"], clip=True) if s["closed"] == "right" else encoders.k_bin(x, s["edges"])).cast("double")
        if f.encoding in ("polynomial", "splines"):
            return x
        return F.get(self.column(f, kind), F.lit(0))

    def rows(self, f: Feature, x: np.ndarray, one_hot: bool = True) -> np.ndarray:
        """A feature's block in numpy, from its ``source``; ``one_hot`` also for categories that are encoded as numbers."""
        s = f.state
        if f.kind == "cat" or f.encoding == "one_hot":
            if f.kind == "cat" and not one_hot:
                return x[:, None]
            return np.eye(len(s["categories"]) + 1 if f.kind == "cat" else f.width)[x.astype(int)]
        if f.encoding == "ple":
            return tree.ple_rows(x, s["cuts"], 1.0 if s["max"] > s["min"] else 0.0)
        if f.encoding == "polynomial":
            return x[:, None] ** np.arange(1, s["degree"] + 1)
        if f.encoding == "splines":
            return encoders.bspline_rows(x, s["min"], s["max"], s["knots"], s["degree"])
        return x[:, None]

    def effect(self, f: Feature, kind: T.DataType, weights: list[float]) -> Column:
        """A feature's block times weights, without making the block where the encoding allows it."""
        s, x = f.state, self.source(f, kind)
        if f.kind == "cat" or f.encoding == "one_hot":
            return F.get(F.array(*map(F.lit, weights)), x.cast("int"))
        if f.encoding == "ple":
            return tree.ple_effect(x, s["cuts"], 1.0 if s["max"] > s["min"] else 0.0, weights)
        if f.encoding == "polynomial":
            total = F.lit(0.0)
            for w in reversed(weights):
                total = (total + w) * x
            return total
        if f.encoding == "splines":
            return exprs.dot(self.column(f, kind), F.array(*map(F.lit, weights)))
        return x * weights[0]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """``keep`` and one column a feature, numerical ones first: ``num_<name>`` arrays and ``cat_<name>`` integers or arrays. No job runs."""
        if not self.features:
            raise RuntimeError("fit comes before transform")
        kinds = {f.name: df.schema[f.name].dataType for f in self.features}
        for c, vocabulary in self.vocabularies.items():
            fill = next(f.state["fill"] for f in self.features if f.name == c)
            df = encoders.ordinal_join(df.withColumn(f"_text_{c}", F.coalesce(F.col(c).cast("string"), F.lit(fill))), f"_text_{c}", vocabulary, f"_code_{c}")
        return df.select(*keep, *((F.col(f"_code_{f.name}").cast("int") if f.name in self.vocabularies else self.column(f, kinds[f.name])).alias(f.block) for f in self.features))

    def fit_transform(self, df: DataFrame, target: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        return self.fit(df, target, keep).transform(df, (*keep, *([target] if target else [])))

    def feature_info(self, spark: SparkSession) -> DataFrame:
        """(feature, kind, encoding, dimension, unique_vals) of the fitted features."""
        rows = [(f.name, f.kind, f.encoding, f.width, (f.state["size"] if f.state["categories"] is None else len(f.state["categories"])) + 1 if f.kind == "cat" else None) for f in self.features]
        return spark.createDataFrame(rows, "feature string, kind string, encoding string, dimension int, unique_vals int")

    def input_width(self) -> int:
        """The number of columns that all blocks make together."""
        return sum(f.width for f in self.features)

    def to_json(self) -> str:
        if self.vocabularies:
            raise ValueError(f"vocabularies of {sorted(self.vocabularies)} are tables: write those of ``vocabularies`` too")
        return json.dumps({**self.get_params(), "features": [dataclasses.asdict(f) for f in self.features]})

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        got = json.loads(text)
        return cls(**{**got, "features": [Feature(**f) for f in got["features"]]})
