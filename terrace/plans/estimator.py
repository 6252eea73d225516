"""Estimators: a preprocessor, a shape and a task in one object, with fit, predict, evaluate and saved state.

``Regressor``, ``Classifier`` and ``Lss`` take the name of a shape: linreg, snam (splines), gpnam (Gaussian process), boosted, nodegam (tabulated GA2M),
or a neural one: nam, qnam, nbm, natt, namformer, nodegam_soft, spline (learned knots), oblique (hard oblique trees), or one that ``register_shape`` was given. Parameters of the preprocessor and of the shape are keywords and told apart by name.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from terrace.functions import exprs
from terrace.operators import effects, families, metrics, schema
from terrace.plans.additive import AdditiveModel
from terrace.plans.boosted import BoostedFamily, OneVsRest, TabulatedGam
from terrace.plans.layers import REGISTRY, Shape
from terrace.plans.neural import KINDS, NeuralModel
from terrace.plans.preprocess import Preprocessor
from terrace.sources.shared import removed, written

SHAPES: dict[str, tuple[type, dict[str, Any]]] = {
    "linreg": (AdditiveModel, {"shape": "linear"}), "snam": (AdditiveModel, {"shape": "spline"}), "gpnam": (AdditiveModel, {"shape": "gp", "ridge": 1e-3}),
    "boosted": (TabulatedGam, {"n_estimators": 64, "depth": 3}), "nodegam": (TabulatedGam, {"n_estimators": 200, "depth": 3, "pairs": 10}),
    "nam": (NeuralModel, {"kind": "nam"}), "qnam": (NeuralModel, {"kind": "qnam"}), "nbm": (NeuralModel, {"kind": "nbm"}), "natt": (NeuralModel, {"kind": "natt"}),
    "namformer": (NeuralModel, {"kind": "namformer"}), "nodegam_soft": (NeuralModel, {"kind": "nodegam"}), "spline": (NeuralModel, {"kind": "spline"}), "oblique": (NeuralModel, {"kind": "trees", "num_trees": 64, "depth": 8}),
}
#: What shrinks effects of columns of many categories, as so many rows of effect 0; rounds of fits beside them at most.
WIDE_RIDGE, WIDE_ROUNDS = 1.0, 12


def register_shape(name: str, shape: Shape, **defaults: Any) -> None:
    """Makes a shape function of one's own known by ``name`` to all three tasks; ``defaults`` are parameters of ``NeuralModel``. To load a saved model the shape has to be registered again."""
    if name in KINDS:
        raise ValueError(f"{name!r} is a shape already")
    REGISTRY[name] = shape
    SHAPES[name] = (NeuralModel, {"kind": name, **defaults})


class Estimator:
    """What the three tasks share."""

    task = "regression"

    def __init__(self, shape: str = "linreg", **params: Any) -> None:
        if shape not in SHAPES:
            raise ValueError(f"shape must be one of {', '.join(SHAPES)}, not {shape!r}")
        self.shape, self.norm_fn = shape, params.pop("norm_fn", None)
        self._model_type, self._model_params = SHAPES[shape][0], dict(SHAPES[shape][1])
        task = "classification" if self.task == "classification" else "regression"
        default = {"linreg": "standardization", "snam": "normalization", "gpnam": "normalization", "spline": "normalization"}.get(shape, "standardization" if self._model_type is NeuralModel else "none")
        self._pre_params = {"numerical_preprocessing": default, "task": task}
        self.set_params(**params)

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        return {"shape": self.shape, **self._pre_params, **self._model_params}

    def set_params(self, **params: Any) -> Estimator:
        own = {f.name for f in dataclasses.fields(self._model_type)}
        for k, v in params.items():
            if k in own and not (k in Preprocessor.parameters() and self._model_type is AdditiveModel and k != "knots"):
                self._model_params[k] = v
            elif k in Preprocessor.parameters():
                self._pre_params[k] = v
            else:
                raise ValueError(f"unknown parameter {k!r} of {self.shape}")
        return self

    def _family(self) -> families.Family | None:
        return None

    def fit(self, df: DataFrame, target: str, validation: DataFrame | None = None, val_size: float = 0.2, random_state: int = 101, keys: list[str] | None = None, fit_on: str = "train", exclude: tuple[str, ...] = ()) -> Estimator:
        """Without ``validation`` a hash of ``keys`` (or of all columns) sets ``val_size`` of the rows aside where the shape needs them. ``fit_on="all"`` fits the preprocessor to both parts."""
        df, validation = self._normed(df), None if validation is None else self._normed(validation)
        self.target, self._validation = target, validation
        if validation is not None or self._model_type is not NeuralModel or not val_size:
            return self._fitted(df, validation, target, fit_on, exclude)
        marked = df.withColumn("_held", schema.held_out(keys or df.columns, val_size, random_state)).persist(StorageLevel.MEMORY_AND_DISK)  # hashed once, not in every job of the fit
        try:
            return self._fitted(*(marked.where(part).drop("_held") for part in (~F.col("_held"), F.col("_held"))), target, fit_on, exclude)
        finally:
            marked.unpersist()

    def _fitted(self, train: DataFrame, val: DataFrame | None, target: str, fit_on: str, exclude: tuple[str, ...]) -> Estimator:
        self.pre = Preprocessor(**self._pre_params)
        self._prepare(train)
        base = train.unionByName(val) if fit_on == "all" and val is not None else train
        if self._model_type is TabulatedGam:
            num, cat = schema.detect_column_types(base, self.pre.cat_cutoff, self.pre.treat_all_integers_as_numerical, {target, *exclude})
            loss = "logistic" if self.task == "classification" else "squared"
            if self.task == "lss":
                self.model = BoostedFamily(self._model_params, self._family()).fit(self._coded(train), "_y", num, cat)
                return self
            if self.task == "classification" and len(self.classes) > 2:
                coded = self._coded(train)
                fits = [TabulatedGam(**{**self._model_params, "loss": loss}).fit(coded.withColumn("_y", (F.col("_y") == k).cast("double")), "_y", num, cat) for k in range(len(self.classes))]
                self.model = OneVsRest(fits)
                return self
            self.model = TabulatedGam(**{**self._model_params, "loss": loss}).fit(self._coded(train), "_y", num, cat)
            return self
        self.pre.fit(base, target, exclude)
        self.model, self.wide, self.shift = self._model_type(**self._model_params), {}, {}
        wide = [f.name for f in self.pre.features if f.kind == "cat" and f.state["categories"] is None]
        if wide:
            if self.task != "regression":
                raise ValueError(f"columns of over {self.pre.literals} categories are fitted by squared error and by boosted shapes only: {wide}")
            self.pre.features = [f for f in self.pre.features if f.name not in wide]
            self.pre.vocabularies = {c: v for c, v in self.pre.vocabularies.items() if c not in wide}
            self._backfit(train, val, wide)
            return self
        if self._model_type is AdditiveModel:
            self.model.fit(self._coded(train), "_y", self.pre, self._family())
            return self
        enc = self.pre.transform(self._coded(train), ("_y",))
        extra = {"validation": self.pre.transform(self._coded(val), ("_y",))} if val is not None else {}
        self.model.fit(enc, "_y", self.pre, self._family(), size=self.pre.row_count if base is train else None, **extra)
        return self

    def _backfit(self, train: DataFrame, val: DataFrame | None, wide: list[str]) -> None:
        """Columns whose categories are too many for blocks have a table of effects each: the shape is fitted to what the tables leave, then each table to what everything else leaves (sums by category, shrunk by
        ``WIDE_RIDGE``, which for a given rest is the least-squares solution with that ridge), until the squared error settles."""
        if not self.pre.features:
            raise ValueError("a fit needs a feature beside the columns of many categories")
        error = float("inf")
        for k in range(WIDE_ROUNDS):
            left = self._joined(self._coded(train)).withColumn("_y", F.col("_y") - F.col("_wide"))
            if self._model_type is AdditiveModel:
                self.model.fit(left, "_y", self.pre, None)
            else:
                after = self._joined(self._coded(val)).withColumn("_y", F.col("_y") - F.col("_wide")) if val is not None else None
                extra = {"validation": self.pre.transform(after, ("_y",))} if after is not None else {}
                self.model.fit(self.pre.transform(left, ("_y",)), "_y", self.pre, None, go_on=k > 0, **extra)
            for c in wide:
                found = self._scored(self._coded(train))
                rest = F.col("_y") - (F.col("output") - F.col(f"f_{c}") - self.shift[c] if c in self.wide else F.col("output"))
                sums = found.where(F.col(c).isNotNull() & F.col("_y").isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.sum(rest).alias("s"))
                sums = written(sums, "sums")
                share = F.col("n") / (F.col("n") + WIDE_RIDGE)
                mean = sums.agg(F.sum(F.col("s") / (F.col("n") + WIDE_RIDGE)) / F.sum(share)).first()[0] or 0.0  # so effects sum to nothing, as they do at the solution
                old, self.wide[c] = self.wide.get(c), written(sums.select("value", "n", (F.col("s") / (F.col("n") + WIDE_RIDGE) - mean * share).alias("effect")), "effects")
                self.shift[c] = float(mean)
                removed(sums, *([old] if old is not None else []))
            was, error = error, self._scored(self._coded(train)).agg(F.avg((F.col("_y") - F.col("output")) ** 2)).first()[0] or 0.0
            if k and was - error <= 1e-7 * was:
                return

    def _joined(self, df: DataFrame) -> DataFrame:
        """Adds ``f_<column>`` of the columns of many categories (0 for one that is not known) and ``_wide``, their sum and what they have in common."""
        for c, table in self.wide.items():
            own = table.select(F.col("value").alias("_value"), F.col("effect").alias(f"f_{c}"))
            df = df.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value").fillna(0.0, subset=[f"f_{c}"])
        return df.withColumn("_wide", sum((F.col(f"f_{c}") for c in self.wide), F.lit(sum(self.shift.values()))))

    def _prepare(self, df: DataFrame) -> None:
        pass

    def _normed(self, df: DataFrame) -> DataFrame:
        """``df`` as ``norm_fn`` makes it: the hook that fit, scores and effects share."""
        return df.transform(self.norm_fn) if self.norm_fn else df

    def _coded(self, df: DataFrame) -> DataFrame:
        """``df`` with the target as the model sees it."""
        return df.withColumn("_y", F.col(self.target).cast("double"))

    def contributions(self, df: DataFrame) -> DataFrame:
        """``df`` with ``f_<term>``, ``output`` and ``raw``."""
        return self._scored(self._normed(df))

    def _scored(self, df: DataFrame) -> DataFrame:
        if getattr(self, "wide", None):
            found = self._shaped(self._joined(df))
            return found.withColumns({"output": F.col("output") + F.col("_wide"), "raw": F.transform("raw", lambda v: v + F.col("_wide"))}).drop("_wide")
        return self._shaped(df)

    def _shaped(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, OneVsRest | BoostedFamily):
            return self.model.transform(df)
        if self._model_type is TabulatedGam:
            return self.model.transform(df).withColumn("raw", F.array("output"))
        if self._model_type is AdditiveModel:
            return self.model.transform(df, self.pre)
        blocks = [f.block for f in self.pre.features]
        enc = df.withColumns({f.block: self.pre.column(f, df.schema[f.name].dataType) for f in self.pre.features})
        return self.model.transform(enc, self.pre, blocks) if isinstance(self.model, NeuralModel) else self.model.transform(enc, self.pre).drop(*blocks)

    def evaluate(self, df: DataFrame, metric: dict[str, Callable[..., Column]] | None = None) -> dict[str, float]:
        """All metrics in one job; a metric takes the target and the prediction's Columns to an aggregate."""
        found = self.predict(df)
        use = metric or self._metrics()
        args = self._metric_arguments()
        return metrics.evaluate(found, {k: f(*args) for k, f in use.items()}).first().asDict()

    def effect_table(self, df: DataFrame, **options: Any):
        """Effects of all terms of one or two numerical features; see ``effects.effect_table``."""
        found = self.contributions(df)
        terms = [c[2:] for c in found.columns if c.startswith("f_")]
        singles, doubles = [t for t in terms if ":" not in t and t in df.columns], [t for t in terms if t.count(":") == 1]
        names = list(dict.fromkeys([*singles, *(n for t in doubles for n in t.split(":"))]))
        intercept = self.model.intercept if self._model_type is TabulatedGam or isinstance(self.model, OneVsRest | BoostedFamily) else float(self.model.coefficients[0, 0]) if self._model_type is AdditiveModel else float(self.model.params["intercept"][0])
        return effects.effect_table(found, names, {t: F.col(f"`f_{t}`") for t in singles}, {t: F.col(f"`f_{t}`") for t in doubles}, intercept, **options)

    def plot_data(self, df: DataFrame, column: str, bins: int = 30) -> tuple[DataFrame, DataFrame]:
        """(x, y) by distinct value, centred, and (bin, n, shade): what a plot of an effect shows."""
        found = self.contributions(df)
        table = effects.centred(effects.main_effects(found, {column: (F.col(column), F.col(f"`f_{column}`"))}))
        row = df.agg(F.min(column), F.max(column)).first()
        return table.select("x", "y", "n"), effects.density(df, column, float(row[0]), float(row[1]), bins)


class Regressor(Estimator):
    """Squared error."""

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        return self.contributions(df).withColumn("prediction", F.col("output"))

    def _metrics(self) -> dict[str, Callable[..., Column]]:
        return {"mse": metrics.mse}

    def _metric_arguments(self) -> list[Column]:
        return [F.col(self.target).cast("double"), F.col("prediction")]


class Classifier(Estimator):
    """Two classes by the logistic loss, more by softmax."""

    task = "classification"

    def _prepare(self, df: DataFrame) -> None:
        self.classes = [r[0] for r in df.select(self.target).where(F.col(self.target).isNotNull()).distinct().orderBy(self.target).collect()]  # a row a class
        if len(self.classes) < 2:
            raise ValueError("a classifier needs two classes")

    def _family(self) -> families.Family:
        return families.by_name("bernoulli") if len(self.classes) == 2 else families.by_name("categorical", classes=len(self.classes))

    def _coded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_y", (F.array_position(F.array(*map(F.lit, self.classes)), F.col(self.target)) - 1).cast("double"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities``, one a class in order; models of one class each are scaled to sum to 1."""
        one = exprs.sigmoid(F.col("output"))
        if isinstance(self.model, OneVsRest):
            own = F.transform("raw", exprs.sigmoid)
            return self.contributions(df).withColumn("probabilities", F.transform(own, lambda v: v / F.aggregate(own, F.lit(0.0), lambda a, b: a + b)))
        p = F.array(1 - one, one) if len(self.classes) == 2 else exprs.softmax(F.col("raw"))
        return self.contributions(df).withColumn("probabilities", p)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities`` and ``prediction``, the likeliest class."""
        found = self.predict_proba(df)
        at = F.when(F.get("probabilities", F.lit(1)) > 0.5, 1).otherwise(0) if len(self.classes) == 2 else exprs.argmax(F.col("probabilities"))
        return found.withColumn("prediction", F.get(F.array(*map(F.lit, self.classes)), at))

    def _metrics(self) -> dict[str, Callable[..., Column]]:
        return {"accuracy": lambda y, p, _: metrics.accuracy(y, p)}

    def _metric_arguments(self) -> list[Column]:
        return [F.col(self.target), F.col("prediction"), F.col("probabilities")]


class Lss(Estimator):
    """All parameters of a distribution family."""

    task = "lss"

    def __init__(self, shape: str = "linreg", family: str | families.Family = "normal", family_options: dict[str, Any] | None = None, **params: Any) -> None:
        self.family = family if isinstance(family, families.Family) else families.by_name(family, **(family_options or {}))
        super().__init__(shape, **params)

    def _family(self) -> families.Family:
        return self.family

    def predict(self, df: DataFrame, raw: bool = False) -> DataFrame:
        """``df`` with a column a parameter, or raw outputs under the same names."""
        found = self.contributions(df)
        outputs = [F.get("raw", F.lit(i)) for i in range(self.family.size)]
        named = [c.alias(p) for c, p in zip(outputs, self.family.parameters, strict=True)] if raw else self.family.transformed(outputs)
        return found.select("*", *named)

    def _metrics(self) -> dict[str, Callable[..., Column]]:
        return {"nll": lambda y, *p: F.avg(self.family.nll(y, list(p))), **metrics.DEFAULTS.get(self.family.name, {})}

    def _metric_arguments(self) -> list[Column]:
        return [F.col(self.target).cast("double"), *(F.col(p) for p in self.family.parameters)]


def _named(name: str, base: type[Estimator], shape: str, **fixed: Any) -> type[Estimator]:
    def init(self, **params: Any) -> None:
        base.__init__(self, shape, **{**fixed, **params})

    return type(name, (base,), {"__init__": init, "__doc__": f"{base.__name__} with the shape {shape}."})


_TITLES = {"NAM": "nam", "LinReg": "linreg", "GPNAM": "gpnam", "NBM": "nbm", "NATT": "natt", "NAMformer": "namformer", "NodeGAM": "nodegam"}
#: Estimators by public name.
ESTIMATORS: dict[str, type[Estimator]] = {
    f"{t}{suffix}": _named(f"{t}{suffix}", base, "nodegam_soft" if s == "nodegam" and suffix == "LSS" else s) for t, s in _TITLES.items() for suffix, base in (("Regressor", Regressor), ("Classifier", Classifier), ("LSS", Lss))
} | {
    "QNAM": _named("QNAM", Lss, "qnam", family="quantile"), "SNAMRegressor": _named("SNAMRegressor", Regressor, "snam"), "TreeNAMLSS": _named("TreeNAMLSS", Lss, "boosted"), "TreeNAMRegressor": _named("TreeNAMRegressor", Regressor, "boosted"),
}
globals().update(ESTIMATORS)
