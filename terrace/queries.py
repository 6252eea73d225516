"""Queries over the reference tables, one or more an operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions import exprs, special
from terrace.operators import effects, encoders, families, metrics, mrf, schema, splines, thinplate, tree
from terrace.operators.gram import sufficient_stats
from terrace.operators.rff import RandomFeatures
from terrace.plans.boosted import TabulatedGam
from terrace.plans.estimator import ESTIMATORS, Regressor
from terrace.plans.gam import Gam
from terrace.plans.region import RegionGam
from terrace.plans.smooths import Plate, Region
from terrace.plans.preprocess import Preprocessor
from terrace.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FEATURES = ("l_quantity", "l_discount", "l_tax")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column) -> Column:
    """Six digits; what is left of a rounding error around 0 goes."""
    return F.round(c, 6) + F.lit(0.0)


def _long(df: DataFrame, keys: list[str], v: Column) -> DataFrame:
    """A vector as (keys, pos, value) rows."""
    return df.select(*keys, F.posexplode(v).alias("pos", "value")).select(*keys, F.col("pos").cast("long").alias("pos"), r6(F.col("value")).alias("value"))


# ---- types, imputation, splits


@query
def infer_feature_types(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    num, cat = schema.detect_column_types(df)
    kind = {**dict.fromkeys(num, "numerical"), **dict.fromkeys(cat, "categorical")}
    return spark.createDataFrame([(c, kind[c]) for c in df.columns], "feature string, kind string")


@query
def feature_info(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    return Preprocessor(numerical_preprocessing="normalization").fit(df).feature_info(spark)


@query
def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") != 10, F.col("l_quantity")).alias("l_quantity"))
    return schema.impute_mean(df, ["l_quantity"]).select("l_orderkey", r6(F.col("l_quantity")).alias("l_quantity"))


@query
def impute_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return schema.impute_most_frequent(df, ["o_orderstatus"])


@query
def impute_constant(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"))
    return schema.impute_constant(df, ["o_orderstatus"])


@query
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    train, val = schema.train_validation_split(table(spark, d, "orders"), ["o_orderkey"])
    both = train.select(F.lit("train").alias("part"), "o_orderkey").unionByName(val.select(F.lit("validation").alias("part"), "o_orderkey"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query
def union_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Train and validation put together again hold every value that the whole holds."""
    train, val = schema.train_validation_split(table(spark, d, "orders"), ["o_orderkey"])
    return train.unionByName(val).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


@query
def class_logodds_bias(spark: SparkSession, d: str) -> DataFrame:
    return schema.class_log_odds(table(spark, d, "labels"), "toxic").select("toxic", "n", r6(F.col("bias")).alias("bias"))


# ---- numerical encodings


def _moments(df: DataFrame, c: str):
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()


@query
def standardize(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    m = _moments(df, "l_extendedprice")
    return df.select("l_orderkey", r6(encoders.standardize(F.col("l_extendedprice"), m["mean"], m["sd"])).alias("z"))


@query
def minmax(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    m = _moments(df, "l_extendedprice")
    return df.select("l_orderkey", r6(encoders.minmax(F.col("l_extendedprice"), m["lo"], m["hi"])).alias("u"))


@query
def bins_uniform(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    edges = [1000.0 * k for k in range(0, 601, 12)]
    return df.groupBy(encoders.k_bin(F.col("o_totalprice"), edges).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def bins_quantile(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders")
    edges = encoders.distinct_edges(tree.quantiles(df, {"x": F.col("o_totalprice")}, [k / 10 for k in range(11)])["x"])
    return df.groupBy(encoders.k_bin(F.col("o_totalprice"), edges).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def bins_kmeans(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_retailprice")
    pre = Preprocessor(n_bins=8, numerical_preprocessing="binning", binning_strategy="kmeans").fit(df)
    return pre.transform(df).groupBy(F.col("num_p_retailprice")[0].cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def bins_custom_right_closed(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return df.groupBy(encoders.custom_bin(F.col("l_quantity"), [5.0, 10.0, 20.0, 40.0]).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def bins_onehot(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(exprs.one_hot(encoders.k_bin(F.col("l_quantity"), [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]), 5).alias("v"))
    return _long(df, [], F.col("v")).groupBy("pos").agg(F.sum("value").cast("long").alias("n"))


@query
def quantile_uniform(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    q = tree.quantiles(df, {"x": F.col("c_acctbal")}, [k / 20 for k in range(21)])["x"]
    return df.select("c_custkey", r6(encoders.quantile_map(F.col("c_acctbal"), q)).alias("u"))


@query
def quantile_normal(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    q = tree.quantiles(df, {"x": F.col("c_acctbal")}, [k / 20 for k in range(21)])["x"]
    return df.select("c_custkey", r6(encoders.quantile_map(F.col("c_acctbal"), q, normal=True)).alias("z"))


@query
def polynomial(spark: SparkSession, d: str) -> DataFrame:
    return _long(table(spark, d, "part"), ["p_partkey"], encoders.polynomial(F.col("p_retailprice") / 1000, 3))


@query
def bspline_basis(spark: SparkSession, d: str) -> DataFrame:
    return _long(table(spark, d, "part"), ["p_partkey"], encoders.bspline(F.col("p_size"), 1.0, 50.0, 5, 2, last=True))


@query
def bspline_unity(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the default B-spline basis sum to 1."""
    v = encoders.bspline(F.col("p_size"), 1.0, 50.0, 12, 3, last=True)
    return table(spark, d, "part").select(F.round(exprs.total(v), 9).alias("total"), F.size(v).cast("long").alias("width")).groupBy("total", "width").agg(F.count("*").alias("n"))


@query
def cubic_basis(spark: SparkSession, d: str) -> DataFrame:
    s = splines.CubicSpline(np.array([1.0, 20.0, 50.0]))
    return _long(table(spark, d, "part"), ["p_partkey"], s.column(F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 30.0).otherwise(0.0)))


@query
def cubic_unity(spark: SparkSession, d: str) -> DataFrame:
    s = splines.CubicSpline.over(1.0, 50.0, 12)
    return table(spark, d, "part").select(F.round(exprs.total(s.column(F.col("p_size"))), 9).alias("total")).groupBy("total").agg(F.count("*").alias("n"))


@query
def thin_plate_basis(spark: SparkSession, d: str) -> DataFrame:
    """Absolute basis sums of a bivariate thin-plate basis (signs of eigenvectors are free)."""
    df = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10_000).alias("x"), (F.col("s_nationkey") / 25.0).alias("y"))
    s = thinplate.fit(df, ["x", "y"], 6, 2)
    return _long(thinplate.at_rows(s, df, ["x", "y"], "basis"), ["s_suppkey"], F.transform("basis", F.abs))


@query
def rff_features(spark: SparkSession, d: str) -> DataFrame:
    f = RandomFeatures(np.array([0.5, -1.25, 2.0]), np.array([0.1, 1.5, 3.0]), 0.2)
    return _long(table(spark, d, "part"), ["p_partkey"], f.column(F.col("p_size") / 50.0))


# ---- trees and piecewise linear encoding


@query
def stump_split(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    cuts = tree.fit_thresholds(tree.target_tables(df, {"l_quantity": F.col("l_quantity")}, F.col("l_extendedprice")), max_depth=1)
    return spark.createDataFrame([(f, float(t)) for f, ts in cuts.items() for t in ts], "feature string, threshold double")


@query
def tree_bins_depth3(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    cuts = tree.fit_thresholds(tree.target_tables(df, {c: F.col(c) for c in FEATURES}, F.col("l_extendedprice")), max_depth=3)
    return spark.createDataFrame([(f, i, round(t, 6)) for f, ts in cuts.items() for i, t in enumerate(ts)], "feature string, i long, threshold double")


@query
def tree_bins_classes(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    cuts = tree.fit_thresholds(tree.target_tables(df, {"n_chars": F.col("n_chars")}, F.col("quality"), classes=[0, 1]), max_depth=1)
    return spark.createDataFrame([(f, float(t)) for f, ts in cuts.items() for t in ts], "feature string, threshold double")


@query
def ple_fit(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(*FEATURES, "l_extendedprice")
    pre = Preprocessor(n_bins=8, cat_cutoff=2).fit(df, "l_extendedprice")
    return spark.createDataFrame([(f.name, i, round(t, 6)) for f in pre.features for i, t in enumerate(f.state["cuts"])], "feature string, i long, threshold double")


@query
def ple_encode(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("l_quantity") - 1) / 49
    v = tree.ple(x, [0.2, 0.5, 0.9], 1.0)
    return _long(table(spark, d, "lineitem"), ["l_orderkey"], v)


# ---- categories


@query
def cat_ordinal(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return encoders.ordinal_join(df.select("doc_id", "source"), "source", encoders.category_table(df, "source"), "code").select("doc_id", F.col("code").cast("long").alias("code"))


@query
def cat_ordinal_unknown(spark: SparkSession, d: str) -> DataFrame:
    code = encoders.ordinal(F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")), ["A", "R"])
    return table(spark, d, "lineitem").groupBy(code.cast("long").alias("code")).agg(F.count("*").alias("n"))


@query
def cat_onehot(spark: SparkSession, d: str) -> DataFrame:
    v = encoders.one_hot_ordinal(encoders.ordinal(F.col("l_returnflag"), ["A", "N"]), 2)
    return _long(table(spark, d, "lineitem"), [], v).groupBy("pos").agg(F.sum("value").cast("long").alias("n"))


@query
def preprocess_block_sums(spark: SparkSession, d: str) -> DataFrame:
    """Block sums of a whole preprocessor: normalised numbers and one-hot categories."""
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag")
    pre = Preprocessor(numerical_preprocessing="normalization", categorical_preprocessing="one_hot").fit(df)
    enc = pre.transform(df)
    rows = F.array(*(F.struct(F.lit(f.block).alias("block"), F.col(f.block).alias("v")) for f in pre.features))
    long = enc.select(F.explode(rows).alias("b")).select("b.block", F.posexplode("b.v").alias("pos", "value"))
    return long.groupBy("block", F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum("value"), 3).alias("total"))


# ---- linear models


@query
def gram_sufficient_stats(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(*FEATURES, (F.col("l_extendedprice") / 1e5).alias("y"))
    return sufficient_stats(df, list(FEATURES), "y").select("name", F.round("value", 3).alias("value"))


@query
def linreg_fit_1d(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    m = Regressor("linreg", numerical_preprocessing="none", cat_cutoff=2, ridge=0.0).fit(df, "l_extendedprice").model
    return spark.createDataFrame([("intercept", round(float(m.coefficients[0, 0]), 4)), ("slope", round(float(m.coefficients[0, 1]), 4))], "name string, value double")


@query
def linreg_mse(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1e4).alias("y"))
    e = Regressor("linreg", numerical_preprocessing="none", cat_cutoff=2, ridge=0.0).fit(df, "y")
    return e.predict(df).agg(F.round(metrics.mse(F.col("y"), F.col("prediction")), 5).alias("mse"))


def _gam(spark: SparkSession, d: str) -> Gam:
    return Gam(["l_quantity", "l_discount"], k=8).fit(table(spark, d, "lineitem"), "l_extendedprice")


@query
def gam_fit(spark: SparkSession, d: str) -> DataFrame:
    return _gam(spark, d).coefficients(spark)


@query
def gam_summary(spark: SparkSession, d: str) -> DataFrame:
    return _gam(spark, d).summary(spark)


@query
def gam_gcv(spark: SparkSession, d: str) -> DataFrame:
    g = _gam(spark, d)
    return spark.createDataFrame([(float(lam), g.gcv([lam, lam])) for lam in (1e-3, 1.0, 1e3)], "lambda double, gcv double")


@query
def gam_wald(spark: SparkSession, d: str) -> DataFrame:
    g = _gam(spark, d)
    return spark.createDataFrame([(c, *g.wald_test(j)) for j, c in enumerate(g.columns)], "term string, wald double, p_value double")


@query
def gam_predict(spark: SparkSession, d: str) -> DataFrame:
    return _gam(spark, d).transform(table(spark, d, "lineitem")).agg(F.round(F.avg("output"), 4).alias("mean"))


@query
def gam_moments(spark: SparkSession, d: str) -> DataFrame:
    """What a penalty leaves free, constants and linear functions of each column, a fit has to meet: moments of the fitted values are those of the target."""
    out = _gam(spark, d).transform(table(spark, d, "lineitem"))
    return out.agg(*(F.round(F.avg(F.col("output") * F.col(c)), 3).alias(f"by_{c}") for c in ("l_quantity", "l_discount")))


def settled(c: Column) -> Column:
    """Five digits of what a fit tells to about 1e-10: its noise goes first, so a tie is rounded as the tie that it is."""
    return F.round(F.round(c, 8), 5)


@query
def gam_thin_plate(spark: SparkSession, d: str) -> DataFrame:
    """A thin plate of two columns beside a spline: moments of the fitted values by what the plate leaves free."""
    df = table(spark, d, "supplier").select((F.col("s_acctbal") / 10_000).alias("x"), (F.col("s_nationkey") / 25.0).alias("y"), (F.col("s_suppkey") % 13).cast("double").alias("w"), (F.col("s_suppkey") % 7 + F.col("s_acctbal") / 1000).alias("t"))
    out = Gam([Plate(["x", "y"], 8), "w"], k=5).fit(df, "t").transform(df)
    return out.agg(settled(F.avg("output")).alias("mean"), *(settled(F.avg(F.col("output") * F.col(c))).alias(f"by_{c}") for c in "xyw"))


@query
def gam_regions(spark: SparkSession, d: str) -> DataFrame:
    """Nations as neighbouring regions: n times the fitted value plus what the neighbours' penalty adds is the region's sum of the target, which holds for no other effects."""
    df = table(spark, d, "customer").select(F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("y"))
    g = RegionGam(Region("region", mrf.neighbours(_polygons(spark, d)))).fit(df, "y", 50.0)
    weight = g.region_lambda * g.scale
    met = g.effects.join(g.laplacian_effects(), "region")
    return met.select("region", F.col("n").cast("long").alias("n"), F.round(F.col("n") * (F.col("effect") + g.intercept) + weight * F.col("rough"), 2).alias("total"))


# ---- classification


def _logit(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.withColumn("p", exprs.sigmoid(0.5 + F.col("n_chars") / 10_000))


@query
def logit_score(spark: SparkSession, d: str) -> DataFrame:
    return _logit(spark, d).select("doc_id", r6(F.col("p")).alias("p"), (F.col("p") > 0.7).cast("int").alias("predicted"))


@query
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _logit(spark, d).agg(r6(metrics.accuracy(F.col("quality"), (F.col("p") > 0.7).cast("int"))).alias("accuracy"), r6(metrics.precision(F.col("quality"), (F.col("p") > 0.7).cast("int"))).alias("precision"))


@query
def auroc_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(_logit(spark, d), "quality", "p").select(r6(F.col("auroc")).alias("auroc"))


@query
def brier(spark: SparkSession, d: str) -> DataFrame:
    return _logit(spark, d).agg(r6(metrics.brier(F.col("quality"), F.col("p"))).alias("brier"))


# ---- losses and metrics


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Targets and parameters that all families accept."""
    return table(spark, d, "orders").select((F.col("o_totalprice") / 1e5 + 0.01).alias("y"), (F.col("o_custkey") % 7 / 2.0 + 0.5).alias("a"), (F.col("o_orderkey") % 5 / 4.0 + 0.75).alias("b"), (F.col("o_orderkey") % 9).cast("double").alias("k"))


def _nll(name: str, y: str, *parameters: str | float) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        y_col = F.col("y") / 10 if y == "unit" else F.col(y)
        values = [F.col(p) if isinstance(p, str) else F.lit(p) for p in parameters]
        return _orders(spark, d).agg(F.round(F.avg(families.by_name(name).nll(y_col, values)), 6).alias("nll"))

    QUERIES[f"nll_{name}"] = fn


for _name, _y, _parameters in (
    ("normal", "y", ("a", "b")), ("poisson", "k", ("a",)), ("gamma", "y", ("a", "b")), ("inversegamma", "y", ("a", "b")), ("beta", "unit", ("a", "b")), ("negativebinom", "k", ("a", "b")), ("robustnormal", "y", ("a", "b")),
    ("studentt", "y", (3.5, "a", "b")),
):
    _nll(_name, _y, *_parameters)


@query
def nll_categorical(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("z"))
    return df.agg(r6(F.avg(families.categorical_nll(F.col("label"), F.col("z")))).alias("nll"))


@query
def nll_dirichlet(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d).select(F.array(F.col("b") / 4, 0.5 - F.col("b") / 8, 0.5 - F.col("b") / 8).alias("y"), F.array("a", "b", F.lit(1.5)).alias("c"))
    return df.agg(r6(F.avg(families.dirichlet_nll(F.col("y"), F.col("c")))).alias("nll"))


@query
def pinball_loss(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).agg(r6(F.avg(families.pinball(F.col("y"), F.array("a", F.col("a") + 1, F.col("a") + 2), [0.25, 0.5, 0.75]))).alias("loss"))


@query
def monotone_quantiles(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e4).alias("y"), (F.col("o_custkey") % 3 - 1.0).alias("u"), (F.col("o_custkey") % 4 / 4.0 - 0.5).alias("w"))
    return _long(df, ["o_orderkey"], exprs.increasing(F.array("y", "u", "w")))


@query
def link_functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal") / 1000
    return table(spark, d, "supplier").select("s_suppkey", r6(exprs.softplus(x)).alias("softplus"), r6(exprs.sigmoid(x)).alias("sigmoid"), r6(families.LINKS["square"](x)).alias("square"), r6(families.LINKS["exp"](x / 10)).alias("exp"), r6(families.LINKS["log"](F.abs(x))).alias("log"))


@query
def special_functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size") / 7.0
    return table(spark, d, "part").select("p_partkey", r6(special.lgamma(x)).alias("lgamma"), r6(special.erf(x / 3)).alias("erf"))


@query
def metric_deviances(spark: SparkSession, d: str) -> DataFrame:
    y, a, b, k = (F.col(c) for c in "yabk")
    return metrics.evaluate(_orders(spark, d), {
        "dev_poisson": F.round(metrics.poisson_deviance(k, a), 4), "dev_gamma": F.round(metrics.gamma_deviance(y, a), 4), "dev_negbin": F.round(metrics.negative_binomial_deviance(k, a, b), 4),
        "loss_studentt": r6(metrics.student_t_loss(y, a, b)), "loss_invgamma": r6(metrics.inverse_gamma_loss(y, a, b)), "mse": r6(metrics.mse(y, a)), "mae": r6(metrics.mae(y, a)), "rmse": r6(metrics.rmse(y, a)),
    })


@query
def err_dirichlet(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return df.agg(r6(metrics.dirichlet_error(F.array("a", "b", "y"), F.array("b", "y", "a"))).alias("error"))


@query
def crps_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).agg(r6(metrics.gaussian_crps(F.col("y"), F.col("a"), F.col("b"))).alias("crps"))


# ---- sparse activations, vector functions


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 6).alias("z"))


@query
def sparsemax(spark: SparkSession, d: str) -> DataFrame:
    return _long(_embeddings(spark, d), ["vec_id"], exprs.sparsemax(F.col("z")))


@query
def entmax15_unity(spark: SparkSession, d: str) -> DataFrame:
    """1.5-entmax sums to 1; its support lies between those of sparsemax and softmax."""
    v = exprs.entmax15(F.col("z"))
    return _embeddings(spark, d).select(F.round(exprs.total(v), 9).alias("total")).groupBy("total").agg(F.count("*").alias("n"))


@query
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).select("vec_id", r6(F.array_max(exprs.softmax(F.col("z")))).alias("p"), exprs.argmax(F.col("z")).alias("at"), r6(exprs.logsumexp(F.col("z"))).alias("norm"))


@query
def entmoid(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("s_acctbal") / 3000
    return table(spark, d, "supplier").select("s_suppkey", r6(exprs.entmoid15(x)).alias("entmoid"), r6(exprs.sparsemoid(x)).alias("sparsemoid"))


@query
def norms(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("z")
    rows = F.array(F.struct(F.lit("rms").alias("norm"), exprs.rms_norm(z).alias("v")), F.struct(F.lit("layer").alias("norm"), exprs.layer_norm(z).alias("v")), F.struct(F.lit("group").alias("norm"), exprs.group_norm(z, 2, 64).alias("v")), F.struct(F.lit("glu").alias("norm"), exprs.glu(z).alias("v")), F.struct(F.lit("reglu").alias("norm"), exprs.reglu(z).alias("v")))
    return _long(_embeddings(spark, d).select("vec_id", F.explode(rows).alias("x")).select("vec_id", "x.norm", "x.v"), ["vec_id", "norm"], F.col("v"))


# ---- effects


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    q, t = F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").select(q, t, (q / 10).alias("fq"), (t * t * 100).alias("ft"), (q * t).alias("fqt"))


@query
def effect_main(spark: SparkSession, d: str) -> DataFrame:
    e = effects.main_effects(_contributions(spark, d), {"l_quantity": (F.col("l_quantity"), F.col("fq")), "l_discount": (F.col("l_discount"), F.col("ft"))})
    return e.select("term", r6(F.col("x")).alias("x"), "n", r6(F.col("y")).alias("y"))


@query
def effect_pair(spark: SparkSession, d: str) -> DataFrame:
    e = effects.pair_effects(_contributions(spark, d), {"q:d": (F.col("l_quantity"), F.col("l_discount"), F.col("fqt"))})
    return effects.seen_or_nonzero(effects.dense_pairs(e)).select("x1", "x2", "n", r6(F.col("y")).alias("y"))


@query
def effect_centered(spark: SparkSession, d: str) -> DataFrame:
    e = effects.main_effects(_contributions(spark, d), {"l_quantity": (F.col("l_quantity"), F.col("fq"))})
    return effects.centred(e).select("x", "n", r6(F.col("y")).alias("y"), r6(F.col("offset")).alias("offset"))


@query
def effect_importance(spark: SparkSession, d: str) -> DataFrame:
    e = effects.main_effects(_contributions(spark, d), {"l_quantity": (F.col("l_quantity"), F.col("fq")), "l_discount": (F.col("l_discount"), F.col("ft"))})
    return effects.importance(e).select("term", r6(F.col("importance")).alias("importance"))


@query
def purify_pair(spark: SparkSession, d: str) -> DataFrame:
    e = effects.pair_effects(_contributions(spark, d), {"q:d": (F.col("l_quantity"), F.col("l_discount"), F.col("fqt"))})
    return effects.purify_table(e, 4).select("x1", "x2", "n", r6(F.col("y")).alias("y"), r6(F.col("row")).alias("row"), r6(F.col("col")).alias("col"))


@query
def purify_converged(spark: SparkSession, d: str) -> DataFrame:
    """Until no weighted row or column mean is left, in Spark."""
    e = effects.pair_effects(_contributions(spark, d), {"q:d": (F.col("l_quantity"), F.col("l_discount"), F.col("fqt"))})
    return effects.purify_converged(e, 1e-9)[0].select("x1", "x2", "n", r6(F.col("y")).alias("y"))


@query
def effect_histogram(spark: SparkSession, d: str) -> DataFrame:
    return effects.density(table(spark, d, "lineitem"), "l_quantity", 0.0, 60.0, 30).select(F.col("bin").cast("long").alias("bin"), "n", r6(F.col("shade")).alias("shade"))


@query
def effect_sorted_columns(spark: SparkSession, d: str) -> DataFrame:
    return effects.sorted_columns(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).select("column", "rank", r6(F.col("value")).alias("value"))


@query
def effect_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _gam(spark, d)
    return effects.effect_grid(spark, "l_quantity", 1.0, 50.0, lambda x: g.effect(0, x)).select(r6(F.col("x")).alias("x"), F.round("y", 3).alias("y"))


@query
def tree_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct feature sets of trees, with customers as trees and their nations' and segments' names as features."""
    sel = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("tree"), F.col("c_mktsegment").alias("feature"))
    return effects.distinct_terms(sel).select("term")


@query
def tree_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    sel = table(spark, d, "customer").select((F.col("c_custkey") % 40).alias("tree"), F.col("c_mktsegment").alias("feature"))
    return effects.trees_by_feature(sel)


# ---- regions


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """Unit squares, one a nation, five a row."""
    cell = table(spark, d, "nation").select(F.col("n_nationkey").alias("region"), (F.col("n_nationkey") % 5).alias("i"), F.floor(F.col("n_nationkey") / 5).alias("j"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("c")
    return cell.select("region", "i", "j", corner).select("region", (F.col("i") + F.col("c.a")).cast("double").alias("vx"), (F.col("j") + F.col("c.b")).cast("double").alias("vy"))


@query
def mrf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return mrf.neighbours(_polygons(spark, d))


@query
def mrf_laplacian(spark: SparkSession, d: str) -> DataFrame:
    return mrf.laplacian(_polygons(spark, d))


@query
def region_indicator(spark: SparkSession, d: str) -> DataFrame:
    v = mrf.indicator(F.col("c_nationkey"), list(range(25)))
    return _long(table(spark, d, "customer"), [], v).groupBy("pos").agg(F.sum("value").cast("long").alias("n"))


# ---- fitted models


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*FEATURES, "l_returnflag", (F.col("l_extendedprice") / 1e4).alias("y"))


@query
def snam_fit(spark: SparkSession, d: str) -> DataFrame:
    df = _train(spark, d)
    e = ESTIMATORS["SNAMRegressor"](cat_cutoff=2).fit(df, "y")
    return e.predict(df).agg(F.count("*").alias("n"), F.round(metrics.mse(F.col("y"), F.col("prediction")), 3).alias("mse"))


@query
def gpnam_fit(spark: SparkSession, d: str) -> DataFrame:
    df = _train(spark, d)
    e = ESTIMATORS["GPNAMRegressor"](cat_cutoff=2, random_features=20).fit(df, "y")
    return e.predict(df).agg(F.count("*").alias("n"), F.round(metrics.mse(F.col("y"), F.col("prediction")), 3).alias("mse"))


@query
def ga2m_boosted(spark: SparkSession, d: str) -> DataFrame:
    df = _train(spark, d)
    m = TabulatedGam(n_bins=32, n_estimators=50, pairs=2, pair_rounds=3).fit(df, "y", list(FEATURES), ["l_returnflag"])
    return m.transform(df).agg(F.count("*").alias("n"), F.round(metrics.mse(F.col("y"), F.col("output")), 3).alias("mse"))


@query
def lss_gamma_fit(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(F.col("o_orderstatus"), (F.col("o_totalprice") / 1e5).alias("y"))
    e = ESTIMATORS["LinRegLSS"](family="gamma", max_iter=6).fit(df, "y")
    return e.predict(df).agg(F.count("*").alias("n"), F.round(F.avg(e.family.nll(F.col("y"), [F.col("shape"), F.col("rate")])), 3).alias("nll"))


@query
def nam_mlp(spark: SparkSession, d: str) -> DataFrame:
    df = _train(spark, d)
    e = ESTIMATORS["NAMRegressor"](cat_cutoff=2, hidden=(16, 8), max_epochs=2).fit(df, "y")
    return e.predict(df).agg(F.count("*").alias("n"), F.round(metrics.mse(F.col("y"), F.col("prediction")), 1).alias("mse"))


@query
def additive_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Piecewise linear encoding, an additive fit and its effect table."""
    df = table(spark, d, "lineitem").select(*FEATURES, (F.col("l_extendedprice") / 1e4).alias("y"))
    e = Regressor("linreg", numerical_preprocessing="ple", n_bins=10, cat_cutoff=2).fit(df, "y")
    t = e.effect_table(df)
    return spark.createDataFrame([(r.feat_name, len(r.x), float(r.importance)) for r in t.itertuples()], "feat_name string, n_values int, importance double")


@query
def daily_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts a user and day: targets of count models, with their window sums."""
    day = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return day.withColumn("running", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
