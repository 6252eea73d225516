"""Operators of the engine do the whole job: what an earlier rule cut off."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.operators import thinplate, tree
from terrace.plans import boosted as boosted_plans
from terrace.plans.boosted import TabulatedGam
from terrace.plans.estimator import Classifier
from terrace.plans.gam import Gam
from terrace.plans.preprocess import Preprocessor
from terrace.queries import QUERIES
from terrace.sources.tables import load_state, save_state


@pytest.mark.parametrize("kwargs", [{"max_leaves": 9}, {"max_depth": 3}])
def test_tree_splits_exactly_over_ranges(spark, kwargs):
    """Skewed columns with more values than a task takes: the same cuts as a search over all distinct values."""
    rng = np.random.default_rng(3)
    x = np.append(rng.permutation(3000) / 7.0, 1e9)
    pdf = pd.DataFrame({"x": x, "z": rng.integers(0, 20, len(x)).astype(float), "y": np.sin(x / 40) + (x > 200) + rng.normal(0, 0.1, len(x))})
    df = spark.createDataFrame(pdf)
    tables = tree.target_tables(df, {"x": F.col("x"), "z": F.col("z")}, F.col("y"))
    want = {}
    for f in ("x", "z"):
        g = pdf.groupby(f)["y"].agg(["count", "sum"])
        v = g.index.to_numpy()
        want[f] = tree.thresholds(v, v, g["count"].to_numpy(float), g["sum"].to_numpy()[:, None], **kwargs)
    found = tree.fit_thresholds(tables, max_points=200, **kwargs)
    assert len(want["x"]) > 6 and np.allclose(found["x"], want["x"], atol=1e-9) and np.allclose(found["z"], want["z"])


def test_one_large_value_leaves_splits(spark):
    n = tree.MAX_POINTS + 2000
    df = spark.range(n).select(F.when(F.col("id") == n - 1, 1e12).otherwise(F.col("id").cast("double")).alias("x"), (F.col("id") > 700).cast("int").alias("y"))
    assert tree.fit_thresholds(tree.target_tables(df, {"x": F.col("x")}, F.col("y"), [0, 1]), max_depth=1) == {"x": [700.5]}
    bins = tree.target_tables(df, {"x": F.col("x")}, F.lit(0.0), max_points=100).toPandas()
    assert len(bins) <= 100 and bins["n"].sum() == n and bins["n"].max() <= 2 * n / 100


def test_thin_plate_query_takes_all_rows(spark):
    d = "/root/testdata/sf0.1"
    x = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") / 10_000).alias("x"), (F.col("s_nationkey") / 25.0).alias("y")).toPandas().sort_values("s_suppkey")[["x", "y"]].to_numpy()
    full = thinplate.ThinPlate(np.unique(x, axis=0), 6, 2)
    found = QUERIES["thin_plate_basis"](spark, d).toPandas().sort_values(["s_suppkey", "pos"])["value"].to_numpy().reshape(-1, 6)
    assert len(full.knots) == 1000 and np.allclose(found, np.abs(full.rows(x)), atol=1e-6)


def test_entmax15_unity_reads_whole_vectors(spark, tiny):
    """Only the sum is returned, so the plan tells whether a part of the column was cut off."""
    df = QUERIES["entmax15_unity"](spark, tiny)
    assert "slice(" not in df._jdf.queryExecution().analyzed().toString()
    assert [r["total"] for r in df.collect()] == [1.0]


def test_quantiles_are_exact_over_ranges(spark):
    """Skewed columns with ties, in one range or many: numpy's percentiles."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": np.round(rng.lognormal(0, 2, 4000), 3), "z": rng.integers(0, 5, 4000).astype(float)})
    pdf.loc[0, "x"] = 1e12
    df = spark.createDataFrame(pdf)
    grid = np.linspace(0, 1, 21).tolist()
    for most in (tree.MAX_POINTS, 100):
        found = tree.quantiles(df, {c: F.col(c) for c in "xz"}, grid, most)
        assert all(np.allclose(found[c], np.quantile(pdf[c], grid), rtol=1e-12) for c in "xz")
    assert tree.quantiles(df.limit(0), {"x": F.col("x")}, grid) == {}


def test_large_vocabularies_are_joined(spark):
    """The same codes and fill on both sides of the size from which vocabularies stay tables."""
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.format_string("v%04d", F.col("id") % 900)).alias("c"))
    codes = []
    for most in (20_000, 100):
        pre = Preprocessor(literals=most).fit(df, exclude=("id",))
        assert bool(pre.vocabularies) == (most == 100)
        codes.append(pre.transform(df.unionByName(spark.sql("SELECT 9000L AS id, 'unknown' AS c")), ("id",)).orderBy("id").toPandas()["cat_c"].tolist())
    assert codes[0] == codes[1] and codes[0][-1] == 0
    with pytest.raises(ValueError):
        Preprocessor(literals=100, categorical_preprocessing="one_hot").fit(df, exclude=("id",))


def test_splits_stay_when_rows_multiply():
    """A hundred million times the rows have the same thresholds."""
    rng = np.random.default_rng(5)
    x, n = np.arange(11.0), rng.integers(900, 1100, 11).astype(float)
    s = (n * (40_000 + 3 * np.sin(x)))[:, None]
    assert len(tree.thresholds(x, x, n, s, max_depth=3)) > 4 and tree.thresholds(x, x, n * 1e8, s * 1e8, max_depth=3) == tree.thresholds(x, x, n, s, max_depth=3)
    assert tree.thresholds(x, x, n, (n * 7.1)[:, None], max_depth=3) == []


def test_models_of_every_kind_are_saved(spark, tmp_path):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300), "c": rng.choice(["u", "v"], 300)})
    pdf["y"], pdf["k"] = pdf.a**2 + pdf.b, np.digitize(pdf.a, [-0.5, 0.5])
    df = spark.createDataFrame(pdf)
    gam = Gam(["a", "b"], k=6).fit(df, "y")
    boosted = TabulatedGam(n_bins=16, n_estimators=20, pairs=1).fit(df, "y", ["a", "b"], ["c"])
    rest = Classifier("nodegam", n_estimators=10).fit(df.select("a", "b", "k"), "k").model
    total = lambda m: m.transform(df).agg(F.sum("output")).first()[0]
    for m in (gam, boosted, rest):
        save_state(spark, f"{tmp_path}/{type(m).__name__}", None, m)
        pre, again = load_state(spark, f"{tmp_path}/{type(m).__name__}")
        assert pre is None and type(again) is type(m) and np.isclose(total(again), total(m))
    again = load_state(spark, f"{tmp_path}/Gam")[1]
    assert np.allclose(again.covariance, gam.covariance) and again.gcv() == gam.gcv()
    assert np.isclose(load_state(spark, f"{tmp_path}/TabulatedGam")[1].purified().intercept, boosted.purified().intercept)


def test_groups_of_features_and_pairs_take_jobs_of_their_own(spark, monkeypatch):
    """With room for few tables a job, boosting still fits, and the same pair is found."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({c: rng.integers(0, 6, 1500).astype(float) for c in "abcd"})
    pdf["y"] = pdf.a - pdf.d + 2.0 * (pdf.b > 2) * (pdf.c > 2)
    df = spark.createDataFrame(pdf)
    whole = TabulatedGam(n_bins=8, n_estimators=60, pairs=1).fit(df, "y", list("abcd"))
    monkeypatch.setattr(boosted_plans, "TABLE_NUMBERS", 150)
    parts = TabulatedGam(n_bins=8, n_estimators=60, pairs=1)
    parts.fit(df, "y", list("abcd"))
    assert len(parts._groups()) > 1 and list(parts.tables) == list(whole.tables) == [("b", "c")] and parts.gains.keys() == whole.gains.keys()
    mse = lambda m: m.transform(df).agg(F.avg(F.pow(F.col("y") - F.col("output"), 2))).first()[0]
    assert mse(parts) < 0.2 * pdf["y"].var()


def test_noise_of_quantiles_is_repeatable(spark):
    """Ties are spread by noise that no partitioning changes; the map is normal and increasing."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"i": range(400), "x": np.round(rng.normal(size=400), 1), "y": 0.0})
    df = spark.createDataFrame(pdf)
    states = [Preprocessor(numerical_preprocessing="quantile_noise", cat_cutoff=2).fit(df.repartition(n), "y", exclude=("i",)) for n in (1, 7)]
    assert np.allclose(states[0].features[0].state["quantiles"], states[1].features[0].state["quantiles"], rtol=1e-12, atol=1e-14) and len(set(states[0].features[0].state["quantiles"])) > 350
    out = states[0].transform(df, ("i", "x")).toPandas().sort_values("x")
    z = np.array([v[0] for v in out["num_x"]])
    assert (np.diff(z) >= -1e-9).all() and abs(z.mean()) < 0.2 and 0.7 < np.clip(z, -3, 3).std() < 1.3
    assert Preprocessor.from_json(states[0].to_json()).features[0].state["quantiles"] == states[0].features[0].state["quantiles"]


def test_normal_quantiles_compute_their_input_once(spark, tiny):
    """The place of a value among the quantiles is worked out once a row, not wherever the approximation names it."""
    from statistics import NormalDist

    df = QUERIES["quantile_normal"](spark, tiny)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("c_acctbal") < 20
    x = spark.read.parquet(f"{tiny}/customer.parquet").select("c_custkey", "c_acctbal").toPandas().sort_values("c_custkey")["c_acctbal"].to_numpy()
    u = np.interp(x, np.quantile(x, np.linspace(0, 1, 21)), np.linspace(0, 1, 21)).clip(1e-7, 1 - 1e-7)
    assert np.allclose(df.toPandas().sort_values("c_custkey")["z"], [NormalDist().inv_cdf(v) for v in u], atol=2e-6)
