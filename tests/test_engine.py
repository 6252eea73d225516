"""Encodings, splines, models and effects against numpy and their own invariants."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.functions import exprs, special
from terrace.operators import effects, encoders, families, gram, metrics, mrf, schema, thinplate, tree
from terrace.operators.splines import CubicSpline, scale_penalty, sum_to_zero
from terrace.plans.boosted import TabulatedGam
from terrace.plans.estimator import ESTIMATORS, Classifier, Lss, Regressor
from terrace.plans.gam import Gam, chi2_sf
from terrace.plans.preprocess import Preprocessor
from terrace.sources.tables import load_state, map_chunks, read, save_state, training_batches


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 3, 400), rng.choice(list("abc"), 400)
    y = np.sin(2 * x) + (z == "b") * 1.5 + rng.normal(0, 0.1, 400)
    pdf = pd.DataFrame({"x": x, "w": rng.normal(0, 1, 400), "z": z, "y": y, "label": (y > 0.7).astype(int)})
    return spark.createDataFrame(pdf).cache(), pdf


def _column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_special_functions(spark):
    xs = [0.05, 0.5, 1.0, 3.3, 20.0]
    assert np.allclose(_column(spark, xs, special.lgamma), [math.lgamma(x) for x in xs], atol=1e-11)
    assert np.allclose(_column(spark, [-3.0, -0.5, 0.0, 0.4, 2.0], special.erf), [math.erf(x) for x in (-3, -0.5, 0, 0.4, 2)], atol=1e-13)
    from statistics import NormalDist

    assert np.allclose(_column(spark, [1e-5, 0.3, 0.5, 0.999], special.normal_quantile), [NormalDist().inv_cdf(p) for p in (1e-5, 0.3, 0.5, 0.999)], atol=1e-10)
    assert _column(spark, [None], special.erf) == [None]


def test_sparse_activations(spark):
    rows = [[1.0, 2.0, 0.5], [0.0, 0.0], [5.0, 0.0, 0.0], [1.0]]
    for f in (exprs.sparsemax, exprs.entmax15, exprs.softmax):
        for v in _column(spark, rows, f, "array<double>"):
            assert math.isclose(sum(v), 1, abs_tol=1e-9) and min(v) >= 0
    assert _column(spark, rows, exprs.sparsemax, "array<double>")[2] == [1.0, 0.0, 0.0]
    assert np.allclose(_column(spark, [0.7], exprs.entmoid15), [exprs_entmax(0.7)])
    assert _column(spark, [[1.0, 3.0, 3.0]], exprs.argmax, "array<double>") == [1]


def exprs_entmax(x):
    """The first component of the 1.5-entmax of (x, 0), by bisection."""
    lo, hi = -10.0, 10.0
    for _ in range(200):
        t = (lo + hi) / 2
        s = max(x / 2 - t, 0) ** 2 + max(-t, 0) ** 2
        lo, hi = (t, hi) if s > 1 else (lo, t)
    return max(x / 2 - lo, 0) ** 2


def test_types_and_imputation(spark):
    df = spark.createDataFrame([(i, i % 2, float(i) if i % 3 else None, "a" if i % 2 else None, bool(i % 2)) for i in range(100)], "u int, low int, d double, s string, b boolean")
    assert schema.detect_column_types(df) == (["u", "d"], ["low", "s", "b"])
    assert schema.detect_column_types(df, treat_all_integers_as_numerical=True)[0] == ["u", "low", "d"]
    assert schema.detect_column_types(df, cat_cutoff=1000)[1][:2] == ["u", "low"]
    with pytest.raises(TypeError):
        schema.detect_column_types(df.withColumn("a", F.array("u")))
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert sorted(r[0] for r in schema.impute_mean(nan, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert sorted(r[0] for r in schema.impute_most_frequent(tie, ["c"]).collect()) == ["a", "a", "b"]
    with pytest.raises(ValueError):
        schema.impute_mean(spark.createDataFrame([(None,)], "x double"), ["x"])


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    one = {r[0] for r in schema.train_validation_split(df.repartition(1), ["id"])[1].collect()}
    assert one == {r[0] for r in schema.train_validation_split(df.repartition(7), ["id"])[1].collect()} and 60 < len(one) < 140


def test_tree_and_ple(spark):
    pdf = pd.DataFrame({"x": np.repeat(np.arange(10.0), 5)})
    pdf["y"] = (pdf.x > 2) * 4.0 + (pdf.x > 6) * 1.0
    df = spark.createDataFrame(pdf)
    cuts = tree.fit_thresholds(tree.target_tables(df, {"x": F.col("x")}, F.col("y")), max_leaves=3)
    assert cuts == {"x": [2.5, 6.5]}
    flat = tree.fit_thresholds(tree.target_tables(df, {"x": F.col("x")}, F.lit(1.0)), max_leaves=3)
    assert flat == {"x": []}
    found = _column(spark, [0.1, 0.2, 0.3, 0.5, 0.95], lambda x: tree.ple(x, [0.2, 0.5, 0.9], 1.0))
    assert np.allclose(found, [[0.1, 0, 0, 0], [0.2, 0, 0, 0], [1, 1 / 3, 0, 0], [1, 1, 0, 0], [1, 1, 1, 0.95]])
    binned = tree.target_tables(df, {"x": F.col("x")}, F.col("y"), max_points=4).count()
    assert binned <= 5


def test_bins_and_categories(spark):
    assert _column(spark, [-1.0, 0.0, 5.0, 10.0, 99.0, None], lambda x: encoders.k_bin(x, [0.0, 5.0, 10.0])) == [0, 0, 1, 1, 1, None]
    assert _column(spark, [-1.0, 0.0, 5.0, 5.1, 11.0], lambda x: encoders.custom_bin(x, [0.0, 5.0, 10.0])) == [None, 0, 0, 1, None]
    assert _column(spark, [-1.0, 11.0], lambda x: encoders.custom_bin(x, [0.0, 5.0, 10.0], clip=True)) == [0, 1]
    assert _column(spark, ["b", "z", None], lambda x: encoders.ordinal(x, ["a", "b"]), "string") == [2, 0, 0]
    assert encoders.distinct_edges([1.0, 1.0, 2.0]) == [1.0, 2.0]
    assert encoders.kmeans_edges(np.array([0.0, 1.0, 10.0, 11.0]), np.ones(4), 2) == [0.0, 5.5, 11.0]
    q = [0.0, 1.0, 1.0, 4.0]
    assert np.allclose(_column(spark, [-1.0, 0.5, 1.0, 2.5, 9.0], lambda x: encoders.quantile_map(x, q)), [0, 1 / 6, 0.5, 5 / 6, 1])


def test_splines_match_numpy(spark):
    s = CubicSpline.over(0.0, 2.0, 6)
    x = [-1.0, 0.0, 0.3, 0.4, 1.99, 2.0, 3.5]
    found = np.array(_column(spark, x, s.column))
    assert np.allclose(found, s.rows(np.array(x)), atol=1e-12)
    assert np.allclose(found.sum(1), 1) and np.allclose(s.penalty.sum(1), 0)
    assert np.allclose(s.rows(s.knots), np.eye(6), atol=1e-12)
    b = np.array(_column(spark, np.linspace(0, 1, 9).tolist(), lambda v: encoders.bspline(v, 0.0, 1.0, 5, 3, last=True)))
    assert np.allclose(b.sum(1), 1) and b.shape[1] == 7 and (b >= 0).all()
    q = sum_to_zero(np.array([0.2, 0.3, 0.5]))
    assert np.allclose(np.array([0.2, 0.3, 0.5]) @ q, 0) and np.allclose(q.T @ q, np.eye(2))


def test_thin_plate(spark):
    df = spark.createDataFrame(pd.DataFrame(np.random.default_rng(0).uniform(0, 1, (40, 2)), columns=["a", "b"]))
    s = thinplate.fit(df, ["a", "b"], 8)
    x = np.array([(r["a"], r["b"]) for r in df.collect()])
    found = np.array([r[0] for r in df.select(s.column([F.col("a"), F.col("b")])).collect()])
    assert np.allclose(found, s.rows(x), atol=1e-9)
    assert (np.linalg.eigvalsh(s.penalty) > -1e-9).all()
    with pytest.raises(ValueError):
        thinplate.ThinPlate(x, 3, 2)


def test_regions(spark):
    square = lambda r, i, j: [(r, float(i + a), float(j + b)) for a in (0, 1) for b in (0, 1)]
    v = spark.createDataFrame([*square("a", 0, 0), *square("b", 1, 0), *square("c", 0, 1), *square("d", 9, 9), ("a", 0.0, 0.0)], "region string, vx double, vy double")
    regions, p = mrf.penalty(v)
    assert regions == list("abcd") and (p.sum(1) == 0).all() and p[0, 0] == 2 and p[3, 3] == 0 and p[1, 2] == -1


def test_gram_matches_numpy(spark, frame):
    df, pdf = frame
    b = np.stack([np.ones(len(pdf)), pdf.x, pdf.w], 1)
    g = gram.gram(df, F.array(F.lit(1.0), "x", "w"), 3, F.col("y"), blocks=[1, 2])
    assert g.n == 400 and np.allclose(g.bb, b.T @ b) and np.allclose(g.by, b.T @ pdf.y) and np.isclose(g.norms[1], np.abs(b[:, 1:]).sum(1).max())


def test_gam_matches_the_hat_matrix(spark, frame):
    df, pdf = frame
    g = Gam(["x", "w"], k=7).fit(df, "y")
    lam = [0.3, 2.0]
    bases = []
    for c, s in zip(("x", "w"), g.splines, strict=True):
        raw = s.rows(pdf[c].to_numpy())
        bases.append((raw @ sum_to_zero(raw.mean(0)), sum_to_zero(raw.mean(0)).T @ scale_penalty(s.penalty, np.abs(raw).sum(1).max()) @ sum_to_zero(raw.mean(0))))
    z = np.hstack([np.ones((400, 1)), *(b for b, _ in bases)])
    pen = np.zeros((13, 13))
    pen[1:7, 1:7], pen[7:, 7:] = lam[0] * bases[0][1], lam[1] * bases[1][1]
    hat = z @ np.linalg.solve(z.T @ z + pen, z.T)
    rss = ((pdf.y - hat @ pdf.y) ** 2).sum()
    assert np.isclose(g.gcv(lam), rss / 400 / (1 - np.trace(hat) / 400) ** 2, rtol=1e-8)
    assert g.gcv() <= g.gcv(lam) + 1e-12
    out = g.transform(df).select("output", "y").toPandas()
    assert ((out.output - out.y) ** 2).mean() < 0.7 and g.wald_test(0)[1] < 1e-6
    assert g.summary(spark).count() == 2 and len(g.confidence_intervals()) == 13
    assert np.isclose(chi2_sf(3.84, 1), 0.05, atol=1e-3) and np.isclose(chi2_sf(18.3, 10), 0.05, atol=1e-3)


@pytest.mark.parametrize("kind", ["ple", "binning", "one_hot", "standardization", "normalization", "quantile", "quantile_normal", "polynomial", "splines"])
def test_preprocessor(spark, frame, kind):
    df, _ = frame
    pre = Preprocessor(n_bins=6, numerical_preprocessing=kind, categorical_preprocessing="one_hot").fit(df.drop("label"), "y")
    again = Preprocessor.from_json(pre.to_json())
    new = spark.createDataFrame([(None, 99.0, "zz"), (0.5, float("nan"), None)], "x double, w double, z string")
    for p in (pre, again):
        rows = p.transform(new).collect()
        assert [len(rows[0][f.block]) for f in p.features] == [f.width for f in p.features]
        assert rows[0]["cat_z"][0] == 1.0 and sum(rows[1]["cat_z"]) == 1.0
    assert pre.transform(new).collect() == again.transform(new).collect()
    assert pre.feature_info(spark).agg(F.sum("dimension")).first()[0] == pre.input_width()
    with pytest.raises(ValueError):
        Preprocessor(numerical_preprocessing="nonsense")
    with pytest.raises(ValueError):
        pre.set_params(knot=3)


@pytest.mark.parametrize("kind", ["ple", "binning", "one_hot", "polynomial", "splines", "quantile", "standardization"])
def test_closed_forms_match_blocks(spark, frame, kind):
    """Blocks in Spark and in numpy are the same, and so are their products with weights."""
    df, _ = frame
    df = df.unionByName(df.limit(3).withColumns({"x": F.lit(-5.0), "w": F.lit(None).cast("double"), "z": F.lit("new")}))
    pre = Preprocessor(n_bins=6, numerical_preprocessing=kind, categorical_preprocessing="one_hot").fit(df.drop("label"), "y")
    for f in pre.features:
        t = df.schema[f.name].dataType
        weights = np.random.default_rng(2).normal(size=f.width).tolist()
        rows = df.select(pre.column(f, t).alias("v"), pre.source(f, t).alias("s"), pre.effect(f, t, weights).alias("e")).toPandas()
        block = np.stack(rows.v.to_numpy())
        assert np.allclose(pre.rows(f, rows.s.to_numpy()), block) and np.allclose(block @ weights, rows.e)


def test_spline_effect(spark):
    x = np.linspace(-2, 4, 50).tolist()
    for s in (CubicSpline.over(0.0, 2.0, 6), CubicSpline(np.array([0.0, 0.1, 1.0, 2.5]))):
        v = np.random.default_rng(1).normal(size=s.width)
        assert np.allclose(_column(spark, x, lambda c, s=s, v=v: s.effect(c, v)), s.rows(np.array(x)) @ v)


@pytest.mark.parametrize("kwargs", [{"use_decision_tree_bins": True, "numerical_preprocessing": "binning"}, {"binning_strategy": "quantile", "numerical_preprocessing": "one_hot"}, {"binning_strategy": "kmeans", "numerical_preprocessing": "binning"}, {"task": "classification"}])
def test_preprocessor_options(spark, frame, kwargs):
    df, _ = frame
    pre = Preprocessor(n_bins=5, **kwargs).fit(df.select("x", "w", "label"), "label")
    assert pre.transform(df).count() == 400


SMALL = {"max_epochs": 8, "hidden": (12,), "lr": 0.02, "d_model": 8, "num_bases": 8, "batch_size": 32}


@pytest.mark.parametrize("name", ["LinRegRegressor", "SNAMRegressor", "GPNAMRegressor", "TreeNAMRegressor", "NodeGAMRegressor", "NAMRegressor", "NBMRegressor", "NATTRegressor", "NAMformerRegressor"])
def test_regressors(spark, frame, name):
    df, pdf = frame
    e = ESTIMATORS[name](**(SMALL if name in ("NAMRegressor", "NBMRegressor", "NATTRegressor", "NAMformerRegressor") else {})).fit(df.drop("label"), "y")
    assert e.evaluate(df)["mse"] < pdf.y.var() * 0.95
    one = e.contributions(df).limit(20).toPandas()
    terms = [c for c in one if c.startswith("f_")]
    base = e.model.intercept if hasattr(e.model, "mains") else e.model.coefficients[0, 0] if hasattr(e.model, "coefficients") else e.model.params["intercept"][0]
    assert np.allclose(one[terms].sum(axis=1) + base, one.output)


@pytest.mark.parametrize("name", ["LinRegClassifier", "NodeGAMClassifier", "NAMClassifier"])
def test_classifiers(spark, frame, name):
    df, _ = frame
    e = ESTIMATORS[name](**(SMALL if name == "NAMClassifier" else {})).fit(df.drop("y"), "label")
    assert e.evaluate(df)["accuracy"] > 0.7
    p = e.predict(df).select("probabilities").first()[0]
    assert math.isclose(sum(p), 1)


def test_three_classes(spark, frame):
    df, _ = frame
    e = Classifier("linreg", max_iter=10).fit(df.select("x", "w", "z"), "z")
    assert e.evaluate(df)["accuracy"] > 0.3 and len(e.predict(df).first()["probabilities"]) == 3


@pytest.mark.parametrize("family", ["normal", "studentt", "robustnormal", "gamma", "inversegamma", "poisson", "negativebinom", "beta", "quantile"])
def test_lss(spark, frame, family):
    df, _ = frame
    y = {"poisson": F.round(F.exp("y")), "negativebinom": F.round(F.exp("y")), "gamma": F.exp("y"), "inversegamma": F.exp("y"), "beta": exprs.sigmoid(F.col("y"))}.get(family, F.col("y"))
    e = Lss("linreg", family, max_iter=4).fit(df.select("x", "z", y.alias("t")), "t")
    assert e.model.history[-1] < e.model.history[0]
    assert math.isfinite(e.evaluate(df.withColumn("t", y))["nll"])


def test_nodegam_soft_and_qnam(spark, frame):
    df, _ = frame
    e = ESTIMATORS["NodeGAMLSS"](family="normal", interaction_degree=2, **SMALL).fit(df.drop("label"), "y")
    assert e.model.history[-1] <= e.model.history[0] + 1e-6
    q = ESTIMATORS["QNAM"](**SMALL).fit(df.drop("label"), "y").predict(df).select("q25", "q50", "q75").toPandas()
    assert (q.q25 <= q.q50).all() and (q.q50 <= q.q75).all()


def test_interactions_and_effects(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 600) * 1.0, "b": rng.integers(0, 5, 600) * 1.0})
    pdf["y"] = pdf.a + pdf.a * pdf.b
    df = spark.createDataFrame(pdf)
    m = TabulatedGam(n_bins=16, n_estimators=150, pairs=1).fit(df, "y", ["a", "b"])
    plain = TabulatedGam(n_bins=16, n_estimators=150).fit(df, "y", ["a", "b"])
    err = lambda m: m.transform(df).agg(metrics.mse(F.col("y"), F.col("output"))).first()[0]
    assert err(m) < err(plain) * 0.5
    assert np.isclose(err(m), err(m.purified()), rtol=1e-6)
    e = Regressor("linreg", interaction_degree=2, cat_cutoff=1).fit(df, "y")
    assert e.evaluate(df)["mse"] < 1e-6
    t = e.effect_table(df)
    assert list(t.feat_name) == ["offset", "a", "b", "a:b"] and np.isclose(t[t.feat_name == "offset"].y.iloc[0][0], pdf.y.mean(), atol=1e-2)


def test_purify_keeps_the_sum():
    rng = np.random.default_rng(0)
    v, n = rng.normal(size=(5, 4)), rng.integers(0, 4, (5, 4)) + np.eye(5, 4)
    pair, rows, cols = effects.purify(v, n, 1e-9)
    assert np.allclose(pair + rows[:, None] + cols[None], v) and np.abs((pair * n).sum(0)).max() < 1e-6
    with pytest.raises(ValueError):
        effects.purify(v, np.zeros((5, 4)))


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "y double, m double")
    assert np.isclose(df.agg(metrics.poisson_deviance(F.col("y"), F.col("m"))).first()[0], 2.0)
    s = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.auroc(s, "y", "p").first()[0] == 0.875
    assert metrics.auroc(s.limit(0), "y", "p").first()[0] is None


def test_state_and_sources(spark, frame, tmp_path):
    df, _ = frame
    for shape, kw in (("linreg", {}), ("nam", SMALL)):
        e = Regressor(shape, **kw).fit(df.drop("label"), "y")
        save_state(spark, str(tmp_path / shape), e.pre, e.model)
        pre, model = load_state(spark, str(tmp_path / shape))
        want = e.contributions(df).agg(F.sum("output")).first()[0]
        rows = df if shape == "linreg" else pre.transform(df)
        assert np.isclose(model.transform(rows, pre).agg(F.sum("output")).first()[0], want)
    assert read(spark, {"a": [1, 2]}).count() == 2
    assert sum(map(len, training_batches(df.select("x"), 64))) == 400
    assert map_chunks(df.select("x"), lambda b: b, "x double").count() == 400


def test_families_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    raw, y = rng.normal(size=(50, 3)), rng.uniform(0.1, 0.9, 50)
    for name in ("normal", "gamma", "inversegamma", "beta", "studentt", "robustnormal", "negativebinom", "poisson"):
        f = families.by_name(name)
        df = spark.createDataFrame([(i, float(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, raw, strict=True))], "i int, y double, a double, b double, c double")
        cols = f.transformed([F.col(c) for c in "abc"[: f.size]])
        found = [r[0] for r in df.orderBy("i").select(f.nll(F.col("y"), cols)).collect()]
        assert np.allclose(found, f.numpy_nll(y, raw[:, : f.size]), atol=1e-9), name
    with pytest.raises(ValueError):
        families.quantiles([1.5])


def test_stream_scoring(spark, frame, tmp_path):
    from terrace.streaming.scoring import running_moments, score_stream, windowed_counts

    df, _ = frame
    df.drop("label").write.parquet(str(tmp_path / "in"))
    e = Regressor("linreg").fit(df.drop("label"), "y")
    stream = spark.readStream.schema(df.drop("label").schema).parquet(str(tmp_path / "in"))
    score_stream(stream, e, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400
    q = running_moments(stream, ["x"], "y").writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("moments").first()["n"] == 400
    ev = "/root/testdata/sf0.001/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(ev).schema).parquet(ev.replace("events.parquet", "events*"))
    q = windowed_counts(events, "ts", "user_id").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 1000
