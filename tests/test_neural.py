"""Neural shape functions: gradients, trees with learned selectors, and fits that no partition or session changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrace.plans import odst
from terrace.plans.autodiff import Var
from terrace.plans.estimator import ESTIMATORS, Classifier, Regressor
from terrace.plans.neural import NeuralModel
from terrace.plans.preprocess import Preprocessor


def numeric(f, x, eps=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[i] += eps
        down[i] -= eps
        out[i] = (f(up) - f(down)) / (2 * eps)
    return out


@pytest.mark.parametrize("op", [lambda v: v.entmax15(), lambda v: v.sparsemax(), lambda v: v.entmoid15(), lambda v: v.sigmoid(), lambda v: v.standardized(0), lambda v: v.layer_norm()])
def test_gradients_are_those_of_differences(op):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(5, 7)), rng.normal(size=(5, 7))
    v = Var(x)
    (op(v) * Var(w)).reshape(-1).sum(0).backward(np.array(1.0))
    assert np.allclose(v.grad, numeric(lambda a: float((op(Var(a)).value * w).sum()), x), atol=1e-4)


def test_entmax_is_a_distribution():
    x = np.random.default_rng(1).normal(size=(50, 9)) * 3
    s = Var(x).entmax15().value
    assert np.allclose(s.sum(1), 1) and (s >= 0).all() and (s == 0).any()
    two = Var(np.stack([x[:, 0], np.zeros(50)], 1)).entmax15().value[:, 0]
    assert np.allclose(Var(x[:, 0]).entmoid15().value, two)


@pytest.mark.parametrize(("layers", "attention"), [(1, 0), (3, 0), (2, 4)])
def test_hard_trees_read_their_own_features_only(layers, attention):
    rng = np.random.default_rng(2)
    t = odst.Trees([0, 0, 1, 2, 3], ["a", "b", "c", "d"], 2, 6, 3, layers, 2, attention=attention)
    p = t.build(rng)
    for k in range(layers):
        p[f"tree{k}.select"] = rng.normal(size=p[f"tree{k}.select"].shape)
    t.start(p, rng.normal(size=(99, 5)).cumsum(0), rng)
    x = rng.normal(size=(40, 5))
    run = lambda x: np.concatenate([v.value for v in t.forward({k: Var(v) for k, v in p.items()}, x, 1.0, None, False)[0]], 1)
    base, chosen = run(x), t.chosen(p)
    assert len(chosen) == 6 * layers and all(1 <= len(c) <= 2 for c in chosen)
    for i, name in enumerate("abcd"):
        y = x.copy()
        y[:, [k for k, c in enumerate([0, 0, 1, 2, 3]) if c == i]] += 1.7
        moved = np.abs(run(y) - base).max((0, 2)) > 1e-12
        assert all(name in chosen[k] for k in np.flatnonzero(moved))
    v = {k: Var(w) for k, w in p.items()}  # gradients of soft trees, against differences
    out, square = t.forward(v, x[:4], 0.7, None, True)
    total = sum((o.reshape(-1).sum(0) for o in out), square * 0.3)
    total.backward(np.array(1.0))
    for name in ("tree0.select", "tree0.threshold", "tree0.width", f"tree{layers - 1}.leaf"):
        def value(a, name=name):
            w = {**{k: Var(u) for k, u in p.items()}, name: Var(a)}
            o, q = t.forward(w, x[:4], 0.7, None, True)
            return float(sum(u.value.sum() for u in o) + 0.3 * q.value)

        assert np.allclose(v[name].grad, numeric(value, p[name]), atol=1e-4), name


@pytest.fixture(scope="module")
def five(spark):
    """y depends on the third of five features, and a class on it too."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (1500, 5))
    y = 2.0 * (x[:, 2] > 0.2) - 1.0 * (x[:, 2] < -0.4)
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(y=y + rng.normal(0, 0.05, len(x)), k=np.digitize(x[:, 2], [-0.4, 0.2]))
    return spark.createDataFrame(pdf), pdf


def test_selectors_move_to_the_informative_feature(spark, five):
    df, pdf = five
    e = Regressor("nodegam_soft", num_trees=12, depth=2, max_epochs=14, lr=0.05, rows_per_task=750, patience=20, numerical_preprocessing="standardization", output_l2=1e-4).fit(df.drop("k"), "y")
    m = e.model
    assert m.temperature < 0.02 and np.mean([c == ["c"] for c in m._trees().chosen(m.params)]) > 0.6
    start = NeuralModel("nodegam", num_trees=12, depth=2)
    start._build(e.pre, 1)
    assert np.mean([c == ["c"] for c in start._trees().chosen(start.params)]) < 0.6
    assert e.evaluate(df)["mse"] < 0.35 * pdf["y"].var()
    terms = [c for c in e.contributions(df).columns if c.startswith("f_")]
    assert "f_c" in terms
    again = NeuralModel.from_json(m.to_json())
    want = e.contributions(df).agg(F.sum("output")).first()[0]
    assert np.isclose(again.transform(e.pre.transform(df), e.pre).agg(F.sum("output")).first()[0], want)


def test_fits_do_not_depend_on_partitions(spark, five):
    df, _ = five
    pre = Preprocessor(numerical_preprocessing="standardization").fit(df.drop("k"), "y")
    found = []
    for n in (1, 5):
        m = NeuralModel("nam", hidden=(8,), max_epochs=2, rows_per_task=400)
        m.fit(pre.transform(df.drop("k").repartition(n), ("y",)), "y", pre)
        found.append(m)
    assert all(np.allclose(found[0].params[k], found[1].params[k]) for k in found[0].params) and len(found[0].history) == 2


@pytest.mark.parametrize("options", [{"norm": "batch", "activation": "glu"}, {"norm": "rms", "activation": "reglu"}, {"norm": "layer", "skip_connections": True}])
def test_blocks_of_networks(spark, five, options, tmp_path):
    df, pdf = five
    path = str(tmp_path / "best")
    e = Regressor("nam", hidden=(16, 16), max_epochs=6, lr=0.02, rows_per_task=750, checkpoint=path, numerical_preprocessing="standardization", **options).fit(df.drop("k"), "y")
    assert e.evaluate(df)["mse"] < 0.8 * pdf["y"].var()
    kept = NeuralModel.from_json(spark.read.parquet(path).first()["state"])
    assert all(np.allclose(kept.params[k], e.model.params[k]) for k in kept.params)
    before = {k: v.copy() for k, v in e.model.params.items()}
    e.model.max_epochs = 1
    e.model.freeze("a.", "b.").fit(e.pre.transform(df, ("y",)), "y", e.pre, go_on=True)
    moved = {k for k in before if not k.endswith("running") and not np.allclose(before[k], e.model.params[k])}
    assert moved and not any(k.startswith(("a.", "b.")) for k in moved)
    told = {r["parameter"]: r["trained"] for r in e.model.summary(spark).collect()}
    assert set(told) == set(before) and not told["a.0.w"] and told["c.0.w"]


def test_interactions_of_bases_and_dropout_in_attention(spark, five):
    df, pdf = five
    small = df.select("a", "c", "y", F.format_string("g%d", F.col("k")).alias("g"))
    e = Regressor("nbm", interaction_degree=2, num_bases=6, hidden=(8,), max_epochs=2, rows_per_task=750, numerical_preprocessing="standardization").fit(small.drop("g"), "y")
    assert "f_a:c" in e.contributions(small).columns and "mix.a:c.w" in e.model.params
    e = ESTIMATORS["NAMformerRegressor"](d_model=8, attention_dropout=0.2, token_norm=True, token_activation=True, max_epochs=3, lr=0.02, rows_per_task=750).fit(small, "y")
    assert e.evaluate(small)["mse"] < pdf["y"].var()


def test_three_classes_of_tabulated_trees_and_a_norm_hook(spark, five):
    df, pdf = five
    seen = []

    def hook(d):
        seen.append(1)
        return d.withColumn("c", F.col("c") * 10)

    e = ESTIMATORS["NodeGAMClassifier"](n_estimators=40, norm_fn=hook).fit(df.drop("y"), "k")
    assert e.evaluate(df)["accuracy"] > 0.97 and seen
    p = e.predict_proba(df).select("probabilities").toPandas()["probabilities"]
    assert np.allclose([sum(v) for v in p], 1) and len(p[0]) == 3
    again = type(e.model).from_json(e.model.to_json())
    assert np.isclose(again.transform(hook(df)).agg(F.sum("output")).first()[0], e.contributions(df).agg(F.sum("output")).first()[0])
    two = Classifier("nodegam", n_estimators=40).fit(df.drop("y").where("k < 2"), "k")
    assert two.evaluate(df.where("k < 2"))["accuracy"] > 0.97


def test_a_fit_reads_its_input_once(spark):
    """The hash that sets rows aside is made once, and no job counts rows that another has counted."""
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            read.add(batch.num_rows)
            x = batch.column("id").to_numpy() / 500.0
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.where(x > 1, "a", "b")), pa.array(np.sin(x))], ["x", "c", "y"])

    df = spark.range(0, 1000, 1, 4).mapInArrow(rows, "x double, c string, y double")
    e = ESTIMATORS["NAMRegressor"](cat_cutoff=2, hidden=(4,), max_epochs=2).fit(df, "y")
    assert read.value == 1000 and len(e.model.history) == 2


def test_constants_have_no_gradient():
    x, w = Var(np.ones((3, 2)), constant=True), Var(np.ones((2, 1)))
    b = Var(np.zeros(1))
    masked = (x * 2.0).affine(w, b).dropped(np.array([[1.0], [0.0], [1.0]]))
    masked.sum(0).backward(np.ones(1))
    assert x.grad is None and np.allclose(w.grad, 4.0) and np.allclose(b.grad, 2.0)
