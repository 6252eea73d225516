"""Learned knots, hard oblique trees and shape functions of a user's own."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from terrace.operators.splines import CubicSpline
from terrace.plans import layers
from terrace.plans.autodiff import Var
from terrace.plans.estimator import SHAPES, Classifier, Lss, Regressor, register_shape
from terrace.sources.tables import load_state, save_state


def differences(f, x, step=1e-6):
    out = np.zeros(x.size)
    for i in range(x.size):
        d = np.zeros(x.size)
        d[i] = step
        out[i] = (f(x + d.reshape(x.shape)) - f(x - d.reshape(x.shape))) / (2 * step)
    return out.reshape(x.shape)


def test_gradients_by_knots():
    """The basis (inside and beyond the knots), its roughness and the knots' closeness, and knots by distances, equal differences."""
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 1, 7))
    x, g, w = rng.uniform(t[0] - 0.2, t[-1] + 0.2, 60), rng.normal(size=(60, 7)), rng.normal(size=(7, 2))
    v = Var(t)
    (layers.basis(x, v) * g).reshape(-1).sum(0).backward(np.array(1.0))
    assert np.allclose(v.grad, differences(lambda k: (CubicSpline(k).rows(x) * g).sum(), t), rtol=1e-4, atol=1e-4)
    v, u = Var(t), Var(w)
    layers.roughness(v, u).backward(np.array(1.0))
    assert np.allclose(v.grad, differences(lambda k: np.einsum("io,ij,jo->", w, CubicSpline(k).penalty, w), t, 1e-7), rtol=1e-3)
    assert np.allclose(u.grad, differences(lambda k: np.einsum("io,ij,jo->", k, CubicSpline(t).penalty, k), w), rtol=1e-4, atol=1e-3)
    v = Var(t)
    layers.closeness(v).backward(np.array(1.0))
    assert np.allclose(v.grad, differences(lambda k: (1 / np.diff(k)).sum(), t, 1e-8), rtol=1e-3)
    d, c = rng.normal(size=6), rng.normal(size=7)
    v = Var(d)
    (layers.knots(v, -1.0, 3.0) * c).sum(0).backward(np.array(1.0))
    assert np.allclose(v.grad, differences(lambda k: layers.knots(Var(k), -1.0, 3.0).value @ c, d), atol=1e-6)
    k = layers.knots(Var(d), -1.0, 3.0).value
    assert k[0] == -1 and k[-1] == 3 and (np.diff(k) > 0).all()


def test_hard_trees_route_and_point_downhill():
    rng = np.random.default_rng(2)
    split, leaf = layers.start_trees(rng, 3, 2, 4, 2)
    leaf = rng.normal(size=leaf.shape)
    x = rng.normal(size=(50, 2))
    want = np.zeros((50, 2))
    for r, row in enumerate(x):
        for t in range(3):
            node = 0
            for _ in range(4):
                node = 2 * node + (1 if np.append(1, row) @ split[t, :, node] > 0 else 2)
            want[r] += leaf[t, node - 15]
    s, v = Var(split), Var(leaf)
    out = layers.hard_trees(x, s, v)
    assert np.allclose(out.value, want)
    g = rng.normal(size=want.shape)
    (out * g).reshape(-1).sum(0).backward(np.array(1.0))
    assert np.allclose(v.grad, differences(lambda k: (layers.hard_trees(x, Var(split), Var(k)).value * g).sum(), leaf), atol=1e-5)
    # a soft node of one tree has the surrogate as its own gradient
    one, ends = np.array([[[0.3], [1.0]]]), rng.normal(size=(1, 2, 1))
    z, h = rng.normal(size=(40, 1)), rng.normal(size=(40, 1))
    soft = lambda w: (h[:, 0] * (ends[0, 1, 0] + (ends[0, 0, 0] - ends[0, 1, 0]) / (1 + np.exp(-4 * (w[0, 0, 0] + z[:, 0] * w[0, 1, 0]))))).sum()
    s = Var(one)
    (layers.hard_trees(z, s, Var(ends)) * h).reshape(-1).sum(0).backward(np.array(1.0))
    assert np.allclose(s.grad, differences(soft, one), atol=1e-5)


def test_knots_move_to_a_kink(spark):
    """A line that turns at 0.8: learned knots come closer to it than even ones, and fit better."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 1500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.where(x > 0.8, 12 * (x - 0.8), 0.0)}))
    fit = lambda learn: Regressor("spline", knots=5, learn_knots=learn, max_epochs=30, lr=0.03, patience=30, knot_penalty=1e-5, smooth_penalty=1e-7).fit(df, "y", validation=df)
    free, fixed = fit(True), fit(False)
    near = lambda e: np.abs(e.model.learned_knots("x") - 0.8).min()
    assert near(free) < 0.03 < near(fixed) + 1e-9
    assert free.evaluate(df)["mse"] < 0.5 * fixed.evaluate(df)["mse"]


def test_oblique_trees_beat_stumps_on_steps(spark):
    """Depth 8, 64 trees; rows dealt otherwise give the same fit."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.normal(size=500)})
    pdf["y"] = np.floor(2 * pdf.a) + (np.abs(pdf.b) > 0.7)
    df = spark.createDataFrame(pdf)
    fit = lambda d, **more: Regressor("oblique", max_epochs=4, lr=0.05, batch_size=100, numerical_preprocessing="none", **more).fit(d, "y", val_size=0.0)
    whole = fit(df)
    assert whole.model.params["a.split"].shape == (64, 2, 255)
    mse = whole.evaluate(df)["mse"]
    assert mse < 0.6 * fit(df, depth=1, num_trees=1).evaluate(df)["mse"] and mse < 0.5 * pdf.y.var()
    again = fit(df.repartition(5))
    assert np.allclose(again.model.params["b.leaf"], whole.model.params["b.leaf"])


def test_a_shape_of_ones_own(spark, tmp_path):
    """A sine a feature, from outside the package: fits, predicts, is saved and loaded, for all tasks."""

    def start(rng, widths, outputs):
        return {f"{n}.{k}": rng.normal(1, 0.1, (w, outputs)) for n, w in widths.items() for k in ("amplitude", "frequency")}

    def forward(p, blocks, rng):
        out = {}
        for n, x in blocks.items():
            z = x @ p[f"{n}.frequency"]
            sine = Var(np.sin(z.value), ((z, lambda g, z=z: g * np.cos(z.value)),))
            out[n] = sine * p[f"{n}.amplitude"].sum(0).reshape(1, -1)
        return out

    register_shape("sine", layers.Shape(start, forward), max_epochs=12, lr=0.05)
    with pytest.raises(ValueError, match="already"):
        register_shape("nam", layers.Shape(start, forward))
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.normal(size=600)})
    pdf["y"] = 2 * np.sin(1.5 * pdf.x)
    pdf["k"] = (pdf.y > 0).astype(int)
    df = spark.createDataFrame(pdf)
    e = Regressor("sine").fit(df.drop("k"), "y", validation=df.drop("k"))
    assert e.evaluate(df)["mse"] < 0.1 and "f_x" in e.predict(df).columns
    assert Classifier("sine").fit(df.drop("y"), "k").evaluate(df)["accuracy"] > 0.95
    assert Lss("sine", family="normal").fit(df.drop("k"), "y").predict(df).columns[-2:] == ["mean", "scale"]
    save_state(spark, str(tmp_path / "m"), e.pre, e.model)
    _, again = load_state(spark, str(tmp_path / "m"))
    assert np.allclose(again.params["x.frequency"], e.model.params["x.frequency"])
    del SHAPES["sine"], layers.REGISTRY["sine"]
