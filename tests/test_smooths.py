"""Thin plates in tiles, terms of a GAM, regions by conjugate gradients, smoothing by quasi-Newton: against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace import queries
from terrace.operators import thinplate
from terrace.operators.splines import scale_penalty, sum_to_zero
from terrace.plans.gam import Gam
from terrace.plans.region import RegionGam
from terrace.plans.smooths import Cubic, Plate, Region
from terrace.queries import QUERIES


def in_order(rows, d):
    return rows[np.lexsort(rows[:, d - 1 :: -1].T if d > 1 else rows[:, :1].T)]


@pytest.mark.parametrize(("u", "d"), [(300, 2), (150, 1)])
def test_tiles_give_the_basis_of_the_driver(spark, u, d):
    """The same eigenvectors up to sign, the same penalty, and the same effects at new rows; repeated rows weigh in both."""
    rng = np.random.default_rng(u)
    x = rng.uniform(0, 1, (u, d))
    names = list("ab"[:d])
    df = spark.createDataFrame(pd.DataFrame(np.vstack([x, x[:40], x[:40]]), columns=names)).unionByName(spark.createDataFrame([(None,) * d], ", ".join(f"{c} double" for c in names)))
    whole, tiled = thinplate.fit(df, names, 8), thinplate.fit(df, names, 8, local=1, tile=64)
    assert isinstance(tiled, thinplate.TiledThinPlate) and tiled.u == len(whole.knots) == u
    got = in_order(np.array([[*r[:d], *r[d]] for r in tiled.at_knots(df, names).collect()]), d)
    sign = np.sign((got[:, d:] * whole.basis).sum(0))
    assert np.allclose(got[:, :d], whole.knots) and np.allclose(got[:, d:] * sign, whole.basis, atol=1e-6)
    assert np.allclose(tiled.penalty * np.outer(sign, sign), whole.penalty, rtol=1e-5, atol=1e-6)
    assert np.allclose(whole.rows(whole.knots), whole.basis, atol=1e-6)
    c, new = rng.normal(size=8), spark.createDataFrame(pd.DataFrame(rng.uniform(-0.2, 1.2, (9, d)), columns=names))
    effect = lambda s, v: [r["e"] for r in s.with_effect(new, [F.col(n) for n in names], v, "e").collect()]
    assert np.allclose(effect(whole, c), effect(tiled, c * sign), atol=1e-6)
    delta, alpha = whole.uncentred(c)
    assert len(delta) == u and np.allclose(thinplate.radial(thinplate.distances(whole.knots, whole.knots), 2, d) @ delta + thinplate.free(whole.knots, whole.powers) @ alpha, whole.basis @ c, atol=1e-6)
    grid = thinplate.plot_grid(tiled, df, names, c * sign, 7)
    assert grid.count() == 7**d and grid.columns == [*names, "effect"]


def test_evaluation_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 1, (200, 2)), columns=["a", "b"]))
    s, c = thinplate.fit(df, ["a", "b"], 6, local=1, tile=64), rng.normal(size=6)
    run = lambda: [r["e"] for r in s.with_effect(df, [F.col("a"), F.col("b")], c, "e").orderBy("a").collect()]
    one = run()
    monkeypatch.setattr(thinplate, "SENT", 1)
    assert len(s._groups()) == 4 and np.allclose(run(), one, atol=1e-9)


def test_thin_plate_query_beyond_the_driver(spark, tmp_path):
    """More distinct rows than the driver decomposes: the query's rows are those of numpy."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"s_suppkey": np.arange(2300), "s_acctbal": np.round(rng.uniform(-999, 9999, 2300), 2), "s_nationkey": rng.integers(0, 25, 2300)})
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/supplier.parquet")
    x = np.stack([pdf.s_acctbal / 10_000, pdf.s_nationkey / 25.0], 1)
    knots, at, n = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    assert len(knots) > thinplate.LOCAL
    found = QUERIES["thin_plate_basis"](spark, str(tmp_path)).toPandas().sort_values(["s_suppkey", "pos"])["value"].to_numpy().reshape(-1, 6)
    assert np.allclose(found, np.abs(thinplate.ThinPlate(knots, 6, 2, n).basis[at.ravel()]), atol=2e-6)


def penalised(y, blocks, lambdas):
    """Fitted values and hat matrix of an intercept and centred blocks (basis, penalty)."""
    z, at, parts = [np.ones((len(y), 1))], 1, []
    for b, s in blocks:
        q = sum_to_zero(b.mean(0))
        z.append(b @ q)
        parts.append((at, q.T @ scale_penalty(s, np.abs(b).sum(1).max()) @ q))
        at += q.shape[1]
    z = np.hstack(z)
    p = np.zeros((at, at))
    for (a, s), lam in zip(parts, lambdas, strict=True):
        p[a : a + len(s), a : a + len(s)] = lam * s
    hat = z @ np.linalg.pinv(z.T @ z + p, hermitian=True) @ z.T
    return hat @ y, hat


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.uniform(0, 1, 300).round(2), "b": rng.uniform(0, 1, 300).round(2), "x": rng.normal(size=300), "cell": rng.integers(0, 12, 300)})
    pdf["y"] = np.sin(5 * pdf.a) * pdf.b + 0.3 * pdf.x**2 + (pdf.cell % 4) * 0.5 + rng.normal(0, 0.1, 300)
    grid = [(a, b) for a in range(16) for b in range(16) if abs(a // 4 - b // 4) + abs(a % 4 - b % 4) == 1]  # 16 cells, four without rows
    return spark.createDataFrame(pdf), pdf, spark.createDataFrame(grid, "region_a long, region_b long"), grid


@pytest.mark.parametrize("local", [thinplate.LOCAL, 1])
def test_gam_with_a_thin_plate(spark, places, local):
    df, pdf, _, _ = places
    lam = [0.5, 2.0]
    g = Gam([Plate(["a", "b"], 9, local=local, tile=64), "x"], k=6).fit(df, "y", lam)
    x = pdf[["a", "b"]].to_numpy()
    knots, n = np.unique(x, axis=0, return_counts=True)
    plate = thinplate.ThinPlate(knots, 9, 2, n)
    want, hat = penalised(pdf.y.to_numpy(), [(plate.rows(x), plate.penalty), (g.splines[0].rows(pdf.x.to_numpy()), g.splines[0].penalty)], lam)
    got = g.transform(df).select("a", "b", "x", "output").toPandas()
    assert np.allclose(got["output"], want, atol=1e-5)
    assert np.isclose(g.edf, np.trace(hat), rtol=1e-6) and g.summary(spark).count() == 2
    if local > 1:
        again = Gam.from_json(g.to_json())
        assert np.allclose(again.transform(df).toPandas()["output"], want, atol=1e-5)
        assert g.terms[0].grid(df, g.values(0), 5).count() == 25
    else:
        with pytest.raises(ValueError, match="tiles"):
            g.to_json()


def laplacian(grid, n):
    s = np.zeros((n, n))
    for a, b in grid:
        s[a, b] -= 1
        s[a, a] += 1
    return s


def test_gam_with_regions(spark, places):
    df, pdf, edges, grid = places
    lam = [0.7, 1.5]
    unit = np.eye(16)[pdf.cell]
    g = Gam([Region("cell", edges), Cubic("x", 6)]).fit(df, "y", lam)
    want, _ = penalised(pdf.y.to_numpy(), [(unit, laplacian(grid, 16)), (g.splines[0].rows(pdf.x.to_numpy()), g.splines[0].penalty)], lam)
    assert np.allclose(g.transform(df).toPandas()["output"], want, atol=1e-7)
    assert np.allclose(Gam.from_json(g.to_json()).transform(df).toPandas()["output"], want, atol=1e-7)
    tables = RegionGam(Region("cell", edges), ["x"], k=6).fit(df, "y", 0.7, [1.5])
    got = tables.transform(df).select("x", "y", "output").toPandas().sort_values(["x", "y"])
    assert np.allclose(got["output"], want[np.lexsort((pdf.y, pdf.x))], atol=1e-6)
    effects = {r["region"]: r["effect"] for r in tables.effects.collect()}
    at = g.values(0)
    assert len(effects) == 16 and np.allclose([effects[i] for i in range(16)], at, atol=1e-6)
    rough = tables.laplacian_effects().toPandas()["rough"]
    assert abs(rough.sum()) < 1e-9 and rough.abs().max() > 0


def test_regions_alone_and_more_than_the_driver_takes(spark, monkeypatch):
    from terrace.plans import smooths

    n = 40
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in (a - 1, a + 1) if 0 <= b < n], "region_a long, region_b long")
    df = spark.range(n * 5).select((F.col("id") % n).alias("cell"), F.sin(F.col("id") * 1.7).alias("y"))
    pdf = df.toPandas()
    g = RegionGam(Region("cell", edges)).fit(df, "y", 2.0)
    want, _ = penalised(pdf.y.to_numpy(), [(np.eye(n)[pdf.cell], laplacian([(a, b) for a in range(n) for b in (a - 1, a + 1) if 0 <= b < n], n))], [2.0])
    got = g.transform(df).select("cell", "output").distinct().toPandas().sort_values("cell")["output"]
    assert np.allclose(got, [want[pdf.index[pdf.cell == c][0]] for c in range(n)], atol=1e-7)
    monkeypatch.setattr(smooths, "DENSE", 10)
    with pytest.raises(ValueError, match="RegionGam"):
        Gam([Region("cell", edges)]).fit(df, "y")


def test_smoothing_is_at_the_best_of_a_grid(spark):
    """Ten terms: the gradient equals differences, and no point of a fine grid around the optimum, nor any common parameter, scores lower."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.uniform(0, 1, (400, 10)), columns=[f"x{i}" for i in range(10)])
    pdf["y"] = np.sin(6 * pdf.x0) + pdf.x1**2 + np.exp(pdf.x2) * 0.3 + rng.normal(0, 0.3, 400)
    g = Gam([f"x{i}" for i in range(10)], k=6).fit(spark.createDataFrame(pdf), "y")
    log = np.log(g.lambdas)
    at = np.clip(log, -5, 5)
    value, slope = g._score(at)
    assert np.isclose(value, g.gcv(np.exp(at)))
    for j in range(10):
        step = np.eye(10)[j] * 1e-5
        assert np.isclose((g._score(at + step)[0] - g._score(at - step)[0]) / 2e-5, slope[j], rtol=1e-3, atol=1e-9)
    best = g.gcv()
    for j in range(10):
        for v in np.linspace(-16, 16, 65):
            other = log.copy()
            other[j] = v
            assert best <= g.gcv(np.exp(other)) * (1 + 1e-9)
    assert all(best <= g.gcv([np.exp(v)] * 10) * (1 + 1e-9) for v in np.linspace(-16, 16, 129))


def test_purification_until_it_settles(spark, monkeypatch):
    """Unbalanced counts and cells that are missing: numpy's result; frames equal the table where that fits the driver, and need no bound."""
    from terrace.operators import effects

    rng = np.random.default_rng(9)
    n = rng.integers(0, 6, (12, 9)) * (rng.random((12, 9)) < 0.6)
    n[np.arange(12), np.arange(12) % 9] += 1
    n[np.arange(9), np.arange(9)] += 1
    y = rng.normal(size=n.shape)
    rows = [("a:b", float(i), float(j), int(n[i, j]), float(y[i, j])) for i, j in zip(*np.nonzero(n), strict=True)]
    cells, axes = effects.purify_converged(spark.createDataFrame(rows, "term string, x1 double, x2 double, n long, y double"), 1e-9)
    want, u, w = effects.purify(np.where(n > 0, y, 0), n, 1e-9)
    got = {(int(r["x1"]), int(r["x2"])): r["y"] for r in cells.collect()}
    assert all(np.isclose(got[i, j], want[i, j], atol=1e-6) for i, j in got) and len(got) == (n > 0).sum()
    effect = {(r["axis"], int(r["x"])): r["effect"] for r in axes.collect()}
    assert np.isclose(effect[0, 3] + effect[1, 2], u[3] + w[2], atol=1e-6)
    df = spark.createDataFrame([(float(i), float(j), float(y[i, j])) for i, j in zip(*np.nonzero(n), strict=True) for _ in range(n[i, j])], "a double, b double, e double")
    options = ({"a": F.col("a") * 0.1, "b": None}, {"a:b": F.col("e")}, 2.0)
    table = effects.effect_table(df, ["a", "b"], *options, tol=1e-9).set_index("feat_name")
    monkeypatch.setattr(effects, "MAX_CELLS", 5)
    with pytest.raises(ValueError, match="effect_frames"):
        effects.effect_table(df, ["a", "b"], *options)
    main, pair, offset = effects.effect_frames(df, *options, tol=1e-9)
    assert np.isclose(offset.first()["y"], table.loc["offset", "y"][0], atol=1e-6)
    assert np.allclose([r["y"] for r in main.where("term = 'a'").orderBy("x").collect()], table.loc["a", "y"], atol=1e-6)
    assert pair.count() == (n > 0).sum()


def test_products_near_and_far(spark):
    """A step multiplies near tiles row by row and distant boxes by their nodes: the dense product, with most pairs of tiles never met."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (4000, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).selectExpr("a", "b", "1D AS _n")
    cuts = thinplate._cuts(df, ["a", "b"], len(x), 64)
    state = thinplate._packed(df, ["a", "b"], 63, 3, cuts)
    boxes = thinplate._boxes(state, 2, len(cuts[0]) + 1)
    assert boxes.leaves == 64 and sum(map(len, boxes.near.values())) < 64 * 64 / 3
    rows = [(np.frombuffer(s["x"]).reshape(-1, 2), np.frombuffer(s["q"]).reshape(-1, 3)) for s in state.collect()]
    found = thinplate._multiplied_near_and_far(state, boxes, 2, 2, 3).collect()
    assert sorted(r["tile"] for r in found) == list(range(64))
    for r in found:
        if r["tile"] in (0, 21, 63):
            dense = sum(thinplate.radial(thinplate.distances(np.frombuffer(r["x"]).reshape(-1, 2), at), 2, 2) @ v for at, v in rows)
            assert np.allclose(np.frombuffer(r["w"]).reshape(-1, 3), dense, atol=1e-11)


def test_ties_of_fitted_moments(spark):
    """24.556925 is the moment of sf0.001: a fit may come out on either side of it."""
    rows = spark.createDataFrame([(24.556925 + e,) for e in (-1e-10, 0.0, 1e-10)] + [(24.55692,), (-1.2345649,)], "v double")
    assert [r[0] for r in rows.select(queries.settled(F.col("v"))).collect()] == [24.55693, 24.55693, 24.55693, 24.55692, -1.23456]
