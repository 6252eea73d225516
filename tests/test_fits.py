"""Fits of the additive shapes on raw features against least squares and closed forms in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers import run_sql, same

from terrace.operators.splines import scale_penalty
from terrace.oracles import ORACLES
from terrace.plans.estimator import ESTIMATORS, Regressor
from terrace.queries import QUERIES


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x, z = rng.uniform(0, 3, 300), rng.choice(list("abc"), 300)
    pdf = pd.DataFrame({"x": x, "z": z, "y": np.sin(2 * x) + 1.5 * (z == "b") + rng.normal(0, 0.1, 300)})
    return spark.createDataFrame(pdf).cache(), pdf


def _solved(z: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Fitted values of penalised least squares, the intercept left free."""
    z, full = np.hstack([np.ones((len(z), 1)), z]), np.zeros((1 + z.shape[1], 1 + z.shape[1]))
    full[1:, 1:] = penalty
    return z @ np.linalg.lstsq(z.T @ z + full, z.T @ y, rcond=1e-12)[0]


def test_piecewise_linear_fit_is_least_squares(spark, data):
    """The flagship's path: a fitted preprocessor makes blocks in numpy, and none of its methods is hidden by what the fit sets."""
    df, pdf = data
    e = Regressor("linreg", numerical_preprocessing="ple", n_bins=5).fit(df.drop("z"), "y")
    assert e.pre.row_count == 300 and not [a for a in vars(e.pre) if callable(getattr(type(e.pre), a, None))]
    z = np.stack(e.pre.transform(df).toPandas()["num_x"].to_numpy())
    assert np.allclose(e.predict(df).toPandas().prediction, _solved(z, pdf.y, 1e-6 * np.eye(z.shape[1])), atol=1e-6)
    assert len(e.effect_table(df).set_index("feat_name").loc["x"].x) == 300


def test_gaussian_process_fit_is_ridge_regression(spark, data):
    df, pdf = data
    e = ESTIMATORS["GPNAMRegressor"](random_features=8).fit(df, "y")
    u = ((pdf.x - pdf.x.min()) / (pdf.x.max() - pdf.x.min())).to_numpy()
    z = np.hstack([u[:, None], e.model.rff.rows(u), pd.get_dummies(pdf.z).to_numpy(float)])
    assert np.allclose(e.predict(df).toPandas().prediction, _solved(z, pdf.y, 1e-3 * np.eye(z.shape[1])), atol=1e-6)


def test_one_line_is_fitted_exactly(spark, tiny):
    """Slope and intercept without a ridge, with gaps that the mean fills; and SQL's on a larger table."""
    x, y = np.array([1.0, 2.0, 4.0, 7.0, 9.5]), np.array([3.0, 1.0, 8.0, 5.0, 12.0])
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).unionByName(spark.createDataFrame([(None, 2.0)], "x double, y double"))
    m = Regressor("linreg", numerical_preprocessing="none", ridge=0.0).fit(df, "y").model
    assert np.allclose(m.coefficients[0, ::-1], np.polyfit(np.append(x, x.mean()), np.append(y, 2.0), 1), rtol=1e-9)
    folder = tiny.replace("sf0.001", "sf0.01")
    same(QUERIES["linreg_fit_1d"](spark, folder).toPandas(), run_sql(folder, ORACLES["linreg_fit_1d"]))


def test_squared_error_of_a_line(spark, tiny):
    """Predictions of a fit are as far off as least squares; and as SQL's on a larger table."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": rng.normal(0, 1, 50), "y": rng.normal(3, 2, 50)})
    df = spark.createDataFrame(pdf)
    want = np.polyfit(pdf.x, pdf.y, 1, full=True)[1][0] / 50
    assert np.isclose(Regressor("linreg", numerical_preprocessing="none", ridge=0.0).fit(df, "y").evaluate(df)["mse"], want, rtol=1e-9)
    folder = tiny.replace("sf0.001", "sf0.01")
    same(QUERIES["linreg_mse"](spark, folder).toPandas(), run_sql(folder, ORACLES["linreg_mse"]))


def test_gamma_of_categories_alone_has_their_means(spark):
    """No numerical column, so no job of the fit counts rows: the likeliest gamma of each category has the category's mean."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"z": np.repeat(["F", "O", "P"], 200), "y": np.concatenate([rng.gamma(2.0, s, 200) for s in (0.5, 1.0, 2.0)])})
    df = spark.createDataFrame(pdf)
    e = ESTIMATORS["LinRegLSS"](family="gamma").fit(df, "y")
    assert e.pre.row_count is None
    out = e.predict(df).toPandas()
    assert np.allclose((out["shape"] / out["rate"]).groupby(out.z).first(), pdf.groupby("z").y.mean(), rtol=1e-2)


def test_spline_fit_has_the_least_gcv(spark, data):
    """The penalised fit with the smoothing of least GCV, by hat matrices over the same grid."""
    df, pdf = data
    e = ESTIMATORS["SNAMRegressor"](knots=6).fit(df, "y")
    u = ((pdf.x - pdf.x.min()) / (pdf.x.max() - pdf.x.min())).to_numpy()
    own = e.model.spline.rows(u)
    z = np.hstack([own, pd.get_dummies(pdf.z).to_numpy(float)])

    def scored(lam: float) -> tuple[float, np.ndarray]:
        pen = 1e-6 * np.eye(z.shape[1])
        pen[: own.shape[1], : own.shape[1]] += lam * scale_penalty(e.model.spline.penalty, np.abs(own).sum(1).max())
        hat = _solved(z, np.eye(300), pen)
        return ((pdf.y - hat @ pdf.y) ** 2).mean() / (1 - np.trace(hat) / 300) ** 2, hat @ pdf.y

    want = min((scored(10.0**k) for k in range(-6, 7)), key=lambda s: s[0])[1]
    assert np.allclose(e.predict(df).toPandas().prediction, want, atol=1e-6)
