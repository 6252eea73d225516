"""Boosted tables for distribution families and wide categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.plans.boosted import MOST_CATEGORIES, BoostedFamily, TabulatedGam
from terrace.plans.estimator import Lss


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.uniform(-2, 2, 1500), "z": rng.uniform(0, 1, 1500), "c": rng.choice(list("abc"), 1500)})
    shape, mean = np.where(pdf.z > 0.5, 8.0, 2.0), np.exp(np.sin(2 * pdf.x) + (pdf.c == "a"))
    pdf["y"] = rng.gamma(shape, mean / shape) + 1e-3
    return spark.createDataFrame(pdf), pdf


def test_gamma_boosting_is_at_least_as_good_as_linear(spark, skewed):
    """Both of a gamma's parameters are functions of features, not linear ones."""
    df, _ = skewed
    linear = Lss("linreg", family="gamma").fit(df, "y").evaluate(df)
    boosted = Lss("boosted", family="gamma", n_bins=16, n_estimators=30).fit(df, "y")
    got = boosted.evaluate(df)
    assert got["nll"] < linear["nll"] - 0.05
    h = boosted.model.history
    assert all(b < a for a, b in zip(h, h[1:], strict=False)) and np.isclose(h[-1], got["nll"], rtol=1e-6)
    again = BoostedFamily.from_json(boosted.model.to_json())
    a, b = (m.transform(df).select("x", "raw").orderBy("x").toPandas()["raw"].tolist() for m in (boosted.model, again))
    assert np.allclose(np.array([list(v) for v in a]), np.array([list(v) for v in b]))


def test_partitions_change_nothing(spark, skewed):
    df, _ = skewed
    fit = lambda d: BoostedFamily({"n_bins": 8, "n_estimators": 10}, Lss(family="normal").family, rounds=2).fit(d, "y", ["x", "z"], ["c"])
    a, b = fit(df), fit(df.repartition(7))
    assert np.allclose(a.history, b.history, rtol=1e-6) and all(np.allclose(a.models[k].mains["x"], b.models[k].mains["x"], atol=1e-6) for k in (0, 1))


def test_categories_beyond_the_bound_share_a_bin(spark):
    df = spark.range(6000).select(F.concat(F.lit("c"), F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(F.col("id"))).alias("c"), (F.col("id") % 10 * 1.0).alias("y"))
    m = TabulatedGam(n_estimators=20).fit(df, "y", [], ["c"])
    assert len(m.categories["c"]) == MOST_CATEGORIES and m.size["c"] == MOST_CATEGORIES + 1
    assert {"c0", "c2", "c4", "c6", "c8"} <= set(m.categories["c"])
    assert m.transform(df).where("output IS NULL").count() == 0
