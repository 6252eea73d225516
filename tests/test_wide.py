"""Columns of very many categories in linear and neural shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrace.plans.estimator import WIDE_RIDGE, Classifier, Regressor


def test_wide_column_equals_ridge_regression(spark):
    """The effects and the slope are those of one least-squares problem with a one-hot block that is shrunk."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"c": rng.integers(0, 60, 600), "x": rng.normal(size=600)})
    effect = rng.normal(size=60)
    pdf["y"] = effect[pdf.c] + 0.7 * pdf.x + 0.2 * pdf.c / 60 * pdf.x + rng.normal(0, 0.1, 600)
    pdf["c"] = "k" + pdf.c.astype(str)
    df = spark.createDataFrame(pdf)
    e = Regressor("linreg", literals=20, ridge=0.0, numerical_preprocessing="none").fit(df, "y")
    names = sorted(pdf.c.unique())
    z = np.column_stack([np.ones(600), pdf.x, (pdf.c.to_numpy()[:, None] == np.array(names)).astype(float)])
    a = z.T @ z + np.diag([0, 0, *[WIDE_RIDGE] * len(names)])
    want = z @ np.linalg.solve(a, z.T @ pdf.y)
    got = e.predict(df).select("c", "x", "y", "prediction", "f_c").toPandas().sort_values(["x", "y"])
    assert np.allclose(got["prediction"], want[np.lexsort((pdf.y, pdf.x))], atol=5e-3)
    new = spark.createDataFrame([("never seen", 0.0), (None, 0.0)], "c string, x double")
    assert [r["f_c"] for r in e.predict(new).collect()] == [0.0, 0.0]
    with pytest.raises(ValueError, match="boosted"):
        Classifier("linreg", literals=20).fit(df.withColumn("y", (F.col("y") > 0).cast("int")), "y")


@pytest.mark.parametrize(("shape", "more"), [("linreg", {}), ("nam", {"max_epochs": 2, "hidden": (8,)})])
def test_a_hundred_thousand_categories(spark, shape, more):
    df = spark.range(200_000).select(F.concat(F.lit("c"), F.col("id") % 100_000).alias("c"), F.rand(1).alias("x"), (F.col("id") % 7 + F.rand(1)).alias("y"))
    e = Regressor(shape, literals=20_000, **more).fit(df, "y")
    assert e.wide["c"].count() > 79_000
    assert e.evaluate(df)["mse"] < 3.0 < df.agg(F.var_pop("y")).first()[0]


def test_epochs_are_shuffled_on_executors(spark, monkeypatch):
    """The same order and batches whatever the partitions and ranges, another one each epoch, every row once; one row by its place."""
    from terrace.sources import tables

    df = spark.range(500).select((F.col("id") % 250).alias("a"), (F.col("id") % 3).alias("b"))
    order = lambda d, epoch: [(r["a"], r["b"]) for r in tables.shuffled(d, epoch).orderBy("_index").collect()]
    one = order(df, 0)
    monkeypatch.setattr(tables, "RANGE_ROWS", 40)
    assert order(df.repartition(7), 0) == one and order(df, 1) != one and sorted(order(df, 1)) == sorted(one)
    indexed = tables.shuffled(df, 0)
    assert sorted(r["_index"] for r in indexed.collect()) == list(range(500))
    assert tuple(tables.row_at(indexed, 123).first())[:2] == one[123]
    got = tables.map_batches(df, 64, lambda b: pd.DataFrame({"batch": b["_batch"][:1], "n": [len(b)], "first": b["a"][:1]}), "batch long, n long, first long", 0).orderBy("batch").collect()
    assert [r["n"] for r in got] == [64] * 7 + [52] and [r["first"] for r in got] == [one[64 * k][0] for k in range(8)]
    assert tables.shuffled(df.limit(0)).count() == 0
