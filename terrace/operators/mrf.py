"""Smooths over regions: neighbours are regions whose polygons share a vertex, the penalty is their graph's Laplacian."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators import encoders


def neighbours(vertices: DataFrame) -> DataFrame:
    """(region_a, region_b, shared) from (region, vx, vy), both ways round: an equality join on vertices, as regions that share one overlap."""
    v = vertices.select("region", "vx", "vy").dropna().distinct()
    a, b = v.withColumnRenamed("region", "region_a"), v.withColumnRenamed("region", "region_b")
    return a.join(b, ["vx", "vy"]).where("region_a <> region_b").groupBy("region_a", "region_b").agg(F.count("*").alias("shared"))


def laplacian(vertices: DataFrame) -> DataFrame:
    """(region_a, region_b, value): -1 for neighbours and their number on the diagonal, also 0 for regions without any."""
    edges = neighbours(vertices)
    degree = edges.groupBy("region_a").agg(F.count("*").alias("value"))
    every = vertices.select(F.col("region").alias("region_a")).where("region_a is not null").distinct()
    diagonal = every.join(degree, "region_a", "left").select("region_a", F.col("region_a").alias("region_b"), F.coalesce("value", F.lit(0)).cast("double").alias("value"))
    return edges.select("region_a", "region_b", F.lit(-1.0).alias("value")).unionByName(diagonal)


def penalty(vertices: DataFrame) -> tuple[list, np.ndarray]:
    """(regions in order, Laplacian matrix); a row a region and neighbour comes to the driver."""
    rows = laplacian(vertices).collect()
    regions = sorted({r["region_a"] for r in rows})
    at = {r: i for i, r in enumerate(regions)}
    out = np.zeros((len(regions), len(regions)))
    for r in rows:
        out[at[r["region_a"]], at[r["region_b"]]] = r["value"]
    return regions, out


def indicator(region: Column, regions: list) -> Column:
    """The unit vector of a region; zeros for one that is not known."""
    code = encoders.ordinal(region, [str(r) for r in regions])
    return F.slice(encoders.one_hot_ordinal(code, len(regions)), 2, len(regions))
