"""Effects of additive models as tables: values and counts a term, purification of pairs, centring, importance and plot data.

Effects are functions of their features, so a group's value is its minimum. All main terms are one grouping (term, x), all pairs another,
whatever the number of rows; only tables of distinct values come to the driver, and only for purification, under a bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.operators import encoders
from terrace.sources.shared import removed, written

MAX_CELLS = 4_000_000


def main_effects(df: DataFrame, terms: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """(term, x, n, y) by distinct x, from {term: (x, contribution)}; a term without contribution has y = 0."""
    rows = F.array(*(F.struct(F.lit(t).alias("term"), x.cast("double").alias("x"), (y if y is not None else F.lit(0.0)).cast("double").alias("y")) for t, (x, y) in terms.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*").groupBy("term", "x").agg(F.count("*").alias("n"), F.min("y").alias("y"))


def pair_effects(df: DataFrame, terms: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """(term, x1, x2, n, y) by distinct pair, from {term: (x1, x2, contribution)}."""
    rows = F.array(*(F.struct(F.lit(t).alias("term"), a.cast("double").alias("x1"), b.cast("double").alias("x2"), y.cast("double").alias("y")) for t, (a, b, y) in terms.items()))
    return df.select(F.explode(rows).alias("r")).select("r.*").groupBy("term", "x1", "x2").agg(F.count("*").alias("n"), F.min("y").alias("y"))


def dense_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a row for every combination of a term's axis values, n and y 0 where there was none."""
    a, b = pairs.select("term", "x1").distinct(), pairs.select("term", "x2").distinct()
    return a.join(b, "term").join(pairs, ["term", "x1", "x2"], "left").select("term", "x1", "x2", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("y", F.lit(0.0)).alias("y"))


def seen_or_nonzero(cells: DataFrame) -> DataFrame:
    """Cells that were observed or have an effect."""
    return cells.where("y <> 0 OR n > 0")


def centred(mains: DataFrame) -> DataFrame:
    """``mains`` with each term's weighted mean taken out into ``offset``."""
    mean = F.sum(F.col("y") * F.col("n")).over(Window.partitionBy("term")) / F.sum("n").over(Window.partitionBy("term"))
    return mains.withColumn("offset", mean).withColumn("y", F.col("y") - F.col("offset"))


def importance(effects: DataFrame) -> DataFrame:
    """(term, importance): the weighted mean absolute effect."""
    return effects.groupBy("term").agg((F.sum(F.abs("y") * F.col("n")) / F.sum("n")).alias("importance"))


def purify(pair: np.ndarray, n: np.ndarray, tol: float = 1e-3, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, row effect, column effect): weighted row and column means moved out of the pair until all are within ``tol``; the sum stays."""
    pair, n = np.array(pair, float), np.array(n, float)
    rows, cols = np.zeros(pair.shape[0]), np.zeros(pair.shape[1])
    by_row, by_col = n.sum(1), n.sum(0)
    if (by_row == 0).any() or (by_col == 0).any():
        raise ValueError("every value of either feature must have been observed")
    for _ in range(rounds):
        u = (pair * n).sum(1) / by_row
        pair -= u[:, None]
        rows += u
        w = (pair * n).sum(0) / by_col
        pair -= w[None, :]
        cols += w
        if max(np.abs(u).max(), np.abs(w).max()) <= tol:
            break
    return pair, rows, cols


def purify_table(pairs: DataFrame, steps: int = 4) -> DataFrame:
    """Purification in Spark, for pair tables beyond the driver: ``steps`` rounds of weighted centring; adds ``row`` and ``col`` effects."""
    out = pairs.withColumns({"row": F.lit(0.0), "col": F.lit(0.0)})
    for axis, into in (("x1", "row"), ("x2", "col")) * steps:
        w = Window.partitionBy("term", axis)
        out = out.withColumn("m", F.sum(F.col("y") * F.col("n")).over(w) / F.sum("n").over(w)).withColumn("y", F.col("y") - F.col("m")).withColumn(into, F.col(into) + F.col("m"))
    return out.drop("m")


def purify_converged(pairs: DataFrame, tol: float = 1e-3, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(pairs, axes): ``pairs`` (term, x1, x2, n, y) with weighted row and column means moved out until no mean exceeds ``tol``, and (term, axis, x, effect) of what was moved.

    Only effects of the axes are iterated, each half round from the cells less the other axis's effects, and written; the cells are read, not rewritten. Every axis value has to have been observed.
    """
    cells = written(pairs, "cells")
    axis = {a: written(cells.select("term", F.col(a).alias("x")).distinct().withColumn("effect", F.lit(0.0)), "axis") for a in ("x1", "x2")}
    for _ in range(rounds):
        moved = 0.0
        for a, b in (("x1", "x2"), ("x2", "x1")):
            other, own = axis[b].select("term", F.col("x").alias(b), F.col("effect").alias("_other")), axis[a].select("term", "x", F.col("effect").alias("_was"))
            mean = cells.join(other, ["term", b]).groupBy("term", F.col(a).alias("x")).agg((F.sum((F.col("y") - F.col("_other")) * F.col("n")) / F.sum("n")).alias("effect"))
            new = written(mean.join(own, ["term", "x"]).select("term", "x", "effect", F.abs(F.col("effect") - F.col("_was")).alias("move")), "axis")
            moved = max(moved, new.agg(F.max("move")).first()[0] or 0.0)
            removed(axis[a])
            axis[a] = new
        if moved <= tol:
            break
    u, w = (axis[a].select("term", F.col("x").alias(a), F.col("effect").alias(f"_{a}")) for a in ("x1", "x2"))
    out = cells.join(u, ["term", "x1"]).join(w, ["term", "x2"]).select("term", "x1", "x2", "n", (F.col("y") - F.col("_x1") - F.col("_x2")).alias("y"))
    both = [axis[a].select("term", F.lit(i).alias("axis"), "x", "effect") for i, a in enumerate(("x1", "x2"))]
    return out, both[0].unionByName(both[1])


def effect_frames(df: DataFrame, mains: dict[str, Column | None], pairs: dict[str, Column] | None = None, intercept: float = 0.0, tol: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``effect_table`` has, as DataFrames of any size: (term, x, n, y) of centred mains, (term, x1, x2, n, y) of the observed cells of purified pairs, and the offset (y)."""
    pairs = pairs or {}
    involved = dict.fromkeys([*mains, *(f for t in pairs for f in t.split(":"))])
    main = main_effects(df, {f: (F.col(f), mains.get(f)) for f in involved})
    cells = pair_effects(df, {t: (*(F.col(f) for f in t.split(":")), c) for t, c in pairs.items()}) if pairs else df.sparkSession.createDataFrame([], "term string, x1 double, x2 double, n long, y double")
    if pairs:
        cells, axes = purify_converged(cells, tol)
        feature = F.get(F.split("term", ":"), F.col("axis"))
        moved = axes.groupBy(feature.alias("term"), "x").agg(F.sum("effect").alias("_moved"))
        main = main.join(moved, ["term", "x"], "left").select("term", "x", "n", (F.col("y") + F.coalesce("_moved", F.lit(0.0))).alias("y"))
    main = written(main, "mains")
    mean = main.groupBy("term").agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("_mean"))
    offset = mean.agg((F.coalesce(F.sum("_mean"), F.lit(0.0)) + intercept).alias("y"))
    return main.join(F.broadcast(mean), "term").select("term", "x", "n", (F.col("y") - F.col("_mean")).alias("y")), cells, offset  # a row a term


def term_order(term: str, features: list[str]) -> float:
    """The place of a term in the table: the offset, features in order, then pairs by their first and second feature."""
    if term == "offset":
        return -1.0
    at = [features.index(f) for f in term.split(":")]
    return float(at[0]) if len(at) == 1 else at[0] * 1e10 + at[1] * 1e5


def effect_table(df: DataFrame, features: list[str], mains: dict[str, Column | None], pairs: dict[str, Column] | None = None, intercept: float = 0.0, tol: float = 1e-3, do_purify: bool = True, y_mu: float = 0.0, y_std: float = 1.0) -> pd.DataFrame:
    """Rows (feat_name, feat_idx, x, y, importance, counts), ordered, with an offset row: all terms of an additive model, pairs purified into mains.

    ``mains`` and ``pairs`` ("a:b") give contributions; targets that were standardised for the fit are scaled back by y_mu and y_std.
    """
    scale = lambda c: c * y_std if c is not None else None
    pairs = pairs or {}
    involved = dict.fromkeys([*mains, *(f for t in pairs for f in t.split(":"))])
    main = main_effects(df, {f: (F.col(f), scale(mains.get(f))) for f in involved}).toPandas()
    tables: dict[str, pd.DataFrame] = {f: t.sort_values("x").reset_index(drop=True) for f, t in main.groupby("term")}
    out_pairs: dict[str, tuple] = {}
    if pairs:
        found = pair_effects(df, {t: (*(F.col(f) for f in t.split(":")), scale(c)) for t, c in pairs.items()})
        sizes = {t: len(tables[t.split(":")[0]]) * len(tables[t.split(":")[1]]) for t in pairs}
        if big := {t: s for t, s in sizes.items() if s > MAX_CELLS}:
            raise ValueError(f"too many cells for a table on the driver (effect_frames has no bound): {big}")
        for t, cells in found.toPandas().groupby("term"):
            a, b = t.split(":")
            xa, xb = tables[a]["x"].to_numpy(), tables[b]["x"].to_numpy()
            y, n = np.zeros((len(xa), len(xb))), np.zeros((len(xa), len(xb)))
            at = np.searchsorted(xa, cells["x1"]), np.searchsorted(xb, cells["x2"])
            y[at], n[at] = cells["y"], cells["n"]
            if do_purify:
                y, u, w = purify(y, n, tol)
                tables[a]["y"] += u
                tables[b]["y"] += w
            out_pairs[t] = xa, xb, y, n
    offset, rows = intercept * y_std + y_mu, []
    for f, t in tables.items():
        y, n = t["y"].to_numpy(), t["n"].to_numpy()
        mean = float((y * n).sum() / n.sum())
        offset += mean
        rows.append((f, features.index(f), t["x"].tolist(), (y - mean).tolist(), float((np.abs(y - mean) * n).sum() / n.sum()), n.tolist()))
    for t, (xa, xb, y, n) in out_pairs.items():
        keep = (y != 0) | (n > 0)
        i, j = np.nonzero(keep)
        rows.append((t, tuple(features.index(f) for f in t.split(":")), list(zip(xa[i].tolist(), xb[j].tolist(), strict=True)), y[keep].tolist(), float((np.abs(y) * n).sum() / n.sum()), n[keep].astype(int).tolist()))
    rows.append(("offset", -1, [], [float(offset)], -1.0, []))
    rows.sort(key=lambda r: term_order(r[0], features))
    return pd.DataFrame(rows, columns=["feat_name", "feat_idx", "x", "y", "importance", "counts"])


def trees_by_feature(selected: DataFrame) -> DataFrame:
    """(feature, n): trees that use a feature, from (tree, feature) rows."""
    return selected.distinct().groupBy("feature").agg(F.count("*").alias("n"))


def distinct_terms(selected: DataFrame) -> DataFrame:
    """(term): the distinct feature sets of trees, from (tree, feature) rows."""
    return selected.distinct().groupBy("tree").agg(F.array_join(F.array_sort(F.collect_set("feature")), ":").alias("term")).select("term").distinct()


def density(df: DataFrame, column: str, least: float, most: float, bins: int = 30) -> DataFrame:
    """(bin, n, shade): a histogram of equal bins, over its largest."""
    at = encoders.k_bin(F.col(column), encoders.uniform_edges(least, most, bins))
    n = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("shade", F.col("n") / F.max("n").over(Window.partitionBy()))


def effect_grid(spark: SparkSession, column: str, least: float, most: float, effect, points: int = 100) -> DataFrame:
    """(x, y): a model's effect of one column on an even grid; ``effect`` takes a Column to a Column."""
    x = F.lit(float(least)) + F.col("id") * ((most - least) / max(points - 1, 1))
    return spark.range(points).select(x.alias(column)).select(F.col(column).alias("x"), effect(F.col(column)).alias("y"))


def sorted_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rank, value): each column sorted on its own, as effect plots show them.

    Distinct values are counted first and ranked by running sums over ranges of values, so a column is not sorted in one task.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("p")).select("p.*").where("value is not null")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    edge = n.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cut = n.join(edge, "column").withColumn("part", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(0))
    up = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("column", "part").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(up), F.lit(0))).drop("m")
    within = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, ["column", "part"])
    return first.select("column", F.explode(F.sequence(F.col("base") + F.col("before") + 1, F.col("base") + F.col("before") + F.col("n"))).alias("rank"), "value")
