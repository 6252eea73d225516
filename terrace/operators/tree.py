"""One-dimensional regression and classification trees from sufficient statistics.

A feature's rows are reduced to (x, n, sums of the target) a distinct x by one grouping for all features; the search then runs on
that table alone, one task a feature. A feature with more than ``MAX_POINTS`` distinct values is dealt into ranges of them and searched by
running sums over the ranges, a round of two jobs for all its open leaves; a leaf of ``MAX_POINTS`` values or fewer is finished on the
driver. So splits are exact at any size. Bins, of equal frequency, are made only where ``max_points`` asks for them.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import exprs

MAX_POINTS = 1 << 14


def best_split(n: np.ndarray, s: np.ndarray) -> tuple[float, int]:
    """(gain, index) of the best cut after ``index``: n counts, s sums of targets (points x outputs); the first of equal gains."""
    if len(n) < 2:
        return 0.0, -1
    left_n, left_s = np.cumsum(n)[:-1], np.cumsum(s, axis=0)[:-1]
    all_n, all_s = n.sum(), s.sum(0)
    gain = (left_s**2).sum(1) / left_n + ((all_s - left_s) ** 2).sum(1) / (all_n - left_n) - (all_s**2).sum() / all_n
    at = int(np.argmax(gain > gain.max() - 1e-12 * max(1.0, abs(gain.max()))))
    return float(gain[at]), at


def thresholds(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, s: np.ndarray, max_leaves: int | None = None, max_depth: int | None = None) -> list[float]:
    """Ascending thresholds of a tree over points sorted by x, from ``lo`` to ``hi`` each.

    With ``max_leaves`` the node of largest gain is split first; with ``max_depth`` all are, to that depth. A threshold is
    the midpoint of neighbours, or the lower one if that rounds up to the upper.
    """
    out: list[float] = []
    heap: list[tuple[float, int, int, int, int]] = []

    def push(a: int, b: int, depth: int) -> None:
        if max_depth is None or depth < max_depth:
            gain, at = best_split(n[a:b], s[a:b])
            if at >= 0 and gain > 1e-12 * float((s[a:b] ** 2 / n[a:b, None]).sum()):  # what rounding leaves of equal means, at any number of rows
                heapq.heappush(heap, (-gain, a, b, a + at, depth))

    push(0, len(n), 0)
    while heap and (max_leaves is None or len(out) + 1 < max_leaves):
        _, a, b, at, depth = heapq.heappop(heap)
        middle = hi[at] + (lo[at + 1] - hi[at]) / 2
        out.append(float(hi[at] if middle >= lo[at + 1] else middle))
        push(a, at + 1, depth + 1)
        push(at + 1, b, depth + 1)
    return sorted(out)


def _ranged(tables: DataFrame, counts: dict[str, int], size: int) -> DataFrame:
    """``tables`` with ``part``: ascending ranges of about ``size`` points of a feature."""
    most = max(-(-n // size) for n in counts.values())
    at = F.array(*(F.lit(k / most) for k in range(1, most))) if most > 1 else None
    edges = {r["feature"]: sorted(set(r["e"])) for r in tables.groupBy("feature").agg(F.percentile_approx("lo", at, max(10_000, 10 * most)).alias("e")).collect()} if most > 1 else {}
    part = F.lit(0)
    for f, e in edges.items():
        part = F.when(F.col("feature") == f, F.size(F.filter(F.array(*map(F.lit, e)), lambda v: v < F.col("lo")))).otherwise(part)
    return tables.withColumn("part", part)


def _binned(tables: DataFrame, max_points: int) -> DataFrame:
    """Bins of equal frequency of the features with more than ``max_points`` points; the others keep their distinct values."""
    counts = {r["feature"]: r["count"] for r in tables.groupBy("feature").count().collect()}
    large = {f: k for f, k in counts.items() if k > max_points}
    if not large:
        return tables
    some = _ranged(tables.where(F.col("feature").isin(*large)), large, MAX_POINTS)
    up = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = some.groupBy("feature", "part").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(up), F.lit(0.0))).withColumn("all", F.sum("m").over(Window.partitionBy("feature"))).drop("m")
    within = Window.partitionBy("feature", "part").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0.0))).join(base, ["feature", "part"])
    some = some.withColumn("bin", F.floor((F.col("base") + F.col("before")) / F.col("all") * max_points))
    width = tables.select(F.size("s").alias("k")).first()["k"]
    sums = F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(width)))
    some = some.groupBy("feature", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_"), sums.alias("s_"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    return some.select("feature", "lo", "hi", F.col("n_").alias("n"), F.col("s_").alias("s"), "mean").unionByName(tables.where(~F.col("feature").isin(*large)))


def target_tables(df: DataFrame, features: dict[str, Column], target: Column, classes: list | None = None, max_points: int | None = None) -> DataFrame:
    """(feature, lo, hi, n, s, mean): each feature's distinct values with row count and target sums (one a class, or the target's).

    With ``max_points``, features of more distinct values are put into at most so many bins of equal frequency.
    """
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), c.cast("double").alias("x")) for f, c in features.items()))
    long = df.select(F.explode(pairs).alias("p"), target.alias("y")).select("p.feature", "p.x", "y").where("x is not null and y is not null")
    sums = [F.sum(F.col("y").cast("double"))] if classes is None else [F.sum(F.when(F.col("y") == k, 1.0).otherwise(0.0)) for k in classes]
    tables = long.groupBy("feature", "x").agg(F.count("*").cast("double").alias("n"), F.array(*sums).alias("s"))
    tables = tables.select("feature", F.col("x").alias("lo"), F.col("x").alias("hi"), "n", "s", F.col("x").alias("mean"))
    return tables if max_points is None else _binned(tables, max_points)


def quantiles(df: DataFrame, features: dict[str, Column], grid: list[float], max_points: int = MAX_POINTS) -> dict[str, list[float]]:
    """Exact percentiles of all features, interpolated between neighbours. Distinct values are counted, ranges of them add up on the driver, and only the ranges that hold a wanted rank are sorted, each in a task of its own."""
    tables = target_tables(df, features, F.lit(0.0)).select("feature", "lo", "n").persist()
    try:
        counts = {r["feature"]: r["count"] for r in tables.groupBy("feature").count().collect()}
        if not counts:
            return {}
        ranged = _ranged(tables, counts, max_points)
        parts = ranged.groupBy("feature", "part").agg(F.sum("n").cast("long").alias("n")).toPandas().sort_values(["feature", "part"])  # a row a range
        wanted, where = {}, {}
        for f, p in parts.groupby("feature"):
            ends = p["n"].cumsum().to_numpy()
            at = [(ends[-1] - 1) * q for q in grid]
            where[f] = at
            for rank in sorted({r for a in at for r in (int(np.floor(a)), int(np.ceil(a)))}):
                k = int(np.searchsorted(ends, rank, "right"))
                wanted.setdefault((f, int(p["part"].iloc[k])), []).append((rank, rank - (int(ends[k - 1]) if k else 0)))

        def pick(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("lo", kind="stable")
            own = wanted[g["feature"].iloc[0], int(g["part"].iloc[0])]
            at = np.searchsorted(np.cumsum(g["n"].to_numpy()), [r for _, r in own], "right")
            return pd.DataFrame({"feature": g["feature"].iloc[0], "rank": [r for r, _ in own], "x": g["lo"].to_numpy()[at]})

        some = F.lit(False)
        for f, k in wanted:
            some = some | ((F.col("feature") == f) & (F.col("part") == k))
        found = {(r["feature"], r["rank"]): r["x"] for r in ranged.where(some).groupBy("feature", "part").applyInPandas(pick, "feature string, rank long, x double").collect()}
    finally:
        tables.unpersist()
    out = {}
    for f, at in where.items():
        out[f] = []
        for a in at:
            lo, hi = int(np.floor(a)), int(np.ceil(a))
            x, y = found[f, lo], found[f, hi]
            out[f].append(x if lo == hi or x == y else (hi - a) * x + (a - lo) * y)
    return out


Leaf = tuple[str, float | None, float | None]


def _cuts_of_leaves(tables: DataFrame, leaves: list[Leaf], width: int, max_points: int) -> list[tuple | pd.DataFrame]:
    """Of each leaf (feature, after, up to): (gain, last x left, first x right) of its best cut, or its points if they are few."""
    mark = F.lit(None).cast("int")
    for k, (f, after, upto) in enumerate(leaves):
        inside = F.col("feature") == f
        inside = inside if after is None else inside & (F.col("lo") > after)
        mark = F.when(inside if upto is None else inside & (F.col("lo") <= upto), k).otherwise(mark)
    marked = tables.withColumn("leaf", mark).where("leaf is not null")
    s = [F.get("s", F.lit(i)) for i in range(width)]
    parts = marked.groupBy("leaf", "part").agg(F.min("lo").alias("lo"), F.count("*").alias("k"), F.sum("n").alias("m"), F.array(*map(F.sum, s)).alias("t"), F.sum(sum(v * v for v in s) / F.col("n")).alias("q")).toPandas().sort_values(["leaf", "part"])
    own = {k: p for k, p in parts.groupby("leaf")}
    out: list = [(0.0, None, None)] * len(leaves)
    few = [k for k, p in own.items() if p["k"].sum() <= max_points]
    if few:
        rows = marked.where(F.col("leaf").isin(*few)).select("leaf", "lo", "hi", "n", "s").toPandas()
        for k, p in rows.groupby("leaf"):
            out[k] = p.sort_values("lo", kind="stable")
    many = {k: p for k, p in own.items() if k not in few}
    if many:
        starts = {}
        for k, p in many.items():
            n, t, lo = p["m"].to_numpy(), np.stack(p["t"].to_numpy()), p["lo"].tolist()
            for i, part in enumerate(p["part"]):
                starts[k, part] = (n[:i].sum(), t[:i].sum(0), n.sum(), t.sum(0), lo[i + 1] if i + 1 < len(lo) else None)

        def best(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("lo", kind="stable")
            key = int(g["leaf"].iloc[0]), int(g["part"].iloc[0])
            n0, s0, all_n, all_s, after = starts[key]
            follow = np.append(g["lo"].to_numpy()[1:], np.nan if after is None else after)
            left_n, left_s = n0 + np.cumsum(g["n"].to_numpy()), s0 + np.cumsum(np.stack(g["s"].to_numpy()), axis=0)
            if after is None:
                left_n, left_s, follow = left_n[:-1], left_s[:-1], follow[:-1]
            if not len(left_n):
                return pd.DataFrame({"leaf": [], "part": [], "gain": [], "hi": [], "next": []}).astype({"leaf": "int32", "part": "int32"})
            gain = (left_s**2).sum(1) / left_n + ((all_s - left_s) ** 2).sum(1) / (all_n - left_n) - (all_s**2).sum() / all_n
            at = int(np.argmax(gain > gain.max() - 1e-12 * max(1.0, abs(gain.max()))))
            return pd.DataFrame({"leaf": [key[0]], "part": [key[1]], "gain": [gain[at]], "hi": [g["hi"].iloc[at]], "next": [follow[at]]})

        found = marked.where(F.col("leaf").isin(*many)).groupBy("leaf", "part").applyInPandas(best, "leaf int, part int, gain double, hi double, next double").toPandas()
        for k, p in found.sort_values("part").groupby("leaf"):
            top = p["gain"].max()
            p = p[p["gain"] > top - 1e-12 * max(1.0, abs(top))].iloc[0]
            if top > 1e-12 * float(many[k]["q"].sum()):
                out[k] = (float(p["gain"]), float(p["hi"]), float(p["next"]))
    return out


def _grow_ranged(tables: DataFrame, counts: dict[str, int], max_leaves: int | None, max_depth: int | None, max_points: int) -> dict[str, list[float]]:
    """``thresholds`` of features whose points are too many for a task."""
    tables = _ranged(tables, counts, max_points)
    width = tables.select(F.size("s").alias("k")).first()["k"]
    cuts: dict[str, list[float]] = {f: [] for f in counts}
    heaps: dict[str, list] = {f: [] for f in counts}
    number = itertools.count()

    def put(f: str, depth: int, points: pd.DataFrame) -> None:
        gain, at = best_split(points["n"].to_numpy(), np.stack(points["s"].to_numpy()))
        if at >= 0 and gain > 1e-12 * float((np.stack(points["s"].to_numpy()) ** 2 / points["n"].to_numpy()[:, None]).sum()):
            heapq.heappush(heaps[f], (-gain, points["lo"].iloc[0], next(number), points["hi"].iloc[at], points["lo"].iloc[at + 1], depth, points, None))

    more = lambda depth: max_depth is None or depth < max_depth
    pending: list[tuple[Leaf, int]] = [((f, None, None), 0) for f in counts if more(0)]
    while pending:
        for (leaf, depth), found in zip(pending, _cuts_of_leaves(tables, [p[0] for p in pending], width, max_points), strict=True):
            if isinstance(found, pd.DataFrame):
                put(leaf[0], depth, found)
            elif found[0] > 0:
                heapq.heappush(heaps[leaf[0]], (-found[0], -np.inf if leaf[1] is None else leaf[1], next(number), found[1], found[2], depth, None, leaf))
        pending = []
        for f, heap in heaps.items():
            waits = False
            while heap and not waits and (max_leaves is None or len(cuts[f]) + 1 < max_leaves):
                _, _, _, left, right, depth, points, leaf = heapq.heappop(heap)
                middle = left + (right - left) / 2
                cuts[f].append(float(left if middle >= right else middle))
                if not more(depth + 1):
                    continue
                if points is None:
                    pending += [((f, leaf[1], left), depth + 1), ((f, left, leaf[2]), depth + 1)]
                    waits = max_leaves is not None
                else:
                    put(f, depth + 1, points[points["lo"] <= left])
                    put(f, depth + 1, points[points["lo"] > left])
        pending = [p for p in pending if max_leaves is None or len(cuts[p[0][0]]) + 1 < max_leaves]
    return {f: sorted(t) for f, t in cuts.items()}


def fit_thresholds(tables: DataFrame, max_leaves: int | None = None, max_depth: int | None = None, max_points: int = MAX_POINTS) -> dict[str, list[float]]:
    """Thresholds of each feature; at most ``max_leaves`` - 1 (or 2^depth - 1) a feature come to the driver, and leaves of ``max_points`` values."""

    def grow(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("lo", kind="stable")
        found = thresholds(t["lo"].to_numpy(), t["hi"].to_numpy(), t["n"].to_numpy(), np.stack(t["s"].to_numpy()), max_leaves, max_depth)
        return pd.DataFrame({"feature": [t["feature"].iloc[0]], "thresholds": [found]})

    tables = tables.persist()
    try:
        counts = {r["feature"]: r["count"] for r in tables.groupBy("feature").count().collect()}
        large = {f: k for f, k in counts.items() if k > max_points}
        found = _grow_ranged(tables.where(F.col("feature").isin(*large)), large, max_leaves, max_depth, max_points) if large else {}
        if len(large) < len(counts):
            rows = tables.where(~F.col("feature").isin(*large)) if large else tables
            found |= {r["feature"]: list(r["thresholds"]) for r in rows.groupBy("feature").applyInPandas(grow, "feature string, thresholds array<double>").collect()}
    finally:
        tables.unpersist()
    return found


def ple(x: Column, cuts: list[float], top: float) -> Column:
    """Piecewise linear encoding of a scaled x by ascending thresholds.

    The last threshold is clamped to ``top``, the largest x of the fit (not of the batch, so a row's encoding does not depend on the
    others). Bins below x's own are 1, those above 0; its own holds x itself at either end and the position within the bin between.
    """
    if not cuts:
        return F.array(x)
    cuts = [*cuts[:-1], min(cuts[-1], top)]
    edges = F.array(*map(F.lit, cuts))
    m = len(cuts)
    at = F.size(F.filter(edges, lambda e: e < x))
    own = F.when((x >= cuts[-1]) | (x <= cuts[0]), x).otherwise((x - F.get(edges, at - 1)) / (F.get(edges, at) - F.get(edges, at - 1)))
    bin_ = F.when(x >= cuts[-1], F.lit(m)).otherwise(at)
    slot = F.struct(bin_.alias("b"), own.alias("v"))
    return F.get(F.transform(F.array(slot), lambda s: F.transform(F.sequence(F.lit(0), F.lit(m)), lambda k: F.when(k < s["b"], 1.0).when(k == s["b"], s["v"]).otherwise(0.0))), F.lit(0))


def ple_rows(x: np.ndarray, cuts: list[float], top: float) -> np.ndarray:
    """``ple`` in numpy."""
    if not cuts:
        return x[:, None]
    edge = np.array([*cuts[:-1], min(cuts[-1], top)])
    m = len(edge)
    at = np.searchsorted(edge, x, "left")
    end = (x >= edge[-1]) | (x <= edge[0])
    inner = np.clip(at, 1, m - 1)
    gap = edge[inner] - edge[inner - 1] if m > 1 else np.ones(len(x))
    own = np.where(end, x, (x - edge[inner - 1]) / np.where(gap == 0, 1, gap)) if m > 1 else x
    bin_ = np.where(x >= edge[-1], m, at)
    out = (np.arange(m + 1) < bin_[:, None]).astype(float)
    out[np.arange(len(x)), bin_] = own
    return out


def ple_effect(x: Column, cuts: list[float], top: float, weights: list[float]) -> Column:
    """``ple`` times weights: a sum of whole bins and a share of x's own."""
    if not cuts:
        return x * weights[0]
    edge = [*cuts[:-1], min(cuts[-1], top)]
    m = len(edge)
    edges, w = F.array(*map(F.lit, edge)), F.array(*map(F.lit, map(float, weights)))
    below = F.array(*map(F.lit, np.append(0, np.cumsum(weights[:-1])).tolist()))
    at = F.size(F.filter(edges, lambda e: e < x))
    inner = F.when(x >= edge[-1], F.get(below, F.lit(m)) + x * float(weights[m])).when(x <= edge[0], x * float(weights[0]))

    def between(b: Column) -> Column:
        lo = F.get(edges, b - 1)
        return F.get(below, b) + F.get(w, b) * (x - lo) / (F.get(edges, b) - lo)

    return inner.otherwise(exprs.let(at, between)) if m > 1 else inner
