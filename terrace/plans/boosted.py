"""Tree-shaped additive models on tables: boosted main effects and pairs (GA2M).

Features are binned; an effect is a table by bin. A Newton step is one job: tasks add up, by bin and by pair of bins, the slopes and curvatures of
the loss at the current scores. On those tables the driver boosts trees feature after feature for as many rounds as asked, exactly for
the quadratic model and without another look at the rows. Pairs follow on what is left: one job ranks all of them, and rounds of one job
each fit those chosen. Tables are bounded by bins, not rows.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from terrace.functions import exprs
from terrace.operators import effects, encoders, families, schema, tree
from terrace.operators.gram import FAN_IN

Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def squared(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope, curvature)."""
    return 0.5 * (z - y) ** 2, z - y, np.ones_like(z)


def logistic(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return np.logaddexp(0, z) - y * z, p - y, np.maximum(p * (1 - p), 1e-6)


#: Categories of a column that get a bin of their own.
MOST_CATEGORIES = 1000
#: Numbers in the tables that a job adds up (64 MB): features and pairs beyond it take further jobs.
TABLE_NUMBERS = 1 << 23
LOSSES: dict[str, Loss] = {"squared": squared, "logistic": logistic}


@dataclasses.dataclass
class TabulatedGam:
    """``pairs`` interactions at most (0: main effects only); trees of ``depth`` with shrinkage ``learning_rate``."""

    n_bins: int = 64
    n_estimators: int = 64
    depth: int = 3
    learning_rate: float = 0.1
    pairs: int = 0
    pair_rounds: int = 6
    newton_steps: int = 1
    loss: str = "squared"
    l2: float = 1.0
    colsample: float = 1.0
    seed: int = 101

    def fit(self, df: DataFrame, y: str, numerical: list[str], categorical: list[str] = ()) -> TabulatedGam:
        src = self._binned(df, y, numerical, categorical)
        mean = src.agg(F.avg("y")).first()[0] or 0.0
        self.intercept = float(np.log((mean + 1e-6) / (1 - mean + 1e-6))) if self.loss == "logistic" else float(mean)
        for _ in range(self.newton_steps if self.loss == "squared" else max(self.newton_steps, 5)):
            self._step(src)
        if self.pairs and len(self.features) > 1:
            self._fit_pairs(src)
        return self

    def _binned(self, df: DataFrame, y: str, numerical: list[str], categorical: list[str]) -> DataFrame:
        """Finds bins and categories, and gives the rows in bins. Of a column's categories the ``MOST_CATEGORIES`` commonest get a bin (ties: the smaller value), and all others together the bin of unknown ones."""
        self.features = [*numerical, *categorical]
        grid = F.array(*map(F.lit, np.linspace(0, 1, self.n_bins + 1).tolist()))
        self.edges, self.categories = {}, {}
        if numerical:
            row = df.agg(*(F.percentile_approx(schema.missing(c, df.schema[c].dataType).cast("double"), grid, 10_000).alias(f"q{i}") for i, c in enumerate(numerical))).first()
            self.edges = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(numerical)}
        if categorical:
            place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))
            part = F.row_number().over(Window.partitionBy("feature", "_part").orderBy(F.desc("n"), "value"))  # a wide column in parts first
            counts = schema.category_counts(df, list(categorical)).withColumn("_part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("_in", part).where(F.col("_in") <= MOST_CATEGORIES)
            kept = counts.withColumn("_at", place).where(F.col("_at") <= MOST_CATEGORIES)
            for r in kept.select("feature", "value").orderBy("feature", "value").collect():  # at most MOST_CATEGORIES a column
                self.categories.setdefault(r["feature"], []).append(r["value"])
        self.size = {c: max(len(self.edges[c]) - 1, 1) + 1 if c in self.edges else len(self.categories.get(c, [])) + 1 for c in self.features}
        self.mains = {c: np.zeros(self.size[c]) for c in self.features}
        self.tables: dict[tuple[str, str], np.ndarray] = {}
        self.counts: dict[str, np.ndarray] = {}
        self.history: list[float] = []
        return df.select(*(self.bin(c).alias(f"b{i}") for i, c in enumerate(self.features)), F.col(y).cast("double").alias("y")).where("y is not null")

    def bin(self, c: str) -> Column:
        """A feature's bin from 1; 0 for missing and unknown values."""
        if c in self.edges:
            x = F.col(c).cast("double")
            return F.when(x.isNull() | F.isnan(x), 0).otherwise(encoders.k_bin(x, self.edges[c] if len(self.edges[c]) > 1 else [0.0, 0.0]) + 1).cast("int")
        return encoders.ordinal(F.col(c), self.categories.get(c, []))

    def _scores(self, bins: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(bins[0]), self.intercept)
        for c, b in zip(self.features, bins, strict=True):
            z += self.mains[c][b]
        for (a, b), t in self.tables.items():
            z += t[bins[self.features.index(a)], bins[self.features.index(b)]]
        return z

    def _parameter(self, y: np.ndarray, bins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(loss, slope, curvature) of a family's loss by one of its raw outputs, at the scores of all: central differences, and a curvature of at least a part of the squared slope."""
        family, at, models = self.family, self.index, self.models
        raw = np.stack([m._scores(bins) for m in models], 1)
        step = 1e-4 * np.maximum(1.0, np.abs(raw[:, at]))
        with np.errstate(all="ignore"):
            value = family.numpy_nll(y, raw)
            up, down = raw.copy(), raw.copy()
            up[:, at] += step
            down[:, at] -= step
            high, low = family.numpy_nll(y, up), family.numpy_nll(y, down)
        slope = np.clip(np.nan_to_num((high - low) / (2 * step)), -1e3, 1e3)
        curve = np.nan_to_num((high + low - 2 * value) / (step * step))
        return np.nan_to_num(value, nan=1e9, posinf=1e9), slope, np.maximum(curve, 0.1 * slope * slope + 1e-6)

    def _sum(self, src: DataFrame, size: int, work: Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, float, int]:
        """The sum over all rows of ``work(bins, slope, curvature, total)``, with mean loss and rows."""
        loss, d = LOSSES.get(self.loss), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2)
            for batch in batches:
                if batch.num_rows:
                    bins = [batch.column(f"b{i}").to_numpy() for i in range(d)]
                    y = batch.column("y").to_numpy()
                    value, slope, curve = loss(y, self._scores(bins)) if loss else self._parameter(y, bins)
                    work(bins, slope, curve, total)
                    total[-2:] += value.sum(), len(y)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["t"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2)
            for batch in batches:
                for t in batch.column("t").to_pylist():
                    total += np.frombuffer(t)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["t"])

        total = sum(np.frombuffer(r["t"]) for r in src.mapInArrow(run, "t binary").repartition(FAN_IN).mapInArrow(merge, "t binary").collect())
        return total[:-2], float(total[-2] / max(total[-1], 1)), int(total[-1])

    def _groups(self) -> list[list[str]]:
        """Features in groups whose tables of pairs fit into one job."""
        out: list[list[str]] = [[]]
        held = 0
        for c in self.features:
            more = 3 * self.size[c] + sum(self.size[c] * self.size[o] for o in out[-1])
            if out[-1] and held + more > TABLE_NUMBERS:
                out.append([])
                held, more = 0, 3 * self.size[c]
            out[-1].append(c)
            held += more
        return out

    def _step(self, src: DataFrame) -> None:
        """For each group of features a job for slopes, curvatures by bin and pairs of bins, then boosting on them."""
        index = {c: i for i, c in enumerate(self.features)}
        masks = schema.feature_masks(len(self.features), self.n_estimators, self.colsample, self.seed)
        for k, group in enumerate(self._groups()):
            loss = self._group_step(src, group, index, masks)
            if loss is None:
                return
            if not k:
                self.history.append(loss)

    def _group_step(self, src: DataFrame, group: list[str], index: dict[str, int], masks) -> float | None:
        at, cuts, size = 0, {}, self.size
        for c in group:
            cuts[c] = at
            at += 3 * size[c]
        for a, b in itertools.combinations(group, 2):
            cuts[a, b] = at
            at += size[a] * size[b]

        def work(bins, slope, curve, total):
            for c in group:
                n, o, i = size[c], cuts[c], index[c]
                total[o : o + n] += np.bincount(bins[i], slope, n)
                total[o + n : o + 2 * n] += np.bincount(bins[i], curve, n)
                total[o + 2 * n : o + 3 * n] += np.bincount(bins[i], minlength=n)
            for a, b in itertools.combinations(group, 2):
                n, o = size[a] * size[b], cuts[a, b]
                total[o : o + n] += np.bincount(bins[index[a]] * size[b] + bins[index[b]], curve, n)

        total, loss, rows = self._sum(src, at, work)
        if not rows:
            return None
        slope, curve = {}, {}
        for c in group:
            n, o = size[c], cuts[c]
            slope[c], curve[c], self.counts[c] = total[o : o + n].copy(), total[o + n : o + 2 * n], total[o + 2 * n : o + 3 * n]
        cross = {(a, b): total[cuts[a, b] : cuts[a, b] + size[a] * size[b]].reshape(size[a], size[b]) for a, b in itertools.combinations(group, 2)}
        for mask in masks:
            for c in itertools.compress(self.features, mask):
                if c not in cuts:
                    continue
                d = self._tree(c, slope[c], curve[c]) * self.learning_rate
                self.mains[c] = self.mains[c] + d
                slope[c] += curve[c] * d
                for other in group:  # what the move changes in the others' slopes
                    if other != c:
                        m = cross[c, other] if (c, other) in cross else cross[other, c].T
                        slope[other] += d @ m
        return loss

    def _tree(self, c: str, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """A tree's step by bin: categories are ordered by their own step, numbers by value; missing values are a leaf of their own."""
        out = np.zeros(len(slope))
        seen = np.flatnonzero(curve[1:] > 0) + 1
        if curve[0] > 0:
            out[0] = -slope[0] / (curve[0] + self.l2)
        if len(seen):
            order = seen if c in self.edges else seen[np.argsort(-slope[seen] / (curve[seen] + self.l2), kind="stable")]
            place = np.arange(len(order), dtype=float)
            cuts = tree.thresholds(place, place, curve[order], -slope[order][:, None], max_depth=self.depth)
            leaf = np.searchsorted(cuts, place, "left")
            out[order] = (-np.bincount(leaf, slope[order]) / (np.bincount(leaf, curve[order]) + self.l2))[leaf]
        return out

    def _fit_pairs(self, src: DataFrame) -> None:
        """One job for all pairs' tables, the best by gain, then rounds of one job on those."""
        size, index = self.size, {c: i for i, c in enumerate(self.features)}

        def tables(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
            cuts = np.cumsum([0, *(2 * size[a] * size[b] for a, b in pairs)])

            def work(bins, slope, curve, total):
                for (a, b), o in zip(pairs, cuts, strict=False):
                    n = size[a] * size[b]
                    cell = bins[index[a]] * size[b] + bins[index[b]]
                    total[o : o + n] += np.bincount(cell, slope, n)
                    total[o + n : o + 2 * n] += np.bincount(cell, curve, n)

            total, loss, _ = self._sum(src, int(cuts[-1]), work)
            self.history.append(loss)
            return {(a, b): (total[o : o + (n := size[a] * size[b])].reshape(size[a], size[b]), total[o + n : o + 2 * n].reshape(size[a], size[b])) for (a, b), o in zip(pairs, cuts, strict=False)}

        every, part, held = [], [], 0
        for p in itertools.combinations(self.features, 2):
            n = 2 * size[p[0]] * size[p[1]]
            if part and held + n > TABLE_NUMBERS:
                every.append(part)
                part, held = [], 0
            part.append(p)
            held += n
        self.gains, found = {}, {}
        for part in [*every, part]:  # a job each; only the best tables so far are held
            found |= tables(part)
            self.gains |= {p: self._quadrants(*found[p])[0] for p in part}
            found = {p: found[p] for p in sorted(found, key=lambda p: (-self.gains[p], p))[: self.pairs]}
        best = list(found)
        self.tables = {p: np.zeros((size[p[0]], size[p[1]])) for p in best}
        for r in range(self.pair_rounds):
            found = {p: found[p] for p in best} if r == 0 else tables(best)
            for p, (g, h) in found.items():
                self.tables[p] = self.tables[p] + self._boost(g.copy(), h) / max(1.0, len(best) ** 0.5)
        self.pair_counts = {p: h for p, (_, h) in found.items()}

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, np.ndarray]:
        """The best cut of each axis taken together: gain, last row and column of the first parts, and the four steps."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

        def parts(c):
            a = c[:-1, :-1]
            return np.stack([a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a])

        if min(g.shape) < 2:
            return 0.0, -1, -1, np.zeros(4)
        gs, hs = parts(cg), parts(ch)
        gain = (gs**2 / (hs + self.l2)).sum(0) - cg[-1, -1] ** 2 / (ch[-1, -1] + self.l2)
        i, j = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[i, j]), int(i), int(j), -gs[:, i, j] / (hs[:, i, j] + self.l2)

    def _boost(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Steps of quadrants on a pair's table, shrunk, until the rounds are used."""
        out = np.zeros_like(g)
        for _ in range(self.n_estimators):
            gain, i, j, v = self._quadrants(g, h)
            if gain <= 1e-9:
                break
            step = np.empty_like(g)
            step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = v
            out += self.learning_rate * step
            g += h * self.learning_rate * step
        return out

    def purified(self, tol: float = 1e-3) -> TabulatedGam:
        """The same scores with pairs centred by row and column and mains centred into the intercept."""
        out = dataclasses.replace(self)
        out.__dict__ |= {k: v for k, v in self.__dict__.items() if k not in out.__dict__ or k in ("mains", "tables")}
        out.mains, out.tables = {c: v.copy() for c, v in self.mains.items()}, {}
        for (a, b), t in self.tables.items():
            n = np.maximum(self.pair_counts[a, b], 1e-9)
            out.tables[a, b], u, w = effects.purify(t, n, tol)
            out.mains[a] += u
            out.mains[b] += w
        for c, v in out.mains.items():
            n = self.counts[c]
            m = float((v * n).sum() / max(n.sum(), 1))
            out.mains[c] = v - m
            out.intercept += m
        return out

    def to_json(self) -> str:
        """Parameters and tables, without what only a fit needs."""
        tables = {"mains": [[c, v.tolist()] for c, v in self.mains.items()], "tables": [[*p, v.tolist()] for p, v in self.tables.items()], "counts": [[c, v.tolist()] for c, v in self.counts.items()], "pair_counts": [[*p, v.tolist()] for p, v in getattr(self, "pair_counts", {}).items()]}
        return json.dumps({"config": dataclasses.asdict(self), "features": self.features, "edges": self.edges, "categories": self.categories, "size": self.size, "intercept": self.intercept, "history": self.history, **tables})

    @classmethod
    def from_json(cls, text: str) -> TabulatedGam:
        got = json.loads(text)
        m = cls(**got["config"])
        m.__dict__ |= {k: got[k] for k in ("features", "edges", "categories", "size", "intercept", "history")}
        m.mains, m.counts = ({c: np.array(v) for c, v in got[k]} for k in ("mains", "counts"))
        m.tables, m.pair_counts = ({(a, b): np.array(v) for a, b, v in got[k]} for k in ("tables", "pair_counts"))
        return m

    def contributions(self) -> dict[str, Column]:
        """{term: effect}, looked up by bin."""
        own = {c: F.get(F.array(*map(F.lit, map(float, t))), self.bin(c)) for c, t in self.mains.items()}
        for (a, b), t in self.tables.items():
            own[f"{a}:{b}"] = F.get(F.array(*map(F.lit, map(float, t.ravel()))), self.bin(a) * t.shape[1] + self.bin(b))
        return own

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``f_<term>`` and ``output``, and for the logistic loss ``probability``."""
        own = self.contributions()
        out = df.withColumns({f"f_{t}": c for t, c in own.items()})
        out = out.withColumn("output", sum((F.col(f"`f_{t}`") for t in own), F.lit(self.intercept)))
        return out.withColumn("probability", exprs.sigmoid(F.col("output"))) if self.loss == "logistic" else out


@dataclasses.dataclass
class OneVsRest:
    """A tabulated model a class, each against all others; ``raw`` holds their scores in order, terms are those of the first class."""

    models: list[TabulatedGam]

    @property
    def intercept(self) -> float:
        return self.models[0].intercept

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``f_<term>``, ``output`` and ``raw``."""
        scores = [sum(m.contributions().values(), F.lit(m.intercept)) for m in self.models]
        return self.models[0].transform(df).drop("probability").withColumn("raw", F.array(*scores))

    def to_json(self) -> str:
        return json.dumps([m.to_json() for m in self.models])

    @classmethod
    def from_json(cls, text: str) -> OneVsRest:
        return cls([TabulatedGam.from_json(t) for t in json.loads(text)])


@dataclasses.dataclass
class BoostedFamily:
    """All parameters of a distribution family, a tabulated model each on the same bins.

    A round takes the parameters in turn: a job adds up slopes and curvatures of the loss by that parameter's raw output, by bin and pair of bins, trees are grown on the tables, and the step is halved until the
    mean loss falls. Rounds end when a whole one gains less than ``tol`` of the loss.
    """

    params: dict
    family: families.Family
    rounds: int = 20
    tol: float = 1e-4
    models: list[TabulatedGam] = dataclasses.field(default_factory=list)
    history: list[float] = dataclasses.field(default_factory=list)

    @property
    def intercept(self) -> float:
        return self.models[0].intercept

    def fit(self, df: DataFrame, y: str, numerical: list[str], categorical: list[str] = ()) -> BoostedFamily:
        first = TabulatedGam(**{**self.params, "loss": "family", "pairs": 0})
        src = first._binned(df, y, numerical, categorical).persist(StorageLevel.MEMORY_AND_DISK_2)
        self.models = [first, *(dataclasses.replace(first) for _ in range(self.family.size - 1))]
        for k, m in enumerate(self.models):
            m.features, m.edges, m.categories, m.size, m.tables, m.counts, m.history = first.features, first.edges, first.categories, first.size, {}, {}, []
            m.mains = {c: np.zeros(first.size[c]) for c in first.features}
            m.family, m.index, m.models, m.intercept = self.family, k, self.models, 0.0
        try:
            for m, z in zip(self.models, self._start(src), strict=True):
                m.intercept = float(z)
            self.history = [self._loss(src)]
            for _ in range(self.rounds):
                before = self.history[-1]
                for m in self.models:
                    self._move(src, m)
                if before - self.history[-1] <= self.tol * abs(before):
                    break
        finally:
            src.unpersist()
        for m in self.models:
            m.models = None
        return self

    def _start(self, src: DataFrame) -> np.ndarray:
        """Raw outputs without any feature, from at most some 10,000 targets of the smallest hashes; later steps see all rows and move them."""
        n = src.count()
        some = src.where(F.pmod(F.xxhash64("*"), F.lit(1 << 30)) < int(min(1.0, 1e4 / max(n, 1)) * (1 << 30))).select("y").limit(20_000).collect()
        y = np.array([r["y"] for r in some] or [0.0])
        mean = lambda z: float(np.nan_to_num(self.family.numpy_nll(y, np.tile(z, (len(y), 1))), nan=1e9, posinf=1e9).mean())
        z, step = np.zeros(self.family.size), np.ones(self.family.size)
        if self.family.parameters[0] in ("mean", "loc"):
            z[0] = np.median(y)
        with np.errstate(all="ignore"):
            best = mean(z)
            for _ in range(200):
                for k in range(len(z)):
                    for d in (step[k], -step[k]):
                        new = z.copy()
                        new[k] += d
                        if (now := mean(new)) < best:
                            z, best = new, now
                            step[k] *= 1.5
                            break
                    else:
                        step[k] /= 2
                if step.max() < 1e-4:
                    break
        return z

    def _loss(self, src: DataFrame) -> float:
        return self.models[0]._sum(src, 0, lambda *_: None)[1]

    def _move(self, src: DataFrame, m: TabulatedGam) -> None:
        old = {c: v.copy() for c, v in m.mains.items()}
        m._step(src)
        new, size = m.mains, 1.0
        for _ in range(8):
            m.mains = {c: old[c] + size * (new[c] - old[c]) for c in old}
            now = self._loss(src)
            if now < self.history[-1]:
                self.history.append(now)
                return
            size /= 2
        m.mains = old

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``f_<term>`` and ``output`` of the first parameter, and ``raw`` of all."""
        scores = [sum(m.contributions().values(), F.lit(m.intercept)) for m in self.models]
        return self.models[0].transform(df).withColumn("raw", F.array(*scores))

    def to_json(self) -> str:
        return json.dumps({"params": self.params, "family": self.family.name, "rounds": self.rounds, "tol": self.tol, "history": self.history, "models": [m.to_json() for m in self.models]})

    @classmethod
    def from_json(cls, text: str) -> BoostedFamily:
        """The models; the family by its name, so one of a user's own has to be set again."""
        got = json.loads(text)
        try:
            family = families.by_name(got["family"])
        except (KeyError, TypeError, ValueError):
            family = None
        return cls(got["params"], family, got["rounds"], got["tol"], [TabulatedGam.from_json(t) for t in got["models"]], got["history"])
