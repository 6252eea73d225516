"""Neural shape functions in numpy, trained by averaging: in an epoch every task runs mini-batches over its rows from the same start, and the results are averaged by rows.

Kinds (all give one output a feature or interaction and per-output sums):

* ``nam``: a network a feature, and a network an interaction on the joined blocks;
* ``qnam``: as nam with ordered outputs (quantiles), v0, v0 + exp(v1), ...;
* ``nbm``: shared basis functions for all features, mixed by a weight a feature, and others for all interactions of a degree;
* ``natt``: networks for numerical features, attention over embeddings of categories;
* ``namformer``: linear effects, and a head on attention over embeddings of all features;
* ``nodegam``: soft oblivious trees of one or two chosen features each (see ``odst``);
* ``spline``: a cubic spline a numerical feature with learned knots, and penalties on roughness and on knots that meet; other blocks are linear;
* ``trees``: ``num_trees`` hard oblique trees of ``depth`` a feature, each shrunk by ``shrinkage`` (see ``layers``);
* any name that ``register_shape`` of ``terrace.plans.estimator`` was given: a shape function of a user's own.

Rows come as one array column of the joined blocks, dealt by a hash to tasks of about ``rows_per_task`` rows, so that neither the session nor the order of the input changes a fit. Parameters
are summed by rows in tasks, by ``FAN_IN`` more, and ``FAN_IN`` of them reach the driver.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from terrace.functions.exprs import one_hot, temperature
from terrace.operators import families
from terrace.operators.gram import FAN_IN, _matrix
from terrace.plans import layers, odst
from terrace.plans.autodiff import Var, concat
from terrace.plans.preprocess import Preprocessor

KINDS = ("nam", "qnam", "nbm", "natt", "namformer", "nodegam", "spline", "trees")
NORMS, ACTIVATIONS = ("none", "layer", "rms", "batch"), ("relu", "glu", "reglu")
#: Tasks of an epoch at most; a task has more rows then.
MOST_TASKS = 4096


@dataclasses.dataclass
class NeuralModel:
    kind: str = "nam"
    hidden: tuple[int, ...] = (64, 32)
    interaction_degree: int | None = None
    num_bases: int = 32
    d_model: int = 16
    n_heads: int = 2
    n_layers: int = 1
    num_trees: int = 20
    depth: int = 3
    tree_layers: int = 1
    tree_attention: int = 0
    choice: str = "entmax15"
    bins: str = "entmoid15"
    anneal_epochs: int | None = None
    least_temperature: float = 0.01
    data_start: bool = True
    output_l2: float = 0.0
    knots: int = 12
    learn_knots: bool = True
    smooth_penalty: float = 0.0
    knot_penalty: float = 0.0
    shrinkage: float = 0.1
    dropout: float = 0.0
    attention_dropout: float = 0.0
    token_norm: bool = False
    token_activation: bool = False
    feature_dropout: float = 0.0
    skip_connections: bool = False
    layer_norm: bool = False
    norm: str = "none"
    activation: str = "relu"
    intercept: bool = True
    batch_size: int = 128
    max_epochs: int = 20
    lr: float = 5e-3
    lr_patience: int = 5
    lr_factor: float = 0.1
    weight_decay: float = 1e-6
    patience: int = 15
    rows_per_task: int = 75_000
    checkpoint: str | None = None
    frozen: tuple[str, ...] = ()
    seed: int = 101

    def __post_init__(self) -> None:
        if self.norm not in NORMS or self.activation not in ACTIVATIONS:
            raise ValueError(f"norm must be one of {NORMS} and activation one of {ACTIVATIONS}")
        if self.layer_norm and self.norm == "none":
            self.norm = "layer"
        self.temperature = 1.0
        self.custom = layers.REGISTRY.get(self.kind)
        if self.kind not in KINDS and self.custom is None:
            raise ValueError(f"kind must be one of {KINDS} or registered, not {self.kind!r}")

    # ---- structure

    def _build(self, pre: Preprocessor, outputs: int) -> None:
        self.names, self.is_cat, self.slices, at = [], [], {}, 0
        for f in pre.features:
            width = len(f.state["categories"]) + 1 if f.kind == "cat" else f.width
            self.names.append(f.name)
            self.is_cat.append(f.kind == "cat")
            self.slices[f.name] = (at, at + width)
            at += width
        self.width, self.outputs = at, outputs
        self.pairs = [list(p) for d in range(2, (self.interaction_degree or 1) + 1) for p in itertools.combinations(self.names, d)]
        rng = np.random.default_rng(self.seed)
        self.params: dict[str, np.ndarray] = {"intercept": np.zeros(outputs)}
        own = lambda n: self.slices[n][1] - self.slices[n][0]

        def dense(name: str, a: int, b: int) -> None:
            self.params[f"{name}.w"], self.params[f"{name}.b"] = rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)

        def net(name: str, a: int, out: int) -> None:
            sizes = [a, *self.hidden, out]
            for i, (x, y) in enumerate(itertools.pairwise(sizes)):
                last = i == len(sizes) - 2
                dense(f"{name}.{i}", x, y if last or self.activation == "relu" else 2 * y)
                if not last and self.norm != "none":
                    self.params[f"{name}.{i}.scale"], self.params[f"{name}.{i}.shift"] = np.ones(y), np.zeros(y)
                    if self.norm == "batch":
                        self.params[f"{name}.{i}.running"] = np.stack([np.zeros(y), np.ones(y)])
            self.params[f"{name}.{len(sizes) - 2}.w"] *= 0.1

        mlp = [n for n, c in zip(self.names, self.is_cat, strict=True) if self.kind != "natt" or not c]
        if self.kind in ("nam", "qnam", "natt"):
            for n in mlp:
                net(n, own(n), outputs)
        for p in self.pairs if self.kind in ("nam", "qnam", "natt") else []:
            net(":".join(p), sum(map(own, p)), outputs)
        if self.kind == "nbm":
            top = max(map(own, self.names))
            net("bases", top, self.num_bases)
            for n in self.names:
                dense(f"mix.{n}", self.num_bases, outputs)
            for d in range(2, (self.interaction_degree or 1) + 1):
                net(f"bases{d}", d * top, self.num_bases)
            for pair in self.pairs:
                dense(f"mix.{':'.join(pair)}", self.num_bases, outputs)
        if self.kind in ("natt", "namformer"):
            tokens = [n for n, c in zip(self.names, self.is_cat, strict=True) if c or self.kind == "namformer"]
            self.params["cls"] = rng.normal(0, 0.1, (1, 1, self.d_model))
            for n in tokens:
                dense(f"embed.{n}", own(n), self.d_model)
                dense(f"linear.{n}", own(n), outputs)
                self.params[f"linear.{n}.w"] *= 0.1
            for k in range(self.n_layers):
                for m in "qkvo":
                    dense(f"layer{k}.{m}", self.d_model, self.d_model)
                dense(f"layer{k}.up", self.d_model, 2 * self.d_model)
                dense(f"layer{k}.down", 2 * self.d_model, self.d_model)
            dense("head", self.d_model, outputs)
            self.params["head.w"] *= 0.1
        if self.kind == "nodegam":
            self.params |= self._trees().build(rng)
        for n in self.names if self.kind == "spline" else []:
            if self._has_knots(n):
                even = np.log(np.expm1(1.0))
                self.params[f"{n}.distances"], self.params[f"{n}.spline"] = np.full(self.knots - 1, even), rng.normal(0, 0.01, (self.knots, outputs))
            else:
                dense(f"{n}.linear", own(n), outputs)
                self.params[f"{n}.linear.w"] *= 0.1
        for n in self.names if self.kind == "trees" else []:
            self.params[f"{n}.split"], self.params[f"{n}.leaf"] = layers.start_trees(rng, self.num_trees, own(n), self.depth, outputs)
        if self.custom:
            self.params |= {k: np.asarray(v, float) for k, v in self.custom.start(rng, {n: own(n) for n in self.names}, outputs).items()}

    def _has_knots(self, name: str) -> bool:
        return self.slices[name][1] - self.slices[name][0] == 1 and not self.is_cat[self.names.index(name)]

    def _splines(self, p: dict[str, Var], x: dict[str, Var], train: bool) -> dict[str, Var]:
        terms = {}
        for n in self.names:
            if not self._has_knots(n):
                terms[n] = x[n] @ p[f"{n}.linear.w"] + p[f"{n}.linear.b"]
                continue
            d = p[f"{n}.distances"]
            t = layers.knots(d if self.learn_knots else Var(d.value))
            terms[n] = layers.basis(x[n].value[:, 0], t) @ p[f"{n}.spline"]
            if train:
                for weight, part in ((self.smooth_penalty, layers.roughness), (self.knot_penalty, lambda t, _: layers.closeness(t))):
                    if weight:
                        more = part(t, p[f"{n}.spline"]) * weight
                        self.penalty = more if self.penalty is None else self.penalty + more
        return terms

    def learned_knots(self, name: str) -> np.ndarray:
        """A feature's knots, on the scale that its block has (0 to 1 for ``normalization``)."""
        return layers.knots(Var(self.params[f"{name}.distances"])).value

    def _trees(self) -> odst.Trees:
        columns = [i for i, n in enumerate(self.names) for _ in range(*self.slices[n])]
        return odst.Trees(columns, self.names, self.outputs, self.num_trees, self.depth, self.tree_layers, 2 if (self.interaction_degree or 1) > 1 else 1, self.choice, self.bins, self.tree_attention)

    # ---- forward

    def _net(self, p: dict[str, Var], name: str, x: Var, rng: np.random.Generator | None) -> Var:
        layers = len(self.hidden) + 1
        for i in range(layers):
            y = x.affine(p[f"{name}.{i}.w"], p[f"{name}.{i}.b"])
            if i < layers - 1:
                if self.activation != "relu":
                    half = y.value.shape[1] // 2
                    y = y[:, :half] * (y[:, half:].sigmoid() if self.activation == "glu" else y[:, half:].relu())
                if self.norm != "none":
                    y = self._normed(p, f"{name}.{i}", y, rng is not None)
                if self.activation == "relu":
                    y = y.relu()
                if rng is not None and self.dropout:
                    y = y.dropped((rng.random(y.value.shape) >= self.dropout) / (1 - self.dropout))
                if self.skip_connections and y.value.shape == x.value.shape:
                    y = y + x
            x = y
        return x

    def _normed(self, p: dict[str, Var], name: str, y: Var, train: bool) -> Var:
        """Normalised by row (layer, rms) or by batch, with a learned scale; batches leave their moments for the running ones."""
        if self.norm == "layer":
            y = y.layer_norm()
        elif self.norm == "rms":
            y = y * (((y * y).sum(1) * (1 / y.value.shape[1]) + 1e-5).power(-0.5)).reshape(-1, 1)
        elif train and len(y.value) > 1:
            self.moments[f"{name}.running"] = np.stack([y.value.mean(0), y.value.var(0)])
            y = y.standardized(0)
        else:
            mean, var = p[f"{name}.running"].value
            y = (y - mean) * (1 / np.sqrt(var + 1e-5))
        return y * p[f"{name}.scale"] + p[f"{name}.shift"]

    def _attention(self, p: dict[str, Var], x: Var, rng: np.random.Generator | None = None) -> Var:
        n, t, d = x.value.shape
        h = self.n_heads
        for k in range(self.n_layers):
            z = x.layer_norm()
            q, key, v = ((z @ p[f"layer{k}.{m}.w"] + p[f"layer{k}.{m}.b"]).reshape(n, t, h, d // h).transpose(0, 2, 1, 3) for m in "qkv")
            weight = (q @ key.transpose(0, 1, 3, 2) * (d // h) ** -0.5).softmax()
            if rng is not None and self.attention_dropout:
                weight = weight.dropped((rng.random(weight.value.shape) >= self.attention_dropout) / (1 - self.attention_dropout))
            mixed = weight @ v
            x = x + (mixed.transpose(0, 2, 1, 3).reshape(n, t, d) @ p[f"layer{k}.o.w"] + p[f"layer{k}.o.b"])
            z = x.layer_norm()
            x = x + ((z @ p[f"layer{k}.up.w"] + p[f"layer{k}.up.b"]).relu() @ p[f"layer{k}.down.w"] + p[f"layer{k}.down.b"])
        return x

    def _ordered(self, y: Var) -> Var:
        parts = [y[:, :1]]
        for k in range(1, self.outputs):
            parts.append(parts[-1] + y[:, k : k + 1].exp())
        return concat(parts, 1)

    def _forward(self, p: dict[str, Var], rows: np.ndarray, rng: np.random.Generator | None = None) -> dict[str, Var]:
        """{term: its output (rows x outputs)}."""
        x = {n: Var(rows[:, a:b], constant=True) for n, (a, b) in self.slices.items()}
        terms: dict[str, Var] = {}
        if self.kind in ("nam", "qnam", "natt"):
            for n, c in zip(self.names, self.is_cat, strict=True):
                if self.kind != "natt" or not c:
                    terms[n] = self._net(p, n, x[n], rng)
            for pair in self.pairs:
                terms[":".join(pair)] = self._net(p, ":".join(pair), concat([x[n] for n in pair], 1), rng)
        if self.kind == "nbm":
            top = max(b - a for a, b in self.slices.values())
            for n in self.names:
                block = x[n].value
                padded = Var(np.hstack([block, np.zeros((len(block), top - block.shape[1]))]), constant=True)
                terms[n] = self._net(p, "bases", padded, rng).relu() @ p[f"mix.{n}.w"] + p[f"mix.{n}.b"]
            for pair in self.pairs:
                wide = [np.hstack([x[n].value, np.zeros((len(rows), top - x[n].value.shape[1]))]) for n in pair]
                name = ":".join(pair)
                terms[name] = self._net(p, f"bases{len(pair)}", Var(np.hstack(wide)), rng).relu() @ p[f"mix.{name}.w"] + p[f"mix.{name}.b"]
        if self.kind in ("natt", "namformer"):
            tokens = [n for n, c in zip(self.names, self.is_cat, strict=True) if c or self.kind == "namformer"]
            if tokens:
                each = [x[n] @ p[f"embed.{n}.w"] + p[f"embed.{n}.b"] for n in tokens]
                each = [e.relu() if self.token_activation else e for e in each]
                each = [(e.layer_norm() if self.token_norm else e).reshape(len(rows), 1, self.d_model) for e in each]
                seen = self._attention(p, concat([p["cls"] + np.zeros((len(rows), 1, self.d_model)), *each], 1), rng)
                terms["attention"] = seen[:, 0, :] @ p["head.w"] + p["head.b"]
            for n in tokens if self.kind == "namformer" else []:
                terms[n] = x[n] @ p[f"linear.{n}.w"] + p[f"linear.{n}.b"]
        if self.kind == "nodegam":
            trees = self._trees()
            grown, square = trees.forward(p, rows, self.temperature, rng, rng is not None)
            self.penalty = square * self.output_l2 if self.output_l2 else None
            if rng is not None:
                each = concat(grown, 1)
                if self.dropout:
                    each = each.dropped((rng.random((len(rows), each.value.shape[1], 1)) >= self.dropout) / (1 - self.dropout))
                return {"trees": each.sum(1)}
            chosen = trees.chosen({k: v.value for k, v in p.items()})
            each = concat(grown, 1).value
            for name in sorted({":".join(c) for c in chosen}):
                terms[name] = Var(each[:, [i for i, c in enumerate(chosen) if ":".join(c) == name]].sum(1))
            return terms
        if self.kind == "spline":
            terms = self._splines(p, x, rng is not None)
        if self.kind == "trees":
            for n in self.names:
                terms[n] = layers.hard_trees(x[n].value, p[f"{n}.split"], p[f"{n}.leaf"]) * self.shrinkage
        if self.custom:
            terms = self.custom.forward(p, x, rng)
        if rng is not None and self.feature_dropout:
            terms = {n: v.dropped((rng.random((len(rows), 1)) >= self.feature_dropout) / (1 - self.feature_dropout)) for n, v in terms.items()}
        return terms

    def _raw(self, p: dict[str, Var], rows: np.ndarray, rng: np.random.Generator | None = None) -> tuple[Var, dict[str, Var]]:
        terms = self._forward(p, rows, rng)
        total = None
        for v in terms.values():
            total = v if total is None else total + v
        total = total + p["intercept"]
        return (self._ordered(total) if self.kind == "qnam" else total), terms

    # ---- training

    def _epoch(self, loss: families.Family | None, lr: float, epoch: int, train: bool):
        params = {k: v.copy() for k, v in self.params.items()}
        names, cut = sorted(params), np.cumsum([0, *(params[k].size for k in sorted(params))])
        width, fixed = self.width, [k for k in params if k.endswith(".running") or k == "intercept" and not self.intercept or k.startswith(tuple(self.frozen) or ("\0",))]

        def gradient(y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if loss is None:
                e = raw[:, 0] - y
                return e * e, (2 * e)[:, None]
            base, g = loss.numpy_nll(y, raw), np.zeros_like(raw)
            if train:
                for k in range(raw.shape[1]):
                    step = 1e-5 * np.maximum(1, np.abs(raw[:, k]))
                    up, down = raw.copy(), raw.copy()
                    up[:, k] += step
                    down[:, k] -= step
                    g[:, k] = (loss.numpy_nll(y, up) - loss.numpy_nll(y, down)) / (2 * step)
            return base, np.clip(np.nan_to_num(g), -50, 50)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([params[k].ravel() for k in names])
            own = {k: flat[a:b].reshape(params[k].shape) for k, a, b in zip(names, cut[:-1], cut[1:], strict=True)}  # views: a step is taken on all at once
            m, s, g_flat = (np.zeros_like(flat) for _ in range(3))
            p = {k: Var(v) for k, v in own.items()}
            grads = {k: g_flat[a:b].reshape(params[k].shape) for k, a, b in zip(names, cut[:-1], cut[1:], strict=True)}
            live: list[str] | None = None
            rng, n, total, t = np.random.default_rng(self.seed + epoch), 0, 0.0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, y = _matrix(batch.column("b"), width), batch.column("y").to_numpy()
                order = rng.permutation(len(y)) if train else np.arange(len(y))
                size = self.batch_size if train else 4096
                for a in range(0, len(order), size):
                    at = order[a : a + size]
                    self.moments, self.penalty = {}, None
                    raw, _ = self._raw(p, rows[at], rng if train else None)
                    with np.errstate(all="ignore"):
                        value, g = gradient(y[at], raw.value)
                    sum_of = value.sum()
                    n, total = n + len(at), total + float(sum_of if np.isfinite(sum_of) else np.nan_to_num(value, posinf=1e9).sum())
                    if not train:
                        continue
                    root = (raw * Var(g / len(at), constant=True)).reshape(-1).sum(0)  # its gradient at raw is g
                    (root + self.penalty if self.penalty is not None else root).backward(np.array(1.0))
                    t += 1
                    for k, v in self.moments.items():
                        own[k][...] = 0.9 * own[k] + 0.1 * v
                    if (now := [k for k in names if p[k].grad is not None and k not in fixed]) != live:
                        live = now
                        some = np.concatenate([np.arange(a, b) for k, a, b in zip(names, cut[:-1], cut[1:], strict=True) if k in set(live)] or [np.zeros(0, int)])
                        some = slice(None) if len(some) == len(flat) else some
                    for k in live:
                        grads[k][...], p[k].grad = p[k].grad, None
                    for k in fixed:
                        p[k].grad = None
                    d = g_flat[some] + self.weight_decay * flat[some]
                    m[some] = 0.9 * m[some] + 0.1 * d
                    s[some] = 0.999 * s[some] + 0.001 * d * d
                    flat[some] -= lr * (m[some] / (1 - 0.9**t)) / (np.sqrt(s[some] / (1 - 0.999**t)) + 1e-8)
            if n:
                packed = flat * n if train else np.zeros(1)
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([packed.tobytes()])], ["n", "total", "params"])

        return run

    def _pass(self, src: DataFrame, loss: families.Family | None, lr: float, epoch: int, train: bool) -> float:
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, packed = 0, 0.0, None
            for batch in batches:
                for i in range(batch.num_rows):
                    v = np.frombuffer(batch.column("params")[i].as_buffer())
                    n, total, packed = n + batch.column("n")[i].as_py(), total + batch.column("total")[i].as_py(), v.copy() if packed is None else packed + v
            if packed is not None:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([packed.tobytes()])], ["n", "total", "params"])

        kind = "n long, total double, params binary"
        rows = src.mapInArrow(self._epoch(loss, lr, epoch, train), kind).repartition(FAN_IN).mapInArrow(merge, kind).collect()
        n, total = sum(r["n"] for r in rows), sum(r["total"] for r in rows)
        if train and n:
            at, packed = 0, sum(np.frombuffer(r["params"]) for r in rows)
            for k in sorted(self.params):
                size = self.params[k].size
                self.params[k] = (packed[at : at + size] / n).reshape(self.params[k].shape)
                at += size
        return total / n if n else float("inf")

    def _percentiles(self, src: DataFrame) -> np.ndarray:
        """Percentiles of every input column, from 1 to 99 of 100 (grid x columns)."""
        grid = F.array(*map(F.lit, np.linspace(0.01, 0.99, 99).tolist()))
        out = []
        for a in range(0, self.width, 200):  # a job for 200 columns
            row = src.agg(*(F.percentile_approx(F.get("b", F.lit(i)), grid, 1000).alias(f"q{i}") for i in range(a, min(a + 200, self.width)))).first()
            out += [q or [0.0] * 99 for q in row]
        return np.array(out, float).T

    def _save(self, spark, path: str) -> None:
        """The best parameters so far, as a table of one row in any store that Spark writes; an epoch that is lost loses no more than itself."""
        spark.createDataFrame([(type(self).__name__, self.to_json())], "kind string, state string").coalesce(1).write.mode("overwrite").parquet(path)

    def fit(self, df: DataFrame, y: str, pre: Preprocessor, family: families.Family | None = None, validation: DataFrame | None = None, partitions: int | None = None, go_on: bool = False, size: int | None = None) -> NeuralModel:
        """``size`` is the number of rows of ``df``, where it is known. ``df`` (and ``validation``) hold the encoded blocks and the target. Stops early on the validation loss and keeps the best parameters. ``go_on`` starts from the parameters of the fit before."""
        if not go_on:
            self._build(pre, family.size if family else 1)
        self.family = family
        spark = df.sparkSession
        n = partitions or int(min(max(-(-(df.count() if size is None else size) // self.rows_per_task), 1), MOST_TASKS))
        rows = df.select(self._input(pre).alias("b"), F.col(y).cast("double").alias("y")).where("b is not null and y is not null").withColumn("k", F.xxhash64("b", "y"))
        src = rows.repartition(n, "k").sortWithinPartitions("k").drop("k").persist(StorageLevel.MEMORY_AND_DISK)
        val = validation.select(self._input(pre).alias("b"), F.col(y).cast("double").alias("y")).where("b is not null and y is not null").persist(StorageLevel.MEMORY_AND_DISK) if validation is not None else src
        if not go_on and (family is None or family.name == "quantile"):
            start = F.avg("y") if family is None else F.percentile_approx("y", F.array(*map(F.lit, np.linspace(0, 1, self.outputs + 2)[1:-1].tolist())))[0]
            self.params["intercept"][0] = src.agg(start).first()[0]
        if self.kind == "nodegam" and self.data_start and not go_on:
            self._trees().start(self.params, self._percentiles(src), np.random.default_rng(self.seed))
        best, kept, wait, lr, self.history = float("inf"), self.params, 0, self.lr, []
        steps = self.anneal_epochs or max(self.max_epochs // 2, 1)
        try:
            for epoch in range(self.max_epochs):
                self.temperature = temperature(epoch, steps, 1.0, self.least_temperature)
                self._pass(src, family, lr, epoch, True)
                loss = self._pass(val, family, lr, epoch, False)
                self.history.append(loss)
                if loss < best - 1e-9:
                    best, kept, wait = loss, {k: v.copy() for k, v in self.params.items()}, 0
                    if self.checkpoint:
                        self._save(spark, self.checkpoint)
                else:
                    wait += 1
                    if wait % (self.lr_patience + 1) == self.lr_patience:
                        lr *= self.lr_factor
                    if wait >= self.patience:
                        break
        finally:
            src.unpersist()
            val.unpersist()
        self.params = kept
        return self

    # ---- scoring

    def _input(self, pre: Preprocessor) -> Column:
        return F.concat(*(F.col(f.block) if f.kind == "num" or f.encoding == "one_hot" else one_hot(F.col(f.block), len(f.state["categories"]) + 1) for f in pre.features))

    def terms(self) -> list[str]:
        p = {k: Var(v) for k, v in self.params.items()}
        return list(self._forward(p, np.zeros((1, self.width))))

    def transform(self, df: DataFrame, pre: Preprocessor, without: Sequence[str] = ()) -> DataFrame:
        """Adds ``raw`` (an array), ``output`` (its first component) and ``f_<term>`` of the first component, in Arrow batches. Columns ``without`` are read and do not come back."""
        names, width = self.terms(), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = {k: Var(v) for k, v in self.params.items()}
            for batch in batches:
                rows = _matrix(batch.column("_b"), width) if batch.num_rows else np.zeros((0, width))
                raw, terms = self._raw(p, rows)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * raw.value.shape[1]), pa.array(raw.value.ravel()))
                own = {f"f_{t}": pa.array(terms[t].value[:, 0]) for t in names}
                yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_b"]).columns, *own.values(), flat, pa.array(raw.value[:, 0])], [*(n for n in batch.schema.names if n != "_b"), *own, "raw", "output"])

        fields = [*df.drop(*without).schema.fields, *(T.StructField(f"f_{t}", T.DoubleType()) for t in names), T.StructField("raw", T.ArrayType(T.DoubleType())), T.StructField("output", T.DoubleType())]
        return df.withColumn("_b", self._input(pre)).drop(*without).mapInArrow(run, T.StructType(fields))

    def freeze(self, *beginnings: str) -> NeuralModel:
        """Parameters whose names begin so are left as they are by a fit that continues from here (none given: all are free again)."""
        self.frozen = beginnings
        return self

    def summary(self, spark) -> DataFrame:
        """(parameter, shape, size, trained) of every parameter."""
        rows = [(k, list(v.shape), v.size, not k.endswith(".running") and not (self.frozen and k.startswith(tuple(self.frozen)))) for k, v in self.params.items()]
        return spark.createDataFrame(rows, "parameter string, shape array<int>, size long, trained boolean")

    def parameter_count(self) -> int:
        return sum(v.size for v in self.params.values())

    def to_json(self) -> str:
        state = {k: getattr(self, k) for k in ("names", "is_cat", "slices", "width", "outputs", "pairs")}
        return json.dumps({"config": dataclasses.asdict(self), "state": state, "params": {k: v.tolist() for k, v in self.params.items()}})

    @classmethod
    def from_json(cls, text: str) -> NeuralModel:
        got = json.loads(text)
        m = cls(**{**got["config"], "hidden": tuple(got["config"]["hidden"]), "frozen": tuple(got["config"].get("frozen", ()))})
        m.__dict__ |= got["state"]
        m.slices = {k: tuple(v) for k, v in m.slices.items()}
        m.params, m.family = {k: np.array(v) for k, v in got["params"].items()}, None
        return m
