"""Soft oblivious trees that stay additive: each tree chooses one or two features, and may read earlier trees only of these.

A tree has ``arity`` selectors over the input columns. While it is trained a selector is a sparse mixture (entmax by default) whose temperature falls
from 1 by epochs, log-linearly; for scoring it is the largest logit alone, so a tree is a function of its features and goes to the term that they name. Level k of a tree splits what selector
k mod arity gives by a threshold, softly (entmoid by default); leaves hold responses.

Later layers read earlier trees: weights of a later tree on earlier ones are the product of how far each of their features lies within its own, with learned attention
if ``attention`` is its width. With hard selectors that is 1 or 0, so terms stay functions of their features.

Thresholds start at random percentiles of the chosen columns and widths so that the data lie within the bins' linear part.
"""

from __future__ import annotations

import dataclasses

import numpy as np

from terrace.plans.autodiff import Var, concat

CHOICES, BINS = ("entmax15", "softmax", "gumbel", "sparsemax"), ("entmoid15", "sparsemoid", "sigmoid")


@dataclasses.dataclass
class Trees:
    """Structure of the trees; parameters live in the dict that the methods are given."""

    columns: list[int]
    names: list[str]
    outputs: int = 1
    num_trees: int = 20
    depth: int = 3
    layers: int = 1
    arity: int = 1
    choice: str = "entmax15"
    bins: str = "entmoid15"
    attention: int = 0

    def __post_init__(self) -> None:
        if self.choice not in CHOICES or self.bins not in BINS:
            raise ValueError(f"choice must be one of {CHOICES} and bins one of {BINS}")
        self.wide = self.outputs + (self.layers > 1)  # one more response for later layers

    def build(self, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """Starting parameters; ``columns`` gives the feature of each input column."""
        p, n, f = {}, self.num_trees, len(self.columns)
        for k in range(self.layers):
            p[f"tree{k}.select"] = rng.uniform(0, 1, (n * self.arity, f))
            p[f"tree{k}.threshold"] = np.zeros((n, self.depth))
            p[f"tree{k}.width"] = np.zeros((n, self.depth))
            p[f"tree{k}.leaf"] = rng.normal(0, 0.05, (n, 2**self.depth, self.wide))
            p[f"tree{k}.last"] = np.ones((n, self.outputs))
            if k:
                p[f"tree{k}.gain"] = np.full(n, 0.1)
                if self.attention:
                    p[f"tree{k}.query"], p[f"tree{k}.key"] = rng.normal(0, 0.1, (n, self.attention)), rng.normal(0, 0.1, (k * n, self.attention))
        return p

    def start(self, p: dict[str, np.ndarray], percentiles: np.ndarray, rng: np.random.Generator) -> None:
        """Thresholds and widths from percentiles of the columns (grid x columns)."""
        for k in range(self.layers):
            weight = self._weights(Var(p[f"tree{k}.select"]), 1.0, None, soft=True).value.reshape(self.num_trees, self.arity, -1)
            for level in range(self.depth):
                own = weight[:, level % self.arity] @ percentiles.T  # trees x grid
                at = rng.integers(0, len(percentiles), self.num_trees)
                p[f"tree{k}.threshold"][:, level] = own[np.arange(self.num_trees), at]
                far = np.abs(own - p[f"tree{k}.threshold"][:, level : level + 1]).max(1)
                p[f"tree{k}.width"][:, level] = np.log(np.maximum(far, 1e-6) / 2)

    def _weights(self, logits: Var, temperature: float, rng: np.random.Generator | None, soft: bool) -> Var:
        if not soft:
            return Var(np.eye(logits.value.shape[1])[logits.value.argmax(1)])
        if self.choice == "gumbel" and rng is not None:
            logits = logits + Var(rng.gumbel(size=logits.value.shape))
        logits = logits * (1 / temperature)
        return logits.entmax15() if self.choice == "entmax15" else logits.sparsemax() if self.choice == "sparsemax" else logits.softmax()

    def _bin(self, z: Var) -> Var:
        if self.bins == "entmoid15":
            return z.entmoid15()
        if self.bins == "sigmoid":
            return z.sigmoid()
        right = (z * 0.5 + 0.5).relu()
        return right - (right - 1.0).relu()

    def forward(self, p: dict[str, Var], rows: np.ndarray, temperature: float, rng: np.random.Generator | None, soft: bool) -> tuple[list[Var], Var | None]:
        """Each layer's contributions (rows x trees x outputs), and the mean square of all responses."""
        n, t = len(rows), self.num_trees
        to_feature = np.zeros((len(self.columns), len(self.names)))
        to_feature[np.arange(len(self.columns)), self.columns] = 1
        x, out, earlier, features, square = Var(rows), [], None, [], None
        for k in range(self.layers):
            weight = self._weights(p[f"tree{k}.select"], temperature, rng, soft)
            value = (x @ weight.transpose(1, 0)).reshape(n, t, self.arity)
            by_feature = (weight @ Var(to_feature)).reshape(t, self.arity, len(self.names))
            if k:
                without = None  # how far a feature is not the tree's
                for c in range(self.arity):
                    rest = 1.0 - by_feature[:, c, :]
                    without = rest if without is None else without * rest
                match = None
                for c in range(self.arity):
                    inside = (1.0 - without) @ concat([f[:, c, :] for f in features], 0).transpose(1, 0)
                    match = inside if match is None else match * inside
                if self.attention:
                    score = p[f"tree{k}.query"] @ p[f"tree{k}.key"].transpose(1, 0) * self.attention**-0.5
                    match = match * (score - float(score.value.max())).exp()
                match = match * (match.sum(1).reshape(t, 1) + 1e-9).power(-1.0)
                value = value + ((earlier @ match.transpose(1, 0)) * p[f"tree{k}.gain"]).reshape(n, t, 1)
            leaves = None
            for level in range(self.depth):
                r = self._bin((value[:, :, level % self.arity] - p[f"tree{k}.threshold"][:, level]) * (-p[f"tree{k}.width"][:, level]).exp()).reshape(n, t, 1)
                leaves = concat([1.0 - r, r], 2) if leaves is None else concat([leaves * (1.0 - r), leaves * r], 2)
            response = (leaves.transpose(1, 0, 2) @ p[f"tree{k}.leaf"]).transpose(1, 0, 2)
            features.append(by_feature)
            if k < self.layers - 1:
                more = response[:, :, self.outputs]
                earlier = more if earlier is None else concat([earlier, more], 1)
            own = response[:, :, : self.outputs] * p[f"tree{k}.last"]
            mean = (own * own).reshape(-1).sum(0) * (1 / own.value.size)
            square = mean if square is None else square + mean
            out.append(own * (1 / t))
        return out, square

    def chosen(self, p: dict[str, np.ndarray]) -> list[list[str]]:
        """Features of every tree, layer by layer."""
        out = []
        for k in range(self.layers):
            best = np.array(self.columns)[p[f"tree{k}.select"].argmax(1)].reshape(self.num_trees, self.arity)
            out += [[self.names[i] for i in sorted(set(row))] for row in best.tolist()]
        return out
