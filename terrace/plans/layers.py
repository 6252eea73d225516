"""Layers of neural shapes: cubic splines whose knots are learned, and hard oblique trees with surrogate gradients; and shape functions of a user's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from terrace.operators.splines import CubicSpline
from terrace.plans.autodiff import Var, concat

# ---- splines with learned knots


def knots(distances: Var, low: float = 0.0, high: float = 1.0) -> Var:
    """Ascending knots from ``low`` to ``high`` whose distances are in proportion to softplus(distances)."""
    n = distances.value.size
    s = distances.reshape(1, n).softplus()
    share = s * s.sum(1).power(-1.0).reshape(1, 1) * (high - low)
    inner = share @ Var(np.triu(np.ones((n, n - 1)))) + low  # the last one is fixed, not summed up
    return concat([Var(np.full((1, 1), low)), inner, Var(np.full((1, 1), high))], 1).reshape(n + 1)


def _curvature_slopes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """F, S as ``splines.curvature`` has them, and their derivatives by each knot (knot first)."""
    h, k = np.diff(t), len(t)
    i = np.arange(k - 2)
    d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    d[i, i], d[i, i + 1], d[i, i + 2] = 1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]
    b[i, i] = (h[:-1] + h[1:]) / 3
    b[i[1:], i[:-1]] = b[i[:-1], i[1:]] = h[1:-1] / 6
    inverse = np.linalg.inv(b)
    inner = inverse @ d
    by_step_d, by_step_b = np.zeros((k - 1, k - 2, k)), np.zeros((k - 1, k - 2, k - 2))  # by each distance
    q = 1 / h**2
    by_step_d[i, i, i], by_step_d[i, i, i + 1] = -q[:-1], q[:-1]
    by_step_d[i + 1, i, i + 1], by_step_d[i + 1, i, i + 2] = q[1:], -q[1:]
    by_step_b[i, i, i] = by_step_b[i + 1, i, i] = 1 / 3
    by_step_b[i[1:], i[1:], i[:-1]] = by_step_b[i[1:], i[:-1], i[1:]] = 1 / 6
    d_inner = np.einsum("ij,mjk->mik", inverse, by_step_d - by_step_b @ inner)
    d_s = np.einsum("mji,jk->mik", by_step_d, inner) + np.einsum("ji,mjk->mik", d, d_inner)
    zero = np.zeros((k - 1, 1, k))
    by_step = np.concatenate([zero, d_inner, zero], 1)

    def by_knot(x: np.ndarray) -> np.ndarray:
        out = np.zeros((k, *x.shape[1:]))
        out[1:] += x
        out[:-1] -= x
        return out

    return np.vstack([np.zeros(k), inner, np.zeros(k)]), d.T @ inner, by_knot(by_step), by_knot(d_s)


def basis(x: np.ndarray, t: Var) -> Var:
    """The natural cubic basis at x (rows x knots), differentiable by its knots; linear beyond them."""
    spline = CubicSpline(t.value)

    def back(g: np.ndarray) -> np.ndarray:
        k = spline.width
        f, _, df, _ = _curvature_slopes(spline.knots)
        inside = np.clip(x, spline.knots[0], spline.knots[-1])
        beyond = x - inside
        j = np.clip(np.searchsorted(spline.knots, inside, "left"), 1, k - 1) - 1
        h = np.diff(spline.knots)[j]
        b = (inside - spline.knots[j]) / h
        a = 1 - b
        rows = np.arange(len(x))
        ca, cb = (a**3 - a) * h * h / 6, (b**3 - b) * h * h / 6
        # by F at fixed place, then by a, b and h at fixed F
        out = np.einsum("ni,n,mni->m", g, ca, df[:, j], optimize=True) + np.einsum("ni,n,mni->m", g, cb, df[:, j + 1], optimize=True)
        ga = g[rows, j] + (3 * a * a - 1) * h * h / 6 * (g * f[j]).sum(1)
        gb = g[rows, j + 1] + (3 * b * b - 1) * h * h / 6 * (g * f[j + 1]).sum(1)
        gh = (a**3 - a) * h / 3 * (g * f[j]).sum(1) + (b**3 - b) * h / 3 * (g * f[j + 1]).sum(1)
        # where x lies at an end, its place there moves with the knot
        moves = (beyond == 0).astype(float)
        np.add.at(out, j, (ga - gb) * a / h * moves - gh)
        np.add.at(out, j + 1, (ga - gb) * b / h * moves + gh)
        for side, first in ((np.minimum(beyond, 0), True), (np.maximum(beyond, 0), False)):
            if side.any():
                e = 0 if first else k - 2
                step = spline.knots[e + 1] - spline.knots[e]
                total = (g * side[:, None]).sum(0)
                row, sign = (1, -1.0) if first else (k - 2, 1.0)
                out += sign * step / 6 * np.einsum("i,mi->m", total, df[:, row])
                by_step = -(total[e + 1] - total[e]) / step**2 + sign / 6 * total @ f[row]
                out[e + 1] += by_step
                out[e] -= by_step
        # beyond an end the distance to it changes with it
        low, high = spline.slopes
        out[0] -= (g[beyond < 0] @ low).sum()
        out[-1] -= (g[beyond > 0] @ high).sum()
        return out

    return Var(spline.rows(x), ((t, back),))


def roughness(t: Var, w: Var) -> Var:
    """The sum over outputs of w' S w, S the roughness penalty at these knots."""
    f, s, _, ds = _curvature_slopes(t.value)
    v = w.value
    return Var(np.einsum("io,ij,jo->", v, s, v), ((t, lambda g: g * np.einsum("io,mij,jo->m", v, ds, v)), (w, lambda g: g * (s + s.T) @ v)))


def closeness(t: Var) -> Var:
    """The sum of the inverse distances of neighbouring knots."""
    h = np.diff(t.value)

    def back(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t.value))
        out[1:] -= g / h**2
        out[:-1] += g / h**2
        return out

    return Var((1 / h).sum(), ((t, back),))


# ---- oblique trees


def hard_trees(x: np.ndarray, split: Var, leaf: Var, sharp: float = 4.0) -> Var:
    """The sum of trees that send a row left where (1, x) @ split > 0, node by node, and give its leaf's values: split is trees x inputs x nodes (level by level), leaf trees x leaves x outputs.

    The forward pass is hard. Going back, a node that a row passes gets the difference between its two sides' values for that row, times the slope of a sigmoid of ``sharp`` times the decision.
    """
    w, v = split.value, leaf.value
    trees, nodes, leaves = w.shape[0], w.shape[2], v.shape[1]
    depth = leaves.bit_length() - 1
    inputs = np.hstack([np.ones((len(x), 1)), x])
    s = np.einsum("ni,tik->ntk", inputs, w, optimize=True)
    at = np.zeros((len(x), trees), np.int64)
    passed = []
    for _ in range(depth):
        passed.append(at)
        right = np.take_along_axis(s, at[:, :, None], 2)[:, :, 0] <= 0
        at = 2 * at + 1 + right
    at = at - nodes
    tree = np.arange(trees)
    out = v[tree, at].sum(1)

    def to_leaf(g: np.ndarray) -> np.ndarray:
        cell = (tree * leaves + at).ravel()
        return np.stack([np.bincount(cell, np.repeat(g[:, o], trees), trees * leaves) for o in range(v.shape[2])], 1).reshape(v.shape)

    def to_split(g: np.ndarray) -> np.ndarray:
        # what every node would give to a row, for one number a leaf: its values along g
        value = np.einsum("tlo,no->ntl", v, g, optimize=True)
        grad = np.zeros_like(w)
        for level in range(depth - 1, -1, -1):
            first, count = (1 << level) - 1, 1 << level
            left, other = value[:, :, 0::2], value[:, :, 1::2]
            own = passed[level] - first
            difference = np.take_along_axis(left - other, own[:, :, None], 2)[:, :, 0]
            z = sharp * np.take_along_axis(s, passed[level][:, :, None], 2)[:, :, 0]
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            slope = difference * sharp * p * (1 - p)
            cell = (tree * count + own).ravel()
            for i in range(inputs.shape[1]):
                grad[:, i, first : first + count] = np.bincount(cell, (slope * inputs[:, i : i + 1]).ravel(), trees * count).reshape(trees, count)
            value = np.where(s[:, :, first : first + count] > 0, left, other)
        return grad

    return Var(out, ((split, to_split), (leaf, to_leaf)))


def start_trees(rng: np.random.Generator, trees: int, inputs: int, depth: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """(split, leaf) whose cuts lie where inputs of mean 0 and variance 1 do."""
    nodes = (1 << depth) - 1
    direction = rng.normal(size=(trees, inputs, nodes))
    direction /= np.linalg.norm(direction, axis=1, keepdims=True)
    place = rng.normal(0, 1, (trees, 1, nodes))
    return np.concatenate([-place, direction], 1), np.zeros((trees, nodes + 1, outputs))


# ---- a user's own


@dataclass
class Shape:
    """A shape function of a user's own, trained as the others are.

    ``start(rng, widths, outputs)`` gives parameters by name; ``forward(parameters, blocks, rng)`` gives an output (rows x outputs) a term, from parameters and blocks of inputs as ``Var``; ``rng`` is None when scoring.
    """

    start: Callable[[np.random.Generator, dict[str, int], int], dict[str, np.ndarray]]
    forward: Callable[[dict[str, Var], dict[str, Var], np.random.Generator | None], dict[str, Var]]


REGISTRY: dict[str, Shape] = {}
