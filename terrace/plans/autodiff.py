"""Reverse-mode differentiation over numpy arrays: enough for the neural shape functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over broadcast axes."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


class Var:
    """An array with the operations that led to it. What is ``constant``, or made of constants alone, gets no gradient."""

    __array_priority__ = 100

    def __init__(self, value: np.ndarray, sources: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = (), constant: bool = False) -> None:
        self.value, self.grad = np.asarray(value, float), None
        self.sources = tuple(x for x in sources if not x[0].constant)
        self.constant = not self.sources if sources else constant

    def __add__(self, other: Var | float) -> Var:
        o = wrap(other)
        return Var(self.value + o.value, ((self, lambda g: _fit(g, self.value.shape)), (o, lambda g: _fit(g, o.value.shape))))

    def __mul__(self, other: Var | float) -> Var:
        o = wrap(other)
        return Var(self.value * o.value, ((self, lambda g: _fit(g * o.value, self.value.shape)), (o, lambda g: _fit(g * self.value, o.value.shape))))

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self) -> Var:
        return self * -1.0

    def __sub__(self, other: Var | float) -> Var:
        return self + -wrap(other)

    def __rsub__(self, other: float) -> Var:
        return wrap(other) - self

    def __matmul__(self, other: Var) -> Var:
        o = wrap(other)
        turn = lambda a: np.swapaxes(a, -1, -2)
        return Var(self.value @ o.value, ((self, lambda g: _fit(g @ turn(o.value), self.value.shape)), (o, lambda g: _fit(turn(self.value) @ g, o.value.shape))))

    def affine(self, w: Var, b: Var) -> Var:
        """Rows of self @ w + b as one operation."""
        return Var(self.value @ w.value + b.value, ((self, lambda g: g @ w.value.T), (w, lambda g: self.value.T @ g), (b, lambda g: g.sum(0))))

    def __getitem__(self, key) -> Var:
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, key, g)
            return out

        return Var(self.value[key], ((self, back),))

    def power(self, p: float) -> Var:
        return Var(self.value**p, ((self, lambda g: g * p * self.value ** (p - 1)),))

    def relu(self) -> Var:
        return Var(np.maximum(self.value, 0), ((self, lambda g: g * (self.value > 0)),))

    def exp(self) -> Var:
        e = np.exp(self.value)
        return Var(e, ((self, lambda g: g * e),))

    def sum(self, axis: int) -> Var:
        return Var(self.value.sum(axis), ((self, lambda g: np.broadcast_to(np.expand_dims(g, axis), self.value.shape)),))

    def reshape(self, *shape: int) -> Var:
        return Var(self.value.reshape(shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def transpose(self, *axes: int) -> Var:
        return Var(self.value.transpose(axes), ((self, lambda g: g.transpose(np.argsort(axes))),))

    def softmax(self) -> Var:
        e = np.exp(self.value - self.value.max(-1, keepdims=True))
        s = e / e.sum(-1, keepdims=True)
        return Var(s, ((self, lambda g: s * (g - (g * s).sum(-1, keepdims=True))),))

    def sigmoid(self) -> Var:
        s = 1 / (1 + np.exp(-np.clip(self.value, -500, 500)))
        return Var(s, ((self, lambda g: g * s * (1 - s)),))

    def softplus(self) -> Var:
        s = 1 / (1 + np.exp(-np.clip(self.value, -500, 500)))
        return Var(np.logaddexp(0, self.value), ((self, lambda g: g * s),))

    def sparsemax(self) -> Var:
        """Projection of the last axis to the simplex."""
        z = -np.sort(-self.value, -1)
        k = np.arange(1, z.shape[-1] + 1)
        total = np.cumsum(z, -1) - 1
        n = (z * k > total).sum(-1, keepdims=True)
        s = np.maximum(self.value - np.take_along_axis(total, n - 1, -1) / n, 0)
        return Var(s, ((self, lambda g: (s > 0) * (g - (g * (s > 0)).sum(-1, keepdims=True) / n)),))

    def entmax15(self) -> Var:
        """The 1.5-entmax of the last axis: squares of what lies above a threshold, which add up to 1."""
        v = (self.value - self.value.max(-1, keepdims=True)) / 2
        z = -np.sort(-v, -1)
        k = np.arange(1, z.shape[-1] + 1)
        mean, square = np.cumsum(z, -1) / k, np.cumsum(z * z, -1) / k
        tau = mean - np.sqrt(np.maximum((1 - k * (square - mean * mean)) / k, 0))
        n = (tau <= z).sum(-1, keepdims=True)
        root = np.maximum(v - np.take_along_axis(tau, n - 1, -1), 0)
        return Var(root * root, ((self, lambda g: root * (g - (g * root).sum(-1, keepdims=True) / root.sum(-1, keepdims=True))),))

    def entmoid15(self) -> Var:
        """The 1.5-entmax of (x, 0), of which this is the first."""
        t = np.abs(self.value)
        low = np.where(t < 2, np.maximum((np.sqrt(np.maximum(8 - t * t, 0)) - t) / 4, 0) ** 2, 0.0)
        s = np.where(self.value >= 0, 1 - low, low)
        a, b = np.sqrt(s), np.sqrt(1 - s)
        return Var(s, ((self, lambda g: g * a * b / (a + b)),))

    def standardized(self, axis: int, eps: float = 1e-5) -> Var:
        """Centred and scaled along ``axis``."""
        c = self.value - self.value.mean(axis, keepdims=True)
        d = np.sqrt((c * c).mean(axis, keepdims=True) + eps)
        z = c / d
        return Var(z, ((self, lambda g: (g - g.mean(axis, keepdims=True) - z * (g * z).mean(axis, keepdims=True)) / d),))

    def layer_norm(self, eps: float = 1e-5) -> Var:
        c = self.value - self.value.mean(-1, keepdims=True)
        d = np.sqrt((c * c).mean(-1, keepdims=True) + eps)
        z = c / d
        return Var(z, ((self, lambda g: (g - g.mean(-1, keepdims=True) - z * (g * z).mean(-1, keepdims=True)) / d),))

    def dropped(self, mask: np.ndarray) -> Var:
        return self * Var(mask, constant=True)

    def backward(self, grad: np.ndarray) -> None:
        """Adds to ``grad`` of everything this was made of."""
        order, seen = [], set()
        todo: list[tuple[Var, bool]] = [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(s, False) for s, _ in v.sources if s.sources]
        self.grad = np.asarray(grad, float)
        for v in reversed(order):
            if v.grad is not None:
                for s, back in v.sources:
                    g = back(v.grad)
                    s.grad = g if s.grad is None else s.grad + g


def wrap(x: Var | np.ndarray | float) -> Var:
    return x if isinstance(x, Var) else Var(x, constant=True)


def concat(parts: list[Var], axis: int) -> Var:
    cuts = np.cumsum([p.value.shape[axis] for p in parts])[:-1]
    return Var(np.concatenate([p.value for p in parts], axis), tuple((p, lambda g, i=i: np.split(g, cuts, axis)[i]) for i, p in enumerate(parts)))
