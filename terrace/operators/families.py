"""Distribution families: parameters, links, and negative log-likelihoods as Column expressions and in numpy.

A family maps raw model outputs to parameters by links and gives the row-wise loss of a target. Log-gamma is a series of built-in
functions in Spark; on the executors' numpy side (training) it is the same series.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions import exprs
from terrace.functions.special import lgamma

LINKS: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: x, "softplus": exprs.softplus, "square": lambda x: x * x, "exp": F.exp, "sqrt": F.sqrt, "sigmoid": exprs.sigmoid, "log": lambda x: F.ln(x + 1e-6),
}
_NUMPY_LINKS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda x: x, "softplus": lambda x: np.logaddexp(0, x), "square": np.square, "exp": np.exp, "sqrt": np.sqrt, "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "log": lambda x: np.log(x + 1e-6),
}


def _lgamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    shift = x.copy()
    for k in range(1, 8):
        shift = shift * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - np.log(shift)


class _Ops:
    """The functions that a loss is written in, for Columns or arrays."""

    def __init__(self, log, exp, log1p, gamma, larger, choose) -> None:
        self.log, self.exp, self.log1p, self.lgamma, self.larger, self.choose = log, exp, log1p, gamma, larger, choose


SQL = _Ops(F.ln, F.exp, F.log1p, lgamma, lambda a, b: F.greatest(a, b), lambda c, a, b: F.when(c, a).otherwise(b))
NUMPY = _Ops(np.log, np.exp, np.log1p, _lgamma, np.maximum, np.where)
Loss = Callable[..., object]


@dataclass
class Family:
    """Parameter names, a link for each, and ``loss(ops, y, *parameters)``."""

    name: str
    parameters: list[str]
    links: list[str]
    loss: Loss
    custom: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    @property
    def size(self) -> int:
        return len(self.parameters)

    def transformed(self, raw: list[Column]) -> list[Column]:
        """Parameters of raw outputs; a callable in ``custom`` replaces a parameter's link."""
        return [self.custom.get(p, LINKS[k])(r).alias(p) for p, k, r in zip(self.parameters, self.links, raw, strict=True)]

    def nll(self, y: Column, parameters: list[Column]) -> Column:
        """The row's negative log-likelihood (for quantiles the pinball loss)."""
        return self.loss(SQL, y, *parameters)

    def numpy_nll(self, y: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """The loss of raw outputs (rows x parameters)."""
        return self.loss(NUMPY, y, *(_NUMPY_LINKS[k](raw[:, i]) for i, k in enumerate(self.links)))


def _normal(o, y, mean, scale):
    z = (y - mean) / scale
    return 0.5 * math.log(2 * math.pi) + o.log(scale) + 0.5 * z * z


def _poisson(o, y, rate):
    return rate - y * o.log(rate) + o.lgamma(y + 1.0)


def _gamma(o, y, shape, rate):
    return rate * y + o.lgamma(shape) - shape * o.log(rate) - (shape - 1.0) * o.log(y)


def _inverse_gamma(o, y, shape, scale):
    return scale / y + o.lgamma(shape) - shape * o.log(scale) + (shape + 1.0) * o.log(y)


def _beta(o, y, a, b):
    return o.lgamma(a) + o.lgamma(b) - o.lgamma(a + b) - (a - 1.0) * o.log(y) - (b - 1.0) * o.log(1.0 - y)


def _student(o, y, df, loc, scale):
    z = (y - loc) / scale
    return o.lgamma(df / 2) - o.lgamma((df + 1.0) / 2) + 0.5 * o.log(df * math.pi) + o.log(scale) + (df + 1.0) / 2 * o.log1p(z * z / df)


def _negative_binomial(o, y, mean, dispersion):
    """Mean as named: variance mean + dispersion mean^2."""
    r = 1.0 / dispersion
    return o.lgamma(r) + o.lgamma(y + 1.0) - o.lgamma(y + r) - r * o.log(r / (r + mean)) - y * o.log(mean / (r + mean))


def _bernoulli(o, y, logit):
    return o.larger(logit, 0.0 * logit) + o.log1p(o.exp(-o.larger(logit, -logit))) - y * logit


def _robust(rho: float) -> Loss:
    def loss(o, y, mean, scale):
        z = -_normal(o, y, mean, scale) + rho
        return math.log1p(math.exp(rho)) - (o.larger(z, 0.0 * z) + o.log1p(o.exp(-o.larger(z, -z))))

    return loss


def quantiles(levels: list[float]) -> Family:
    """Pinball losses of several quantiles, added."""
    if not levels or not all(0 < q < 1 for q in levels):
        raise ValueError(f"quantiles must lie between 0 and 1: {levels}")

    def loss(o, y, *found):
        return sum(o.larger((q - 1.0) * (y - f), q * (y - f)) for q, f in zip(levels, found, strict=True))

    return Family("quantile", [f"q{round(100 * q)}" for q in levels], ["identity"] * len(levels), loss)


def categorical(classes: int) -> Family:
    """Softmax over raw outputs, a parameter a class; targets are class numbers."""

    def loss(o, y, *z):
        top = z[0]
        for v in z[1:]:
            top = o.larger(top, v)
        norm = top + o.log(sum(o.exp(v - top) for v in z))
        own = z[0]
        for k, v in enumerate(z[1:], 1):
            own = o.choose(y == k, v, own)
        return norm - own

    return Family("categorical", [f"logit{k}" for k in range(classes)], ["identity"] * classes, loss)


def dirichlet_nll(y: Column, concentration: Column) -> Column:
    """For vectors y on the simplex and positive concentrations."""
    each = F.zip_with(concentration, y, lambda a, v: lgamma(a) - (a - 1.0) * F.ln(v))
    return exprs.total(each) - exprs.let(exprs.total(concentration), lgamma)


def categorical_nll(y: Column, logits: Column) -> Column:
    """For a vector of logits and a class number from 0."""
    return exprs.logsumexp(logits) - F.get(logits, y)


def pinball(y: Column, found: Column, levels: list[float]) -> Column:
    """For a vector of quantile predictions."""
    return exprs.total(F.zip_with(F.array(*map(F.lit, levels)), found, lambda q, f: F.greatest((q - 1) * (y - f), q * (y - f))))


def by_name(name: str, **options) -> Family:
    """A family by the name it is known by; options: ``levels``, ``classes``, ``robustness``."""
    simple = {
        "normal": (["mean", "scale"], ["identity", "softplus"], _normal), "poisson": (["rate"], ["softplus"], _poisson), "gamma": (["shape", "rate"], ["softplus"] * 2, _gamma),
        "inversegamma": (["shape", "scale"], ["softplus"] * 2, _inverse_gamma), "beta": (["alpha", "beta"], ["softplus"] * 2, _beta),
        "studentt": (["df", "loc", "scale"], ["softplus", "identity", "softplus"], _student), "negativebinom": (["mean", "dispersion"], ["softplus"] * 2, _negative_binomial),
        "bernoulli": (["logit"], ["identity"], _bernoulli), "robustnormal": (["mean", "scale"], ["identity", "softplus"], _robust(options.get("robustness", 0.1))),
    }
    if name in simple:
        return Family(name, *simple[name])
    if name == "quantile":
        return quantiles(list(options.get("levels") or options.get("quantiles") or (0.25, 0.5, 0.75)))
    if name in ("categorical", "dirichlet"):
        n = int(options["classes"])
        if name == "categorical":
            return categorical(n)

        def loss(o, y, *a):
            raise TypeError("a Dirichlet target is a vector: use dirichlet_nll")

        return Family("dirichlet", [f"concentration{k}" for k in range(n)], ["softplus"] * n, loss)
    raise ValueError(f"unknown family {name!r}")


FAMILIES = ("normal", "poisson", "gamma", "beta", "dirichlet", "studentt", "negativebinom", "inversegamma", "categorical", "quantile", "robustnormal")
