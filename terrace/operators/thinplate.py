"""Thin-plate regression splines: eigenvectors of the radial matrix over the distinct rows, whatever their number, evaluated row by row.

Up to ``LOCAL`` distinct rows the matrix is decomposed on the driver. Beyond that it is never written: a block Krylov iteration multiplies it, tile by tile in tasks, with a few vectors that stay in a table
of tiles; only matrices of the subspace's size come to the driver. Both give the same eigenvectors up to sign (to ``TOLERANCE``).

In one or two dimensions tiles are the leaves of a tree of halved boxes, and only near tiles are multiplied row by row: what boxes apart from each other by their size or more do to each other goes through the
radial function's Chebyshev interpolation (``NODES`` a side, error about 1e-12 of the values), so a step grows in proportion to the rows. In more dimensions every tile meets every tile.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions import exprs
from terrace.sources.shared import added, removed, written

#: Distinct rows that the driver decomposes by itself, rows of a tile, the residual of an eigenpair (of the largest eigenvalue) that ends the iteration, and its most steps.
LOCAL, TILE, TOLERANCE, STEPS = 2000, 1024, 1e-11, 60
#: Interpolation nodes a side of a box, leaves whose products a task adds up, most rows of the sample that places the tree's cuts (any cuts give the same products).
NODES, BLOCK, CUTS = 14, 16, 200_000
#: Bytes of knots and coefficients that an evaluation sends to the executors at a time.
SENT = 64 << 20


def radial_constant(order: int, dims: int) -> float:
    """The factor of the thin-plate radial function r^(2m - d) (times log r for even d)."""
    if dims % 2 == 0:
        return (-1) ** (order + 1 + dims // 2) / (2 ** (2 * order - 1) * math.pi ** (dims / 2) * math.factorial(order - 1) * math.factorial(order - dims // 2))
    return math.gamma(dims / 2 - order) / (2 ** (2 * order) * math.pi ** (dims / 2) * math.factorial(order - 1))


def radial(r: np.ndarray, order: int, dims: int) -> np.ndarray:
    """The radial function; 0 at r = 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = radial_constant(order, dims) * r ** (2 * order - dims) * (np.log(r) if dims % 2 == 0 else 1.0)
    return np.where(r > 0, out, 0.0)


def monomials(order: int, dims: int) -> list[tuple[int, ...]]:
    """Exponents of all monomials of degree below ``order``: a basis of what the penalty leaves free."""
    return sorted((p for p in itertools.product(range(order), repeat=dims) if sum(p) < order), key=lambda p: (sum(p), tuple(-v for v in p)))


def distances(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((x[:, i, None] - knots[None, :, i]) ** 2 for i in range(x.shape[1])))


def free(x: np.ndarray, powers: list[tuple[int, ...]]) -> np.ndarray:
    """The monomials of rows."""
    return np.stack([np.prod(x**p, axis=1) for p in powers], 1)


def _null_space(order: int, d: int, k: int, u: int) -> list[tuple[int, ...]]:
    if 2 * order <= d:
        raise ValueError("the order of the penalty must exceed half the number of dimensions")
    powers = monomials(order, d)
    if not len(powers) < k <= u:
        raise ValueError(f"k must exceed {len(powers)} and be at most {u} distinct rows")
    return powers


@dataclass
class ThinPlate:
    """A basis of rank k over distinct knots (u x d), each there ``counts`` times; ``map`` takes radial values and monomials of a row to its basis."""

    knots: np.ndarray
    k: int
    order: int
    counts: np.ndarray | None = None

    def __post_init__(self) -> None:
        u, d = self.knots.shape
        powers = self.powers = _null_space(self.order, d, self.k, u)
        m, weight = len(powers), np.ones(u) if self.counts is None else np.asarray(self.counts, float)
        value, vector = np.linalg.eigh(radial(distances(self.knots, self.knots), self.order, d))
        top = np.argsort(-value)[: self.k]
        value, vector = value[top], vector[:, top]
        t = free(self.knots, powers)
        z = np.linalg.qr(vector.T @ t, mode="complete")[0][:, m:]
        self.basis = np.hstack([vector * value @ z, t])
        scale = 1 / np.sqrt(weight @ self.basis**2 / weight.sum())
        self.basis *= scale
        self.map = np.zeros((u + m, self.k))
        self.map[:u, : self.k - m] = vector @ z
        self.map[u:, self.k - m :] = np.eye(m)
        self.map *= scale
        self.penalty = np.zeros((self.k, self.k))
        self.penalty[: self.k - m, : self.k - m] = (z.T * value) @ z
        self.penalty *= np.outer(scale, scale)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """The basis at rows x."""
        return np.hstack([radial(distances(x, self.knots), self.order, x.shape[1]), free(x, self.powers)]) @ self.map

    def column(self, xs: list[Column]) -> Column:
        """The basis as an array column."""
        return _evaluated(xs, self.knots, self.map, self.order, self.powers)

    def uncentred(self, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A basis's coefficients as those of the knots' radial functions and of the monomials."""
        full = self.map @ coefficients
        return full[: len(self.knots)], full[len(self.knots) :]

    def effect(self, xs: list[Column], coefficients: np.ndarray) -> Column:
        """basis @ coefficients at any rows."""
        return F.get(_evaluated(xs, self.knots, (self.map @ coefficients)[:, None], self.order, self.powers), F.lit(0))

    def with_effect(self, df: DataFrame, xs: list[Column], coefficients: np.ndarray, name: str) -> DataFrame:
        return df.withColumn(name, self.effect(xs, coefficients))

    def with_basis(self, df: DataFrame, xs: list[Column], name: str) -> DataFrame:
        return df.withColumn(name, self.column(xs))

    def at_knots(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """(columns, basis) of the distinct rows: what a fit joins its rows with, in place of u radial functions a row."""
        rows = [(*map(float, x), list(map(float, b))) for x, b in zip(self.knots, self.basis, strict=True)]
        return df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns) + ", basis array<double>")

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.knots.min(0), self.knots.max(0)


def _evaluated(xs: list[Column], knots: np.ndarray, table: np.ndarray, order: int, powers: list[tuple[int, ...]]) -> Column:
    """[radial values at ``knots``, monomials] @ ``table`` of each row, in Arrow batches; NULL where a coordinate is."""

    @F.pandas_udf("array<double>")
    def run(*parts: pd.Series) -> pd.Series:
        x = np.stack([p.to_numpy(float) for p in parts], 1)
        out = np.full((len(x), table.shape[1]), np.nan)
        for a in range(0, len(x), max(1, (1 << 21) // max(len(knots), 1))):
            own = x[a : a + max(1, (1 << 21) // max(len(knots), 1))]
            out[a : a + len(own)] = np.hstack([radial(distances(own, knots), order, x.shape[1]), free(own, powers)]) @ table
        return pd.Series(list(out))

    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, run(*(x.cast("double") for x in xs)))


@dataclass
class TiledThinPlate:
    """The same basis with knots in a table of tiles (tile, x, basis, map): for more distinct rows than the driver decomposes."""

    tiles: DataFrame
    u: int
    dims: int
    k: int
    order: int
    free_map: np.ndarray
    penalty: np.ndarray
    extent: tuple[np.ndarray, np.ndarray]
    powers: list[tuple[int, ...]] = field(init=False)

    def __post_init__(self) -> None:
        self.powers = monomials(self.order, self.dims)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.extent

    def at_knots(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """(columns, basis) of the distinct rows."""
        d, k = self.dims, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, basis in zip(batch.column("x").to_pylist(), batch.column("basis").to_pylist(), strict=True):
                    x, basis = np.frombuffer(x).reshape(-1, d), np.frombuffer(basis)
                    cut = pa.array(np.arange(0, len(basis) + 1, k, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[:, i])) for i in range(d)), pa.ListArray.from_arrays(cut, pa.array(basis))], [*columns, "basis"])

        return self.tiles.select("x", "basis").mapInArrow(run, ", ".join(f"`{c}` double" for c in columns) + ", basis array<double>")

    def _groups(self) -> list[list[int]]:
        """Tiles whose knots and coefficients are sent together."""
        tiles = sorted(r["tile"] for r in self.tiles.select("tile").collect())
        most = max(1, SENT // (TILE * 2 * (self.dims + self.k) * 8))
        return [tiles[a : a + most] for a in range(0, len(tiles), most)]

    def _some(self, group: list[int], table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        rows = self.tiles.where(F.col("tile").isin(group)).select("x", "map").collect()  # ``SENT`` at most
        x = np.vstack([np.frombuffer(r["x"]).reshape(-1, self.dims) for r in rows])
        m = np.vstack([np.frombuffer(r["map"]).reshape(-1, self.k) for r in rows])
        return x, m if table is None else m @ table

    def _summed(self, df: DataFrame, xs: list[Column], table: np.ndarray | None, name: str) -> DataFrame:
        """Adds [radial values, monomials] @ map (@ table), a pass of the rows for each ``SENT`` bytes of knots."""
        fixed = self.free_map if table is None else self.free_map @ table
        groups, coordinates = self._groups(), [f"_tp_{name}_{i}" for i in range(self.dims)]
        df = df.withColumns(dict(zip(coordinates, xs, strict=True)))
        for no, group in enumerate(groups):
            x, m = self._some(group, table)
            more = _evaluated([F.col(c) for c in coordinates], x, np.vstack([m, fixed if no == 0 else 0 * fixed]), self.order, self.powers)
            df = df.withColumn(name, more if no == 0 else F.zip_with(name, more, lambda a, b: a + b))
            if no + 1 < len(groups):
                df = written(df, "thin-plate")
        return df.drop(*coordinates)

    def with_basis(self, df: DataFrame, xs: list[Column], name: str) -> DataFrame:
        """Adds the basis at any rows."""
        return self._summed(df, xs, None, name)

    def with_effect(self, df: DataFrame, xs: list[Column], coefficients: np.ndarray, name: str) -> DataFrame:
        """Adds basis @ coefficients: at rows of the fit by a join with the distinct rows, at others (if there are any) by all radial functions."""
        names, knots = [f"_tp_{name}_{i}" for i in range(self.dims)], [f"_knot_{name}_{i}" for i in range(self.dims)]
        known = self.at_knots(df, knots).select(*knots, sum((F.get("basis", F.lit(i)) * float(c) for i, c in enumerate(coefficients)), F.lit(0.0)).alias(name))
        met = df.withColumns(dict(zip(names, (x.cast("double") for x in xs), strict=True)))
        met = met.join(known, [F.col(c) == F.col(n) for c, n in zip(names, knots, strict=True)], "left").drop(*knots)
        new = F.col(name).isNull()
        for c in names:
            new = new & F.col(c).isNotNull()
        rest = met.where(new)
        done = met.drop(*names)
        if rest.isEmpty():
            return done
        more = self._summed(rest.drop(name, *names), xs, np.asarray(coefficients)[:, None], name).withColumn(name, F.get(name, F.lit(0)))
        return met.where(~new).drop(*names).unionByName(more)

    def knot_coefficients(self, coefficients: np.ndarray) -> DataFrame:
        """(tile, x, delta): the radial functions' coefficients, as bytes of doubles."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                delta = [(np.frombuffer(m).reshape(-1, k) @ coefficients).tobytes() for m in batch.column("map").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("tile"), batch.column("x"), pa.array(delta, pa.binary())], ["tile", "x", "delta"])

        return self.tiles.select("tile", "x", "map").mapInArrow(run, "tile int, x binary, delta binary")


def _cuts(x: DataFrame, columns: list[str], u: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of the cut of each inner node of a tree with leaves of about ``tile`` rows, children of node i at 2 i + 1 and 2 i + 2: medians of the wider side."""
    depth = max(0, math.ceil(math.log2(max(u / tile, 1))))
    share = max(1, -(-u // min(CUTS, 64 << depth)))
    some = x.where(F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(share)) == 0).select(*columns)
    rows = [np.array(sorted(tuple(r) for r in some.collect())).reshape(-1, len(columns))]
    dims, values = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
    for i in range(2**depth - 1):
        own = rows[i]
        if len(own):
            dims[i] = np.argmax(np.ptp(own, axis=0))
            values[i] = np.sort(own[:, dims[i]])[(len(own) - 1) // 2]
        left = own[:, dims[i]] <= values[i]
        rows += [own[left], own[~left]]
    return dims, values


def _leaf(columns: list[str], dims: np.ndarray, values: np.ndarray) -> Column:
    """The leaf that a row falls into."""

    @F.pandas_udf("int")
    def run(*parts: pd.Series) -> pd.Series:
        x, at = np.stack([p.to_numpy(float) for p in parts], 1), np.zeros(len(parts[0]), int)
        while len(dims) and len(at) and at[0] < len(dims):  # all leaves are equally deep
            at = 2 * at + 1 + (x[np.arange(len(x)), dims[at]] > values[at])
        return pd.Series((at - len(dims)).astype(np.int32))

    return run(*map(F.col, columns))


def _weights(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of a box, each row's weights of them): Chebyshev interpolation a side, one node where the box is flat."""
    at, weight = np.zeros((1, 0)), np.ones((len(x), 1))
    for i in range(len(lo)):
        own, w = np.array([lo[i]]), np.ones((len(x), 1))
        if hi[i] > lo[i]:
            angle, k = np.pi * (np.arange(NODES) + 0.5) / NODES, np.arange(1, NODES)
            own = (lo[i] + hi[i]) / 2 + (hi[i] - lo[i]) / 2 * np.cos(angle)
            place = np.arccos(np.clip((2 * x[:, i] - lo[i] - hi[i]) / (hi[i] - lo[i]), -1, 1))
            w = 1 / NODES + 2 / NODES * np.cos(place[:, None] * k) @ np.cos(k[:, None] * angle)
        at = np.hstack([np.repeat(at, len(own), 0), np.tile(own, len(at))[:, None]])
        weight = (weight[:, :, None] * w[:, None, :]).reshape(len(x), weight.shape[1] * w.shape[1])
    return at, weight


@dataclass
class _Boxes:
    """The tree's boxes and, by block of ``BLOCK`` leaves, which pairs of leaves and which pairs of boxes (target, source) a product takes."""

    lo: np.ndarray
    hi: np.ndarray
    leaves: int
    near: dict[int, list[tuple[int, int]]]
    far: dict[int, dict[int, list[int]]]

    def path(self, leaf: int) -> Iterator[int]:
        """A leaf's box and those around it."""
        at = leaf + self.leaves - 1
        while True:
            yield at
            if not at:
                return
            at = (at - 1) // 2


def _boxes(state: DataFrame, d: int, leaves: int) -> _Boxes:
    """From a row a leaf: its extent."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(b).reshape(-1, d) for b in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array([np.concatenate([v.min(0), v.max(0)]).tolist() for v in x], pa.list_(pa.float64()))], ["tile", "ends"])

    lo, hi = np.full((2 * leaves - 1, d), np.inf), np.full((2 * leaves - 1, d), -np.inf)
    for r in state.select("tile", "x").mapInArrow(ends, "tile int, ends array<double>").collect():
        lo[r["tile"] + leaves - 1], hi[r["tile"] + leaves - 1] = r["ends"][:d], r["ends"][d:]
    for i in range(leaves - 2, -1, -1):
        lo[i], hi[i] = np.minimum(lo[2 * i + 1], lo[2 * i + 2]), np.maximum(hi[2 * i + 1], hi[2 * i + 2])
    full = np.isfinite(lo[:, 0])
    size = np.sqrt(np.where(full[:, None], np.where(full[:, None], hi, 0) - np.where(full[:, None], lo, 0), 0) ** 2 @ np.ones(d))
    near, far = {}, {}
    first = lambda i: (i + 1) * (leaves >> ((i + 1).bit_length() - 1)) - leaves  # noqa: E731  the first leaf under a node
    a, b = np.array([0]), np.array([0])
    while len(a):
        keep = full[a] & full[b]
        a, b = a[keep], b[keep]
        gap = np.sqrt(np.maximum(np.maximum(lo[a] - hi[b], lo[b] - hi[a]), 0) ** 2 @ np.ones(d))
        apart = (gap > 0) & (gap >= np.maximum(size[a], size[b]))
        ends_a, ends_b = a >= leaves - 1, b >= leaves - 1
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            low = first(i)
            many = max(1, leaves >> ((i + 1).bit_length() - 1))
            for k in range(low // BLOCK, (low + many - 1) // BLOCK + 1):
                far.setdefault(k, {}).setdefault(i, []).append(j)
        met = ~apart & ends_a & ends_b
        for i, j in zip((a[met] - leaves + 1).tolist(), (b[met] - leaves + 1).tolist(), strict=True):
            near.setdefault(i // BLOCK, []).append((i, j))
        on = ~apart & ~(ends_a & ends_b)
        a, b, ends_a, ends_b = a[on], b[on], ends_a[on], ends_b[on]
        cut_a, cut_b = ~ends_a & (ends_b | (size[a] >= size[b])), ~ends_b & (ends_a | (size[b] >= size[a]))
        pairs = [(2 * a + 1 + p if p is not None else a, 2 * b + 1 + q if q is not None else b, pick) for pick, ps, qs in ((cut_a & cut_b, (0, 1), (0, 1)), (cut_a & ~cut_b, (0, 1), (None,)), (~cut_a & cut_b, (None,), (0, 1))) for p in ps for q in qs]
        a, b = np.concatenate([x[pick] for x, _, pick in pairs]), np.concatenate([y[pick] for _, y, pick in pairs])
    return _Boxes(lo, hi, leaves, near, far)


def _multiplied_near_and_far(state: DataFrame, boxes: _Boxes, order: int, d: int, width: int) -> DataFrame:
    """As ``_multiplied``: a task adds up the products of a block of leaves, from near leaves' rows and far boxes' sums at their nodes."""
    spark, lo, hi = state.sparkSession, boxes.lo, boxes.hi
    sources = {j for own in boxes.far.values() for js in own.values() for j in js}
    last = lambda q, x: np.ascontiguousarray(np.frombuffer(q).reshape(len(x) // (8 * d), -1)[:, -width:])

    def own_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["tile"]], pa.int32()), pa.array([r["x"]], pa.binary()), pa.array([last(r["q"], r["x"]).tobytes()], pa.binary())], ["id", "x", "v"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        given = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["id", "v"])
        for batch in batches:
            for r in batch.to_pylist():
                x, v = np.frombuffer(r["x"]).reshape(-1, d), last(r["q"], r["x"])
                for node in boxes.path(r["tile"]):
                    if node in sources:
                        total[node] = total.get(node, 0) + _weights(x, lo[node], hi[node])[1].T @ v
                if len(total) > 512:
                    yield given()
                    total = {}
        if total:
            yield given()

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"id": table.column("id")[:1], "v": pa.array([sum(np.frombuffer(b) for b in table.column("v").to_pylist()).tobytes()], pa.binary())})

    def product(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        mine = {r["id"]: r for r in rows if r["kind"] == 0}
        at = {r["id"]: (np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["v"]).reshape(-1, width) if r["kind"] else last(r["q"], r["x"])) for r in rows if r["kind"] < 2}
        sums = {r["id"]: np.frombuffer(r["v"]).reshape(-1, width) for r in rows if r["kind"] == 2}
        w, block = {t: np.zeros_like(at[t][1]) for t in mine}, rows[0]["block"]
        for t, j in boxes.near.get(block, []):
            w[t] += radial(distances(at[t][0], at[j][0]), order, d) @ at[j][1]
        nodes, local = {}, {}
        place = lambda i: nodes[i] if i in nodes else nodes.setdefault(i, _weights(np.zeros((0, d)), lo[i], hi[i])[0])
        for i, js in boxes.far.get(block, {}).items():
            local[i] = sum(radial(distances(place(i), place(j)), order, d) @ sums[j] for j in js)
        for t in mine:
            for i in boxes.path(t):
                if i in local:
                    w[t] += _weights(at[t][0], lo[i], hi[i])[1] @ local[i]
        return pa.table({"tile": pa.array(list(mine), pa.int32()), **{c: pa.array([r[c] for r in mine.values()], pa.binary()) for c in ("x", "n", "q")}, "w": pa.array([w[t].tobytes() for t in mine], pa.binary())})

    none = F.lit(None).cast("binary")
    block = F.floor(F.col("tile") / BLOCK).cast("int").alias("block")
    dealt = state.select(block, F.lit(0).alias("kind"), F.col("tile").alias("id"), "x", none.alias("v"), "n", "q")
    near = sorted({(k, j) for k, pairs in boxes.near.items() for _, j in pairs if j // BLOCK != k})
    if near:
        to = spark.createDataFrame(pd.DataFrame(near, columns=["block", "to"]), "block int, to int")
        vectors = state.select("tile", "x", "q").mapInArrow(own_vectors, "id int, x binary, v binary").join(to, F.col("id") == F.col("to"))
        dealt = dealt.unionByName(vectors.select("block", F.lit(1).alias("kind"), "id", "x", "v", none.alias("n"), none.alias("q")))
    far = sorted({(k, j) for k, own in boxes.far.items() for js in own.values() for j in js})
    if far:
        to = spark.createDataFrame(pd.DataFrame(far, columns=["block", "to"]), "block int, to int")
        total = state.select("tile", "x", "q").mapInArrow(summed, "id int, v binary").groupBy("id").applyInArrow(merged, "id int, v binary").join(to, F.col("id") == F.col("to"))
        dealt = dealt.unionByName(total.select("block", F.lit(2).alias("kind"), "id", none.alias("x"), "v", none.alias("n"), none.alias("q")))
    return dealt.groupBy("block").applyInArrow(product, "tile int, x binary, n binary, q binary, w binary")


def _packed(x: DataFrame, columns: list[str], tiles: int, width: int, cuts: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(tile, x, n, q): rows by the leaf they fall into, or else by the hash of their coordinates, in order within a tile, with counts and a block of start vectors."""
    d = len(columns)

    def pack(table: pa.Table) -> pa.Table:
        part = np.stack([table.column(c).to_numpy() for c in [*columns, "_n"]], 1)
        part = part[np.lexsort(part[:, d - 1 :: -1].T if d > 1 else part[:, :1].T)]
        tile = table.column("_tile")[0].as_py()
        start = np.random.default_rng(tile).normal(size=(len(part), width))
        return pa.table({"tile": pa.array([tile], pa.int32()), "x": pa.array([np.ascontiguousarray(part[:, :d]).tobytes()], pa.binary()), "n": pa.array([np.ascontiguousarray(part[:, d]).tobytes()], pa.binary()), "q": pa.array([start.tobytes()], pa.binary())})

    keyed = x.withColumn("_tile", F.pmod(F.xxhash64(*columns), F.lit(tiles)).cast("int") if cuts is None else _leaf(columns, *cuts))
    return written(keyed.groupBy("_tile").applyInArrow(pack, "tile int, x binary, n binary, q binary"), "tiles")


def _multiplied(state: DataFrame, order: int, d: int, width: int) -> DataFrame:
    """The state with w: the radial matrix times the last ``width`` columns of q. Every tile goes to every tile, and a task adds up one tile's products as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict | None = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own["tile"]], pa.int32()), *(pa.array([own[c]], pa.binary()) for c in ("x", "n", "q")), pa.array([own["w"].tobytes()], pa.binary())], ["tile", "x", "n", "q", "w"])

        for batch in batches:
            for r in batch.to_pylist():
                x, v = np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["v"]).reshape(-1, width)
                if own is None or own["tile"] != r["tile"]:  # a tile's own row comes first
                    if own is not None:
                        yield done()
                    own = {**r, "at": x, "w": np.zeros_like(v)}
                own["w"] += radial(distances(own["at"], x), order, d) @ v
        if own is not None:
            yield done()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = len(r["x"]) // (8 * d)
                v = np.ascontiguousarray(np.frombuffer(r["q"]).reshape(rows, -1)[:, -width:])
                yield pa.RecordBatch.from_arrays([pa.array([r["tile"]], pa.int32()), pa.array([r["x"]], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["other", "x", "v"])

    every = state.select(F.col("tile").alias("to"))
    sent = state.select("tile", "x", "q").mapInArrow(last, "other int, x binary, v binary").join(F.broadcast(every), F.lit(True))  # tile numbers only
    home = state.select(F.col("tile").alias("home"), "n", "q")
    mine = sent.where("other = to").join(home, F.col("to") == F.col("home")).select("to", "other", "x", "v", "n", "q")
    rest = sent.where("other <> to").select("to", "other", "x", "v", F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("q"))
    dealt = mine.unionByName(rest).withColumnRenamed("to", "tile").repartition("tile").sortWithinPartitions("tile", F.col("n").isNull(), "other")
    return dealt.mapInArrow(run, "tile int, x binary, n binary, q binary, w binary")


def _eigen(state: DataFrame, order: int, d: int, k: int, width: int, boxes: _Boxes | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(state, values, y): the k largest eigenvalues, with eigenvectors q @ y."""
    shape = lambda r: len(r["x"]) // (8 * d)

    def parts(r: dict) -> tuple[np.ndarray, np.ndarray]:
        q = np.frombuffer(r["q"]).reshape(shape(r), -1)
        return q, np.frombuffer(r["w"]).reshape(shape(r), -1) if "w" in r else q

    def orthonormal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(R, its inverse) with R'R the cross product."""
        r = np.linalg.cholesky(gram + np.eye(len(gram)) * np.trace(gram) * 1e-15).T
        return r, np.linalg.inv(r)

    def applied(table: DataFrame, h: np.ndarray, inverse: np.ndarray, append: bool, h2: np.ndarray | None = None, inverse2: np.ndarray | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    q, w = parts(r)
                    w = (w - q @ h) @ inverse if append else w @ inverse
                    if h2 is not None:
                        w = (w - q @ h2) @ inverse2
                    out = np.hstack([q, w]) if append else w
                    yield pa.RecordBatch.from_arrays([pa.array([r["tile"]], pa.int32()), pa.array([r["x"]], pa.binary()), pa.array([r["n"]], pa.binary()), pa.array([np.ascontiguousarray(out).tobytes()], pa.binary())], ["tile", "x", "n", "q"])

        return written(table.mapInArrow(run, "tile int, x binary, n binary, q binary"), "krylov")

    def crossed(h: np.ndarray | None = None, inverse: np.ndarray | None = None):  # noqa: ANN202
        def of(r: dict) -> np.ndarray:
            q, w = parts(r)
            if h is not None:
                w = (w - q @ h) @ inverse
            return np.concatenate([(q.T @ w).ravel(), (w.T @ w).ravel()])

        return of

    gram = added(state.select("x", "q"), lambda r: (parts(r)[0].T @ parts(r)[0]).ravel(), width * width).reshape(width, width)
    _, inverse = orthonormal(gram)
    state = applied(state, np.zeros((0, 0)), inverse, False)
    t, m = np.zeros((0, 0)), width
    for _ in range(STEPS):
        more = written(_multiplied(state, order, d, width) if boxes is None else _multiplied_near_and_far(state, boxes, order, d, width), "product")
        size = m * width + width * width
        got = added(more.select("x", "q", "w"), crossed(), size)
        h, gram = got[: m * width].reshape(m, width), got[m * width :].reshape(width, width)
        r1, i1 = orthonormal(gram - h.T @ h)
        got = added(more.select("x", "q", "w"), crossed(h, i1), size)
        h2 = got[: m * width].reshape(m, width)
        r2, i2 = orthonormal(got[m * width :].reshape(width, width) - h2.T @ h2)
        new = np.zeros((m, m))
        new[: m - width, : m - width] = t if len(t) else new[:0, :0]
        column = h + h2 @ r1
        new[:, m - width :], new[m - width :, :] = column, column.T
        t, link = new, r2 @ r1
        value, y = np.linalg.eigh((t + t.T) / 2)
        top = np.argsort(-value)[:k]
        value, y = value[top], y[:, top]
        residual = np.linalg.norm(link @ y[m - width :], axis=0).max()
        if m >= k + width and residual <= TOLERANCE * np.abs(t).max():
            removed(more)
            return state, value, y
        old, state = state, applied(more, h, i1, True, h2, i2)
        removed(old, more)
        m += width
    raise RuntimeError(f"the eigenvectors did not settle in {STEPS} steps: residual {residual:.2g}")


def _tiled(x: DataFrame, columns: list[str], u: int, k: int, order: int, tile: int) -> TiledThinPlate:
    d, width = len(columns), k + 6
    powers = _null_space(order, d, k, u)
    m = len(powers)
    cuts = _cuts(x, columns, u, tile) if d <= 2 else None
    packed = _packed(x, columns, -(-u // tile), width, cuts)
    state, value, y = _eigen(packed, order, d, k, width, None if cuts is None else _boxes(packed, d, len(cuts[0]) + 1))
    vector = lambda r: (np.frombuffer(r["x"]).reshape(-1, d), np.frombuffer(r["q"]).reshape(-1, len(y)) @ y)

    def sums(r: dict) -> np.ndarray:
        at, v = vector(r)
        t, n = free(at, powers), np.frombuffer(r["n"])[:, None]
        return np.concatenate([(v.T @ t).ravel(), ((v * value * n).T @ (v * value)).ravel(), (t * t * n).sum(0), n.sum(0)])

    got = added(state.select("x", "n", "q"), sums, k * m + k * k + m + 1)
    cross, square, ones, n = got[: k * m].reshape(k, m), got[k * m : k * m + k * k].reshape(k, k), got[-m - 1 : -1], got[-1]
    z = np.linalg.qr(cross, mode="complete")[0][:, m:]
    scale = 1 / np.sqrt(np.concatenate([np.diag(z.T @ square @ z), ones]) / n)
    penalty = np.zeros((k, k))
    penalty[: k - m, : k - m] = (z.T * value) @ z
    free_map = np.hstack([np.zeros((m, k - m)), np.eye(m)]) * scale

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, v = vector(r)
                basis = np.hstack([v * value @ z, free(at, powers)]) * scale
                table = np.hstack([v @ z, np.zeros((len(v), m))]) * scale
                yield pa.RecordBatch.from_arrays([pa.array([r["tile"]], pa.int32()), *(pa.array([b], pa.binary()) for b in (r["x"], np.ascontiguousarray(basis).tobytes(), np.ascontiguousarray(table).tobytes()))], ["tile", "x", "basis", "map"])

    tiles = written(state.mapInArrow(finished, "tile int, x binary, basis binary, map binary"), "thin-plate")
    removed(state)
    ends = x.agg(*(f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.min, F.max))).first()
    return TiledThinPlate(tiles, u, d, k, order, free_map, penalty * np.outer(scale, scale), (np.array([ends[f"min{i}"] for i in range(d)]), np.array([ends[f"max{i}"] for i in range(d)])))


def fit(df: DataFrame, columns: list[str], k: int = 10, order: int = 2, local: int = LOCAL, tile: int = TILE) -> ThinPlate | TiledThinPlate:
    """Over all distinct rows of ``columns`` without a missing value, each weighing as often as it is there."""
    x = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().groupBy(*columns).agg(F.count("*").cast("double").alias("_n"))
    x = written(x, "distinct")
    u = x.count()
    if u > local:
        out = _tiled(x, columns, u, k, order, tile)
        removed(x)
        return out
    rows = np.array(sorted(tuple(r) for r in x.collect())).reshape(-1, len(columns) + 1)
    removed(x)
    return ThinPlate(rows[:, :-1], k, order, rows[:, -1])


def at_rows(smooth: ThinPlate | TiledThinPlate, df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Adds the basis at rows of the fit, by a join with the distinct rows; NULL at any other row."""
    names = [f"_at_{name}_{i}" for i in range(len(columns))]
    known = smooth.at_knots(df, names).withColumnRenamed("basis", name)
    same = [F.col(c).cast("double") == F.col(n) for c, n in zip(columns, names, strict=True)]
    return df.join(known, same, "left").drop(*names)


def plot_grid(smooth: ThinPlate | TiledThinPlate, df: DataFrame, columns: list[str], coefficients: np.ndarray, points: int | None = None) -> DataFrame:
    """(columns, effect) on an even grid over the knots' extent: 1,000 points of one dimension, 50 x 50 of two, as many a side for more."""
    d = len(columns)
    points = points or (1000 if d == 1 else 50)
    low, high = smooth.bounds()
    spark, at = df.sparkSession, F.col("id")
    grid = spark.range(points**d).select(*((F.lit(float(low[i])) + F.pmod(F.floor(at / points**i), F.lit(points)) * float((high[i] - low[i]) / max(points - 1, 1))).alias(c) for i, c in enumerate(columns)))
    return smooth.with_effect(grid, [F.col(c) for c in columns], coefficients, "effect")
