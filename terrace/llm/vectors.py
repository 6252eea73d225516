"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, and so do their projections on any orthonormal axes.
Vectors are sorted by label and by the cells, eps wide, of their coordinates on the leading ``AXES`` principal axes (fitted to
all vectors), and the sequence is cut into intervals: ranges of partitions, partitions, blocks of ``BLOCK`` vectors. From the top
down, pairs of intervals of one label are joined unless their bounding boxes are more than eps apart; pairs of blocks go on
recursively in halves, down to tiles of ``TILE`` vectors that a matrix product in double precision decides. How much is skipped depends on how much
of the vectors' variance the axes hold and on how many vectors there are; ``tiles`` gives it. Any axes give the same links.

Equal vectors of one label are one class, and a class goes on as one vector with a count. A pair of blocks gives a link count
a vector and a spanning forest of its links, never the list of its links. Dense groups of any size are split into blocks.

Nulls: rows with a null label, or a vector that is null, empty, zero or has a null or non-finite component, have no links; vectors of
different lengths have none to each other. Equal rows count as several vectors; different vectors of one vec_id are one node, whose links add up. Ties in all cells are put in order by vec_id; a null vec_id has no links. Ids are integers (others stop the job with a cast error). Extra columns are not read. An
empty table gives an empty result. Vectors of any length are read whole; d numbers need a matrix of d^2 in a task, summed up by tasks of a few rows each, and one at the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import binaries, buckets, drop, stage
from terrace.llm.components import components

COSINE, AXES, BLOCK, TILE, FAN = 0.98, 6, 1024, 32, 6


def _unit(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector: the length, its rows, and the vectors scaled to length 1."""
    own = batch.column("v")
    size = own.value_lengths().to_numpy(zero_copy_only=False)
    flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    off = np.append(0, np.cumsum(size))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[off[rows][:, None] + np.arange(d)]
        x /= np.abs(x).max(1, keepdims=True)
        yield int(d), rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, _, x in _unit(batch):
            x = np.hstack([x, np.ones((len(x), 1))])
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()])], ["d", "m"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for d, m in zip(batch.column("d").to_pylist(), batch.column("m"), strict=True):
            total[d] = total.get(d, 0) + np.frombuffer(m.as_buffer())
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()])], ["d", "m"])


def principal_axes(vectors: DataFrame, axes: int = AXES) -> dict[int, np.ndarray]:
    """For each length d of vector, its leading principal axes as a d x axes matrix. A task gives one matrix of sums, and a few tasks add them up before the driver does."""
    sums, kind = vectors.mapInArrow(_moments, "d int, m binary"), "d int, m binary"
    for parts in (64, 8):
        sums = sums.repartition(parts).mapInArrow(_added, kind)
    out = {}
    for (batch,) in ((b,) for b in _added(sums.toArrow().to_batches())):
        d, m = batch.column("d")[0].as_py(), np.frombuffer(batch.column("m")[0].as_buffer())
        m = m.reshape(d + 1, d + 1) / m[-1]
        out[d] = np.linalg.eigh(m[:d, :d] - np.outer(m[d, :d], m[d, :d]))[1][:, ::-1][:, :axes]
    return out


def _cells(basis: dict[int, np.ndarray], eps: float, axes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dims = np.zeros((batch.num_rows, axes), np.int32), np.zeros(batch.num_rows, np.int32)
            for d, rows, x in _unit(batch):
                z = x @ basis[d]
                cell[rows[:, None], np.arange(z.shape[1])] = np.floor(z / eps)
                dims[rows] = d
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), *(pa.array(np.ascontiguousarray(cell[:, k])) for k in range(axes))], [*batch.schema.names, "d", *(f"c{k}" for k in range(axes))])

    return run


def _blocks(basis: dict[int, np.ndarray], axes: int, block: int):
    """Runs of up to ``block`` sorted rows of one label and length, with their bounding box."""

    def flush(rows: list[pa.RecordBatch], no: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        (d, _, x), = _unit(t)
        z = np.zeros((len(x), axes))
        z[:, : basis[d].shape[1]] = x @ basis[d]
        one = np.array([0, len(x)])
        flat = lambda a: pa.array([a.tolist()], pa.list_(pa.float64()))
        raw = t.column("v").flatten().to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [t.column("label").slice(0, 1), t.column("d").slice(0, 1), t.column("pid").slice(0, 1), pa.array([no], pa.int32()), flat(z.min(0)), flat(z.max(0)),
             binaries(t.column("rep").to_numpy(), one), binaries(t.column("n").to_numpy(), one), binaries(raw, np.array([0, len(raw)]))],
            ["label", "d", "pid", "no", "lo", "hi", "ids", "ns", "vs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, key, no = 0, None, 0
        for batch in batches:
            at = 0
            keys = list(zip(batch.column("label").to_pylist(), batch.column("d").to_pylist(), strict=True))
            while at < batch.num_rows:
                if held and (keys[at] != key or count == block):
                    yield flush(held, no)
                    held, count, no = [], 0, no + 1
                key, end = keys[at], at
                while end < batch.num_rows and keys[end] == key and count + end - at < block:
                    end += 1
                held.append(batch.slice(at, end - at))
                count, at = count + end - at, end
        if held:
            yield flush(held, no)

    return run


def _boxes(z: np.ndarray, tile: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bounding boxes of the tiles of a sequence, of pairs of tiles, and so on up to the whole."""
    cut = np.arange(0, len(z), tile)
    out = [(np.minimum.reduceat(z, cut), np.maximum.reduceat(z, cut))]
    while len(out[-1][0]) > 1:
        lo, hi = out[-1]
        cut = np.arange(0, len(lo), 2)
        out.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))
    return out


def tiles(za: np.ndarray, zb: np.ndarray, eps: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tiles of two sequences that may hold neighbours: pairs of intervals are halved from the whole down, and those provably apart are skipped."""
    a, b = _boxes(za, tile), _boxes(zb, tile)
    top = max(len(a), len(b))
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for k in range(top - 1, -1, -1):
        (la, ha), (lb, hb) = a[min(k, len(a) - 1)], b[min(k, len(b) - 1)]
        if k < top - 1:  # the halves of what is left
            x, y = np.repeat(2 * x, 4) + np.tile([0, 0, 1, 1], len(x)) if k < len(a) - 1 else np.repeat(x, 4), np.repeat(2 * y, 4) + np.tile([0, 1, 0, 1], len(y)) if k < len(b) - 1 else np.repeat(y, 4)
            x, y = np.unique(np.stack([x, y])[:, (x < len(la)) & (y < len(lb))], axis=1)
        gap = np.maximum(np.maximum(la[x] - hb[y], lb[y] - ha[x]), 0)
        near = (gap * gap).sum(1) <= eps * eps
        x, y = x[near], y[near]
    return x, y


def _join(basis: dict[int, np.ndarray], cosine: float, eps: float, tile: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, links, root = [], [], []
            for no in range(batch.num_rows):
                row = batch.slice(no, 1).to_pylist()[0]  # a pair of blocks
                d, ids, ns, xs = row["d"], [], [], []
                for s in "ab":
                    ids.append(np.frombuffer(row[f"ids_{s}"], np.int64))
                    ns.append(np.frombuffer(row[f"ns_{s}"], np.int64))
                    v = np.frombuffer(row[f"vs_{s}"], kind).astype(np.float64).reshape(-1, d)
                    v /= np.abs(v).max(1, keepdims=True)
                    xs.append(v / np.linalg.norm(v, axis=1, keepdims=True))
                same = row["same"]
                near = np.zeros((len(ids[0]), len(ids[1])), bool)
                left, right = tiles(xs[0] @ basis[d], xs[1] @ basis[d], eps, tile)
                for i in np.unique(left):
                    column = (right[left == i][:, None] * tile + np.arange(tile)).ravel()
                    column = column[column < len(xs[1])]
                    near[i * tile : (i + 1) * tile, column] = xs[0][i * tile : (i + 1) * tile] @ xs[1][column].T >= cosine
                if same:
                    near |= near.T
                    np.fill_diagonal(near, False)
                if not near.any():
                    continue
                la, lb = ids[0].copy(), ids[1].copy()
                big = np.iinfo(np.int64).max
                while True:
                    down = np.minimum(lb, np.where(near, la[:, None], big).min(0))
                    up = np.minimum(la, np.where(near, down[None, :], big).min(1))
                    if same:
                        up = down = np.minimum(up, down)
                    if (up == la).all() and (down == lb).all():
                        break
                    la, lb = up, down
                for own, n, r in ((ids[0], near @ ns[1], la), (ids[1], near.T @ ns[0], lb))[: 1 if same else 2]:
                    some = n > 0
                    node.append(own[some])
                    links.append(n[some])
                    root.append(r[some])
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node, links, root)], ["node", "links", "root"])

    return run


def near_duplicates(table: DataFrame, cosine: float = COSINE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    item = table.schema["embedding"].dataType.elementType
    if not isinstance(item, (T.FloatType, T.DoubleType)):
        table, item = table.withColumn("embedding", F.col("embedding").cast("array<double>")), T.DoubleType()
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    src = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, F.col("label").cast("string")).alias("label"), F.when(valid, F.col("embedding")).alias("v"))
    classes = src.where("label is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    one = stage(classes, "vectors")
    basis = principal_axes(one.select("v"), axes)
    cells = [f"c{k}" for k in range(axes)]
    parts = buckets(table)
    kinds = f"label string, v {src.schema['v'].dataType.simpleString()}, rep long, n long, d int, {', '.join(f'{c} int' for c in cells)}"
    ordered = one.mapInArrow(_cells(basis, eps, axes), kinds).repartitionByRange(parts, "label", "d", *cells, "rep").sortWithinPartitions("label", "d", *cells, "rep")
    made = ordered.select("label", "v", "rep", "n", "d", F.spark_partition_id().alias("pid")).mapInArrow(
        _blocks(basis, axes, block), "label string, d int, pid int, no int, lo array<double>, hi array<double>, ids binary, ns binary, vs binary")
    made = stage(made, "blocks")

    box = made.select("label", "d", "lo", "hi", F.struct("pid", "no").alias("i0"))
    top = 1
    while parts >> FAN * (top - 1) > 1 << FAN:
        top += 1
    for k in range(1, top + 1):  # interval k of a block: its partition, then runs of partitions
        box = box.withColumn(f"i{k}", F.struct(F.shiftright(F.col("i0.pid"), FAN * (k - 1)).alias("p"), F.lit(0).alias("z")))
    pairs = None
    for k in range(top, -1, -1):
        up = f"i{k + 1}" if k < top else None
        ends = lambda c, f: F.array(*(f(F.col(c)[j]).alias("x") for j in range(axes)))  # noqa: E731, B023
        level = box.groupBy("label", "d", *([up] if up else []), f"i{k}").agg(ends("lo", F.min).alias("lo"), ends("hi", F.max).alias("hi"))
        side = lambda s: level.select(F.col("label"), F.col("d"), *([F.col(up).alias(f"up_{s}")] if up else []), F.col(f"i{k}").alias(f"i_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))  # noqa: E731, B023
        if pairs is None:
            pairs = side("a").join(side("b"), ["label", "d"])
        else:
            was = pairs.select("label", "d", F.col("i_a").alias("up_a"), F.col("i_b").alias("up_b"))
            pairs = was.join(side("a"), ["label", "d", "up_a"]).join(side("b"), ["label", "d", "up_b"])
        gap = sum((F.pow(F.greatest(F.col("lo_a")[j] - F.col("hi_b")[j], F.col("lo_b")[j] - F.col("hi_a")[j], F.lit(0.0)), 2) for j in range(axes)), F.lit(0.0))
        pairs = pairs.where((F.col("i_a") <= F.col("i_b")) & (gap <= eps * eps)).select("label", "d", "i_a", "i_b")
    pairs = pairs.repartition(parts, "i_a", "i_b")
    for s in "ab":
        own = made.select("label", "d", F.struct("pid", "no").alias(f"i_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "ns", "vs")))
        pairs = pairs.join(own, ["label", "d", f"i_{s}"])
    pairs = pairs.select("d", (F.col("i_a") == F.col("i_b")).alias("same"), *(f"{c}_{s}" for c in ("ids", "ns", "vs") for s in "ab"))
    kind = np.float32 if isinstance(item, T.FloatType) else np.float64
    found = stage(pairs.mapInArrow(_join(basis, cosine, eps, TILE, kind), "node long, links long, root long"), "links")
    drop(made)
    root = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    done = one.join(links, one["rep"] == links["node"], "left").join(root.withColumnRenamed("root", "top").withColumnRenamed("node", "own"), F.col("rep") == F.col("own"), "left").select(
        "label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("top", "rep").alias("component"))
    return (
        src.join(done, ["label", "v"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
