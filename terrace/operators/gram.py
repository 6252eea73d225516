"""One-pass sufficient statistics of vector columns: counts, sums and cross products, added up in tasks and by a narrow second stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Build = Callable[[pa.RecordBatch], np.ndarray]
#: Tasks of the second stage; as many matrices come to the driver.
FAN_IN = 8


@dataclass
class Gram:
    """Over rows: n, sum w, sum w b, sum w b b', sum w b y, sum w y, sum w y^2, max |b|_1 by block."""

    n: int
    weight: float
    b: np.ndarray
    bb: np.ndarray
    by: np.ndarray
    y: float
    yy: float
    norms: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"rows must have {width} components")
    return flat.reshape(-1, width)


def vectors_of(width: int) -> Build:
    """Rows of an array column b."""
    return lambda batch: _matrix(batch.column("b"), width)


def gram(df: DataFrame, vector: Column | dict[str, Column], width: int, y: Column | None = None, weight: Column | None = None, blocks: list[int] | None = None, build: Build | None = None) -> Gram:
    """Statistics of ``vector`` (array of ``width`` doubles); rows where any of the inputs is NULL do not count. ``blocks`` are widths for ``norms``.

    With ``build``, ``vector`` names the columns that it makes the rows x width matrix of, in numpy: a basis need not be a column.
    """
    cuts = np.cumsum([0, *(blocks or [width])])
    inputs = vector if isinstance(vector, dict) else {"b": vector}
    build = build or vectors_of(width)
    src = df.select(*(c.alias(k) for k, c in inputs.items()), (y if y is not None else F.lit(0.0)).cast("double").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")).dropna()
    size = width * width + 2 * width + 4

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, top = np.zeros(size), np.zeros(len(cuts) - 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            b, t, w = build(batch), batch.column("y").to_numpy(), batch.column("w").to_numpy()
            wb = b * w[:, None]
            total += np.concatenate([[len(b), w.sum(), w @ t, w @ (t * t)], wb.sum(0), wb.T @ t, (wb.T @ b).ravel()])
            top = np.maximum(top, np.add.reduceat(np.abs(b), cuts[:-1], axis=1).max(0))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([top.tobytes()])], ["total", "top"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, top = np.zeros(size), np.zeros(len(cuts) - 1)
        for batch in batches:
            for t, m in zip(batch.column("total").to_pylist(), batch.column("top").to_pylist(), strict=True):
                total += np.frombuffer(t)
                top = np.maximum(top, np.frombuffer(m))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([top.tobytes()])], ["total", "top"])

    kinds = "total binary, top binary"
    rows = src.mapInArrow(partial, kinds).repartition(FAN_IN).mapInArrow(merge, kinds).collect()
    total = np.sum([np.frombuffer(r["total"]) for r in rows], axis=0)
    top = np.max([np.frombuffer(r["top"]) for r in rows], axis=0)
    head, b, by, bb = np.split(total, [4, 4 + width, 4 + 2 * width])
    return Gram(int(head[0]), head[1], b, bb.reshape(width, width), by, head[2], head[3], top)


def sufficient_stats(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """n, sums and pairwise cross products of a few scalar columns as one aggregate of expressions: (name, value) rows."""
    names = [*columns, y]
    terms = [("n", F.count("*").cast("double")), *((f"sum_{c}", F.sum(c)) for c in names), *((f"{a}_{b}", F.sum(F.col(a) * F.col(b))) for i, a in enumerate(names) for b in names[i:])]
    row = df.agg(*(v.alias(k) for k, v in terms))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k, _ in terms))).alias("t")).select("t.*")
