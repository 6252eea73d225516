"""Where rows come from and where fitted state goes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.plans.additive import AdditiveModel
from terrace.plans.boosted import BoostedFamily, OneVsRest, TabulatedGam
from terrace.plans.gam import Gam
from terrace.plans.neural import NeuralModel
from terrace.plans.preprocess import Preprocessor, as_frame

__all__ = ["as_frame", "load_state", "map_batches", "map_chunks", "read", "row_at", "save_state", "shuffled", "table", "training_batches"]

Model = AdditiveModel | NeuralModel | TabulatedGam | OneVsRest | BoostedFamily | Gam
_MODELS = {m.__name__: m for m in (AdditiveModel, NeuralModel, TabulatedGam, OneVsRest, BoostedFamily, Gam)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, source: str | DataFrame | pd.DataFrame | dict, kind: str = "parquet", **options: Any) -> DataFrame:
    """A DataFrame of a path in any format that Spark reads, or of a DataFrame, a pandas one or a dict of columns."""
    if isinstance(source, str):
        return spark.read.format(kind).options(**options).load(source)
    return as_frame(spark, source)


def map_chunks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over Arrow batches: how any row-wise numpy function runs in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


#: Rows of a range of hashes that is put in order at a time, about.
RANGE_ROWS = 100_000


def shuffled(df: DataFrame, epoch: int = 0, index: str = "_index") -> DataFrame:
    """``df`` with each row's place, from 0, in an order that an epoch's hash of the row gives: the same whatever the partitions. Ranges of hashes are ordered by themselves, after one job that counts them."""
    h = F.xxhash64(F.lit(epoch), *df.columns)
    rows = df.withColumn("_h", h)
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    part = F.least(F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("long")  # never falls as the hash rises
    rows = rows.withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # a row a range
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    first = df.sparkSession.createDataFrame(starts, "_part long, _first long")
    order = Window.partitionBy("_part").orderBy("_h", *df.columns)
    return rows.join(F.broadcast(first), "_part").withColumn(index, F.col("_first") + F.row_number().over(order) - 1).select(*df.columns, index)


def row_at(indexed: DataFrame, place: int, index: str = "_index") -> DataFrame:
    """One row of what ``shuffled`` gives."""
    return indexed.where(F.col(index) == place)


def map_batches(df: DataFrame, batch_size: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, epoch: int = 0) -> DataFrame:
    """``fn`` over an epoch's batches of ``batch_size`` rows on the executors; it gets a batch in order, with its number in ``_batch``."""
    numbered = shuffled(df, epoch).withColumn("_batch", F.floor(F.col("_index") / batch_size).cast("long"))
    return numbered.groupBy("_batch").applyInPandas(lambda pdf: fn(pdf.sort_values("_index", ignore_index=True).drop(columns="_index")), schema)


def training_batches(df: DataFrame, batch_size: int, epoch: int = 0, shuffle: bool = True) -> Iterator[pd.DataFrame]:
    """Batches on the driver, one at a time, for trainers outside Spark; ``shuffle`` orders by a hash that depends on the epoch."""
    if shuffle:
        df = df.orderBy(F.xxhash64(F.lit(epoch), *df.columns))
    rows: list[Any] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        if len(rows) == batch_size:
            yield pd.DataFrame(rows, columns=df.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=df.columns)


def save_state(spark: SparkSession, path: str, pre: Preprocessor | None, model: Model) -> None:
    """Preprocessor (None for models that bin for themselves) and model as a table of JSON, in any store that Spark writes."""
    rows = [*([("preprocessor", "Preprocessor", pre.to_json())] if pre else []), ("model", type(model).__name__, model.to_json())]
    spark.createDataFrame(rows, "part string, kind string, state string").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[Preprocessor | None, Model]:
    """What ``save_state`` wrote."""
    rows = {r["part"]: r for r in spark.read.parquet(path).collect()}  # two rows
    pre = Preprocessor.from_json(rows["preprocessor"]["state"]) if "preprocessor" in rows else None
    return pre, _MODELS[rows["model"]["kind"]].from_json(rows["model"]["state"])
