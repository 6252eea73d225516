"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor loses nothing of them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tasks that add up what the others send; as many arrays come to the driver.
FAN_IN = 8
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a master in one process gets a folder made here, and a cluster an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[:] = _own or [tempfile.mkdtemp(prefix="terrace-")]
        there = _own[0]
    return there.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again."""
    path = f"{folder(df.sparkSession)}/terrace-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables as ``written`` returned them, once nothing that is still to be computed reads them."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._written)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def added(df: DataFrame, of: Callable[[dict], np.ndarray], size: int) -> np.ndarray:
    """The sum of a vector of ``size`` numbers over all rows (given as dicts): added up in tasks, and by ``FAN_IN`` more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                total += of({c: batch.column(c)[i].as_py() for c in batch.schema.names})
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("total").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    rows = df.mapInArrow(partial, "total binary").repartition(FAN_IN).mapInArrow(merge, "total binary").collect()
    return np.sum([np.frombuffer(r["total"]) for r in rows], axis=0)
