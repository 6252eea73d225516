"""What the operators share: tables in the cluster's shared folder, and Arrow batches as byte chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bytes of input files to a bucket: a task holds about ten times as much.
BUCKET_BYTES = 32 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"
_own: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a master in one process (tests) gets a folder made here; on a cluster that would be lost."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = _own[0] if _own else tempfile.mkdtemp(prefix="terrace-")
        _own[:] = [there]
    return there.rstrip("/")


def stage(df: DataFrame, name: str, merge: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing of it.

    The shuffle files of the write are deleted when it has ended, not when the driver next collects its garbage. With ``merge``, joins whose sides are exchanged already stay as they are, however small a
    side turns out: Spark would else gather it in the driver, build a table there and broadcast it, for many joins of a plan at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrace-{name}-{uuid.uuid4().hex}"
    put = {_CLEANUP: "true"} | ({_BROADCAST: "-1"} if merge else {})
    was = {k: spark.conf.get(k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _tables.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def staged() -> list[str]:
    """Paths of all tables that ``stage`` wrote and that were not deleted, oldest first."""
    return list(_tables)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables: an operator's own may go once its result is written, as nothing else reads them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _tables:
            _tables.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables as ``stage`` returned them, once no result that is still to be computed reads them."""
    for table in tables:
        delete(table.sparkSession, [table._staged])


def buckets(df: DataFrame) -> int:
    """Number of hash buckets for packed exchanges of ``df``: as many as the session shuffles into, more if they would hold over ``BUCKET_BYTES`` of files each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, most, -(-size // BUCKET_BYTES) if size < 1 << 50 else 0)  # rows that no file holds have no size


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes padded by 8 zeros, offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        a, b = int(off[lo]), int(off[hi])
        buf = np.zeros(b - a + 8, np.uint8)
        buf[: b - a] = raw[a:b]
        yield lo, hi, buf, off[lo : hi + 1] - a
        lo = hi


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list array of ``values`` cut into runs of ``counts``."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), values if isinstance(values, pa.Array) else pa.array(values))


def binaries(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """A binary array of the items of ``data`` between successive entries of ``cut``."""
    data = np.ascontiguousarray(data)
    off = (np.asarray(cut, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def gathered(column: list[pa.Array], kind: type) -> np.ndarray:
    """All bytes of binary arrays, one after the other, as numbers."""
    parts = [np.frombuffer(x, kind) for a in column for x in a.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def flat(column: list[pa.Array]) -> np.ndarray:
    """All values of list arrays, one after the other."""
    parts = [a.flatten().to_numpy(zero_copy_only=False) for a in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
