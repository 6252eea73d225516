"""Fitted transforms and models over streams: they are projections, so a streaming DataFrame goes through them like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.plans.estimator import Estimator


def score_stream(stream: DataFrame, estimator: Estimator, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes predictions of a stream as Parquet; ``once`` takes what is there and stops."""
    out = estimator.predict(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by window and key, with events up to ``late`` behind the newest taken in: the targets of count models from an event stream."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def running_moments(stream: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Sums that a linear fit needs, kept up to date over the stream (complete mode): n, and sum and cross sums of the columns and the target."""
    names = [*columns, target]
    return stream.groupBy().agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in names), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]))
