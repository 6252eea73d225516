"""Connected components by alternating stars: edges are rewired towards the smallest neighbour until every node hangs on its root.

Nodes are only ever reduced (a minimum a node) and joined on; no node's neighbours are gathered. Each round is written to the
shared folder, so lineage stays short and nothing reaches the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import drop, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame, written: list[DataFrame]) -> DataFrame:
    """Every edge with the smallest b of its a. The minima are written first: a join of two exchanges of its own can be split where one a has many edges."""
    written.append(stage(edges.groupBy("a").agg(F.min("b").alias("m")), "least", merge=True))
    return edges.join(written[-1], "a")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not its component's smallest node, and so its root."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", merge=True)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        written = [edges]
        large = _least(both, written).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        small = _least(large, written).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = stage(small, "edges", merge=True)
        was, mark = mark, _mark(new)
        drop(*written)
        edges = new
        if mark == was:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
