"""Near-duplicate detection by SetSketch: mergeable registers, banding, a likelihood estimate, and exact verification.

A document's set holds the hashes (64 bits) of its distinct word shingles. Register i is ``floor(1 - log_b m_i)``, clipped, of
the minimum m_i over the set of exponentially distributed hashes: exponentially spaced truncated minima, so a union's
register is the larger of two. Documents with equal sets are one class, and only its smallest document goes on.

1. Bands of ``rows`` registers each are hashed to buckets; every member is paired with its bucket's smallest member.
2. Pairs pass if the joint likelihood of their registers and sizes is still rising ``MARGIN`` standard errors below the
   threshold (the log-likelihood is concave, so its maximum lies above), and are verified on the full sets.
3. A member that is not yet in its bucket's component meets the bucket's other members in blocks of ``BLOCK``: the estimate
   picks which documents have a partner in another component, and those are compared exactly, block against block, with a
   spanning forest of the links as output. Buckets of any size are split into blocks, and no list of pairs is formed. A block has ``BLOCK`` documents and
   ``BLOCK_SHINGLES`` shingles on average, so long documents make blocks of fewer (one document is the least), and a task holds two blocks at a time.

A pair of similarity 0.85 shares no band of 7 with probability 1e-6 (0.8 and 6: 3e-6), and fails the estimate with about 4e-6.

Nulls: a null or wordless text has the empty set, which is linked with nothing; so is a null doc_id (component null, kept).
Rows with one doc_id are one document with the links of each row, so repeated rows are linked; ids are integers (others stop the job with a cast error). Documents at exactly the threshold are linked; of equal
sets the smallest doc_id stands for all, and nothing else can tie. Texts of any length are worked on whole. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import words
from terrace.llm.common import chunks, drop, stage
from terrace.llm.components import components

SHINGLE, PERCENT = 3, 85
#: Registers, registers a band (6 for a similarity of 0.8), documents a block, and standard errors below the threshold that the estimate lets pass.
REGISTERS, ROWS, BLOCK, MARGIN = 252, 7, 512, 4.5
#: Shingles a block (16 MB of hashes).
BLOCK_SHINGLES = 1 << 21
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
_M = REGISTERS
_RUN = 1 << 16
_A = words.mix(np.arange(1, _M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; of a document with fewer words, the whole sequence as one."""
    low = words.LOWER[buf]
    starts, ends, first = words.spans(low, off, words.PLAIN)
    h = words.hashes(low, starts, ends)
    all_runs = words.runs(h, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        s = np.sort(all_runs[a : b - shingle + 1] if b - a >= shingle else words.runs(h[a:b], b - a) if b > a else h[:0])
        if len(s) > 1:
            s = s[np.append(True, s[1:] != s[:-1])]
        out.append(s)
    return out


def registers(own: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; none of the sets is empty."""
    out = np.full((len(own), _M), ~np.uint64(0))
    size = np.array([len(s) for s in own], np.int64)
    x, doc = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    for a in range(0, len(x), _RUN):
        part, of = x[a : a + _RUN], doc[a : a + _RUN]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rows, t = of[heads], np.empty_like(part)
        for i in range(_M):
            np.multiply(part, _A[i], out=t)
            out[rows, i] = np.minimum(out[rows, i], np.minimum.reduceat(t, heads))
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def rising(more: np.ndarray, less: np.ndarray, same: np.ndarray, nu: np.ndarray, nv: np.ndarray, j: float) -> np.ndarray:
    """Whether the joint log-likelihood of two sketches rises at similarity ``j``: more, less and same count u's registers against v's."""
    u, v = nu / (nu + nv), nv / (nu + nv)
    fits = np.minimum(u / v, v / u) > j
    c = (BASE - 1) / BASE
    p = lambda x: -np.log1p(-c * x) / np.log(BASE)
    q = lambda x: c / ((1 - c * x) * np.log(BASE))
    a, b = np.where(fits, u - v * j, 0.5), np.where(fits, v - u * j, 0.5)
    slope = -v * more * q(a) / p(a) - u * less * q(b) / p(b) + same * (v * q(a) + u * q(b)) / np.maximum(1 - p(a) - p(b), 1e-9)
    return fits & (slope >= 0)


def _sketch(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column("text")):
                own = sets(buf, off, shingle)
                some = [s for s in own if len(s)]
                regs = iter(registers(some) if some else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(s) for s in own], pa.int64()), pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in own], pa.binary()), pa.array([next(regs).tobytes() if len(s) else None for s in own], pa.binary())],
                    ["doc_id", "n", "digest", "regs"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(lo, hi - lo), pa.array([s.tobytes() for s in sets(buf, off, shingle)], pa.binary())], ["doc", "own"])

    return run


def _likely(j: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, _M) for c in ("regs_a", "regs_b"))
            nx, ny = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            good = rising((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), nx, ny, j)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("own_a").to_pylist(), batch.column("own_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.sort(np.concatenate([x, y]))
                both = int((z[1:] == z[:-1]).sum())
                good.append(100 * both >= percent * (len(z) - both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return run


def _active(j: float, rows: int):
    """Of a block of unplaced members and a block of all: those with a likely partner in another component, where this band is the first they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, docs, roots = [], [], []
            for k in range(batch.num_rows):
                key, band, ly, lx, ys, xs = (batch.column(c)[k].as_py() for c in ("key", "band", "block_y", "block_x", "ys", "xs"))  # one pair of blocks
                rx = np.frombuffer(b"".join(m["regs"] for m in xs), np.uint16).reshape(-1, _M)
                nx, cx = np.array([m["n"] for m in xs]), np.array([m["root"] for m in xs])
                hit_x, hit_y = np.zeros(len(xs), bool), []
                for m in ys:
                    ry = np.frombuffer(m["regs"], np.uint16)
                    same = rx == ry
                    shared = same.reshape(-1, _M // rows, rows).all(2)
                    pos = (rx > ry).sum(1)
                    eq = same.sum(1)
                    good = (cx != m["root"]) & (shared.argmax(1) == band) & shared[:, band] & rising(pos, _M - eq - pos, eq, nx, np.full(len(nx), m["n"]), j)
                    if good.any():
                        hit_x |= good
                        hit_y.append(m)
                own = {m["doc"]: m["root"] for m in (*hit_y, *(xs[i] for i in np.flatnonzero(hit_x)))}
                no += [(key, ly, lx)] * len(own)
                docs += list(own)
                roots += list(own.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in no], pa.int64()), pa.array([k[1] for k in no], pa.int64()), pa.array([k[2] for k in no], pa.int64()), pa.array(docs, pa.int64()), pa.array(roots, pa.int64())], ["key", "block_y", "block_x", "doc", "root"])

    return run


def forest(own: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of the first set of its component, by exact intersections as a blockwise matrix product."""
    size = np.array([len(s) for s in own], np.int64)
    values, which = np.unique(np.concatenate(own), return_inverse=True)
    doc = np.repeat(np.arange(len(own)), size)
    shared = np.bincount(which, minlength=len(values)) > 1
    slot = np.cumsum(shared) - 1
    keep = shared[which]
    col, doc = slot[which[keep]], doc[keep]
    by = np.argsort(col, kind="stable")
    col, doc = col[by], doc[by]
    both, width = np.zeros((len(own), len(own)), np.float32), 4096
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, [a, a + width])
        x = np.zeros((len(own), width), np.float32)
        x[doc[lo:hi], col[lo:hi] - a] = 1
        both += x @ x.T
    inter = both.astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    np.fill_diagonal(linked, True)
    label = np.arange(len(own))
    while True:
        new = np.where(linked, label[None, :], len(own)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blockwise(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                members = batch.column("members")[k].as_py()  # one group of sets
                root = forest([np.frombuffer(m["own"], np.uint64) for m in members], percent)
                a += [m["doc"] for m, r in zip(members, root, strict=True) if members[r]["doc"] != m["doc"]]
                b += [members[r]["doc"] for m, r in zip(members, root, strict=True) if members[r]["doc"] != m["doc"]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; documents with 100 * intersection >= percent * union are linked."""
    at = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / _M) ** 0.5
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stage(src.mapInArrow(_sketch(shingle), "doc_id long, n long, digest binary, regs binary"), "sketch")
    reps = stage(
        sketch.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "regs")).alias("s")).select("digest", F.col("s.doc_id").alias("doc"), "s.n", "s.regs"), "classes", merge=True)
    keys = F.array(*(F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("regs", 2 * rows * i + 1, 2 * rows)).alias("key")) for i in range(_M // rows)))
    member = reps.select("doc", "n", F.explode(keys).alias("k")).select("doc", "n", "k.band", "k.key")
    hub = stage(member.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1"), "hubs", merge=True)
    member = stage(member.drop("n").join(hub, "key"), "buckets", merge=True)
    own = stage(src.withColumnRenamed("doc_id", "doc").join(member.select("doc").distinct().hint("shuffle_hash"), "doc").mapInArrow(_sets(shingle), "doc long, own binary"), "sets", merge=True)

    pairs = member.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    for side in "ba":
        pairs = pairs.join(reps.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}")), side)
    pairs = likely = stage(pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely(at), "a long, b long").distinct(), "pairs", merge=True)
    for side in "ba":
        pairs = pairs.join(own.select(F.col("doc").alias(side), F.col("own").alias(f"own_{side}")), side)
    root = components(pairs.select("a", "b", "own_a", "own_b").mapInArrow(_verify(percent), "a long, b long"))

    placed = member.where("size > 2")
    for c in ("doc", "hub"):
        placed = placed.join(root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    placed = placed_all = stage(placed.withColumn("open", F.col("doc_root") != F.col("hub_root")), "placed", merge=True)
    live = placed.where("open").select("key").distinct()
    placed = placed.join(live, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))))
    block = (
        placed.join(reps.select("doc", "n", "regs"), "doc").groupBy("key", "band", "block")
        .agg(F.collect_list(F.struct("doc", F.col("doc_root").alias("root"), "n", "regs", "open")).alias("members")))
    ys = block.select("key", "band", F.col("block").alias("block_y"), F.filter("members", lambda m: m["open"]).alias("ys")).where("size(ys) > 0")
    both = ys.join(block.select("key", F.col("block").alias("block_x"), F.col("members").alias("xs")), "key")
    active = both.select("key", "band", "block_y", "block_x", "ys", "xs").mapInArrow(_active(at, rows), "key long, block_y long, block_x long, doc long, root long")
    groups = active.join(own, "doc").groupBy("key", "block_y", "block_x").agg(F.collect_list(F.struct("doc", "own")).alias("members"))
    more = groups.select("members").mapInArrow(_blockwise(percent), "a long, b long")
    some = sketch.where("n > 0 and doc_id is not null").select("doc_id", "digest")
    twice = some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")  # ids of several texts
    alike = some.join(twice, "doc_id").join(reps.select("digest", "doc"), "digest").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more).unionByName(alike))

    drop(hub, member, own, likely, placed_all)
    of = reps.select("digest", F.col("doc").alias("node")).join(root, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return (
        sketch.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def representatives(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, all columns kept."""
    gone = stage(near_duplicates(docs, **options).where("not kept").select("doc_id").distinct(), "gone", merge=True)
    return docs.join(gone, "doc_id", "left_anti")
