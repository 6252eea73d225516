"""Substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window (``WINDOW`` // 2 words); any window of a document
holds one of its blocks whole. The blocks are indexed by hash, and every rolling window of the same width of every
document probes the index. A probe that meets a block of a smaller document is an anchor, for the prober and for the block's
owner. Anchors are extended: each window of ``WINDOW`` words around an anchor is compared with all others around anchors, and the
windows that also start in a smaller document, joined where they overlap or touch, are the maximal exact repeats.

Documents are held in groups of ``GROUP`` rows and ``GROUP_BYTES`` of text at most (one longer text is a group), written once. A group sends each hash once, with the least and the greatest document that has it,
and hears back for each hash that repeats which document is the least (and the greatest) of all; positions never travel, as a group finds them again in its texts. So a
passage that all documents share adds one entry a group to its bucket, not one a document. Entries are packed: one row a batch of groups and bucket.

Windows are compared by two 64-bit hashes, whose word hashes and rolling sums share no state: for 10^12 windows the chance of one
false match is about 10^24 / 2^128, or 3 * 10^-15. Anchors need no such care, as a false one only adds comparisons.

Nulls: a null text has no words. A null doc_id counts as larger than any; ids are integers (others stop the job with a cast error). Repeated doc_ids are separate rows; equal ids are never
smaller than each other, so ties remove nothing, and equal rows get equal results. Texts of any length are worked on whole; one of over ``CHUNK_BYTES`` is a chunk of its own. Columns other than doc_id and text are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import words
from terrace.llm.common import binaries, buckets, chunks, gathered, stage

WINDOW = 50
#: Rows and bytes of a group; ranks of documents in it have 16 bits.
GROUP, GROUP_BYTES = 512, 16 << 20
_LAST = (1 << 63) - 1
_NONE = np.uint16(0xFFFF)
_U = np.uint64
#: Entries that are packed together.
_HELD = 1 << 20


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, cut into groups by rows and bytes."""
    group, rows, held = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        out = []
        for size in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
            if rows and (rows == GROUP or held + size > GROUP_BYTES):
                group, rows, held = group + 1, 0, 0
            rows, held = rows + 1, held + size
            out.append(group)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "grp"])


def _bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> _U(32)) % _U(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)


class _Packer:
    """Entries of groups, packed by bucket: keys, ranks (places in the group's documents that the row lists), and runs of entries by group."""

    def __init__(self, kinds: tuple[type, ...], parts: int) -> None:
        self.kinds, self.parts, self.held, self.size = kinds, parts, [], 0

    def add(self, group: int, bucket: np.ndarray, keys: tuple[np.ndarray, ...], docs: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append((np.full(len(bucket), group), bucket, *keys, *(np.where(r == _NONE, _LAST, docs[np.where(r == _NONE, 0, r)]) if len(docs) else r.astype(np.int64) for r in ranks)))
        self.size += len(bucket)
        if self.size >= _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            group, bucket, *rest = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.argsort(bucket, kind="stable")
            group, bucket, rest = group[order], bucket[order], [x[order] for x in rest]
            own, cut = np.unique(bucket, return_index=True)
            cut = np.append(cut, len(bucket))
            head = np.append(True, (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1]))
            heads = np.flatnonzero(head)
            runs = np.searchsorted(heads, cut)
            no = np.cumsum(head) - 1
            # documents of each run, once: an entry names its two by their place among them
            low, high = rest[-2:]
            known = np.unique(rest[-2:])
            codes = [no * len(known) + np.searchsorted(known, d) for d in (low, high)]
            used = np.unique(np.concatenate([codes[0][low != _LAST], codes[1]]))
            first = np.searchsorted(used, np.arange(len(heads) + 1) * len(known))
            low, high = (np.where(none, _NONE, np.searchsorted(used, c) - first[no]).astype(np.uint16) for c, none in zip(codes, (low == _LAST, False), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), *(binaries(k, cut) for k in rest[:-2]), binaries(low, cut), binaries(high, cut),
                 binaries(group[heads], runs), binaries(np.diff(np.append(heads, len(group))).astype(np.int32), runs), binaries(known[used % len(known)], first[runs]), binaries(np.diff(first).astype(np.int32), runs)],
                ["bucket", *(f"k{i}" for i in range(len(self.kinds))), "low", "high", "grp", "n", "docs", "m"],
            )
        self.held, self.size = [], 0


_PACKED = "low binary, high binary, grp binary, n binary, docs binary, m binary"


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: tuple[type, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, least documents (``_LAST``: none), greatest documents and groups of all entries."""
    got = list(batches)
    col = lambda name, kind: gathered([b.column(name) for b in got], kind)
    keys = [col(f"k{i}", k) for i, k in enumerate(kinds)]
    n, docs = col("n", np.int32), np.append(col("docs", np.int64), _LAST)
    run = np.repeat(np.arange(len(n)), n)
    first = np.append(0, np.cumsum(col("m", np.int32)))
    low, high = col("low", np.uint16), col("high", np.uint16)
    return keys, np.where(low == _NONE, _LAST, docs[np.where(low == _NONE, 0, first[run] + low)]), docs[first[run] + high], col("grp", np.int64)[run]


def _answers(bucket: int, hit: np.ndarray, keys: list[np.ndarray], least: np.ndarray, most: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row a group: the keys of its entries that repeat, and their least and greatest documents."""
    hit = hit[np.argsort(group[hit], kind="stable")]
    own, cut = np.unique(group[hit], return_index=True)
    cut = np.append(cut, len(hit))
    for a in range(0, len(own), 10_000):
        part, c = hit[cut[a] : cut[min(a + 10_000, len(own))]], cut[a : a + 10_001] - cut[a]
        yield pa.RecordBatch.from_arrays([pa.array(own[a : a + 10_000]), pa.array(np.full(len(c) - 1, bucket, np.int32)), *(binaries(k[part], c) for k in keys), binaries(least[part], c), binaries(most[part], c)], ["grp", "bucket", *(f"k{i}" for i in range(len(keys))), "least", "most"])


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one group."""
    group = batch.column("grp").to_numpy()
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    for a, b in zip(cut, np.append(cut[1:], len(group)), strict=True):
        yield int(group[a]), batch.slice(a, b - a)


def _distinct(keys: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each key once, with the smallest of ``low`` and the largest of ``high``."""
    order = np.lexsort(keys[::-1])
    head = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0))
    heads = np.flatnonzero(head)
    return [k[order[heads]] for k in keys], np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads)


def _probes(block: int, parts: int):
    """The rolling windows of each group: their hashes, the least document that has one as a reference block, and the greatest that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packer((np.uint32,), parts)
        for batch in batches:
            for group, rows in _grouped(batch):
                docs, rank = np.unique(rows.column("doc").to_numpy(), return_inverse=True)
                for lo, hi, buf, off in chunks(rows.column("text")):
                    starts, ends, first = words.spans(buf, off, words.PLAIN)
                    at = words.inside(first, block)
                    if len(at):
                        row = np.repeat(np.arange(hi - lo), np.diff(first))[at]
                        own = rank[lo:hi][row].astype(np.uint16)
                        (key,), low, high = _distinct((words.runs(words.hashes(buf, starts, ends), block)[at],), np.where((at - first[row]) % block == 0, own, _NONE), own)
                        yield from out.add(group, _bucket(key, parts), (key.astype(np.uint32),), docs, (low, high))
        yield from out.flush()

    return run


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, the hashes of reference blocks that another document has."""
    batches = list(batches)
    for bucket in sorted({b for x in batches for b in x.column("bucket").unique().to_pylist()}):
        (key,), low, high, group = _unpacked((x.filter(pc.equal(x.column("bucket"), bucket)) for x in batches), (np.uint32,))
        own = np.unique(key[low != _LAST])  # reference blocks
        if not len(own):
            continue
        slot = np.minimum(np.searchsorted(own, key), len(own) - 1)
        at = np.flatnonzero(own[slot] == key)
        slot = slot[at]
        least, most = np.full(len(own), _LAST), np.full(len(own), -_LAST - 1)
        np.minimum.at(least, slot, low[at])
        np.maximum.at(most, slot, high[at])
        hit = (high[at] > least[slot]) | (low[at] < most[slot])
        at, slot = at[hit], slot[hit]
        yield from _answers(bucket, np.arange(len(at)), [key[at]], least[slot], most[slot], group[at])


def _heard(table: pa.Table, kinds: tuple[type, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys, least and greatest documents, and buckets of a group's answers."""
    col = lambda name, kind: gathered(table.column(name).chunks, kind)
    least = col("least", np.int64)
    n = np.array([len(x) // 8 for x in table.column("least").to_pylist()], np.int64)
    return [col(f"k{i}", k) for i, k in enumerate(kinds)], least, col("most", np.int64), np.repeat(table.column("bucket").to_numpy(), n) if len(n) else np.zeros(0, np.int64)


def _near(width: int, block: int, parts: int):
    """The windows around the anchors of a group: their hashes, and the least and the greatest document that has one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, made = _Packer((np.uint64, np.uint64), parts), []
        (key,), least, most, bucket = _heard(right, (np.uint32,))
        known = bucket.astype(np.uint64) << _U(32) | key
        order = np.argsort(known, kind="stable")
        known, least, most = known[order], least[order], most[order]
        rows = left.combine_chunks()
        ids = rows.column("doc").to_numpy()
        docs, rank = np.unique(ids, return_inverse=True)
        for lo, hi, buf, off in chunks(rows.column("text")) if len(known) and len(ids) else ():
            starts, ends, first = words.spans(buf, off, words.PLAIN)
            h = words.hashes(buf, starts, ends)
            at = words.inside(first, block)
            if not len(at):
                continue
            key = words.runs(h, block)[at]
            key = _bucket(key, parts).astype(np.uint64) << _U(32) | key & _U(0xFFFFFFFF)
            slot = np.minimum(np.searchsorted(known, key), len(known) - 1)
            same = known[slot] == key
            at, slot = at[same], slot[same]
            row = np.searchsorted(first, at, "right") - 1
            doc = ids[lo:hi][row]
            hit = (doc > least[slot]) | ((at - first[row]) % block == 0) & (doc < most[slot])
            anchor, row = at[hit], row[hit]
            # windows of which an anchor is part: all that start up to width - block words before it
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(anchor - (width - block), first[row]), 1)
            np.add.at(edge, anchor + 1, -1)
            p = words.inside(first, width)
            p = p[np.cumsum(edge)[p] > 0]
            if len(p):
                own = rank[lo:hi][np.searchsorted(first, p, "right") - 1].astype(np.uint16)
                keys, low, high = _distinct((words.runs(h, width)[p], words.runs(words.hashes(buf, starts, ends, 1), width, 1)[p]), own, own)
                made += out.add(int(left.column("grp")[0].as_py()), _bucket(keys[0], parts), tuple(keys), docs, (low, high))
        made += out.flush()
        return pa.Table.from_batches(made) if made else pa.table({c: pa.array([], k) for c, k in zip(["bucket", "k0", "k1", "low", "high", "grp", "n", "docs", "m"], [pa.int32()] + [pa.binary()] * 8, strict=True)})

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, the windows of a group that also start in a smaller document, with the least one."""
    (k1, k2), low, high, group = _unpacked(batches, (np.uint64, np.uint64))
    if not len(k1):
        return
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = np.empty(len(a), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], heads), np.diff(np.append(heads, len(a))))
    yield from _answers(0, np.flatnonzero(high > least), [k1, k2], least, least, group)


def _cut(width: int):
    """Every row of a group: its words, the spans of those in a repeat, and the other words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (k1, k2), least, _, _ = _heard(right, (np.uint64, np.uint64))
        order = np.lexsort((k2, k1))
        k1, k2, least = k1[order], k2[order], least[order]
        rows = left.combine_chunks()
        ids = rows.column("doc").to_numpy()
        n, spans, kept = [], [], []
        for lo, hi, buf, off in chunks(rows.column("text")):
            starts, ends, first = words.spans(buf, off, words.PLAIN)
            n += np.diff(first).tolist()
            p = words.inside(first, width) if len(k1) else np.zeros(0, np.int64)
            if len(p):
                key = words.runs(words.hashes(buf, starts, ends), width)[p]
                slot = np.searchsorted(k1, key)
                some = np.flatnonzero((slot < len(k1)) & (k1[np.minimum(slot, len(k1) - 1)] == key))
                p, slot, key = p[some], slot[some], key[some]
                if len(p):
                    other = words.runs(words.hashes(buf, starts, ends, 1), width, 1)[p]
                    while len(move := np.flatnonzero((slot < len(k1)) & (k1[np.minimum(slot, len(k1) - 1)] == key) & (k2[np.minimum(slot, len(k1) - 1)] < other))):
                        slot[move] += 1
                    at = np.minimum(slot, len(k1) - 1)
                    row = np.searchsorted(first, p, "right") - 1
                    p = p[(slot < len(k1)) & (k1[at] == key) & (k2[at] == other) & (ids[lo:hi][row] > least[at])]
            cut = np.searchsorted(p, first)
            raw = buf.tobytes()
            for i in range(hi - lo):
                own, merged = raw[off[i] : off[i + 1]].split(), []
                for q in (p[cut[i] : cut[i + 1]] - first[i]).tolist():
                    if merged and q <= merged[-1][1]:
                        merged[-1][1] = q + width
                    else:
                        merged.append([q, q + width])
                left_over, last = [], 0
                for a, b in merged:
                    left_over += own[last:a]
                    last = b
                kept.append(b" ".join(left_over + own[last:] if merged else own))
                spans.append([{"start": a, "end": b} for a, b in merged])
        return pa.table({"doc_id": rows.column("i"), "n_words": pa.array(n, pa.int64()), "repeat_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, repeat_spans, kept_text) of every row: words in a repeat, starts from 0 and ends exclusive, and the other words joined by spaces."""
    parts, block = buckets(docs), width // 2
    src = docs.select(F.col("doc_id").cast("long").alias("i"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    held = stage(src.mapInArrow(_dealt, "i long, doc long, text string, grp long"), "groups")
    packed = held.mapInArrow(_probes(block, parts), f"bucket int, k0 binary, {_PACKED}")
    anchors = stage(packed.repartitionById(parts, "bucket").mapInArrow(_anchors, "grp long, bucket int, k0 binary, least binary, most binary"), "anchors")
    group = held.groupBy("grp")
    near = group.cogroup(anchors.groupBy("grp")).applyInArrow(_near(width, block, parts), f"bucket int, k0 binary, k1 binary, {_PACKED}")
    found = near.repartitionById(parts, "bucket").mapInArrow(_repeated, "grp long, bucket int, k0 binary, k1 binary, least binary, most binary")
    return group.cogroup(found.groupBy("grp")).applyInArrow(_cut(width), "doc_id long, n_words long, repeat_spans array<struct<start:int,end:int>>, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the digest of the kept words."""
    removed = F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
