"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole item if it has fewer. As a set of shingles it is
contained in a document only if its rarest shingle is, so with shingles ordered by rarity (their count over the whole
corpus) the prefix that has to be indexed is that one shingle. A document position with such a shingle is a candidate; the
shingle's place in the window fixes where the window would start, windows that would leave the document are dropped (length
and positional bounds), and what is left is compared word by word.

The benchmark is cut into pieces of ``PIECE`` words that overlap by a window, so an item of any length is split, and the pieces are sent to the executors in blocks of
``BLOCK_BYTES`` of text: two passes of the corpus a block (counts, hits), each a job of its own whose hits are written, so what is held is one block's whatever the benchmark's size. A block is one byte buffer and arrays of numbers: about 6 bytes
go to the executors for each byte of benchmark text, and at its peak the driver holds about 30. Windows that items share are stored once, by a 128-bit hash.

Nulls: a null text has no words, a null doc_id stays as it is; a null item_id reads as ''. Rows are kept one for one: repeated
doc_ids stay separate rows, and equal rows get equal results; shingles that tie in rarity are interchangeable, as any of them finds the window. Texts of any length are worked on whole. Extra columns
are dropped by ``contamination``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm import words
from terrace.llm.common import chunks, drop, stage

WINDOW, SHINGLE, PIECE, BLOCK_BYTES = 10, 3, 1 << 14, 8 << 20
_BITS = 20


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and of their words starts, ends, the documents' first words and hashes."""
    low = words.LOWER[buf]
    starts, ends, first = words.spans(low, off, words.ALNUM)
    return low, starts, ends, first, words.hashes(low, starts, ends)


def _pieces(window: int):
    """Items as runs of at most ``PIECE`` lower-cased words joined by spaces; neighbours share what a window needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in chunks(batch.column("text")):
                low, starts, ends, first, _ = _tokens(buf, off)
                item, piece = [], []
                for i in range(hi - lo):
                    for a in range(first[i], max(first[i + 1] - window + 1, first[i] + (first[i] < first[i + 1])), PIECE - window + 1):
                        b = min(a + PIECE, first[i + 1])
                        item.append(lo + i)
                        piece.append(b" ".join([low[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(item, pa.int64())), pa.array(piece, pa.binary()).cast(pa.string())], ["item_id", "text"])

    return run


def _windows(pieces: pa.Table, window: int, shingle: int) -> dict:
    """The distinct windows of a block of pieces: first word, length and hash of each, its items, and the block's words and shingles."""
    texts, ids = pieces.column("text").combine_chunks(), pieces.column("item_id").to_pylist()
    got = list(chunks(texts, 1 << 62))
    low, starts, ends, first, h = _tokens(*got[0][2:]) if got else (np.zeros(8, np.uint8), *(np.zeros(0, np.int64),) * 2, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    names = sorted(set(ids))
    number = {x: i for i, x in enumerate(names)}
    item = np.array([number[x] for x in ids], np.int32)
    n = np.diff(first)
    out = {"bytes": low.tobytes(), "starts": starts.astype(np.int32), "ends": ends.astype(np.int32), "names": names, "keys": {}, "by": {}}
    other = words.hashes(low, starts, ends, 1) if len(h) else h
    for length in sorted({int(min(k, window)) for k in np.unique(n) if k}):
        at = words.inside(first, window) if length == window else first[:-1][n == length]
        k1, k2 = (words.runs(x, length, which)[at] for which, x in enumerate((h, other)))
        order = np.lexsort((k2, k1))
        head = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
        heads = order[np.flatnonzero(head)]
        owner = (np.cumsum(head) - 1) * len(names) + item[np.searchsorted(first, at[order], "right") - 1]
        owner = np.unique(owner)
        width = min(shingle, length)
        out["by"][length] = {"at": at[heads].astype(np.int32), "hash": k1[heads], "cut": np.searchsorted(owner, np.arange(len(heads) + 1) * len(names)).astype(np.int32), "items": (owner % max(len(names), 1)).astype(np.int32)}
        out["keys"].setdefault(width, words.runs(h, width))
    return out


class _Index:
    """Sorted keys behind a bitmap: most words of a corpus fall out at the bitmap."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.keys & np.uint64((1 << _BITS) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of known keys, and the keys' numbers."""
        at = np.flatnonzero(self.bitmap[h & np.uint64((1 << _BITS) - 1)])
        if not len(self.keys):
            return at[:0], at[:0]
        no = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[no] == h[at]
        return at[same], no[same]


def _counts(docs: DataFrame, win: dict, shingle: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size of shingle, those of the windows and how often they occur over all documents."""
    index = {}
    for w in win["keys"]:
        used = [win["keys"][w][b["at"] + k] for length, b in win["by"].items() if min(shingle, length) == w for k in range(length - w + 1)]
        index[w] = _Index(np.unique(np.concatenate([np.unique(x) for x in used])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {w: np.zeros(len(x.keys), np.int64) for w, x in index.items()}
        for batch in batches:
            for _, _, buf, off in chunks(batch.column("text")):
                *_, first, h = _tokens(buf, off)
                for w, x in index.items():
                    at, no = x.find(words.runs(h, w))
                    inside = at + w <= np.repeat(first[1:], np.diff(first))[at]
                    total[w] += np.bincount(no[inside], minlength=len(x.keys))
        for w, x in index.items():
            some = np.flatnonzero(total[w])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), w, np.int32)), pa.array(x.keys[some].view(np.int64)), pa.array(total[w][some])], ["w", "key", "n"])

    got = docs.select("text").mapInArrow(count, "w int, key long, n long").groupBy("w", "key").agg(F.sum("n").alias("n")).toArrow()  # at most the block's shingles, as Arrow
    size, key, n = (got.column(c).to_numpy() for c in ("w", "key", "n"))
    out = {}
    for w, x in index.items():
        own = np.zeros(len(x.keys), np.int64)
        own[np.searchsorted(x.keys, key[size == w].view(np.uint64))] = n[size == w]
        out[w] = (x.keys, own)
    return out


def _rarest(win: dict, counts: dict[int, tuple[np.ndarray, np.ndarray]], shingle: int) -> dict:
    """For each length of window its size of shingle, and of each window the rarest shingle: its place, and windows by shingle."""
    probe = {}
    for length, b in win["by"].items():
        w = min(shingle, length)
        keys, n = counts[w]
        place = np.zeros(len(b["at"]), np.uint8)
        least = np.full(len(b["at"]), np.iinfo(np.int64).max)
        for k in range(length - w + 1):
            own = n[np.searchsorted(keys, win["keys"][w][b["at"] + k])]
            rarer = own < least
            place[rarer], least = k, np.minimum(least, own)
        live = np.flatnonzero(least > 0)  # a shingle that no document has
        key = win["keys"][w][b["at"][live] + place[live]]
        x = _Index(key)
        no = np.searchsorted(x.keys, key)
        by = np.argsort(no, kind="stable")
        probe[length] = (w, x, live[by].astype(np.int32), np.searchsorted(no[by], np.arange(len(x.keys) + 1)).astype(np.int32), place)
    return probe


def _probe(docs: DataFrame, win: dict, counts: dict[int, tuple[np.ndarray, np.ndarray]], shingle: int) -> DataFrame:
    """A block's hits in every row: its other columns than text, n_words, hit spans as (start, end) words one after the other, items."""
    keys = [c for c in docs.columns if c != "text"]
    probe = _rarest(win, counts, shingle)
    by_length, raw, start, end, names = win["by"], win["bytes"], win["starts"], win["ends"], win["names"]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found, sizes = [], [], []
            for _, _, buf, off in chunks(batch.column("text")):
                low, starts, ends, first, h = _tokens(buf, off)
                sizes.append(np.diff(first))
                hit_at, hit_size, hit_item = [], [], []
                shingles: dict[int, np.ndarray] = {}
                for length, (w, x, own, cut, place) in probe.items():
                    at, no = x.find(shingles.setdefault(w, words.runs(h, w)))
                    n = cut[no + 1] - cut[no]
                    row = own[np.repeat(cut[no], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    at = np.repeat(at, n)
                    doc = np.searchsorted(first, at, "right") - 1
                    at = at - place[row]
                    good = (at >= first[doc]) & (at + length <= first[doc + 1])  # positional and length bounds
                    at, row = at[good], row[good]
                    good = words.runs(h, length)[at] == by_length[length]["hash"][row] if len(at) else good[:0]
                    for p, r in zip(at[good].tolist(), row[good].tolist(), strict=True):
                        q = by_length[length]["at"][r]
                        if b" ".join([low[a:b].tobytes() for a, b in zip(starts[p : p + length], ends[p : p + length], strict=True)]) == raw[start[q] : end[q + length - 1]]:
                            hit_at.append(p)
                            hit_size.append(length)
                            hit_item.append((length, r))
                by = np.argsort(hit_at, kind="stable") if hit_at else []
                at, size, items = np.array([hit_at[i] for i in by], np.int64), [hit_size[i] for i in by], [hit_item[i] for i in by]
                cut = np.searchsorted(at, first)
                for d in range(len(first) - 1):
                    a, b = cut[d], cut[d + 1]
                    spans.append([v for p, k in zip(at[a:b].tolist(), size[a:b], strict=True) for v in (p - int(first[d]), p - int(first[d]) + k)])
                    found.append(sorted({names[i] for k, r in set(items[a:b]) for i in by_length[k]["items"][by_length[k]["cut"][r] : by_length[k]["cut"][r + 1]]}))
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(n), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))], [*keys, "n_words", "flat", "item_ids"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.mapInArrow(hits, f"{kinds}, n_words long, flat array<int>, item_ids array<string>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit spans as (start, end) pairs that neither overlap nor touch, and the words they cover."""
    for batch in batches:
        out, n = [], []
        for flat in batch.column("flat").to_pylist():
            merged: list[list[int]] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append([{"start": a, "end": b} for a, b in merged])
            n.append(sum(b - a for a, b in merged))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(out, kind), batch.column("item_ids")], ["doc_id", "n_words", "n_hit", "hit_spans", "item_ids"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, hit_spans, item_ids) for every row of ``docs``; spans count words from 0, ends exclusive."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    items = stage(items.mapInArrow(_pieces(window), "item_id string, text string"), "items")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + size // block_bytes
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if blocks > 1:  # rows get a number that the blocks' hits meet by
        rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    first, hits = None, []
    for k in range(blocks):
        win = _windows(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow(), window, shingle)  # about block_bytes
        if first is not None and not win["by"]:
            continue
        found = _probe(rows, win, _counts(rows, win, shingle) if win["by"] else {}, shingle)
        if blocks == 1:
            first = found
            break
        found = stage(found if first is None else found.where(F.size("flat") > 0), "hits")
        first = found.select("_row", "doc_id", "n_words") if first is None else first
        hits.append(found.where(F.size("flat") > 0).select("_row", "flat", "item_ids"))
    drop(items)
    if blocks > 1:
        all_hits = hits[0]
        for h in hits[1:]:
            all_hits = all_hits.unionByName(h)
        joined = all_hits.groupBy("_row").agg(F.flatten(F.collect_list("flat")).alias("flat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
        first = first.join(joined, "_row", "left").select("doc_id", "n_words", none("flat", "array<int>"), none("item_ids", "array<string>"))
        drop(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return first.select("doc_id", "n_words", "flat", "item_ids").mapInArrow(_merge, f"doc_id {kind}, n_words long, n_hit long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of its items and whether it is contaminated."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns kept; rows of one doc_id (or without any) go together."""
    bad = contamination(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
