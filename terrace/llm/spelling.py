"""Spelling variant grouping: a symmetric-delete join of the corpus's words.

Every word emits itself and its single deletions as keys, and words that share a key meet: a longer word meets the shorter one whose own key it emits, two words of one length meet at the key that both leave. A shared key alone says
distance two at most; what proves distance one is the place. A deletion that equals a word is one insertion away from it. Two words that leave the same key by dropping the same place differ at that place and nowhere else, and
every pair that differs at one place leaves one such key; places that a run of equal code points makes interchangeable are emitted one by one, so none is missed. The join is a window over the keys, one exchange of
the emitted rows: each row learns how many words share its key and place and which of them is commonest, and pairs are never written. A key of n code points is shared by its alphabet (90 letters) times n + 1 words at most, a key
and place by the alphabet, whatever the corpus holds.

Words are counted in tasks first (Arrow), and kept as a written table in code-point order, so an id says which of two words comes first. Keys of over ``LONG`` code points are two 64-bit hashes in place of text, made from prefix
sums: a word of a million letters emits a million small rows. Forms are followed to the last by doubling: each round joins pointers with pointers, and a form is at least ten times as common as its word, so a
corpus of 10^12 words needs four rounds.

Nulls: a null text has no words; a null doc_id writes as '' in the digest that decides on deletions. Repeated rows count as often as they are there. An empty table gives an empty result; columns other than doc_id and text are not read.
Words of any length and texts of any length are worked on whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm import words
from terrace.llm.common import CHUNK_BYTES, chunks, drop, stage

LEAST, TIMES, OFTEN, EVERY, LONG = 7, 2, 10, 31, 64
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


def _letters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts and ends of the runs of letters: ASCII ones, and those of two bytes whose first is 0xC3 (U+00C0 to U+00FF)."""
    n = int(off[-1])
    raw = buf[:n]
    two = raw == 0xC3
    kind = _ASCII[raw] | two
    kind[1:] |= two[:-1]
    first, last = kind.copy(), kind.copy()
    if n:
        first[1:] &= ~kind[:-1]
        last[:-1] &= ~kind[1:]
        some = off[:-1] < off[1:]
        first[off[:-1][some]] = kind[off[:-1][some]]
        last[off[1:][some] - 1] = kind[off[1:][some] - 1]
    return words.LOWER[buf], np.flatnonzero(first), np.flatnonzero(last) + 1


def digests(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each word's bytes, each going on from a crc32 of what comes before it."""
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")  # the longest first: those that still have bytes are a prefix
    size = (ends - starts)[order]
    at, crc = starts[order], out[order]
    k = 0
    while (live := int(np.searchsorted(-size, -k, "left"))) > 0:
        crc[:live] = _CRC[(crc[:live] ^ low[at[:live] + k]) & np.uint32(255)] ^ (crc[:live] >> np.uint32(8))
        k += 1
        if live < 64 and size[0] - k > 256:  # few words are left and long: the library's own
            for i in range(live):
                crc[i] = zlib.crc32(low[at[i] + k : at[i] + size[i]].tobytes(), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF if size[i] > k else crc[i]
            break
    out[order] = crc
    return out ^ np.uint32(0xFFFFFFFF)


def _found(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray, every: int, least: int) -> pa.Array:
    """The words as they count: where ``every`` divides the digest one code point goes, and only words of ``least`` code points or more stay."""
    size = ends - starts
    cut = np.append(0, np.cumsum(size))
    at = np.repeat(starts, size) + np.arange(cut[-1]) - np.repeat(cut[:-1], size)
    data = low[at]
    lead = (data & 0xC0) != 0x80
    point = np.append(0, np.cumsum(lead))  # code points before each byte
    length = point[cut[1:]] - point[cut[:-1]]
    hit = crc % np.uint32(every) == 0
    gone = np.zeros(int(point[-1]) + 1, bool)
    gone[(point[cut[:-1]] + crc % np.maximum(length, 1).astype(np.uint32))[hit]] = True
    word = np.repeat(length - hit >= least, size)
    keep = word & ~gone[point[1:] - 1] if len(data) else word
    left = np.append(0, np.cumsum(keep))[cut]
    some = np.flatnonzero(np.diff(left))
    offsets = np.append(left[some], left[-1]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])


def occurrences(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """(word, n) over all texts, words of ``least`` code points or more; where ``every`` divides the crc32 of ``<doc_id>:<word>`` a code point is missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, buf, off in chunks(batch.column("text"), 4 * CHUNK_BYTES):
                low, starts, ends = _letters(buf, off)
                states = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[lo:hi]], np.uint32)
                state = states[np.searchsorted(off, starts, "right") - 1]
                got = pc.value_counts(_found(low, starts, ends, digests(low, starts, ends, state), every, least))
                yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.string()), got.field(1).cast(pa.int64())], ["word", "n"])

    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return got.groupBy("word").agg(F.sum("n").alias("n"))


def _hashes(points: np.ndarray, which: int) -> tuple[np.uint64, np.ndarray]:
    """A polynomial hash of a word, and those of what is left without each of its code points, by prefix sums modulo 2^64."""
    up, down = words._power(words._BASES[which], len(points))
    value = words.mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 * (which + 1) % (1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(value * up))
    back = np.uint64(pow(words._BASES[which], -1, 1 << 64))
    return sums[-1], sums[:-1] + (sums[-1] - sums[1:]) * back


def _long_keys(long: int):
    """Keys of words of over ``long`` code points: its own, and where a deletion leaves over ``long`` those too, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
                points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                (own1, left1), (own2, left2) = (_hashes(points, which) for which in (0, 1))
                some = len(points) if len(points) > long + 1 else 0
                head = np.append(True, points[1:] != points[:-1])
                for a in range(-1, some, 1 << 16):
                    b = min(some, a + (1 << 16))
                    keys = [f"#{len(points) - (k >= 0)}:{left1[k] if k >= 0 else own1:x}:{left2[k] if k >= 0 else own2:x}" for k in range(a, b)]
                    places = np.arange(a, b, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places), pa.array(np.where(places < 0, False, head[places])), pa.array(np.full(b - a, no)), pa.array(np.full(b - a, n))], ["key", "place", "head", "id", "n"])

    return run


def keys(known: DataFrame, long: int = LONG) -> DataFrame:
    """(key, place, head, id, n): every word of ``known`` (id, word, n) itself, with place -1, and without each of its places; ``head``: the place is the first of its run of equal code points."""
    size, place = F.length("word"), F.col("place")
    short = known.where(size <= long + 1).select("*", F.explode(F.sequence(F.when(size > long, 0).otherwise(-1), size - 1)).alias("place"))
    key = F.when(place < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    head = F.when(place < 0, False).otherwise((place == 0) | (F.expr("substring(word, place + 1, 1)") != F.expr("substring(word, place, 1)")))
    short = short.select(key.alias("key"), "place", head.alias("head"), "id", "n")
    return short.unionByName(known.where(size > long).select("id", "word", "n").mapInArrow(_long_keys(long), "key string, place int, head boolean, id long, n long"))


def neighbours(emitted: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word with a word at distance one, how many there are and the commonest as (-n, id)."""
    best = lambda n, i: F.struct((-n).alias("less"), i.alias("id"))
    by_place = Window.partitionBy("key", "place").orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_key = Window.partitionBy("key")
    own = F.col("place") < 0
    met = emitted.repartition("key").select(
        "id", "place", "head", F.count("*").over(by_place).alias("same"), F.first("id").over(by_place).alias("id1"), F.first("n").over(by_place).alias("n1"),
        F.nth_value("id", 2).over(by_place).alias("id2"), F.nth_value("n", 2).over(by_place).alias("n2"),
        F.max(F.when(own, F.col("id"))).over(by_key).alias("whole"), F.max(F.when(own, F.col("n"))).over(by_key).alias("whole_n"),
        F.count(F.when(F.col("head"), 1)).over(by_key).alias("longer"), F.min(F.when(~own, best(F.col("n"), F.col("id")))).over(by_key).alias("longest"),
    )
    mine = F.col("id1") == F.col("id")
    other = F.when(F.col("same") > 1, best(F.when(mine, F.col("n2")).otherwise(F.col("n1")), F.when(mine, F.col("id2")).otherwise(F.col("id1"))))
    shorter = F.when(F.col("head") & F.col("whole").isNotNull(), best(F.col("whole_n"), F.col("whole")))
    found = met.select(
        "id", F.when(own, F.col("longer")).otherwise(F.col("same") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(own, F.col("longest")).otherwise(F.least(other, shorter)).alias("best"),
    ).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): pointers are joined with pointers until none moves."""
    at = stage(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("id").alias("_at"), F.col("root").alias("_next"))
        new = stage(at.join(on, F.col("root") == F.col("_at"), "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        drop(at)
        at, moved = new, new.where("moved").limit(1).count()
        if not moved:
            return at


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, often: int = OFTEN, every: int = EVERY, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``least`` code points or more that occurs ``times`` times or more; a form is ``often`` times as common as its word or more."""
    counts = stage(occurrences(docs, least, every).where(F.col("n") >= times), "counts")
    known = stage(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    drop(counts)
    near = stage(neighbours(keys(known, long)), "near")
    told = known.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= often * F.col("n"), F.col("best.id")).alias("form"), (-F.col("best.less")).alias("form_n"))
    told = stage(told, "told")
    drop(near)
    roots = _roots(told.where("form IS NOT NULL").select("id", "form"))
    name = lambda which: known.select(F.col("id").alias(f"_{which}"), F.col("word").alias(f"_{which}_word"))
    some = told.where("form IS NOT NULL").join(roots.select(F.col("id"), "root"), "id").join(name("form"), F.col("form") == F.col("_form")).join(name("root"), F.col("root") == F.col("_root"))
    kept: Column = F.col("form_n").cast("long")
    with_form = some.select("word", F.col("_form_word").alias("form"), F.col("_root_word").alias("root"), "n", "n_near", kept.alias("form_n"))
    without = told.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return with_form.unionByName(without)
