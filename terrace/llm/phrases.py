"""Phrase collocation mining with compressed position bitmaps.

Words are cut into shards of one language and about ``SHARD`` positions; between two pieces one position stays empty, so nothing that is shifted by a position crosses from one piece to the next. A shard holds, of each word, its
positions as a bitmap of which only the bytes with a bit are kept (block, bits). A phrase's bitmap marks where it ends: shifted by one and ANDed with a word's bitmap it marks where the longer phrase ends, and the bits that are set
are its occurrences. Shards extend phrases depth first, a slice of first words at a time, so what a task holds is bounded by a slice and five levels. All words of a block are ANDed at once through an index by block.

Only sums over all shards say what is frequent. Shards send their counts by the phrases' text, so sums are exact, first of words, then of pairs, of runs of three, and of longer phrases; what is frequent comes back as a filter of
fixed size (``FILTER`` bits a level, ORed together in tasks), and a phrase is extended only where it, and every run of up to three words in it, passes. A filter may let more pass, never less: what is not
frequent falls out at the sums, and where there are more frequent phrases than the filter tells apart, more is counted and nothing is lost. Shards stay where they are written.
A phrase that a shard counts extends an occurrence of a frequent one, so occurrences bound what a level sends. Levels go in turns by the hash of the first word, as many as keep a turn's bound at ``TURN`` rows a word of the corpus:
each turn is summed and its shuffle deleted before the next, so the disk that sums take grows with the words and not with the pairs that become worth counting as the text grows.

Nulls: a null text has no words, a null language is ``und``, together with rows that say so. Repeated rows count as often as they are there. An empty table gives an empty result; columns other than text and lang are not read. A text
of any length is worked on whole: one that is larger than a shard is cut between pieces, and a piece is never cut.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm import words
from terrace.llm.common import chunks, drop, lists, stage

SHARD, LEAST, LONGEST, TOP = 1 << 20, 100, 5, 2000
#: Entries of bitmaps that are extended at a time; bits of a filter, as a power of two, and how many a phrase sets.
SLICE, FILTER, MARKS = 1 << 15, 26, 3
#: Rows that shards send in a turn, a word of the corpus.
TURN = 0.25
#: Bytes that end a piece: ``[.,;:!?\x0A-\x0D]``; bytes that end a word without ending a piece: blank and tab.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[0x20] = False
_SHARD = "lang string, shard long, total long, words array<string>, counts array<long>, entries binary, block binary, bits binary"


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words, the document of each, and whether it starts a piece."""
    low = words.LOWER[buf]
    starts, ends, first = words.spans(low, off, WORD)
    before = np.append(0, np.cumsum(ENDS[low[: int(off[-1])]], dtype=np.int32))
    new = np.ones(len(starts), bool)
    new[1:] = before[starts[1:]] > before[ends[:-1]]
    new[first[:-1][first[:-1] < len(starts)]] = True
    size = ends - starts
    cut = np.append(0, np.cumsum(size)).astype(np.int64)
    inside = WORD[low[: int(off[-1])]]
    data = np.ascontiguousarray(low[: int(off[-1])][inside])
    text = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(data)])
    return text, np.repeat(np.arange(len(off) - 1), np.diff(first)), new


def _shard(lang: str, no: int, text: pa.Array, new: np.ndarray) -> pa.RecordBatch:
    """The bitmaps of a run of words."""
    known = text.dictionary_encode()
    word = known.indices.to_numpy().astype(np.int64)
    at = np.arange(len(word)) + np.cumsum(new)
    by = np.argsort(word, kind="stable")
    key = word[by] << 40 | at[by] >> 3
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bits = np.bitwise_or.reduceat((1 << (at[by] & 7)).astype(np.uint8), head)
    entries = np.bincount(key[head] >> 40, minlength=len(known.dictionary)).astype(np.int32)
    columns = [pa.array([lang]), pa.array([no]), pa.array([len(word)]), lists(known.dictionary.cast(pa.string()), np.array([len(known.dictionary)])), lists(np.bincount(word).astype(np.int64), np.array([len(known.dictionary)]))]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in (entries, (key[head] & (1 << 40) - 1).astype(np.int32), bits)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "shard", "total", "words", "counts", "entries", "block", "bits"])


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """(lang, shard, total, words, counts, entries, block, bits): the words of one language in a task, about ``size`` of them a row, as bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        many: dict[str, int] = {}
        no = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal no
            text, new = pa.concat_arrays([x for x, _ in held[lang]]), np.concatenate([x for _, x in held[lang]])
            heads, a = np.append(np.flatnonzero(new), len(new)), 0
            while a < len(new):  # between pieces; a piece of more than ``size`` words is a shard of its own
                k = int(np.searchsorted(heads, a + size, "right")) - 1
                b = int(heads[k] if heads[k] > a else heads[k + 1])
                yield _shard(lang, no, text[a:b], new[a:b])
                a, no = b, no + 1
            del held[lang], many[lang]

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, buf, off in chunks(batch.column("text")):
                text, doc, new = _words(buf, off)
                names = sorted(set(langs[lo:hi]))
                own = np.array([names.index(x) for x in langs[lo:hi]], np.int32)[doc]
                by = np.argsort(own, kind="stable")
                text, new, cut = text.take(pa.array(by)), new[by], np.searchsorted(own[by], np.arange(len(names) + 1))
                for k, lang in enumerate(names):
                    if cut[k] < cut[k + 1]:
                        held.setdefault(lang, []).append((text[cut[k] : cut[k + 1]], new[cut[k] : cut[k + 1]]))
                        many[lang] = many.get(lang, 0) + int(cut[k + 1] - cut[k])
                full = [x for x, n in many.items() if n >= size] if sum(many.values()) < 4 * size else list(many)
                for lang in full:
                    yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SHARD)


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _hashes(text: pa.Array) -> np.ndarray:
    """A hash of each word."""
    got = [words.hashes(buf, off[:-1], off[1:]) for _, _, buf, off in chunks(text, 1 << 62)]
    return got[0] if got else np.zeros(0, np.uint64)


def _chained(hashes: list[np.ndarray], seed: np.uint64 | np.ndarray) -> np.ndarray:
    """A hash of phrases from those of their words, a column a word."""
    out = words.mix(np.zeros(len(hashes[0]), np.uint64) + seed + np.uint64(len(hashes)))
    for h in hashes:
        out = words.mix(out * np.uint64(words._BASES[0]) + h)
    return out


class Filter:
    """A set of hashes of fixed size that may hold more than was put in."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, len(bits).bit_length() + 5

    @staticmethod
    def places(h: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([words.mix(h + np.uint64(k)) >> np.uint64(64 - size) for k in range(MARKS)])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.places(h, self.size)
        return ((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).reshape(MARKS, -1).all(0)

    @classmethod
    def of(cls, frequent: DataFrame, length: int, size: int) -> Filter:
        """Of (lang, phrase), phrases of ``length`` words, with 2^``size`` bits."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column("lang").to_pylist()
                seeds = {x: _seed(x) for x in set(langs)}
                for lo, hi, buf, off in chunks(batch.column("phrase")):
                    starts, ends, _ = words.spans(buf, off, _NOT_BLANK)
                    h = words.hashes(buf, starts, ends).reshape(-1, length)
                    at = Filter.places(_chained(list(h.T), np.array([seeds[x] for x in langs[lo:hi]], np.uint64)), size)
                    yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bit"])

        got = frequent.select("lang", "phrase").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^size bits at most
        bits = np.zeros(1 << size - 6, np.uint64)
        bits[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        return cls(bits)


class _Vertical:
    """A shard's bitmaps of the words that may be frequent, and an index of them by block. ``filters`` holds what is known of phrases of 1, 2, .. words; those of up to ``known`` words are counted already."""

    def __init__(self, row: dict[str, np.ndarray], hashes: np.ndarray, seed: np.uint64, filters: list[Filter], known: int) -> None:
        self.filters, self.known, self.seed = filters, known, seed
        use = filters[0].has(_chained([hashes], seed))
        self.ids = np.flatnonzero(use)
        self.hashes = hashes[self.ids]
        keep = np.repeat(use, row["entries"])
        self.cut = np.append(0, np.cumsum(row["entries"][self.ids]))
        self.block, self.bits = row["block"][keep], row["bits"][keep]
        self.word = np.repeat(np.arange(len(self.ids)), row["entries"][self.ids]).astype(np.int32)
        by = np.argsort(self.block, kind="stable")
        self.by = by.astype(np.int32)
        self.blocks = int(self.block.max()) + 1 if len(self.block) else 0
        self.first = np.searchsorted(self.block[by], np.arange(self.blocks + 1)).astype(np.int64)

    def wanted(self, path: np.ndarray) -> np.ndarray:
        """Which phrases may be frequent, by their last words."""
        j = min(path.shape[1], len(self.filters))
        return self.filters[j - 1].has(self.key(path[:, path.shape[1] - j :]))

    def key(self, path: np.ndarray) -> np.ndarray:
        return _chained([self.hashes[c] for c in path.T], self.seed)

    def extended(self, cut: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps shifted by one position and ANDed with those of all words: phrase, word, and the bitmaps' bounds, blocks, bits and popcounts."""
        owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        owner, block, bits = np.concatenate([owner, owner]), np.concatenate([block, block + 1]), np.concatenate([bits << 1, bits >> 7])  # the last bit goes on to the next block
        some = (bits != 0) & (block < self.blocks)
        owner, block, bits = owner[some], block[some], bits[some]
        n = self.first[block + 1] - self.first[block]
        at = self.by[np.repeat(self.first[block] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.repeat(bits, n) & self.bits[at]
        hit = np.flatnonzero(both)
        at, both = at[hit], both[hit]
        key = np.repeat(owner, n)[hit] << 32 | self.word[at]
        by = np.argsort(key, kind="stable")
        key, both = key[by], both[by]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat(np.bitwise_count(both), head, dtype=np.int64) if len(key) else head
        return key[head] >> 32, key[head] & 0xFFFFFFFF, np.append(head, len(key)), self.block[at[by]], both, count

    def grow(self, path: np.ndarray, cut: np.ndarray, block: np.ndarray, bits: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, popcounts) of all extensions up to ``upto`` words that are longer than the known ones, depth first."""
        a = 0
        while a < len(path) and path.shape[1] < upto:
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + SLICE, "right")) - 1)
            owner, word, inner, where, what, count = self.extended(cut[a : b + 1] - cut[a], block[cut[a] : cut[b]], bits[cut[a] : cut[b]])
            more = np.column_stack([path[a:b][owner], word])
            keep = self.wanted(more) if len(self.filters) > 1 and len(more) else np.ones(len(more), bool)  # words are known to be frequent
            if more.shape[1] > self.known:
                yield more[keep], count[keep]
            if more.shape[1] < upto and keep.any():
                entry = np.repeat(keep, np.diff(inner))
                yield from self.grow(more[keep], np.append(0, np.cumsum(np.diff(inner)[keep])), where[entry], what[entry], upto)
            a = b

    def phrases(self, upto: int, turn: int = 0, turns: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of one turn: whose first word's hash leaves ``turn`` of ``turns``."""
        mine = words.mix(self.hashes) % np.uint64(turns) == turn
        size = np.diff(self.cut)
        entry = np.repeat(mine, size)
        yield from self.grow(np.flatnonzero(mine)[:, None], np.append(0, np.cumsum(size[mine])), self.block[entry], self.bits[entry], upto)


def _longer(table: DataFrame, filters: list[Filter], known: int, upto: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(lang, phrase, n): what each shard counts of phrases of ``known`` + 1 to ``upto`` words that pass the filters, those of one turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, text = batch.column("lang")[i].as_py(), batch.column("words")[i].values
                row = {c: np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("entries", np.int32), ("block", np.int32), ("bits", np.uint8))}
                shard = _Vertical(row, _hashes(text), _seed(lang), filters, known)
                for path, count in shard.phrases(upto, turn, turns):
                    for a in range(0, len(path), 1 << 16):
                        part = shard.ids[path[a : a + (1 << 16)]]
                        phrase = pc.binary_join_element_wise(*(text.take(pa.array(part[:, j])) for j in range(part.shape[1])), " ")
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), phrase, pa.array(count[a : a + len(part)])], ["lang", "phrase", "n"])

    return table.select("lang", "words", "entries", "block", "bits").mapInArrow(run, "lang string, phrase string, n long")


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD, filter_bits: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) for every phrase of up to ``longest`` words with ``least`` occurrences in its language or more, and (lang, n) of all words."""
    table = stage(shards(docs, size), "shards")
    totals = stage(table.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    each = table.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    def frequent(rows: DataFrame) -> DataFrame:  # shards have added up what is theirs: a second table in the same tasks would only hold memory
        made.append(stage(rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent"))
        return made[-1]

    made: list[DataFrame] = []
    levels, filters = [frequent(each)], []
    total = totals.agg(F.sum("n")).first()[0] or 0
    while len(levels) <= 3 and len(levels) < longest:
        length = len(levels)
        upto = length + 1 if length < 3 else longest
        filters.append(Filter.of(levels[-1], length, filter_bits))
        most = (upto - length) * (levels[-1].agg(F.sum("f")).first()[0] or 0)  # a phrase that is counted extends an occurrence of a frequent one
        turns = max(1, math.ceil(most / max(TURN * total, 1)))
        levels.append(functools.reduce(DataFrame.unionByName, [frequent(_longer(table, list(filters), length, upto, turn, turns)) for turn in range(turns)]))
    drop(table)
    whole = functools.reduce(DataFrame.unionByName, levels)
    out = stage(whole.select("lang", "phrase", F.size(F.split("phrase", " ", -1)).alias("k"), "f"), "phrases")
    drop(*made)
    return out, totals


def _part(a, n):  # noqa: ANN001, ANN202  columns
    return F.array_join(F.slice("w", a, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD, filter_bits: int = FILTER) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more by their weakest cut, without those that occur inside a longer one as often as alone."""
    known, totals = counted(docs, least, longest, size, filter_bits)
    several = known.where("k > 1").withColumn("w", F.split("phrase", " ", -1))
    cuts = several.select("lang", "phrase", F.col("f").alias("a"), "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda c, f: known.select("lang", F.col("phrase").alias(c), F.col("f").alias(f))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(1000 * a as decimal(20,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    inner = several.where("k > 2").select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("j"))
    inner = inner.select("lang", "f", "w", "j", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("j") + 1)).alias("p")).select("lang", _part(F.col("p"), F.col("j")).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    left = stage(weakest.join(inner, ["lang", "phrase"], "left").where("inside IS NULL OR inside < a").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))  # a language's candidates meet in one task as ``top`` rows a part
    first = left.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    drop(known, totals)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
