"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their beginnings of 4, 5 and 6 bytes (inflected and coined forms share
them), hashed to ``2 ** BITS`` slots. The score is a logistic function of a bias, a weight a term, and for every pair of terms the
product of their ``FACTORS`` latent values, so that a pair such as an insult and the mention of a group counts for more than
both alone. It is fitted to labelled rows by AdaGrad with an L1 penalty on weights and an L2 penalty on factors. The machine's terms
are those that tell on their own, and those that tell in a pair (terms that occur in the same texts count once): of all terms, two that meet in ``PAIR_TEXTS`` positive texts or more that a first fit leaves
unexplained, if the texts that hold both are positive more often than chance makes likely among all the pairs so tried (``CHANCE``); and of the ``PAIR_TERMS`` most frequent ones also two that make texts harmless, if
what is unexplained in the texts that hold both is ``PAIR_DEVIATIONS`` standard deviations from nothing. So two terms that say nothing alone, or a neutral one that makes an insult toxic, get weights and factors.

``SAMPLE`` bounds the labelled rows used for fitting: they are those with the smallest hashes of their doc_id (and of their text, where ids have many). They are picked out of the documents in one
job on all cores, written, and gathered. Every text is scored whole, a chunk of about 2 MB of an Arrow batch at a time (a longer text is a chunk of its own).

Nulls: a null or empty text has the bias alone. Rows without doc_id are scored and count as not held out. Labels that are null
are no labels; of several labels of one document the largest counts. Without any positive or any negative label, every
score is a smoothed prior. Repeated rows get equal scores, and a repeated labelled document counts as often as it is there, until repeats make up as many as ``SAMPLE``; then their numbers shrink in proportion; rows that are fitted are put in order first, so ties of nothing decide.
Columns are kept; one named ``toxicity`` is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm import words
from terrace.llm.common import binaries, chunks, drop, stage

SAMPLE, BITS, FACTORS, THRESHOLD = 12_000, 20, 4, 0.3
PREFIXES = (4, 5, 6)
#: A term is used if its count among positive texts is so many standard deviations from what its frequency makes likely.
DEVIATIONS = 4.0
#: Terms whose pairs are searched in both directions, the standard deviations that such a pair needs, and the texts that have to hold both.
PAIR_TERMS, PAIR_DEVIATIONS, PAIR_TEXTS = 2048, 6.0, 8
#: The chance, over all pairs tried, of a pair of any terms that tells nothing; a positive text is unexplained from this residual up.
CHANCE, UNEXPLAINED = 0.05, 0.5
#: A positive row counts as so many: the classes are uneven, and short texts hold one telling term.
POSITIVE = 4.0
STEPS, BATCH, RATE, L1, L2 = 2_000, 256, 0.3, 5e-5, 1e-3


@dataclass
class Model:
    """Bias, and weight and factors of the terms in ``slots``, in ascending order."""

    bias: float
    slots: np.ndarray
    weight: np.ndarray
    factors: np.ndarray


def terms(buf: np.ndarray, off: np.ndarray, bits: int = BITS, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every distinct term; with ``number`` (a slot's, -1 for none) only of those that have one."""
    low = words.LOWER[buf]
    starts, ends, first = words.spans(low, off, words.ALNUM)
    eight = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))[starts] if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    size = ends - starts
    keys, docs = [words.hashes(low, starts, ends)], [doc]
    for k in PREFIXES:
        long = size > k
        keys.append(words.mix(words.mix(eight[long] & words._MASK[k]) + np.uint64(k)))
        docs.append(doc[long])
    slot, doc = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(docs)
    if number is not None:
        used = np.flatnonzero(number[slot] >= 0)
        slot, doc = slot[used], doc[used]
    both = np.unique(doc.astype(np.int64) << bits | slot)
    return both >> bits, both & ((1 << bits) - 1)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in chunks(batch.column("text")):
            doc, slot = terms(buf, off)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), binaries(slot.astype(np.int32), cut)], ["doc_id", "y", "slots"])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sums(v: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``v`` by ``row`` (ascending)."""
    out = np.zeros((n, v.shape[1]), v.dtype)
    if len(row):
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[heads]] = np.add.reduceat(v, heads)
    return out


def raw(model: Model, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The machine's values for n texts; text ``row`` holds the model's term number ``at``."""
    v = model.factors[at]
    s, q = _sums(v, row, n), _sums(v * v, row, n)
    return model.bias + np.bincount(row, model.weight[at], n) + 0.5 * (s * s - q).sum(1)


def _count(at: np.ndarray, n: int) -> np.ndarray:
    """``np.bincount``, which copies what it counts, a part at a time."""
    return sum((np.bincount(at[a : a + (1 << 20)], minlength=n) for a in range(0, len(at), 1 << 20)), np.zeros(n, np.int64))


def _runs(first: np.ndarray, most: int = 1 << 18) -> list[int]:
    """Cuts of entries, a text's from ``first`` on, into runs of whole texts with about ``most`` entries."""
    return np.unique(first[np.searchsorted(first, np.append(np.arange(0, first[-1], most), first[-1]))]).tolist()


def _owners(of: np.ndarray, first: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that hold each group, in ascending order, and where each group's begin; text t holds the distinct groups ``of[first[t]:first[t + 1]]``."""
    cut = np.append(0, np.cumsum(_count(of, groups)))
    owner, free = np.zeros(len(of), np.int32), cut[:-1].copy()
    for lo, hi in itertools.pairwise(_runs(first)):
        part = of[lo:hi]
        order = np.argsort(part, kind="stable")
        part = part[order]
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        n = np.diff(np.append(heads, len(part)))
        owner[free[part] + np.arange(len(part)) - np.repeat(heads, n)] = np.searchsorted(first, lo + order, "right") - 1
        free[part[heads]] += n
    return owner, cut


def telling_pairs(row: np.ndarray, at: np.ndarray, terms: int, residual: np.ndarray, spread: np.ndarray, most: int = PAIR_TERMS) -> np.ndarray:
    """Whether each term is part of a pair whose texts are left unexplained; text ``row`` (ascending) holds term ``at``, and has a residual and its variance."""
    n = len(residual)
    count, column, mark = _count(at, terms), np.zeros(terms), np.random.default_rng(0).random(n)
    some = np.searchsorted(row, np.arange(0, n + 512, 512))  # 512 texts at a time: entries are many
    for lo, hi in itertools.pairwise(some):
        column += np.bincount(at[lo:hi], mark[row[lo:hi]], terms)  # equal for terms of the same texts
    often = np.flatnonzero(count >= PAIR_TEXTS)
    alike, group = np.unique(column[often], return_inverse=True)
    size = np.zeros(len(alike), np.int64)
    size[group] = count[often]
    used = np.argsort(-size, kind="stable")[:most]
    number = np.full(len(alike), -1, np.int32)
    number[used] = np.arange(len(used))
    place, tells = np.full(terms, -1, np.int32), np.zeros(len(used), bool)
    place[often] = number[group]
    del count, column, group, number
    for one in range(0, len(used), 1024):  # 1024 terms at a time against all: sums of all pairs at once are large
        own = slice(one, one + 1024)
        left, var, both = (np.zeros((len(used[own]), len(used)), np.float32) for _ in range(3))
        for a, (lo, hi) in zip(range(0, n, 512), itertools.pairwise(some), strict=False):
            col = place[at[lo:hi]]
            x = np.zeros((min(512, n - a), len(used)), np.float32)
            x[row[lo:hi][col >= 0] - a, col[col >= 0]] = 1
            y = np.ascontiguousarray(x[:, own].T)
            both += y @ x
            left += y @ (x * residual[a : a + 512, None].astype(np.float32))
            var += y @ (x * spread[a : a + 512, None].astype(np.float32))
        pair = (both >= PAIR_TEXTS) & (var > 0) & (np.abs(left) >= PAIR_DEVIATIONS * np.sqrt(var))
        pair[np.arange(len(pair)), np.arange(one, one + len(pair))] = False
        tells[own] = pair.any(1)
    out = np.zeros(terms, bool)
    held = place >= 0
    out[held] = tells[place[held]]
    return out


def meeting_pairs(row: np.ndarray, at: np.ndarray, terms: int, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each term, of all there are, is part of a pair that meets in unexplained positive texts and is positive beyond chance; text ``row`` (ascending) holds term ``at`` and is expected to be positive with p.

    Terms are taken one by one: a count over the unexplained texts that hold it says which others it meets, and one over all texts that hold it how often both are positive and how often that is expected.
    """
    out = np.zeros(terms, bool)
    want = (y == 1) & (1 - p >= UNEXPLAINED)
    some = want[row]
    often = _count(at[some], terms) >= PAIR_TEXTS
    if not often.any():
        return out
    mark, column = np.random.default_rng(1).random(len(y)), np.zeros(terms)
    first = np.searchsorted(row, np.arange(len(y) + 1))
    for lo in range(0, len(at), 1 << 20):
        column += np.bincount(at[lo : lo + (1 << 20)], mark[row[lo : lo + (1 << 20)]], terms)
    column[~often] = -1
    alike, number = np.unique(column, return_inverse=True)  # equal for terms of the same texts
    number = np.where(often, number - (not often.all()), -1).astype(np.int32)
    size = len(alike) - (not often.all())
    count, parts = np.zeros(len(y), np.int64), []
    for lo, hi in itertools.pairwise(_runs(first)):  # entries are many: their order is found a run of texts at a time
        by = number[at[lo:hi]].astype(np.int64)
        own = by >= 0
        by = np.unique(row[lo:hi][own].astype(np.int64) * size + by[own])  # a group once a text
        count += np.bincount(by // size, minlength=len(y))
        parts.append((by % size).astype(np.int32))
    of, first = np.concatenate(parts), np.append(0, np.cumsum(count))
    del parts
    owner, cut = _owners(of, first, size)

    def others(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = first[texts + 1] - first[texts]
        return of[np.repeat(first[texts], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.repeat(texts, n)

    met, tried = [], 0
    for a in range(size):
        texts = owner[cut[a] : cut[a + 1]]
        n = np.bincount(others(texts[want[texts]])[0], minlength=size)
        n[: a + 1] = 0
        b = np.flatnonzero(n >= PAIR_TEXTS)
        if len(b):
            met.append((a, b))
            tried += len(b)
    told = np.zeros(size, bool)
    for a, b in met:
        term, text = others(owner[cut[a] : cut[a + 1]])
        good = np.bincount(term, y[text], size)[b]
        likely = np.maximum(np.bincount(term, p[text], size)[b], 1e-3)
        beyond = np.where(good > likely, good * np.log(good / likely) - good + likely, 0.0)  # the tail of a Poisson count
        tells = beyond >= np.log(tried / CHANCE)
        told[b[tells]] = True
        told[a] |= tells.any()
    out[often] = told[number[often]]
    return out


def _descend(m: Model, row: np.ndarray, at: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Model:
    """AdaGrad from ``m`` over mini-batches of texts."""
    first = np.searchsorted(row, np.arange(len(y) + 1))
    gw, gv, g0 = np.full(len(m.slots), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(1 + STEPS * BATCH // len(y)):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            n = first[own + 1] - first[own]
            r = np.repeat(np.arange(len(own)), n)
            i = at[np.repeat(first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            v = m.factors[i]
            s = _sums(v, r, len(own))
            z = m.bias + np.bincount(r, m.weight[i], len(own)) + 0.5 * (s * s - _sums(v * v, r, len(own))).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * np.where(y[own] == 1, POSITIVE, 1)
            touched, no = np.unique(i, return_inverse=True)
            dw = np.bincount(no, g[r], len(touched))
            dv = g[r][:, None] * (s[r] - v)
            dv = np.stack([np.bincount(no, dv[:, k], len(touched)) for k in range(dv.shape[1])], 1) + L2 * len(own) * m.factors[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            step = RATE / np.sqrt(gw[touched])
            w = m.weight[touched] - step * dw
            m.weight[touched] = np.sign(w) * np.maximum(np.abs(w) - step * L1 * len(own), 0)
            m.factors[touched] -= 0.2 * RATE / np.sqrt(gv[touched]) * np.clip(dv, -5, 5)
            g0 += g.sum() ** 2
            m.bias -= RATE * g.sum() / np.sqrt(g0)
    return m


def fit(texts: list[np.ndarray], y: np.ndarray, factors: int = FACTORS, seed: int = 7) -> Model:
    """Fit to texts, each an array of slots, with labels 0 and 1."""
    prior = (y.sum() + 0.5) / (len(y) + 10)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < y.sum() < len(y):
        return Model(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    at = np.concatenate(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    del texts  # with the table they lie in, if the caller has let go of it
    slots = np.zeros(0, at.dtype)
    for a in range(0, len(at), 1 << 20):
        slots = np.union1d(slots, at[a : a + (1 << 20)])
    for a in range(0, len(at), 1 << 20):
        at[a : a + (1 << 20)] = np.searchsorted(slots, at[a : a + (1 << 20)])
    count, share = _count(at, len(slots)), y.mean()
    bad = _count(at[(y == 1)[row]], len(slots))

    def machine(used: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        keep = used[at]
        own = (np.cumsum(used) - 1)[at[keep]]
        return _descend(Model(bias, slots[used], np.zeros(used.sum()), rng.normal(0, 0.01, (used.sum(), factors))), row[keep], own, y, rng), row[keep], own

    alone = np.abs(bad - count * share) >= DEVIATIONS * np.sqrt(count * share * (1 - share))
    m, own_row, own = machine(alone)
    p = 1 / (1 + np.exp(-np.clip(raw(m, own_row, own, len(y)), -30, 30)))
    p = p / (p + (1 - p) * POSITIVE)  # as likely as it is without the weight of positive rows
    pairs = telling_pairs(row, at, len(slots), y - p, np.maximum(p * (1 - p), share * (1 - share) / 10)) & ~alone
    pairs |= meeting_pairs(row, at, len(slots), y, p) & ~alone
    if pairs.any():
        m, _, _ = machine(alone | pairs)
    m.factors[np.abs(m.factors) < 1e-3] = 0
    some = (m.weight != 0) | m.factors.any(1)
    return Model(float(m.bias), m.slots[some], m.weight[some], m.factors[some])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most about ``sample`` labelled rows that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # binomial: within a few hundredths of sample
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").mapInArrow(_terms, f"doc_id {kind}, y int, slots binary")
    rows = stage(rows.groupBy("doc_id", "y", "slots").agg(F.count("*").alias("times")), "labelled")  # equal rows once
    many, total = rows.agg(F.count("*"), F.sum("times")).first()
    some = rows.where(F.pmod(F.xxhash64("doc_id", "slots"), F.lit(1 << 30)) < int(min(1.0, 1.5 * sample / max(many, 1)) * (1 << 30)))  # ids with many texts
    found = some.sort("doc_id", "slots").toArrow().combine_chunks()  # the bounded sample
    drop(rows)
    times = np.ceil(found.column("times").to_numpy() * min(1.0, 2 * sample / max(total or 1, 1))).astype(np.int64)
    at = np.repeat(np.arange(len(times)), times)
    y, texts = found.column("y").to_numpy().astype(np.float64)[at], [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("slots")]
    texts = [texts[i] for i in at[::-1]]
    del found
    return fit([texts.pop() for _ in at], y)  # which lets go of them


def scores(docs: DataFrame, model: Model, bits: int = BITS, into: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``into`` from 0 to 1."""
    docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << bits, -1, np.int32)
        number[model.slots] = np.arange(len(model.slots))
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, buf, off in chunks(batch.column("text")):
                doc, slot = terms(buf, off, bits, number)
                z = raw(model, doc, number[slot], hi - lo)
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def digest(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: whether it was held out, its score and class."""
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""
    return scores(docs, train(docs, labels), into="_toxicity").where(F.col("_toxicity") < threshold).select(*docs.columns)
