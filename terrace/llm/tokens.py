"""Token counts by rank-synchronous merging of ragged arrays.

A text's bytes are cut into pre-tokens by the classes of their characters, a chunk of documents at a time. The distinct pre-tokens of a chunk lie as one ragged array of symbols. In each round every sequence finds
its pair of lowest rank and merges it at all its places at once (of overlapping places the left one); sequences without a known pair are done, and the symbols that are left are the tokens. A round costs as much as
the sequences that still change. A sequence of more than ``LONG`` symbols goes by itself and keeps its places by rank, so a round touches the places of one rank only: a long run of letters takes n log n, not n a round.

Merging one rank at all places at once gives what merging one place after the other gives, as a merge's rank is above those of the merges that make its parts; ``load`` checks that. The class of a character
(letter, number, space, other) is asked of the library's own pre-tokenizer, once a character and worker, so its version of Unicode counts. Strings of special tokens inside a text are one token, and text around them
is cut as if it ended there, which is the library's default.

Nulls: a null text is empty and has 0 bytes and 0 tokens; a null doc_id stays as it is. Rows are kept one for one, repeated ids and equal rows too. Texts of any length are worked on whole. Columns other than
doc_id and text are not read; an empty table gives an empty result. What the executors get is the vocabulary's merges, about 1 MB.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import chunks

#: Symbols from which a sequence is merged by itself; bytes of text worked on at a time.
LONG, CHUNK = 512, 6 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from U+0100 up."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass
class Merges:
    """A byte-level vocabulary's merges: sorted pairs of symbols with rank and result, first-round ranks of pairs of bytes, the symbol of each byte, and special strings."""

    pairs: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    start: np.ndarray
    symbols: np.ndarray
    special: list[bytes] = field(default_factory=list)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or ``_NONE``."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)


def load(path: str) -> Merges:
    """Merges of a byte-level file of the tokenizers library; ValueError for other kinds."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, before = data["model"], data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or data.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("only byte-level vocabularies without normaliser, prefix space or dropout are known")
    vocab, made = model["vocab"], {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    for k, (a, b) in enumerate(merges):
        if max(made.get(a, -1), made.get(b, -1)) >= k or a + b in made:
            raise ValueError("a merge comes before one that makes its parts")
        made[a + b] = k
    left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
    key = left << 32 | right
    by = np.argsort(key)
    out = Merges(key[by], by.astype(np.int32), np.array([vocab[a + b] for a, b in merges], np.int32), np.zeros(0, np.int32), np.array([vocab[c] for c in byte_symbols()], np.int32))
    both = np.arange(1 << 16)
    out.start = out.look(out.symbols[both >> 8], out.symbols[both & 255])
    out.special = [x["content"].encode() for x in data.get("added_tokens", []) if x.get("special")]
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x.get("special") for x in data.get("added_tokens", [])):
        raise ValueError("added tokens that take in space or whole words are not known")
    return out


class Classes:
    """The class of every character met so far, by code point."""

    def __init__(self) -> None:
        from tokenizers import pre_tokenizers

        self._cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.table = np.zeros(0x110000, np.uint8)
        self.ask(np.arange(128))
        self.ascii = np.zeros(256, np.uint8)
        self.ascii[:128] = self.table[:128]

    def ask(self, points: np.ndarray) -> None:
        """Fill in what is not known yet: a character is of the class of that sign with which it makes one pre-token."""
        for p in np.unique(points[self.table[points] == 0]).tolist():
            c = chr(p)
            self.table[p] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self._cut(x + c)) == 1), SPACE)

    def of(self, buf: np.ndarray, n: int) -> np.ndarray:
        """The class of each byte: its character's."""
        raw = buf[:n]
        out = self.ascii[raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            b = [buf[lead + k].astype(np.int32) & 0x3F for k in range(4)]
            size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
            point = np.select([size == 2, size == 3], [(b[0] & 0x1F) << 6 | b[1], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]], (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3])
            self.ask(point)
            kind = self.table[point]
            for k in range(4):
                some = size > k
                out[lead[some] + k] = kind[some]
        return out


def _special(buf: np.ndarray, off: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """(start, end) of special strings, none across two documents."""
    found: list[tuple[int, int]] = []
    if strings:
        pattern, whole = re.compile(b"|".join(re.escape(x) for x in sorted(strings, key=len, reverse=True))), buf.tobytes()
        if pattern.search(whole):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                found += [m.span() for m in pattern.finditer(whole, a, b)]
    return np.array(found, np.int64).reshape(-1, 2)


def pretokens(buf: np.ndarray, off: np.ndarray, classes: Classes, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where pre-tokens start, and which of them are special strings."""
    n = int(off[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, spans = classes.of(buf, n), _special(buf, off, special)
    cut = np.unique(np.concatenate([off, spans.ravel()]))  # text ends at each of them
    start = np.append(True, kind[1:] != kind[:-1])
    start[cut[cut < n]] = True
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    ended = np.zeros(n + 1, bool)
    ended[cut] = True
    # of white space before other text the last character goes with that text if it is a blank, else by itself
    some = (kind[runs] == SPACE) & ~ended[ends]
    a, b = runs[some], ends[some]
    last = b - 1
    while len(wide := np.flatnonzero((buf[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    start[last] = True
    blank = buf[last] == 0x20
    start[b[blank]] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe is a run of its own that no blank precedes
    some = (buf[runs] == 0x27) & (ends - runs == 1) & start[runs] & ~ended[ends]
    p = runs[some]
    if len(p):
        x, y, inside = buf[p + 1], buf[p + 2], np.searchsorted(cut, p + 2, "right") == np.searchsorted(cut, p + 1, "right")
        size = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 1, 0)
        size[inside & (np.isin(x, np.frombuffer(b"rv", np.uint8)) & (y == ord("e")) | (x == ord("l")) & (y == ord("l")))] = 2
        p, size = p[size > 0], size[size > 0]
        start[p + 1] = False
        after = p + 1 + size
        start[after[after < n]] = True
    if len(spans):
        size = spans[:, 1] - spans[:, 0]
        start[np.repeat(spans[:, 0], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = False
        start[spans[:, 0]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, spans[:, 0])


def _distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])[: len(places)]]


def _alternate(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places in order, those that do not overlap: where each follows the one before it, every other one."""
    n = np.arange(len(places))
    return places[(n - np.maximum.accumulate(np.where(follows, 0, n))) % 2 == 0]


def sizes(raw: np.ndarray, cut: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols left of each sequence of bytes raw[cut[i] : cut[i + 1]] when nothing more can be merged."""
    n = np.diff(cut)
    out = n.copy()
    for i in np.flatnonzero(n > LONG):
        out[i] = _long(raw[cut[i] : cut[i + 1]], merges)
    who = np.flatnonzero((n > 1) & (n <= LONG))
    size = n[who]
    at = np.repeat(cut[who], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data = raw[at].astype(np.int64)
    symbol = merges.symbols[data]
    rank = np.full(len(data), _NONE, np.int32)
    rank[:-1] = merges.start[data[:-1] << 8 | data[1:]]
    rank[np.cumsum(size) - 1] = _NONE
    while len(who):
        heads = np.cumsum(size) - size
        least = np.minimum.reduceat(rank, heads)
        live = least < _NONE
        out[who[~live]] = size[~live]
        hit = np.flatnonzero((rank == np.repeat(least, size)) & np.repeat(live, size))
        follows = np.append(False, hit[1:] == hit[:-1] + 1)[: len(hit)]
        hit = _alternate(hit, follows)
        symbol[hit] = merges.results[rank[hit]]
        keep = np.repeat(live, size)
        keep[hit + 1] = False
        seq = np.repeat(np.arange(len(who)), size)
        size = np.bincount(seq[keep], minlength=len(who))[live]
        who, place = who[live], np.cumsum(keep) - 1
        symbol, rank, hit = symbol[keep], rank[keep], place[hit]
        tails = np.zeros(len(symbol), bool)
        tails[np.cumsum(size) - 1] = True
        touched = np.zeros(len(symbol), bool)
        touched[hit] = touched[hit[hit > 0] - 1] = True
        rank[touched & tails] = _NONE
        changed = np.flatnonzero(touched & ~tails)
        rank[changed] = merges.look(symbol[changed], symbol[changed + 1])
    return out


def _long(raw: np.ndarray, merges: Merges) -> int:
    """Symbols left of one long sequence: places by rank, the lowest rank first, at all its places at once."""
    n = len(raw)
    symbol, after, before = merges.symbols[raw].astype(np.int32), np.arange(1, n + 1), np.arange(-1, n)
    rank = np.full(n + 1, _NONE, np.int32)
    rank[: n - 1] = merges.start[raw[:-1].astype(np.int64) << 8 | raw[1:]]
    waiting: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(places: np.ndarray) -> None:
        places = places[np.argsort(rank[places], kind="stable")]
        places = places[rank[places] < _NONE]
        heads = np.flatnonzero(np.append(True, rank[places][1:] != rank[places][:-1])) if len(places) else places
        for k, group in zip(rank[places[heads]].tolist(), np.split(places, heads[1:]), strict=False):
            if k not in waiting:
                heapq.heappush(queue, k)
            waiting.setdefault(k, []).append(group)

    add(np.arange(n - 1))
    left = n
    while queue:
        k = heapq.heappop(queue)
        p = _distinct(np.concatenate(waiting.pop(k)))
        p = p[rank[p] == k]
        if not len(p):
            continue
        p = _alternate(p, np.append(False, after[p[:-1]] == p[1:]))
        gone = after[p]
        symbol[p], rank[gone] = merges.results[k], _NONE
        after[p] = after[gone]
        before[after[p]] = p
        left -= len(p)
        changed = _distinct(np.concatenate([p, before[p][before[p] >= 0]]))
        inner = after[changed] < n
        rank[changed[~inner]] = _NONE
        changed = changed[inner]
        rank[changed] = merges.look(symbol[changed], symbol[after[changed]])
        add(changed)
    return left


def counted(texts: pa.Array, merges: Merges, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text; a chunk's distinct pre-tokens are merged once."""
    n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, _, buf, off in chunks(texts, CHUNK):
        at, special = pretokens(buf, off, classes, merges.special)
        cut = np.append(at, off[-1]).astype(np.int64)
        known = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(buf)]).dictionary_encode()
        n = np.zeros(0, np.int64)
        if len(known.dictionary):
            _, ends, data = known.dictionary.buffers()
            n = sizes(np.frombuffer(data, np.uint8), np.frombuffer(ends, np.int64)[: len(known.dictionary) + 1], merges)[known.indices.to_numpy()]
        n[special] = 1
        n_bytes.append(np.diff(off))
        n_tokens.append(np.diff(np.append(0, np.cumsum(n))[np.searchsorted(at, off)]))
    return np.concatenate(n_bytes), np.concatenate(n_tokens)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; ``path``: a byte-level vocabulary file on the driver."""
    merges = load(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()
        for batch in batches:
            n_bytes, n_tokens = counted(batch.column("text"), merges, classes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")


def digest(counts: DataFrame, limit: int = 512) -> DataFrame:
    """With whether a document has more than ``limit`` tokens."""
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
