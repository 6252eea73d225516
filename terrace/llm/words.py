"""Words of UTF-8 texts as numpy arrays: spans, 64-bit hashes, and hashes of runs of words.

Both word patterns are classes of single bytes (all bytes from 0x80 up count as word bytes), so no decoding is needed.
Hash functions are fixed: a seed changes between runs of Python, these do not.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of ``[^\x20\x09-\x0D]``: anything but ASCII white space.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, lower-case ASCII letters, anything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 256
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def spans(buf: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``buf``, and for each document of ``off`` the index of its first word, with the total last."""
    n = int(off[-1])
    word = kind[buf[:n]]
    first, last = word.copy(), word.copy()
    if n:
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads, tails = off[:-1], off[1:]
        some = heads < tails
        first[heads[some]] = word[heads[some]]
        last[tails[some] - 1] = word[tails[some] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step; words over 256 bytes by BLAKE2. ``which`` picks one of two functions that have no state in common."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    size = ends - starts
    h = mix((size.astype(np.uint64) * _U(_BASES[0]) + _U(which * 0x632BE59BD9B4E019)) ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= _LONG))
    pos, left = starts[live] + 8, size[live] - 8
    while live.size:
        h[live] = mix((h[live] * _U(_BASES[1 - which])) ^ (eight[pos] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, pos, left = live[more], pos[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def runs(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of h[p : p + width] for every p with width values left; ``which`` picks one of two independent functions."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 3:
        out = h[:n].copy()
        for k in range(1, width):
            out *= _U(_BASES[which])
            out += h[k : k + n]
            out ^= out >> _U(32)
        return mix(out + _U(width))
    up, down = _power(_BASES[which], len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h if not which else mix(h + _U(0x632BE59BD9B4E019))) * up, out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Positions p where h[p : p + width] lies within one document; ``first`` as from ``spans``."""
    total = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(total) + width <= ends)
