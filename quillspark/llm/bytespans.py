"""Vectorised word and shingle hashing over UTF-8 buffers (NumPy).

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` yields.  A block of documents becomes one buffer of words joined by
single spaces; every word or shingle is then a span of that buffer, and XXH64 is
computed for all spans at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# XXH64 primes (fixed values of the published algorithm).
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)

#: Spans hashed together; keeps the temporaries inside the CPU cache.
SPAN_BLOCK = 1 << 15


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _merge(h, acc):
    return (h ^ _round(np.uint64(0), acc)) * P1 + P4


def _hash_block(u8, u32, u64, pos, size, seed):
    """XXH64 of the spans [pos, pos+size) of one block."""
    seed = np.uint64(seed)
    h = np.full(pos.size, seed + P5, np.uint64)
    at = pos.copy()
    left = size.copy()
    long = np.flatnonzero(size >= 32)
    if long.size:
        acc = [np.full(long.size, v, np.uint64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        p, rest = pos[long], size[long]
        live = np.arange(long.size)
        while live.size:
            q = p[live]
            for lane in range(4):
                acc[lane][live] = _round(acc[lane][live], u64[q + 8 * lane])
            p[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        v = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            v = _merge(v, a)
        h[long] = v
        at[long] = p
        left[long] = rest
    h += size.astype(np.uint64)
    for _ in range(3):
        k = np.flatnonzero(left >= 8)
        if not k.size:
            break
        x = h[k] ^ _round(np.uint64(0), u64[at[k]])
        h[k] = _rotl(x, 27) * P1 + P4
        at[k] += 8
        left[k] -= 8
    k = np.flatnonzero(left >= 4)
    if k.size:
        x = h[k] ^ (u32[at[k]].astype(np.uint64) * P1)
        h[k] = _rotl(x, 23) * P2 + P3
        at[k] += 4
        left[k] -= 4
    for _ in range(3):
        k = np.flatnonzero(left > 0)
        if not k.size:
            break
        x = h[k] ^ (u8[at[k]].astype(np.uint64) * P5)
        h[k] = _rotl(x, 11) * P1
        at[k] += 1
        left[k] -= 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    return h


def xxh64_spans(buf: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of every span of ``buf``."""
    padded = buf + b"\0" * 8
    n = len(buf) + 1
    u8 = np.frombuffer(padded, np.uint8)
    u32 = np.ndarray((n,), "<u4", padded, strides=(1,))
    u64 = np.ndarray((n,), "<u8", padded, strides=(1,))
    out = np.empty(starts.size, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, starts.size, SPAN_BLOCK):
            b = a + SPAN_BLOCK
            out[a:b] = _hash_block(u8, u32, u64, starts[a:b].astype(np.int64), sizes[a:b].astype(np.int64), seed)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * P2
        x ^= x >> np.uint64(29)
        x *= P3
        x ^= x >> np.uint64(32)
    return x


class Words:
    """The words of a block of documents, as spans of one buffer.

    ``first[d] : first[d + 1]`` are the words of document ``d``.
    """

    def __init__(self, texts: Iterable[bytes | None], lower: bool = False):
        parts, counts = [], []
        for t in texts:
            words = (t.lower() if lower else t).split() if t else []
            counts.append(len(words))
            if words:
                parts.append(b" ".join(words))
        self.buf = b" ".join(parts)
        self.first = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=self.first[1:])
        raw = np.frombuffer(self.buf, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        n = int(self.first[-1])
        self.start = np.zeros(n, np.int64)
        self.end = np.full(n, raw.size, np.int64)
        if n:
            self.start[1:] = gaps + 1
            self.end[:-1] = gaps
        #: per word, the index after the last word of its document
        self.limit = np.repeat(self.first[1:], np.diff(self.first))

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64_spans(self.buf, self.start, self.end - self.start, seed)

    def shingles(self, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first shingle of each document): shingles of ``k`` words, joined by a
        space; a document of fewer words has its whole sequence as one shingle."""
        counts = np.diff(self.first)
        index = np.arange(self.start.size)
        whole = index + k <= self.limit
        short = (counts > 0) & (counts < k)
        whole[self.first[:-1][short]] = True
        at = np.flatnonzero(whole)
        last = np.minimum(at + k, self.limit[at]) - 1
        h = xxh64_spans(self.buf, self.start[at], self.end[last] - self.start[at], seed)
        first = np.zeros(counts.size + 1, np.int64)
        np.cumsum(np.where(short, 1, np.maximum(counts - k + 1, 0)), out=first[1:])
        return h, first


_MULTIPLIER = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for at least ``n`` positions."""
    global _powers, _inverses
    if _powers.size < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        with np.errstate(over="ignore"):
            tables = []
            for base in (_MULTIPLIER, inverse):
                t = np.full(size, base, np.uint64)
                t[0] = 1
                tables.append(np.multiply.accumulate(t))
        _powers, _inverses = tables
    return _powers, _inverses


class Rolling:
    """Hashes of word windows of any length, from prefix sums of a polynomial in the word hashes."""

    def __init__(self, word_hashes: np.ndarray):
        n = word_hashes.size
        self.powers, self.inverses = _power_tables(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(word_hashes * self.powers[:n], out=self.prefix[1:])

    def windows(self, starts: np.ndarray, sizes) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.prefix[starts + sizes] - self.prefix[starts]) * self.inverses[starts]
            return mix(x + np.asarray(sizes, np.uint64) * P5)


def blocks(sizes: Iterable[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes; a larger row stands alone."""
    begin, total = 0, 0
    end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield begin, end
            begin, total = end, 0
    if begin < end:
        yield begin, end
