"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 bytes of a block of whole texts: words
are found with byte tables, hashed with a polynomial rolling hash and combined
into shingles without a Python object per word.  Blocks are cut at document
boundaries by the callers and at word boundaries inside ``word_hashes``, so
memory does not grow with a text beyond a small multiple of its own bytes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
_SEGMENT = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int = 1) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a counter; the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(salt)) | np.uint64(1)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.pow = np.ones(1, dtype=np.uint64)
        self.inv = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.pow):
            n = 1 << (n - 1).bit_length()
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("pow", BASE), ("inv", inverse)):
                factors = np.full(n, base & _MASK, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.pow, self.inv


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the hash base and of its inverse."""
    return _POWERS.upto(n)


class Words:
    """The words of a block of texts.

    ``hashes``, ``begin`` and ``end`` (byte positions in ``data``) hold one
    entry for each word, in order; ``first[i]:first[i + 1]`` are those of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = data, offsets
        n = len(offsets) - 1
        inside = ~SPACE[data] if len(data) else np.zeros(0, dtype=bool)
        before = np.zeros(len(data), dtype=bool)
        after = np.zeros(len(data), dtype=bool)
        if len(data):
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            cuts = offsets[1:-1]
            before[cuts[cuts < len(data)]] = False
            after[cuts[cuts > 0] - 1] = False
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.hashes = self._hash(lower)
        self.n = n

    def _hash(self, lower: bool) -> np.ndarray:
        out = np.empty(len(self.begin), dtype=np.uint64)
        i, total = 0, len(self.begin)
        while i < total:
            at = self.begin[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + _SEGMENT, side="right")))
            stop = self.end[j - 1]
            power, inverse = _POWERS.upto(int(stop - at) + 1)
            piece = self.data[at:stop]
            piece = LOWER[piece] if lower else piece
            value = piece.astype(np.uint64)
            value += np.uint64(1)
            value *= power[: len(piece)]
            total_to = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(value, out=total_to[1:])
            b, e = self.begin[i:j] - at, self.end[i:j] - at
            out[i:j] = (total_to[e] - total_to[b]) * inverse[b]
            i = j
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ngrams(hashes: np.ndarray, k: int, salt: int = 7) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries; ``len(hashes) - k + 1`` of them."""
    if len(hashes) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i, a in enumerate(seeds(k, salt)):
        out += hashes[i : len(hashes) - k + 1 + i] * a
    return mix(out)


def text_blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into (start, stop, bytes, offsets) of whole texts.

    Nulls count as empty texts.  A text longer than ``block_bytes`` is a block of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


assert sys.byteorder == "little"


PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block without ASCII punctuation, in lower case (A-Z and the capitals of Latin-1)."""
    keep = ~PUNCTUATION[data]
    upto = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=upto[1:])
    data = LOWER[data[keep]]
    high = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
    data[high] += 0x20
    return data, upto[offsets]


class Runs:
    """Hashes of runs of consecutive words, of any length, from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        power, self._inverse = powers(len(hashes) + 1)
        self._upto = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=self._upto[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._upto[end] - self._upto[begin]) * self._inverse[begin])


def stretches(equal: np.ndarray, gain: int, loss: int) -> list[tuple[int, int]]:
    """Maximal runs of true entries, joined while gain * hits - loss * misses stays at 0 or more."""
    padded = np.zeros(len(equal) + 2, dtype=bool)
    padded[1:-1] = equal
    edge = np.flatnonzero(padded[1:] != padded[:-1]).tolist()
    return joined(zip(edge[::2], edge[1::2], strict=True), gain, loss)


def joined(runs: Iterable[tuple[int, int]], gain: int, loss: int) -> list[tuple[int, int]]:
    """Runs (first, last + 1) in order, joined as by ``stretches``."""
    out: list[list[int]] = []
    for a, b in runs:
        out.append([a, b, b - a])
        while len(out) > 1:
            begin, _, hits = out[-2]
            total = hits + out[-1][2]
            if gain * total < loss * (out[-1][1] - begin - total):
                break
            out[-2:] = [[begin, out[-1][1], total]]
    return [(a, b) for a, b, _ in out]
