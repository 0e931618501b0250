"""Words of whole Arrow text columns as 64-bit hashes, in numpy.

A batch's texts already lie in one UTF-8 buffer. Words are found there by a lookup table over bytes, and hashed by differences of
one running polynomial sum (modulo 2**64), so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text is hashed alone.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: the space and the ASCII controls from tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside ASCII letters and multi-byte characters.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 2 * len(_powers[k])), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that all bits depend on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets at which its rows begin; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of rows first..last-1: bounds in the bytes, and the row of each. letter, if given, marks the bytes of words, else `between` those that are none."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, between: np.ndarray = SPACE, letter: np.ndarray | None = None):
        lo, hi = offsets[first], offsets[last]
        self.first, self.last = first, last
        self.data = LOWER[data[lo:hi]]
        gap = between[self.data] if letter is None else ~letter[lo:hi]
        edge = np.zeros(len(gap) + 1, bool)
        edge[offsets[first : last + 1] - lo] = True
        word = ~gap
        before = np.ones(len(gap), bool)
        before[1:] = gap[:-1]
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        after = np.ones(len(gap), bool)
        after[:-1] = gap[1:]
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        #: begin[r]: the first word of row first + r.
        self.begin = np.searchsorted(self.starts, offsets[first : last + 1] - lo)
        self._sums = None

    def _running(self) -> np.ndarray:
        if self._sums is None:
            power, _ = _power_tables(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=sums[1:])
            self._sums = sums
        return self._sums

    def hashes(self, width: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first width bytes (words shorter than that: of the whole word)."""
        sums, inverse = self._running(), _power_tables(len(self.data) + 1)[1]
        ends = self.ends if width is None else np.minimum(self.ends, self.starts + width)
        return mix((sums[ends] - sums[self.starts]) * inverse[self.starts] + (ends - self.starts).astype(np.uint64))


def word_hash(word: str) -> int:
    """The hash that hashes() gives to this one word, as a signed number."""
    data = np.frombuffer(word.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]), 0, 1, np.zeros(256, bool))
    return int(w.hashes().view(np.int64)[0])


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about size bytes; each row is whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


_STEP = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, k: int) -> Iterator[np.ndarray]:
    """Of each row, the hashes of its runs of k words in order (with fewer words, of all as one; with none, nothing)."""
    h = words.hashes()
    runs = max(0, len(h) - k + 1)
    of_k = np.zeros(runs, np.uint64)
    for j in range(k):
        of_k += mix(h[j : j + runs] ^ _STEP[j]) * _STEP[j + 8]
    of_k = mix(of_k)
    for r in range(words.last - words.first):
        a, b = words.begin[r], words.begin[r + 1]
        if b - a >= k:
            yield of_k[a : b - k + 1]
        elif b > a:
            short = sum((mix(h[a + j : a + j + 1] ^ _STEP[j]) * _STEP[j + 16] for j in range(b - a)), np.zeros(1, np.uint64))
            yield mix(short + np.uint64(b - a))
        else:
            yield of_k[:0]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct hashes of shingles(); a row at a time in memory beyond one chunk."""
    data, offsets = buffers(texts)
    for first, last in chunks(offsets):
        for h in shingles(Words(data, offsets, first, last), k):
            yield np.unique(h)
