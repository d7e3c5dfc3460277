"""Vectorized word and shingle hashing over many texts at once (numpy, byte level)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_SEED = 0x5851F42D4C957F2D
_PLACES = 32  # places in a word whose terms are looked up


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Word and shingle hashes of batches of texts. Words are runs of bytes other than 0x20 and 0x09-0x0D;
    A-Z are lower-cased first. Equal words have equal hashes wherever they stand."""

    def __init__(self, width: int = 5):
        self.width = width
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.known = self._terms(np.arange(_PLACES, dtype=np.uint64).repeat(256), np.tile(self.lower, _PLACES))

    @staticmethod
    def _terms(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """A random function of (place in the word, byte)."""
        return mix64(((place << np.uint64(8)) | byte) * _M + np.uint64(_SEED))

    def words(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, in order; number of words of each text). ``start`` and ``end`` then hold where
        the words lie in the texts joined by one space each."""
        self.start = self.end = np.zeros(0, np.int64)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b" ".join([*texts, b""]) if len(texts) else b"", np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        self.start, self.end = start, end = edge[::2], edge[1::2]
        at = np.flatnonzero(~gap)
        size = end - start
        first = np.cumsum(size) - size
        # a word's hash sums a random function of (place in the word, byte): no polynomial, whose values modulo a
        # power of two agree for some words whatever the base
        place = at - np.repeat(start, size)
        byte = raw[at]
        terms = np.take(self.known, (place << 8) | byte, mode="clip")
        if len(size) and size.max() > _PLACES:
            far = np.flatnonzero(place >= _PLACES)
            terms[far] = self._terms(place[far].astype(np.uint64), self.lower[byte[far]])
        hashes = mix64(np.add.reduceat(terms, first) + size.astype(np.uint64) * _M) if len(first) else np.zeros(0, np.uint64)
        bounds = np.concatenate(([0], np.cumsum(lens + 1)))
        return hashes, np.diff(np.searchsorted(start, bounds))

    def runs(self, hashes: np.ndarray) -> np.ndarray:
        """The hash of each ``width`` words in a row."""
        w = self.width
        if len(hashes) < w:
            return hashes[:0]
        out = hashes[: len(hashes) - w + 1].copy()
        for k in range(1, w):
            out *= _M
            out += hashes[k : len(hashes) - w + 1 + k]
        return mix64(out)

    def sets(self, texts: Sequence[bytes]) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles: with fewer words than a shingle has, the
        whole sequence is one; without words there are none."""
        hashes, counts = self.words(texts)
        w = self.width
        runs = self.runs(hashes)
        at = 0
        for n in counts.tolist():
            if n >= w:
                yield np.unique(runs[at : at + n - w + 1])
            elif n:
                whole = np.uint64(n)
                with np.errstate(over="ignore"):
                    for h in hashes[at : at + n]:
                        whole = whole * _M + h
                yield mix64(np.array([whole], np.uint64))
            else:
                yield hashes[:0]
            at += n


def blocks(texts: Sequence[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, each with the index of its first; a long text stands alone."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= limit):
            size += len(texts[j] or b"")
            j += 1
        yield i, [t or b"" for t in texts[i:j]]
        i = j
