"""Words and their hashes for many texts at once, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased. A range's hash
is a polynomial over its bytes modulo 2**64, mixed at the end. Such polynomials have colliding strings that are
known for every base, so words also have a polynomial modulo the prime 2**61 - 1 (``prime_hashes``). All
constants come from a fixed seed, so every process has the same hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1 << 40, 1 << 60)) * 8 + 5
COMBINE = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 19
PRIME = np.uint64((1 << 61) - 1)
PRIME_BASE = int(_RNG.integers(1 << 59, 1 << 60))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64."""
    if len(_POW[0]) < n:
        _POW[:] = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _fold(x: np.ndarray) -> np.ndarray:
    """Modulo the prime."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products of numbers below the prime, modulo the prime, from halves of 31 bits."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _fold(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + _fold(a0 * b0))


_PRIME_POW = [np.ones(1, np.uint64)]


def _prime_powers(n: int) -> np.ndarray:
    while len(_PRIME_POW[0]) < n:
        k = len(_PRIME_POW[0])
        _PRIME_POW[0] = np.concatenate((_PRIME_POW[0], _times(_PRIME_POW[0], np.uint64(pow(PRIME_BASE, k, int(PRIME))))))
    return _PRIME_POW[0]


def prime_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of ranges of bytes, none of which overlap or are empty: polynomials modulo the prime."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    within = np.arange(size.sum()) - np.repeat(first, size)
    # one more than the byte, so that zero bytes count; sums of halves stay below 2**64 for words of up to 32 MB
    byte, power = data[within + np.repeat(start, size)].astype(np.uint64) + np.uint64(1), _prime_powers(int(size.max()))
    high = np.add.reduceat((power >> np.uint64(31))[within] * byte, first)
    low = np.add.reduceat((power & np.uint64((1 << 31) - 1))[within] * byte, first)
    return _fold(_times(_fold(high), np.uint64(1 << 31)) + _fold(low))


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > size:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Buffer:
    """Texts one after another, each followed by a blank, and the prefix sums that range hashes come from."""

    def __init__(self, texts: list[bytes], lower: bool = True) -> None:
        joined = b" ".join(texts) + b" "
        self.raw = np.frombuffer(joined, np.uint8)
        self.bytes = np.frombuffer(joined.lower(), np.uint8) if lower else self.raw
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(sizes + 1) - 1  # the blank after each text
        self.start = self.stop - sizes
        up, self.down = powers(len(joined) + 1)
        self.sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(BYTE[self.bytes] * up[: len(joined)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes of each range, wherever it stands."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and for each text the number of words before it (one more at the end)."""
        blank = (self.bytes == 32) | ((self.bytes >= 9) & (self.bytes <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(start, np.append(self.start, len(self.bytes)))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text, or of the text's whole words if it has fewer, and each text's first (one more at the end)."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(first[:-1], count) + np.arange(begin[-1]) - np.repeat(begin[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = j < size
        out += np.where(inside, hashes[np.minimum(at + j, max(0, len(hashes) - 1))] * COMBINE[j], 0) if len(hashes) else 0
    return mix(out + size.astype(np.uint64)), begin


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start .. start + size - 1 of each range, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes (at least one) from each a and from each b on are the same."""
    if not len(size):
        return np.empty(0, bool)
    return np.logical_and.reduceat(data[ranges(a, size)] == data[ranges(b, size)], np.cumsum(size) - size)


def range_hashes(data: np.ndarray, start: np.ndarray, size: int, chunk: int = 1 << 20) -> np.ndarray:
    """Of the ``size`` bytes from each start (ascending) on."""
    out, up = np.empty(len(start), np.uint64), powers(chunk + size + 1)
    for a in range(0, len(data), chunk):
        lo, hi = np.searchsorted(start, (a, a + chunk))
        part = data[a : a + chunk + size]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[part] * up[0][: len(part)])))
        at = start[lo:hi] - a
        out[lo:hi] = mix((sums[at + size] - sums[at]) * up[1][at])
    return out
