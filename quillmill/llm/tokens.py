"""Words and their 64-bit hashes for many texts at once, in numpy.

A word is what `re.findall(r"\\w+", text.lower())` finds. Hashes come from one polynomial prefix sum over all code
points of a step, so that no Python code runs for each word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() or chr(i) == "_" for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of several texts: `hash`, `start` and `end` in `points`, and `doc`, the index of the text."""

    def __init__(self, texts: list[str], lower: bool = True):
        parts = [t.lower() for t in texts] if lower else texts
        raw = "\n".join(parts).encode("utf-32-le", "surrogatepass")
        self.points = np.frombuffer(raw, np.uint32)
        n = len(self.points)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = _word_table()[self.points]
        turns = np.diff(inside)
        self.start = np.flatnonzero(turns == 1)
        self.end = np.flatnonzero(turns == -1)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.text_start = np.cumsum(sizes + 1) - sizes - 1
        first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(np.append(first, len(self.start)))
        self.doc = np.repeat(np.arange(len(parts)), self.counts)
        self.first = first
        self.prefix = self._prefix(n)
        self.hash = self.span_hash(self.start, self.end)

    def _prefix(self, n: int) -> np.ndarray:
        power, _ = _powers_to(n + 1)
        out = np.zeros(n + 1, np.uint64)
        terms = self.points.astype(np.uint64)
        terms += np.uint64(0x2545F4914F6CDD1D)
        terms *= power[:n]
        np.cumsum(terms, out=out[1:])
        return out

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the code points from start to end, the same wherever they stand."""
        _, inverse = _powers_to(len(self.points) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def window_hash(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each run of `size` words; a text of fewer words (but one) has one run of all its words."""
    h, n = words.hash, len(words.hash)
    out = np.zeros(n, np.uint64)
    left = np.repeat(words.first + words.counts, words.counts) - np.arange(n)  # words from here to the text's end
    rolled = np.zeros(n + size, np.uint64)
    rolled[:n] = h
    full = np.zeros(n, np.uint64)
    for k in range(size):
        full = full * _MIX[0] + rolled[k : k + n]
    whole = left >= size
    out[whole] = full[whole]
    keep = whole
    for d in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        i, acc = words.first[d], 0
        for k in range(words.counts[d]):
            acc = (acc * int(_MIX[0]) + int(h[i + k])) & (2**64 - 1)
        out[i] = acc ^ int(words.counts[d])
        keep[i] = True
    return mix(out[keep]), words.doc[keep]
