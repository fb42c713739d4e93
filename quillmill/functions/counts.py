"""How often words occur in each of many lists, by sorted numbers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Words that are counted at once.
SLICE_WORDS = 1 << 20


def slices(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of lists with about so many words in all, one list at least."""
    part = (np.cumsum(sizes) - sizes) // (most or SLICE_WORDS)
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from pairwise([0, *cuts.tolist(), len(sizes)])


def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(list, code, n) of each list's distinct words in the order of lists, and the words by code."""
    words = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    size = max(1, len(words.dictionary))
    pairs, n = np.unique(owner * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return pairs // size, pairs % size, n, words.dictionary


def grouped(starts: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of the values from each start to the next."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)
