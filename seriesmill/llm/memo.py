"""Columnar look-up of remembered pieces: each distinct piece of text is encoded once per task."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

# Entries kept at most; beyond it the memory starts anew.  Longer pieces are not kept.
ENTRIES, LONGEST = 500_000, 64


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Memo(dict):
    """Piece -> number; the ids of all numbers lie in one flat array with offsets."""

    def __init__(self, encode: Callable[[str], Iterable[int]], entries: int = ENTRIES):
        super().__init__()
        self.encode, self.entries = encode, entries
        self.flat, self.offsets = array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.flat.extend(self.encode(piece))
        self.offsets.append(len(self.flat))
        number = len(self.offsets) - 2
        if len(piece) <= LONGEST:
            self[piece] = number
        return number

    def ids(self, pieces: list[str]) -> np.ndarray:
        """Ids of all pieces, one after the other."""
        if len(self.offsets) > self.entries:
            self.clear()
            self.flat, self.offsets = array("i"), array("q", [0])
        if not pieces:
            return np.zeros(0, np.int32)
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        # Views, gone on return: the arrays can grow again then.
        offsets = np.frombuffer(self.offsets, np.int64)
        starts = offsets[numbers]
        return np.frombuffer(self.flat, np.int32)[spans(starts, offsets[numbers + 1] - starts)]


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes each, one row at least."""
    start = held = end = 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held >= limit:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end
