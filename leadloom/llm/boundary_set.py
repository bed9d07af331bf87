"""Sets of cut offsets in a text, by rank: Roaring-style containers with cumulative cardinalities.

An offset's upper bits choose a container of 2**16 offsets. A container holds its low halves in whichever form is
smallest: a sorted array, a bitmap, or runs of successive values. ``select(k)`` finds the container by the cumulative
cardinalities and the member by a local select of that form, so neither needs the other containers' members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Offsets per container, and 64-bit words of a bitmap over them.
SPAN, WORDS = 1 << 16, 1 << 10


@dataclass(frozen=True)
class ArrayContainer:
    values: np.ndarray  # uint16, sorted

    def select(self, k: int) -> int:
        return int(self.values[k])

    def rank(self, low: int) -> int:
        return int(np.searchsorted(self.values, low, "right"))


@dataclass(frozen=True)
class BitmapContainer:
    words: np.ndarray  # uint64
    before: np.ndarray  # members ahead of each word

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word, left = int(self.words[at]), k - int(self.before[at])
        for _ in range(left):
            word &= word - 1
        return (at << 6) + (word & -word).bit_length() - 1

    def rank(self, low: int) -> int:
        at, bit = low >> 6, low & 63
        return int(self.before[at]) + (int(self.words[at]) & ((2 << bit) - 1)).bit_count()


@dataclass(frozen=True)
class RunContainer:
    starts: np.ndarray  # first value of each run
    before: np.ndarray  # members ahead of each run, and of the end

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])

    def rank(self, low: int) -> int:
        at = int(np.searchsorted(self.starts, low, "right")) - 1
        if at < 0:
            return 0
        length = int(self.before[at + 1] - self.before[at])
        return int(self.before[at]) + min(length, low - int(self.starts[at]) + 1)


Container = ArrayContainer | BitmapContainer | RunContainer


def container(low: np.ndarray) -> Container:
    """The smallest form of sorted, different values below SPAN: two bytes a value, four a run, 8 KB a bitmap."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    size = min(2 * len(low), 4 * len(first), 8 * WORDS)
    if size == 4 * len(first):
        return RunContainer(low[first], np.append(first, len(low)))
    if size == 2 * len(low):
        return ArrayContainer(low.astype(np.uint16))
    held = np.zeros(SPAN, bool)
    held[low] = True
    words = np.packbits(held, bitorder="little").view("<u8")
    return BitmapContainer(words, np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)]))


class BoundarySet:
    """Sorted, different offsets from 0 on."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets >> 16
        first = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.append(first, len(offsets))
        self.keys = high[first]
        self.before = ends.astype(np.int64)
        self.containers = [container(offsets[a:b] & (SPAN - 1)) for a, b in zip(ends[:-1], ends[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The member that has ``k`` smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - int(self.before[at]))

    def rank(self, offset: int) -> int:
        """Members up to and including ``offset``."""
        at = int(np.searchsorted(self.keys, offset >> 16, "right")) - 1
        if at < 0:
            return 0
        if self.keys[at] < offset >> 16:
            return int(self.before[at + 1])
        return int(self.before[at]) + self.containers[at].rank(offset & (SPAN - 1))
