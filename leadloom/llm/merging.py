"""Byte-pair merging of many words at once in rounds over flat numpy arrays.

All words lie in one symbol array. A round looks up the rank of every adjacent pair, takes the least rank of
each word (a segmented minimum), merges the leftmost non-overlapping pairs of that rank in all words
simultaneously, and compacts the array; a word without a mergeable pair leaves it. This gives what one merge
at a time in order of (rank, position) gives, as long as a merge cannot create a pair of a rank as low as its
own. The pieces for which it can are known from the table; a word about to make such a piece merges only its
leftmost pair in that round.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """Hashed lookup (left symbol, right symbol) -> (rank, merged symbol). Ranks may tie."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        keys, first = np.unique(keys, return_index=True)
        rank, merged = rank[first].astype(np.int32), merged[first].astype(np.int32)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, NONE)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):  # one more linear probe for the keys that found their slot taken
            slot = self._slot(keys[todo], self.probes)
            free = self.keys[slot] == np.uint64(2**64 - 1)
            slot, chosen = np.unique(slot[free], return_index=True)
            placed = todo[free][chosen]
            self.keys[slot], self.rank[slot], self.merged[slot] = keys[placed], rank[placed], merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            self.probes += 1
        self.unsafe = self._unsafe(left, right, rank=rank, merged=merged, keys=keys)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)

    @staticmethod
    def _unsafe(left, right, rank, merged, keys) -> np.ndarray:
        """Symbols that may take part, once made, in a pair ranked as low as the one that made them."""
        size = int(max(left.max(), right.max(), merged.max())) + 1
        made = np.full(size, -1, np.int64)
        np.maximum.at(made, merged, rank)
        used = np.full(size, np.int64(NONE))
        for side in ((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(2**32 - 1)).astype(np.int64)):
            np.minimum.at(used, side, rank)
        return (made >= 0) & (used <= made)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the pair does not merge) and merged symbol; negative symbols never merge."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot = self._slot(keys, 0)
        hit = self.keys[slot] == keys
        rank, merged = np.where(hit, self.rank[slot], NONE), np.where(hit, self.merged[slot], np.int32(-1))
        rest = np.flatnonzero(~hit & (self.keys[slot] != np.uint64(2**64 - 1)))
        for probe in range(1, self.probes):
            if not len(rest):
                break
            slot = self._slot(keys[rest], probe)
            same = self.keys[slot] == keys[rest]
            rank[rest[same]], merged[rest[same]] = self.rank[slot[same]], self.merged[slot[same]]
            rest = rest[~same & (self.keys[slot] != np.uint64(2**64 - 1))]
        return rank, merged


def merge_words(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word until no pair remains; returns the flat symbols and the new word lengths.

    ``symbols`` holds the words one after the other, ``lengths`` their sizes (zero is allowed).
    """
    total = len(lengths)
    done_words, done_symbols = [], []
    words = np.repeat(np.arange(total, dtype=np.int32), lengths)
    sym = symbols.astype(np.int32)
    rank, new = _pairs(table, sym, words, np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        sizes = np.diff(np.r_[starts, len(words)])
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        over = least == NONE
        if over.any():
            done_words.append(words[over])
            done_symbols.append(sym[over])
            keep = ~over
            sym, words, rank, new, least = sym[keep], words[keep], rank[keep], new[keep], least[keep]
            if not len(sym):
                break
        at = np.flatnonzero(rank == least)
        # leftmost non-overlapping: every other one of a run of adjacent candidates
        fresh = np.r_[True, (at[1:] != at[:-1] + 1)]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        chosen = (np.arange(len(at)) - run) % 2 == 0
        first = np.r_[True, words[at[1:]] != words[at[:-1]]]
        alone = np.zeros(len(at), bool)
        risky = table.unsafe[new[at]]
        if risky.any():
            group = np.cumsum(first) - 1
            alone = np.maximum.reduceat(risky, np.flatnonzero(first))[group]
        at = at[np.where(alone, first, chosen)]
        sym[at] = new[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))  # every earlier merge removed one symbol
        sym, words, rank, new = sym[keep], words[keep], rank[keep], new[keep]
        touched = np.zeros(len(sym) + 1, bool)
        touched[moved] = touched[moved - 1] = True  # position -1 is the spare last one
        stale = np.flatnonzero(touched[:-1])
        rank[stale], new[stale] = _pairs(table, sym, words, stale)
    if not done_words:
        return np.empty(0, np.int32), np.zeros(total, np.int64)
    words, sym = np.concatenate(done_words), np.concatenate(done_symbols)
    return sym[np.argsort(words, kind="stable")], np.bincount(words, minlength=total)


def _pairs(table: PairTable, sym: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of the pairs that start at the given positions."""
    rank, new = np.full(len(at), NONE), np.full(len(at), -1, np.int32)
    inner = np.flatnonzero(at + 1 < len(sym))
    inner = inner[words[at[inner]] == words[at[inner] + 1]]
    if len(inner):
        rank[inner], new[inner] = table.find(sym[at[inner]], sym[at[inner] + 1])
    return rank, new
