"""An FM-index of a sequence of numbers, in numpy: all phrases are searched in step.

The sequence holds words as 1, 2, ... and 0 between stretches that no phrase crosses.
Only the index's own parts answer a search: the wavelet matrix of the Burrows-Wheeler
transform with rank counters, the counts of smaller symbols, and sampled positions.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with rank in O(1)."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[Bits, int, int]] = []
        for level in reversed(range(max(int(top).bit_length(), 1))):
            bit = ((symbols >> level) & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum()), level))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = self.down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bits, zeros, level in self.levels:
            one = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol comes before place i."""
        return self.down(symbol, i) - self.begin[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each comes before its place."""
        symbol = np.zeros(len(i), np.int64)
        for bits, zeros, _ in self.levels:
            bit, one = bits.at(i), bits.rank(i)
            symbol = symbol * 2 + bit
            i = np.where(bit == 1, zeros + one, i - one)
        return symbol, i - self.begin[symbol]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By prefix doubling.  Each 0 counts as a symbol of its own, less than all words and in order of place."""
    n = len(sequence)
    zero = sequence == 0
    rank = np.where(zero, np.cumsum(zero), sequence.astype(np.int64) + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        sorted_ = rank[order]
        new = np.ones(n, bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        if width > 1:
            second = np.where(order + width // 2 < n, rank[np.minimum(order + width // 2, n - 1)], 0)
            new[1:] |= second[1:] != second[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = head + 1
        # Only places of groups of two or more are sorted again, by what follows `width` on.
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(tied):
            return order
        rows = order[tied]
        follow = np.where(rows + width < n, rank[np.minimum(rows + width, n - 1)], 0)
        order[tied] = rows[np.lexsort((follow, rank[rows]))]
        width *= 2


class FMIndex:
    def __init__(self, sequence: np.ndarray, top: int):
        """sequence ends with 0; its numbers are at most `top`."""
        order = suffix_array(sequence)
        before = sequence[order - 1]
        self.matrix = WaveletMatrix(before.astype(np.int64), top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top + 1))])[:-1]
        # The first word of a stretch is sampled too: steps back never cross a 0.
        marked = (order % SAMPLE == 0) | (before == 0)
        self.marked, self.samples = Bits(marked), order[marked]
        self.size = len(sequence)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of places of the suffixes that begin with each phrase (rows, left-aligned)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.smaller[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes at these places."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        live = np.flatnonzero(self.marked.at(rows) == 0)
        while len(live):
            symbol, before = self.matrix.access(rows[live])
            rows[live] = self.smaller[symbol] + before
            steps[live] += 1
            live = live[self.marked.at(rows[live]) == 0]
        return self.samples[self.marked.rank(rows)] + steps
