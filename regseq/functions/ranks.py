"""Bits of whole sequences in 64-bit words: counts of any stretch, and matches along diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a block of diagonals, and candidates, that are worked on at once.
WORDS = 1 << 17
CANDIDATES = 1 << 16


def _words(bits: np.ndarray, extra: int = 0) -> np.ndarray:
    """Bits packed from the low end of 64-bit words, with `extra` words of zeros behind."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8 + 8 * extra, np.uint8)]).view(np.uint64)


class Ranks:
    """How many positions before any place are marked: a running count every 64 places and the words between."""

    def __init__(self, marked: np.ndarray) -> None:
        self.words = _words(marked, 1)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


def letters(seq: str | None) -> np.ndarray:
    return np.frombuffer((seq or "").encode("ascii", "replace"), np.uint8)


def hidden(seq: np.ndarray) -> Ranks:
    """Ranks of the bases that are N."""
    return Ranks((seq == ord("N")) | (seq == ord("n")))


class Shares:
    """Percentage of a stretch's bases that only the masked text hides, by two lookups in each text."""

    def __init__(self, masked: str | None, seq: str | None) -> None:
        m, u = letters(masked), letters(seq)
        self.masked, self.seq, self.known = hidden(m), hidden(u), min(len(m), len(u)) if masked is not None else 0

    def __call__(self, lo: np.ndarray, width: int) -> np.ndarray:
        """Of the stretches [lo, lo + width); 0 where the masked text is unknown or has ended."""
        inside = lo + width <= self.known
        at = np.where(inside, lo, 0)
        end = np.where(inside, lo + width, 0)
        return 100.0 * (self.masked(end) - self.masked(at) - self.seq(end) + self.seq(at)) / width


def window_matches(x: np.ndarray, y: np.ndarray, width: int, cutoff: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts in x, starts in y, equal bases) of every two windows with at least `cutoff` equal bases; N equals nothing.

    For each base a sequence is one mask, so a shifted AND compares 64 bases of a diagonal at
    once.  Popcounts of its words, and of the bytes of those words that pass, bound every window
    from above; only the windows that begin in a byte whose bound reaches the cutoff are scored
    base by base.  Where most bytes pass, whole words are scored, which costs less a window.
    """
    n, m = len(x), len(y)
    if min(n, m) < width:
        return
    shared = [c for c in np.intersect1d(x, y).tolist() if c != ord("N")]
    many = -(-n // 64)
    span, wide = (width + 6) // 8 + 1, (width + 62) // 64 + 1
    # Differences of running counts are right modulo 256 up to a width of 255.
    kind = np.uint8 if width < 256 else np.uint32
    # y begins behind n zeros, so that every diagonal is a shift to the right.
    lead = 64 * many
    planes = [(_words(x == c), _words(np.concatenate([np.zeros(lead, bool), y == c]), many + 2)) for c in shared]
    diagonals = np.arange(width - n, m - width + 1)
    step = max(1, WORDS // many)
    for first in range(0, len(diagonals), step):
        d = diagonals[first : first + step]
        word, bit = (lead + d) >> 6, ((lead + d) & 63).astype(np.uint64)[:, None]
        at = word[:, None] + np.arange(many)
        same = np.zeros((len(d), many), np.uint64)
        up = (np.uint64(64) - bit) & np.uint64(63)
        for a, b in planes:
            # At a shift of 0 the next word has no part; its shift would be by 64.
            same |= a & (b[at] >> bit | np.where(bit > 0, b[at + 1] << up, np.uint64(0)))
        # Windows may begin where both sequences still have room for them.
        low, high = np.maximum(0, -d), np.minimum(n, m - d) - width
        count = np.zeros((len(d), many + wide - 1), np.uint16)
        count[:, :many] = np.bitwise_count(same)
        bound = count[:, :many].copy()
        for k in range(1, wide):
            bound += count[:, k : k + many]
        begin = 64 * np.arange(many)
        row, place = np.nonzero((bound >= cutoff) & (begin + 63 >= low[:, None]) & (begin <= high[:, None]))
        cells = np.zeros((len(d), 8 * (many + 1) + span), np.uint8)
        cells[:, : 8 * many] = same.view(np.uint8)
        unit = 8
        if len(row):
            near = cells[row[:, None], 8 * place[:, None] + np.arange(8 + span)]
            count = np.bitwise_count(near)
            bound = np.zeros((len(row), 8), np.uint16)
            for k in range(span):
                bound += count[:, k : k + 8]
            some, byte = np.nonzero(bound >= cutoff)
            if 4 * len(some) < 8 * len(row):
                row, place, unit = row[some], 8 * place[some] + byte, 1
            else:
                place = 8 * place
        for k in range(0, len(row), CANDIDATES // unit):
            r, p = row[k : k + CANDIDATES // unit], place[k : k + CANDIDATES // unit]
            bits = np.unpackbits(cells[r[:, None], p[:, None] + np.arange(unit - 1 + span)], axis=1, bitorder="little")
            sums = np.zeros((len(r), bits.shape[1] + 1), kind)
            np.cumsum(bits, axis=1, dtype=kind, out=sums[:, 1:])
            score = sums[:, width : width + 8 * unit] - sums[:, : 8 * unit]
            i = 8 * p[:, None] + np.arange(8 * unit)
            good = (score >= cutoff) & (i >= low[r][:, None]) & (i <= high[r][:, None])
            start = i[good]
            yield start, start + np.broadcast_to(d[r][:, None], good.shape)[good], score[good].astype(np.int32)
