"""Deep-shallow sorting of suffixes, vectorised over all groups of a block at once.

Shallow: a multikey quicksort that takes eight bytes as one character splits the suffixes
by their first SHALLOW bytes; only groups still tied are touched at the next character.
Deep: each group left is ordered by a blind trie.  The trie of a group is built along its
first suffix: the branch point of every other suffix is its common prefix with the first,
and the byte there names the branch.  Suffixes of one branch are again a group, until none
has two members.  Nothing but branch points and branching bytes is kept of the trie.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def big_endian_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(data)]
    return out


def _regroup(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key), and where a new (group, key) begins in it."""
    order = np.lexsort((key, group))
    new = np.ones(len(order), bool)
    g, k = group[order], key[order]
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def _first_byte(x: np.ndarray) -> np.ndarray:
    """Index, from the left, of the first nonzero byte of nonzero words."""
    at = np.zeros(len(x), np.int64)
    for width in (32, 16, 8):
        low = x < (np.uint64(1) << np.uint64(64 - width))
        at += np.where(low, width // 8, 0)
        x = np.where(low, x << np.uint64(width), x)
    return at


def suffix_order(data: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes at `starts` by their first `limit` bytes (a multiple of 8 that all of them have).

    Returns the suffix order, as indices of starts, and for each place of it whether its
    suffix shares `limit` bytes with the one before.
    """
    n = len(starts)
    words = big_endian_words(data)
    order = np.arange(n)
    # head[i]: place i of the order begins a new group; tied[i]: place i shares `limit` bytes with place i - 1.
    head = np.ones(n, bool)
    head[1:] = False
    tied = np.zeros(n, bool)

    def ties(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these ascending places, whole groups, those of groups of two or more; their groups' numbers."""
        if not len(places):
            return places, places
        group = np.cumsum(head[places]) - 1
        keep = np.bincount(group)[group] > 1
        return places[keep], group[keep]

    places, group = ties(np.arange(n))
    for depth in range(0, min(SHALLOW, limit), 8):
        if not len(places):
            break
        rows = order[places]
        to, new = _regroup(group, words[starts[rows] + depth])
        order[places] = rows[to]
        head[places] |= new
        places, group = ties(places)
    known = np.full(n, min(SHALLOW, limit) // 8)  # words that a row shares with its group
    while len(places):
        rows = order[places]
        firsts = places[head[places]]
        leader = order[firsts][np.cumsum(head[places]) - 1]
        is_leader = leader == rows
        word = known[rows].copy()
        lcp = np.full(len(rows), limit)
        byte = np.zeros(len(rows), np.int64)
        side = np.ones(len(rows), np.int64)  # 0: before the leader, 1: the same, 2: behind
        live = np.flatnonzero(~is_leader & (word * 8 < limit))
        while len(live):
            a, b = words[starts[leader[live]] + 8 * word[live]], words[starts[rows[live]] + 8 * word[live]]
            out = np.flatnonzero(a != b)
            hit = live[out]
            at = _first_byte(a[out] ^ b[out])
            lcp[hit] = 8 * word[hit] + at
            byte[hit] = (b[out] >> (56 - 8 * at).astype(np.uint64)).astype(np.int64) & 255
            side[hit] = np.where(b[out] < a[out], 0, 2)
            live = live[a == b]
            word[live] += 1
            live = live[word[live] * 8 < limit]
        # An earlier branch below the leader sorts first, an earlier branch above it last.
        key = (side << 24) | (np.where(side == 0, lcp, np.where(side == 2, limit - lcp, 0)) << 8) | byte
        to, new = _regroup(group, key)
        order[places] = rows[to]
        head[places] |= new
        same = side[to] == 1
        tied[places] |= same & ~new
        known[rows] = np.minimum(lcp, limit) // 8
        places, group = ties(places[~same])
    return order, tied


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix: do `limit` bytes from its start on also start at another of the suffixes."""
    order, tied = suffix_order(data, starts, limit)
    out = np.zeros(len(starts), bool)
    out[order[tied]] = True
    out[order[:-1][tied[1:]]] = True
    return out
