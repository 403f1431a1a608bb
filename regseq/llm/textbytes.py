"""Vectorised work on the bytes of whole texts, used by the operators' Arrow tasks.

A task never loops over characters in Python.  It takes an Arrow batch, cuts it into
slices of a few megabytes of text (a longer text is a slice of its own), and works on
the slice's UTF-8 bytes as one numpy array with the documents' offsets beside it.
Everything here handles null texts as empty ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Powers of the base are worked out in multiples of so many.
POWERS = 1 << 18
_C = ctypes.CDLL(None)

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)

#: ASCII white space: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Digits, ASCII letters of either case, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit value for each byte, and the same with A-Z lower-cased.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
BYTE_LOWER = BYTE[LOWER]

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INVERSE)):
            a = np.full(-(-n // POWERS) * POWERS, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


class Slice(NamedTuple):
    """Rows of a batch, their text bytes end to end, and where each text starts."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and int64 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Hands memory that is free but kept back to the system: workers idle between tasks beside others that run."""
    _powers[:] = [a[:1].copy() for a in _powers]
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts batches into slices of at most `most` bytes of text, but of a row at least."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield Slice(batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that `inside` (bool[256]) holds, none across documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    edge = np.zeros(len(on) + 1, bool)
    edge[1:-1] = on[1:] != on[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = on[starts]
    return starts[keep], ends[keep]


def prefix(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Running polynomial sums, from which ranges() takes the hash of any range in O(1)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    return ranges(prefix(data, table), starts, ends)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows and the index of each one's first word.

    first: index of each document's first word, and the number of words last.  A document
    of fewer words, but not none, is one window; windows never cross documents.
    """
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.diff(first)
    acc = np.zeros(total, np.uint64)
    doc_end = np.repeat(first[1:], lengths)
    at = np.arange(total)
    for k in range(n):
        there = at + k < doc_end
        src = np.minimum(at + k, total - 1)
        acc = acc * np.uint64(BASE) + np.where(there, words[src], np.uint64(0))
    keep = at + n <= doc_end
    short = (lengths > 0) & (lengths < n)
    keep[first[:-1][short]] = True
    at = np.flatnonzero(keep)
    return mix(acc[at]), at


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each of the items whose bounds are `first`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by(values: np.ndarray, first: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i."""
    run = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=run[1:], dtype=dtype)
    return run[first[1:]] - run[first[:-1]]


def with_columns(batch: pa.RecordBatch, more: dict[str, object]) -> pa.RecordBatch:
    """The batch with columns put in place of those of the same names, or behind."""
    names, columns = list(batch.schema.names), list(batch.columns)
    for k, v in more.items():
        v = v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v)
        if k in names:
            columns[names.index(k)] = v
        else:
            names.append(k)
            columns.append(v)
    return pa.RecordBatch.from_arrays(columns, names=names)
