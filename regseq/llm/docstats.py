"""Statistics of whole texts, computed for a slice of documents at once."""

from __future__ import annotations

import numpy as np

from regseq.llm import textbytes as tb

#: The characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
PUNCT = np.zeros(256, bool)
PUNCT[0x21:0x7F] = True
PUNCT &= ~tb.ALNUM
NOT_LINE_END = np.ones(256, bool)
NOT_LINE_END[0x0A] = False
FIRST_BYTE = np.ones(256, bool)
FIRST_BYTE[0x80:0xC0] = False

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Model features: shares and means, so that they mean the same for short and long texts.
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "punct_share", "wide_share", "line_words", "stop_share", "short_word_share", "long_word_share", "log_chars")


def repeated(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more in its document; is it equal to an earlier one of its document."""
    n = len(keys)
    twice, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        both = tb.mix(keys + doc.astype(np.uint64) * np.uint64(tb.BASE))
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        later[order[1:]] = same
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
    return twice, later


def doc_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of COUNTS (int64) and the FEATURES (float64) of each document."""
    n = len(offsets) - 1

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return tb.sums_by(mask, offsets)

    starts, ends = tb.spans(data, offsets, tb.NOT_SPACE)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    doc = tb.doc_of(first)
    sums = tb.prefix(data)
    hashes = tb.ranges(sums, starts, ends)
    in_word = tb.NOT_SPACE[data]
    heads = FIRST_BYTE[data]

    keys, at = tb.shingles(hashes, first, 3)
    whole = words[doc[at]] >= 3
    keys, at = keys[whole], at[whole]
    twice, _ = repeated(doc[at], keys)
    cover = np.zeros(len(hashes) + 3, np.int8)
    for k in range(3):
        cover[at[twice] + k] = 1
    _, seen = repeated(doc, hashes)

    # Lines: maximal stretches without \n that hold a word.
    ls, le = tb.spans(data, offsets, NOT_LINE_END)
    held = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[held], le[held]
    lfirst = np.searchsorted(ls, offsets)
    lines = np.diff(lfirst)
    _, dup = repeated(tb.doc_of(lfirst), tb.ranges(sums, ls, le))

    length = ends - starts
    out = {
        "n_words": words,
        "word_chars": per_doc(in_word & heads),
        "n_symbols": per_doc(SYMBOLS[data]),
        "n_dup_lines": tb.sums_by(dup, lfirst),
        "n_repeat_words": tb.sums_by(cover[: len(hashes)], first),
    }
    some, chars, nlines = np.maximum(words, 1), np.maximum(out["word_chars"], 1), np.maximum(lines, 1)
    out |= {
        "log_words": np.log1p(words),
        "mean_word": out["word_chars"] / some,
        "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / nlines,
        "repeat_share": out["n_repeat_words"] / some,
        "distinct_share": (words - tb.sums_by(seen, first)) / some,
        "upper_share": per_doc(UPPER[data]) / chars,
        "digit_share": per_doc(DIGIT[data]) / chars,
        "punct_share": per_doc(PUNCT[data]) / chars,
        "wide_share": per_doc(data >= 0x80) / chars,
        "line_words": words / nlines,
        "stop_share": tb.sums_by(STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool), first) / some,
        "short_word_share": tb.sums_by(length <= 2, first) / some,
        "long_word_share": tb.sums_by(length >= 12, first) / some,
        "log_chars": np.log1p(np.diff(offsets)),
    }
    assert all(len(v) == n for v in out.values())
    return out


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.column_stack([stats[k].astype(np.float64) for k in FEATURES])
