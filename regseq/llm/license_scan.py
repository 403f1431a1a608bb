"""Licence scans: Dice coefficient over word bigrams between normalised text and templates.

Each line of a text, and the text as a whole, is held against the templates.  Only templates
whose size a match allows (2 min(a, b) / (a + b) is the most the coefficient can be) are
compared; most lines have none.

Notices that are wrapped over lines or stand inside a longer line are passages: for each template
every window of as many words as it has, at any place of the whole text.  A window of m words has
a match only if enough of its bigrams are the template's, which a running sum tells for all
windows at once; only the few that are left are compared.  Of windows that overlap, the best one
is a passage: that of the highest coefficient, then of the longest template, then the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import out_schema, shuffle_free_map

#: Notices that licences are granted with, and texts of short licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
#: A match has at least this coefficient, in hundredths.
PERCENT = 85

WORD = tb.ALNUM.copy()
WORD[0x80:] = False
NOT_LINE_END = np.ones(256, bool)
NOT_LINE_END[0x0A] = False

_COLUMNS = [("n_matches", T.LongType()), ("n_passages", T.LongType()), ("licenses", T.StringType()), ("best_percent", T.DoubleType())]


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words next to each other in a text, and the index of the first; the words' starts."""
    starts, ends = tb.spans(data, offsets, WORD)
    words = tb.word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    keys, at = tb.shingles(words, first, 2)
    pair = np.diff(first)[tb.doc_of(first)[at]] >= 2 if len(at) else np.zeros(0, bool)
    return keys[pair], starts[at[pair]]


def _distinct(segment: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, segment))
    segment, keys = segment[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (keys[1:] != keys[:-1])
    return segment[new], keys[new]


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in table, which is ascending and not empty."""
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        data, offsets = tb.text_bytes(pa.array([t for _, t in templates], pa.string()))
        keys, start = bigrams(data, offsets)
        owner, keys = _distinct(np.searchsorted(offsets, start, "right") - 1, keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.sizes = np.bincount(owner, minlength=len(templates))
        self.names = [n for n, _ in templates]
        starts, _ = tb.spans(data, offsets, WORD)
        self.words = np.diff(np.searchsorted(starts, offsets))
        self.pairs = [self.keys[self.owner == t] for t in range(len(templates))]

    def matches(self, segments: int, segment: np.ndarray, keys: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, template, coefficient in hundredths) of each matching segment's best template, the first of equals; keys are the segments' distinct bigrams."""
        size = np.bincount(segment, minlength=segments)
        # Size bounds: 100 * 2 * min >= percent * (a + b) for some template.
        a, b = size[:, None], self.sizes[None, :]
        fits = (200 * np.minimum(a, b) >= percent * (a + b)) & (a > 0)
        keep = fits.any(axis=1)[segment]
        segment, keys = segment[keep], keys[keep]
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = hi - lo
        owner = self.owner[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))] if len(count) else lo
        both, shared = np.unique(np.repeat(segment, count) * len(self.sizes) + owner, return_counts=True)
        seg, tpl = both // len(self.sizes), both % len(self.sizes)
        good = fits[seg, tpl] & (200 * shared >= percent * (size[seg] + self.sizes[tpl]))
        seg, tpl = seg[good], tpl[good]
        value = 200 * shared[good] / (size[seg] + self.sizes[tpl])
        order = np.lexsort((tpl, -value, seg))
        best = order[np.flatnonzero(np.diff(seg[order], prepend=-1))]
        return seg[best], tpl[best], value[best]


    def passages(self, words: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, template, coefficient in hundredths) of the passages; words: hashes, first: the documents' bounds."""
        total = len(words)
        pairs = tb.mix(words[:-1] * np.uint64(tb.BASE) + words[1:]) if total > 1 else np.zeros(0, np.uint64)
        doc_end = np.repeat(first[1:], np.diff(first))
        got: list[tuple[np.ndarray, ...]] = []
        for t, (size, m) in enumerate(zip(self.sizes.tolist(), self.words.tolist(), strict=True)):
            if m < 2 or total < m:
                continue
            own = self.pairs[t]
            on = _isin(pairs, own)
            run = np.concatenate([[0], np.cumsum(on)])
            # With s shared of at most s + (others) distinct bigrams, 200 s >= percent (a + size) and a >= s.
            need = percent * size / (200 - percent)
            at = np.flatnonzero((run[m - 1 :] - run[: total - m + 1] >= need) & (np.arange(total - m + 1) + m <= doc_end[: total - m + 1]))
            for part in np.array_split(at, len(at) * m // (1 << 20) + 1):
                inside = np.sort(pairs[part[:, None] + np.arange(m - 1)], axis=1)
                new = np.ones(inside.shape, bool)
                new[:, 1:] = inside[:, 1:] != inside[:, :-1]
                a, shared = new.sum(axis=1), (new & _isin(inside, own)).sum(axis=1)
                good = 200 * shared >= percent * (a + size)
                got.append((part[good], np.full(good.sum(), t), 200 * shared[good] / (a[good] + size)))
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, tpl, value = (np.concatenate(x) for x in zip(*got, strict=True))
        return self._best(at, tpl, value, first)

    def _best(self, at: np.ndarray, tpl: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows that no better one overlaps.  Ranks give the order; sparse minima over powers of two give the best rank of a stretch."""
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((tpl, at, -self.words[tpl], -value))] = np.arange(len(at))
        keep = np.ones(len(at), bool)
        for t in np.unique(tpl).tolist():
            mine = np.flatnonzero(tpl == t)
            order = mine[np.argsort(at[mine])]
            table = [rank[order]]
            while 2 << len(table) - 1 <= len(order):
                half = 1 << len(table) - 1
                table.append(np.minimum(table[-1][:-half], table[-1][half:]))
            # Windows of t from lo to hi - 1 overlap window i.
            lo = np.searchsorted(at[order], at - self.words[t], "right")
            hi = np.searchsorted(at[order], at + self.words[tpl], "left")
            some = np.flatnonzero(hi > lo)
            level = np.frexp((hi - lo)[some])[1] - 1
            for k in np.unique(level).tolist():
                i = some[level == k]
                best = np.minimum(table[k][lo[i]], table[k][hi[i] - (1 << k)])
                keep[i] &= best >= rank[i]
        at, tpl, value = at[keep], tpl[keep], value[keep]
        return np.searchsorted(first, at, "right") - 1, tpl, value


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """docs with n_matches (lines, or the whole text of several lines, that match), n_passages, licenses (names, ascending,
    comma-joined; empty if none) and best_percent (null if none).

    Text is normalised to lower-case runs of ASCII letters and digits.  A line of fewer than two
    words has no bigrams and matches nothing; so do null texts.  A line counts for
    the template that it matches best, the first of equals.  Rows keep their number; columns with the results' names are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for s in tb.slices(batches):
            n = len(s.offsets) - 1
            lines, stops = tb.spans(s.data, s.offsets, NOT_LINE_END)
            line_doc = np.searchsorted(s.offsets, lines, "right") - 1
            bounds = np.append(lines, len(s.data))
            keys, start = bigrams(s.data, bounds) if len(lines) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            seg, tpl, value = known.matches(len(lines), *_distinct(np.searchsorted(lines, start, "right") - 1, keys), percent)
            doc = line_doc[seg]
            many = np.bincount(line_doc, minlength=n) > 1
            keys, start = bigrams(s.data, s.offsets)
            owner = np.searchsorted(s.offsets, start, "right") - 1
            keep = many[owner]
            wdoc, wtpl, wvalue = known.matches(n, *_distinct(owner[keep], keys[keep]), percent)
            hits = np.bincount(line_doc[np.unique(seg)], minlength=n) + np.bincount(np.unique(wdoc), minlength=n)
            starts, ends = tb.spans(s.data, s.offsets, WORD)
            pdoc, ptpl, pvalue = known.passages(tb.word_hashes(s.data, starts, ends), np.searchsorted(starts, s.offsets), percent)
            names: list[set[str]] = [set() for _ in range(n)]
            best = np.full(n, -1.0)
            for d, t, v in zip([*doc.tolist(), *wdoc.tolist(), *pdoc.tolist()], [*tpl.tolist(), *wtpl.tolist(), *ptpl.tolist()], [*value.tolist(), *wvalue.tolist(), *pvalue.tolist()], strict=True):
                names[d].add(known.names[t])
                best[d] = max(best[d], v)
            yield tb.with_columns(s.batch, {"n_matches": hits.astype(np.int64), "n_passages": np.bincount(pdoc, minlength=n).astype(np.int64), "licenses": pa.array([",".join(sorted(x)) for x in names], pa.string()), "best_percent": pa.array(np.round(best, 4), mask=best < 0)})

    return shuffle_free_map(docs, run, out_schema(docs, _COLUMNS))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    words = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT row_number() OVER () AS tid, name, len(w) AS m, {pairs} AS tb FROM (SELECT name, {words.format("body")} AS w FROM (VALUES {rows}) v(name, body))),
parts AS (
  SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS body, 1 AS kind FROM documents
  UNION ALL SELECT doc_id, text, 2 FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) > 1),
seg AS (SELECT row_number() OVER () AS sid, doc_id, {pairs} AS sb FROM (SELECT doc_id, {words.format("body")} AS w FROM parts)),
m AS (SELECT sid, doc_id, name, tid, 200.0 * len(list_intersect(sb, tb)) / (len(sb) + len(tb)) AS d FROM seg, t
      WHERE len(sb) > 0 AND 200 * least(len(sb), len(tb)) >= {PERCENT} * (len(sb) + len(tb)) AND 200 * len(list_intersect(sb, tb)) >= {PERCENT} * (len(sb) + len(tb))
      QUALIFY row_number() OVER (PARTITION BY sid ORDER BY d DESC, tid) = 1),
dw AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
db AS (SELECT doc_id, i, n, w1 || ' ' || w2 AS b FROM (SELECT doc_id, len(w) AS n, unnest(range(1, len(w))) AS i, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM dw)),
hit AS (SELECT doc_id, i, n, tid, m, size FROM db JOIN (SELECT tid, m, len(tb) AS size, unnest(tb) AS b FROM t) USING (b)),
win AS (SELECT doc_id, tid, p FROM (SELECT doc_id, tid, size, unnest(range(greatest(1, i - m + 2), least(i, n - m + 1) + 1)) AS p FROM hit)
        GROUP BY doc_id, tid, size, p HAVING (200 - {PERCENT}) * count(*) >= {PERCENT} * size),
wb AS (SELECT doc_id, tid, name, m, p, tb, list_distinct(list_transform(range(1, m), lambda i: v[i] || ' ' || v[i + 1])) AS sb
       FROM (SELECT win.*, name, m, tb, w[p:p + m - 1] AS v FROM win JOIN t USING (tid) JOIN dw USING (doc_id))),
pas AS MATERIALIZED (SELECT doc_id, tid, name, m, p, 200.0 * len(list_intersect(sb, tb)) / (len(sb) + len(tb)) AS d FROM wb
        WHERE 200 * len(list_intersect(sb, tb)) >= {PERCENT} * (len(sb) + len(tb))),
best AS (SELECT doc_id, name, d FROM pas x WHERE NOT EXISTS (
          SELECT 1 FROM pas y WHERE y.doc_id = x.doc_id AND y.p < x.p + x.m AND y.p + y.m > x.p
            AND (y.d > x.d OR y.d = x.d AND (y.m > x.m OR y.m = x.m AND (y.p < x.p OR y.p = x.p AND y.tid < x.tid))))),
found AS (SELECT doc_id, sid, 0 AS passage, name, d FROM m UNION ALL SELECT doc_id, NULL, 1, name, d FROM best),
g AS (SELECT doc_id, count(DISTINCT sid) AS n, sum(passage) AS np, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(d) AS best FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(np, 0)::BIGINT AS n_passages, coalesce(names, '') AS licenses, round(best, 4)::DOUBLE AS best_percent FROM documents d LEFT JOIN g USING (doc_id)
"""


ORACLE_SQL = _sql()
