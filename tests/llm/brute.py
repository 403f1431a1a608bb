"""Plain versions of the text operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def shingles(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(rows, n, percent=80):
    """(doc_id, n_shingles, component_id, kept) for each (doc_id, text)."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        least = min((x for x in groups[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), least, d == least))
    return out


def repeats(rows, length=200):
    """(doc_id, n_bytes, n_removed, n_spans, sha256, kept bytes)."""
    bodies = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def contamination(rows, items, window=10):
    """(doc_id, n_words, n_hit, item ids, hit word indices)."""
    table = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        if i is not None:
            for k in range(max(len(w) - window + 1, 1 if w else 0)):
                table[tuple(w[k : k + window])].add(str(i))
    sizes = {len(k) for k in table}
    out = []
    for d, t in rows:
        w = alnum_words(t)
        hit, ids = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := table.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((d, len(w), len(hit), sorted(ids), sorted(hit)))
    return out


def without_hits(text, items, window=10):
    """text without the stretches from the first to the last word of each run of hit words."""
    hit = contamination([(0, text)], items, window)[0][4]
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))]
    out, done = [], 0
    for i in hit:
        if i - 1 not in hit:
            out.append(text[done : at[i][0]])
        if i + 1 not in hit:
            done = at[i][1]
    return "".join(out) + text[done:] if text is not None else None


def quality_counts(text):
    w = words(text, lower=False)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def base_scores(rows):
    tok = lambda t: [*words(t), None]
    c = collections.Counter(x for d, t in rows if fold(d, 7) != 2 for x in tok(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(t))) for d, t in rows}
