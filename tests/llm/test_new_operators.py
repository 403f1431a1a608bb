"""Packing, divergence audit and resampling against plain versions, and on awkward tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regseq.llm import divergence, packing, resampling
from regseq.llm.bpe import public_path
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
EXTRA = ["piece", "length", "number", "bin", "rank", "value", "item", "part", "n", "z", "p", "score", "segment", "weight", "before", "lang_pred", "__range"]


def clashing(df):
    return df.select("*", *(F.lit("mine").alias(c) for c in EXTRA), F.create_map(F.lit("a"), F.lit(1)).alias("m"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)


# Packing.


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def plain_pieces(rows, tokenizer, capacity=2048):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            out.append((doc, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
    return sorted(out, key=str)


def check_packing(got, want, capacity):
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end = at + size
        assert end <= capacity
    return len(bins)


def test_packing(spark, docs, odd, tokenizer):
    path = public_path("byte_bpe_50k.json")
    for df in (docs, odd, clashing(odd), odd.limit(0)):
        got = packing.pack(df, path).collect()
        n = check_packing(got, plain_pieces([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], tokenizer), 2048)
        assert n <= -(-sum(r.length for r in got) // 2048) + 1


def test_packing_of_small_sequences(spark, odd, tokenizer):
    got = packing.pack(odd, public_path("byte_bpe_50k.json"), 7).collect()
    check_packing(got, plain_pieces(AWKWARD, tokenizer, 7), 7)


def test_tables_of_ranks_give_the_tokenizers_ids(tokenizer):
    r = random.Random(3)
    with open(public_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        bpe = packing.ByteBpe(f.read())
    letters = "aAbé漢😀 ' \t\n\r\x0b\x85  　\x00.,!?-_0159½²٣'s'll'LL<|endoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(2000)]
    texts += ["x<|endoftext|> y", "<|endoftext|>" * 3, " " * 5000 + "x", "\n" * 999, "a" * 5000, "é" * 3000, "'s" * 900, "1" * 3001]
    for t in texts:
        assert bpe.ids(t) == tokenizer.encode(t, add_special_tokens=False).ids
    wide = " " * 2_000_000 + "x"  # beyond the fast matcher's stack
    with pytest.raises(ValueError):
        bpe.fast.encode(wide)
    assert bpe.ids(wide) == tokenizer.encode(wide, add_special_tokens=False).ids


def test_fullest_combination():
    r = random.Random(7)
    for _ in range(300):
        room = r.randrange(1, 30)
        counts = {r.randrange(1, 20): r.randrange(1, 5) for _ in range(r.randrange(1, 5))}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        got = packing.fullest(counts, room)
        assert all(0 < n <= counts[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    r = random.Random(8)
    for _ in range(100):
        counts = {r.randrange(1, 64): r.randrange(1, 150) for _ in range(r.randrange(1, 20))}
        uses = packing.plan(counts, 64)
        used = collections.Counter()
        filled = collections.Counter()
        for u in sorted(uses, key=lambda u: (u.length, u.first)):
            assert u.first == used[u.length]
            used[u.length] += u.each * u.times
            filled[u.bin, u.times] += u.each * u.length
        assert used == counts and max(filled.values()) <= 64
        bins = sum(t for _, t in filled)
        # Few lengths leave little to combine: at most a twentieth more bins than first-fit decreasing.
        free = []
        for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            i = next((i for i, f in enumerate(free) if f >= k), None)
            if i is None:
                free.append(64 - k)
            else:
                free[i] -= k
        assert bins <= 1.05 * len(free) + 1


# Divergence audit.


def plain_audit(rows, least=30, top=50):
    groups, docs, count = set(), collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(brute.LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    price = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    out = []
    for lang, source in groups:
        v = len(kept[lang])
        p = {}
        for l, s in groups:
            if l == lang:
                total = sum(count[l, s, t] for t in kept[l])
                p[s] = {t: price(count[l, s, t], total, v) for t in kept[l]}
        whole = {t: sum(count[lang, s, t] for s in p) for t in kept[lang]}
        q = {t: price(n, sum(whole.values()), v) for t, n in whole.items()}
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept[lang])) for s in p if s != source]
        terms = [(t, p[source][t] - q[t]) for t in kept[lang] if count[lang, source, t] and p[source][t] > q[t]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def audited(df, **more):
    return sorted(tuple(r) for r in divergence.audit(df, **more).collect())


def test_audit_of_the_documents(docs):
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows)


@pytest.mark.parametrize("cells", [1, 40, 1 << 18])
def test_audit_in_small_blocks_and_odd(spark, cells, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "HOLD", cells)
    r = random.Random(11)
    words = ["a", "b", "Ä", "ä", "c", "d1e", "É", "漢", "long" * 3000]
    rows = [(r.choice(["x", "y", None, "z"]), r.choice(["s1", "s2", "S3", None, "", "ü"]), r.choice([None, "", "12 !", " ".join(r.choices(words, k=r.randrange(1, 9)))])) for _ in range(150)]
    rows += [("only", "s", None), ("only", "t", "rare"), ("one", "s", "a b")] + rows[:20]
    df = clashing(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5))
    assert audited(df, least=3, top=4) == plain_audit(rows, 3, 4)
    assert audited(df.limit(0)) == []


def test_prices_are_exact_beyond_64_bits(spark):
    rows = [(10**18, 10**18 + 7), (5, 5 * 10**17), (10**17 + 3, 3 * 10**17), (5, 5)]
    got = spark.createDataFrame(rows, "n long, t long").select(divergence._price("n", "t")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * n // t for n, t in rows]


# Resampling.


def plain_resample(rows, target, percent=10, least=20, buckets=10_000, seed=2024):
    feats = lambda t: [zlib.crc32(w.encode()) % buckets for w in brute.alnum_words(t)]
    s = collections.Counter(f for _, t in rows for f in feats(t))
    b = collections.Counter(f for t in target for f in feats(t))
    ns, nt = sum(s.values()) + buckets, sum(b.values()) + buckets
    gain = lambda f: math.floor(1000 * math.log((b[f] + 1.0) * ns / ((s[f] + 1.0) * nt)))
    out = []
    for doc, text in rows:
        f = feats(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ready = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(ready[: percent * len(ready) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def resampled(df, target, **more):
    return sorted((tuple(r) for r in resampling.resample(df, target, **more).collect()), key=str)


def test_resampling(spark, docs, odd):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in target.collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert resampled(docs, target) == plain_resample(rows, items)
    assert resampled(clashing(odd), target, least=1, percent=60) == plain_resample(AWKWARD, items, 60, 1)
    assert resampled(odd, target.limit(0), least=1, percent=100) == plain_resample(AWKWARD, [], 100, 1)
    assert resampled(odd.limit(0), target) == []


def test_runs_of_words():
    assert resampling.Buckets(1000).of(b"The cat, the CAT!", 2)[1].tolist() == [zlib.crc32(x) % 1000 for x in (b"the", b"cat", b"the", b"cat", b"the cat", b"cat the", b"the cat")]


@pytest.mark.parametrize("segments", [1, 7, 64])
def test_ranks_by_regular_sampling(spark, segments, monkeypatch):
    monkeypatch.setattr(resampling, "RUN", 300)
    r = random.Random(4)
    rows = [(None if r.random() < 0.05 else r.randrange(4000), r.choice([0, 0, 5, r.randrange(-(10**9), 10**9)])) for _ in range(5000)]
    got = resampling.ranked_scores(spark.createDataFrame(rows, "doc_id long, score long").repartition(6), segments).collect()
    ordered = sorted(got, key=lambda x: x["rank"])
    assert [x["rank"] for x in ordered] == list(range(1, 5001))
    assert [(x.score, x.doc_id) for x in ordered] == [(s, d) for d, s in sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0))]


def test_splitters_cut_into_equal_shares():
    keys = np.stack([np.arange(1000), np.zeros(1000, int), np.full(1000, 5)], axis=1)
    cuts = resampling.splitters(np.random.default_rng(0).permutation(keys), 10)
    assert len(cuts) == 9 and set(np.diff(cuts[:, 0])) == {100}


def test_many_lengths_leave_no_slack():
    r = random.Random(9)
    counts = collections.Counter(min(2048, int(r.lognormvariate(6, 1)) + 1) for _ in range(100_000))
    bins = max(u.bin + u.times for u in packing.plan(counts))
    assert bins == -(-sum(k * n for k, n in counts.items()) // 2048)
