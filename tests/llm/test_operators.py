"""Each text operator against its plain version, and on awkward tables."""

import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from regseq.llm import backoff_lm, bpe, components, decontaminate, docstats, factorization, fm_index, gbt, language_mixture, license_scan, minhash_forest, quality_rules, registry, sharding, suffix_dedup, suffixes
from regseq.llm import textbytes as tb
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

LONG = "lorem ipsum " * 30_000 + "x" * 50_000
#: Nulls, empty and very long texts, repeated rows and ties.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (None, "a b c d e f"), (None, None), (7, "a b c d e f"), (7, "a b c d e f"), (8, "Ünïcödé ½ ² \x85 漢字 😀 ́"), (9, "a\x00b\x7f c"), (10, "A B C D E F")]
RESULTS = ["n_words", "kept", "score", "hit_words", "hit_bytes", "item_ids", "n_bytes", "removed", "shard", "lang_pred", "n_tokens", "predicted", "licenses", "cls", "row"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def clash(odd):
    """The awkward table with columns named like results."""
    return odd.select("doc_id", "text", *(F.lit("mine").alias(c) for c in RESULTS))


def key(rows):
    return sorted(rows, key=str)


def test_stats_match(rows):
    for some in ([t for _, t in rows], [t for _, t in AWKWARD]):
        data, offsets = tb.text_bytes(__import__("pyarrow").array(some))
        got = docstats.doc_stats(data, offsets)
        assert list(zip(*(got[k].tolist() for k in docstats.COUNTS), strict=True)) == [brute.quality_counts(t) for t in some]


def test_quality_rules(spark, docs, odd, clash):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality_rules.train(docs, labels)
    found = quality_rules.quality_rules(docs, trees).join(labels, "doc_id")
    held = found.filter(language_mixture.fold(3) == 1).select(((F.col("quality_score") >= 0.5).cast("int") == F.col("quality")).alias("ok")).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert held > 0.95
    out = quality_rules.quality_rules(odd, trees).collect()
    assert len(out) == len(AWKWARD) and all(r.base_failed and not r.kept for r in out if r.doc_id != 5)
    assert quality_rules.quality_rules(clash, trees).columns.count("kept") == 1
    good = docs.join(found.filter("kept").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", *(F.lit("mine").alias(c) for c in RESULTS))
    left = quality_rules.filter_quality(good, labels)
    assert left.columns == good.columns and key(left.collect()) == key(good.collect()) and good.count()
    assert quality_rules.quality_rules(odd.limit(0), trees).count() == 0
    assert quality_rules.train(odd, labels.limit(0)).score(np.zeros((2, 15))).tolist() == [0.5, 0.5]


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] + 0.3 * rng.random(800) > 0.6) ^ (x[:, 1] > 0.9)).astype(float)
    trees = gbt.fit(x, y, np.array([1, 0, -1]), rounds=30)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85
    probe = np.repeat(rng.random((50, 3)), 20, axis=0)
    for column, sign in ((0, 1), (2, -1)):
        p = probe.copy()
        p[:, column] = np.tile(np.linspace(0, 1, 20), 50)
        assert (sign * np.diff(trees.logits(p).reshape(50, 20), axis=1) >= -1e-12).all()


def near_family(seed=3):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    out = []
    for g in range(12):
        base = [word() for _ in range(120)]
        for k in range(random.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(random.choice([0, 1, 3, 6])):
                copy[random.randrange(120)] = word()
            out.append((100 * g + k, " ".join(copy)))
    return out


def test_near_duplicates(spark, docs, rows, odd, clash):
    family = near_family()
    for frame, plain in ((docs, rows), (spark.createDataFrame(family, "doc_id long, text string"), family), (odd, AWKWARD), (clash, AWKWARD)):
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(frame, 4).collect()]
        assert key(got) == key(brute.near(plain, 4))
    assert minhash_forest.near_duplicates(odd.limit(0)).count() == 0
    left = minhash_forest.drop_near_duplicates(clash)
    assert left.columns == clash.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_only_rows_that_repeat_go(spark):
    x, y, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "xyz")
    rows = [(3, x, 1), (5, x, 2), (5, y, 3), (6, y, 4), (7, z, 5), (7, z, 6), (None, z, 7), (8, None, 8), (8, "", 9)]
    left = minhash_forest.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long"))
    got = sorted(r.kept for r in left.collect())
    assert got in ([1, 3, 5, 7, 8, 9], [1, 3, 6, 7, 8, 9]) and left.columns == ["doc_id", "text", "kept"]


def test_near_duplicates_in_large_regions(spark, monkeypatch):
    """Regions far larger than those compared at once: cuts, overlaps and the second step."""
    for name, value in (("FIRST_REGION", 4), ("HOLD", 64)):
        monkeypatch.setattr(minhash_forest, name, value)
    random.seed(1)
    base = [f"w{i}" for i in range(100)]
    plain = [(i, " ".join(f"z{random.random()}" if j in random_places else w for j, w in enumerate(base))) for i in range(60) for random_places in [set(random.sample(range(100), 2))]]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(spark.createDataFrame(plain, "doc_id long, text string"), 4).collect()]
    assert key(got) == key(brute.near(plain, 4))


def test_near_duplicates_across_all_cuts_of_a_large_region(spark, monkeypatch):
    """One source of pairwise similarity of about 0.6 and pairs just above 0.8, with regions cut to almost nothing."""
    for name, value in (("FIRST_REGION", 1), ("REGION", 1), ("NEIGHBOURS", 0), ("SHARERS", 20)):
        monkeypatch.setattr(minhash_forest, name, value)
    random.seed(2)
    new = lambda n: [f"z{random.random()}" for _ in range(n)]
    base, plain = [f"w{i}" for i in range(75)], []
    for i in range(80):
        own = new(25)
        plain += [(2 * i, " ".join(base + own)), (2 * i + 1, " ".join(base + own[:15] + new(10)))]
    want = brute.near(plain, 4)
    assert sum(k[3] for k in want) == 80
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(spark.createDataFrame(plain, "doc_id long, text string"), 4).collect()]
    assert key(got) == key(want)


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 26):
        data = rng.integers(97, 97 + letters, 3000).astype(np.uint8)
        data[500:900] = data[2000:2400]
        starts = np.arange(0, 3000 - 64)
        order, tied = suffixes.suffix_order(data, starts, 64)
        texts = [data[i : i + 64].tobytes() for i in starts[order]]
        assert texts == sorted(texts) and tied.tolist() == [False] + [a == b for a, b in zip(texts, texts[1:], strict=False)]


def repeat_texts():
    random.seed(5)
    parts = ["".join(random.choice("ab cdeé") for _ in range(random.choice([150, 199, 200, 201, 260, 700]))) for _ in range(12)]
    out = [(i, "".join(random.choice([random.choice(parts), "".join(random.choice("abcdefgh \n") for _ in range(random.randint(0, 300))), random.choice(parts)[random.randint(0, 100) :]]) for _ in range(random.randint(0, 6)))) for i in range(150)]
    return out + [(200, "a" * 650), (201, "ab" * 300), (3, out[3][1]), (3, out[3][1]), (None, out[4][1]), (202, None)]


@pytest.mark.parametrize("hot", [1 << 14, 8])
def test_suffix_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    plain = repeat_texts()
    got = suffix_dedup.remove_repeats(spark.createDataFrame(plain, "doc_id long, text string").repartition(3)).collect()
    want = brute.repeats(plain)
    assert key((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == key(w[:5] for w in want)
    assert key((r.doc_id, r.kept_text) for r in got) == key((w[0], w[5].decode("utf-8", "ignore")) for w in want)


def test_suffix_dedup_without_broadcast_and_odd(spark, docs, rows, odd, clash, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", -1)
    got = suffix_dedup.remove_repeats(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert key(map(tuple, got)) == key(w[:5] for w in brute.repeats(rows))
    monkeypatch.undo()
    short = [(d, t) for d, t in AWKWARD if d != 5]
    for frame in (odd, clash):
        got = suffix_dedup.remove_repeats(frame.filter("doc_id is null or doc_id <> 5")).collect()
        assert key((r.doc_id, r.n_bytes, r.n_removed) for r in got) == key(w[:3] for w in brute.repeats(short))
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0
    assert suffix_dedup.dedup_texts(clash).columns == clash.columns


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(10):
        seq = rng.integers(0, 5, 400)
        seq[-1] = 0
        index = fm_index.FMIndex(seq, 4)
        phrases, lengths = rng.integers(1, 5, (40, 4)), rng.integers(1, 5, 40)
        for p, n, a, b in zip(phrases, lengths, *index.search(phrases, lengths), strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(400) if seq[i : i + n].tolist() == p[:n].tolist()]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 40])
def test_decontamination(spark, docs, rows, odd, clash, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    small = [(1, "a b"), (2, "c D e"), (2, "one"), (None, "f"), (3, None), (4, "!"), (5, "漢字")]
    cases = [(odd, AWKWARD, spark.createDataFrame(small, "item_id long, text string"), small), (clash, AWKWARD, spark.createDataFrame(small, "item_id long, text string"), small), (odd, AWKWARD, bench.limit(0), [])]
    if block == decontaminate.BLOCK_BYTES:
        cases.append((docs, rows, bench, items))
    for frame, plain, table, listed in cases:
        got = decontaminate.contamination(frame, table, 10, block).collect()
        assert key((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.hit_words), r.item_ids) for r in got) == key(w[:4] for w in brute.contamination(plain, listed))
        cut = decontaminate.remove_contamination(frame, table)
        assert cut.columns == frame.columns
        assert key((r.doc_id, r.text) for r in cut.collect()) == key((d, brute.without_hits(t, listed)) for d, t in plain)


def test_bpe(spark, docs, rows, odd, clash):
    from tokenizers import Tokenizer

    path = bpe.public_path()
    model = Tokenizer.from_file(path)
    for frame, plain in ((docs, rows), (odd, AWKWARD), (clash, AWKWARD)):
        want = []
        for d, t in plain:
            ids = model.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert key((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame, path).collect()) == key(want)
    assert bpe.digests(odd.limit(0), path).count() == 0
    r = bpe.encode(spark.createDataFrame([(1, "Hello <|endoftext|>x, WORLD's")], "doc_id long, text string"), path).first()
    ids = model.encode("Hello <|endoftext|>x, WORLD's", add_special_tokens=False).ids
    assert (list(r.ids), r.decoded) == (ids, model.decode(ids, skip_special_tokens=False))


def test_bpe_new_words_in_portions(monkeypatch):
    """Words that a task meets first are worked out a bounded number at a time, with the same ids."""
    with open(bpe.public_path(), encoding="utf-8") as f:
        own = bpe.WordBpe(json.load(f))
    text = " ".join(f"w{i}x" for i in range(2 * bpe.WORDS + 5)).encode()
    seen, whole = [], own.encode_words
    want = [i for ids in whole(text.split()) for i in ids]
    monkeypatch.setattr(own, "encode_words", lambda words: seen.append(len(words)) or whole(words))
    ids, first = bpe._encoded(bpe.tb.Slice(None, np.frombuffer(text, np.uint8), np.array([0, len(text)])), own, bpe.Known())
    assert ids.tolist() == want and first.tolist() == [0, len(want)]
    assert max(seen) == bpe.WORDS and sum(seen) == 2 * bpe.WORDS + 5


def test_bpe_fuzz():
    from tokenizers import Tokenizer

    path = bpe.public_path()
    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.WordBpe(json.load(f))
    random.seed(3)
    pool = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 .,;:!?'\"-_()<>|#é ß Σ ς İ ñ 漢 字 ½ ² ٣ ́ \x1c \x85 ​ 😀ﬁ\t\n"
    for _ in range(3000):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 60)))
        got = [i for w in brute.words(text, lower=False) for i in own.encode_words([w.encode()])[0]]
        assert got == model.encode(text, add_special_tokens=False).ids, text


def test_language(spark, docs, odd, clash):
    model = language_mixture.train(docs.filter(language_mixture.fold(3) != 1))
    held = language_mixture.identify(docs.filter(language_mixture.fold(3) == 1), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    out = {r.doc_id: r for r in language_mixture.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[1].score == 0 and out[1].proportions == {}
    numbers = spark.createDataFrame([(1, "123 ½ 😀"), (2, "漢字")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_mixture.identify(numbers, model).orderBy("doc_id").collect()] == [True, False]
    assert language_mixture.identify(clash, model).columns.count("lang_pred") == 1
    assert language_mixture.identify(odd.limit(0), model).count() == 0
    nothing = language_mixture.train(odd.limit(0).withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in language_mixture.identify(odd, nothing).collect()} == {"und"}
    two = {r.lang: r.text for r in docs.filter("length(text) > 2500").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(1, two["en"][:1200] + " " + two["de"][:1200])], "doc_id long, text string")
    assert set(language_mixture.identify(mixed, model).first().proportions) >= {"en", "de"}


def test_backoff(spark, docs, rows, odd, clash):
    got = {r.doc_id: r for r in backoff_lm.op4_backoff_automaton(spark, SF).collect()}
    want = brute.base_scores(rows)
    assert len(got) == len(want)
    for d, (n, known, total, base) in want.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total)
        assert got[d].base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    for frame in (odd, clash):
        out = backoff_lm.score(frame, F.lit(True)).collect()
        assert len(out) == len(AWKWARD)
        by = {r.doc_id: r for r in out}
        assert by[1].n_tokens == by[2].n_tokens == 1 and by[1].score == by[2].score
        assert len({r.score for r in out if r.doc_id == 7}) == 1
        assert all(r.n_known == r.n_tokens for r in out)
    assert backoff_lm.score(odd.limit(0), F.lit(True)).count() == 0
    assert backoff_lm.score(odd.limit(0), F.lit(True), odd).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in backoff_lm.score(odd, F.lit(None).cast("boolean")).collect())


def test_backoff_scores_by_all_ngrams(spark, rows, monkeypatch):
    import collections
    import math

    some = [(d, " ".join((t or "").split()[:80])) for d, t in rows[:60]]
    c1, c2, c3 = (collections.Counter() for _ in range(3))
    for _, t in some[:40]:
        w = [None, *brute.words(t), None]
        c1.update(w[1:])
        c2.update(zip(w, w[1:], strict=False))
        c3.update(zip(w, w[1:], w[2:], strict=False))
    space, mass = sum(c1.values()) + len(c1) + 1, backoff_lm.MASS
    p1 = lambda c: (c1[c] + 1) / space
    p2 = lambda b, c: (c2[b, c] + mass * p1(c)) / (c1[b] + mass)
    p3 = lambda a, b, c: (c3[a, b, c] + mass * p2(b, c)) / (c2[a, b] + mass)

    # Every history's probabilities, with that of all words never seen, sum to one.
    for a, b in [g for g in c2 if g[1] is not None][::50]:
        assert sum(p3(a, b, c) for c in c1) + mass * mass / space / (c1[b] + mass) / (c2[a, b] + mass) == pytest.approx(1)

    def whole(t):
        w = [None, *brute.words(t), None]
        return math.log10(p2(w[0], w[1])) + sum(math.log10(p3(*g)) for g in zip(w, w[1:], w[2:], strict=False))

    want = {d: pytest.approx(whole(t), abs=1e-6) for d, t in some}
    frame = spark.createDataFrame(some, "doc_id long, text string")
    train = F.col("doc_id").isin([d for d, _ in some[:40]])
    corpus, rest = frame.filter(train), frame.filter(~train)
    # Blocks, ranges and lanes of any size give the same scores; so does a corpus beside the scored table.
    for block, span, lane in ((8 << 20, 16 << 20, 256), (2_000, 3_000, 7)):
        for name, value in (("BLOCK", block), ("RANGE", span), ("LANE", lane)):
            monkeypatch.setattr(backoff_lm, name, value)
        assert {r.doc_id: r.score for r in backoff_lm.score(frame, train).collect()} == want
        got = backoff_lm.score(rest, F.lit(False), corpus).union(backoff_lm.score(corpus, F.lit(False), corpus))
        assert {r.doc_id: r.score for r in got.collect()} == want


def test_lanes_carry_the_states_of_a_traversal_from_the_start(monkeypatch):
    rng = np.random.default_rng(0)
    h = tb.mix(rng.integers(1, 40, 3000).astype(np.uint64))
    first = np.array([0, 1, 8, 1500, 3000])
    h[first[1:] - 1] = backoff_lm.END
    g = backoff_lm.grams(h, first, 50)
    n = backoff_lm.own_counts(g, np.array([True, True, True, False]))
    a = backoff_lm.build(g, n, int(n[g.word].max()) + 41)
    whole = backoff_lm.walk(a, g)
    for lane in (3, 11, 5000):
        monkeypatch.setattr(backoff_lm, "LANE", lane)
        assert np.allclose(whole, backoff_lm.walk(a, g), atol=1e-12)
    # Failure arcs lead to what the formula gives: the logarithm of each token's own n-gram, seen or not.
    inner = np.ones(3000, bool)
    inner[first[:-1]] = False
    want = np.where(inner, a.logs[g.triple], a.logs[g.pair])
    assert np.allclose(whole, want, atol=1e-9)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (1, 7, 1000):
        x, y = rng.integers(0, 1 << 62, n).astype(np.uint64), rng.integers(0, 9, n).astype(np.uint64)
        got = backoff_lm._unpacked(backoff_lm._packed(x, y), n, 2)
        assert (got[0] == x).all() and (got[1] == y).all()


def test_licenses(spark, odd, clash):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted((*r[:4], r[4] or 0) for r in con.sql(license_scan.ORACLE_SQL).fetchall())
    assert sorted((r.doc_id, r.n_matches, r.n_passages, r.licenses, r.best_percent or 0) for r in license_scan.op6_license_scan(spark, SF).collect()) == want
    for frame in (odd, clash):
        assert {(r.n_matches, r.licenses, r.best_percent) for r in license_scan.scan(frame).collect()} == {(0, "", None)}
    assert license_scan.scan(odd.limit(0)).count() == 0
    text = "Intro\nreleased under the MIT license!\n" + license_scan.TEMPLATES[5][1]
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licenses == "GPL-3.0-or-later,MIT" and r.best_percent == 100


def test_licence_passages(spark, tmp_path):
    import textwrap

    import duckdb

    by = {}
    for name, t in license_scan.TEMPLATES:
        by.setdefault(name, []).append(t)
    prose = "the cat sat on the mat and the dog lay under the table in the hall of the house "
    wrapped = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 60))
    cases = {
        1: (prose * 40 + "\n" + wrapped(by["Apache-2.0"][1]) + "\n" + prose * 40, "Apache-2.0", 1),
        2: (prose + by["MIT"][0] + " " + prose, "MIT", 1),
        3: (prose * 9 + wrapped(max(by["MIT"], key=len)) + prose * 9, "MIT", 1),
        4: (prose * 3 + wrapped(by["GPL-2.0-or-later"][0]) + "\n\n" + prose + wrapped(by["GPL-3.0-or-later"][0]) + prose, "GPL-2.0-or-later,GPL-3.0-or-later", 2),
        5: (prose * 60, "", 0),
        6: ("See LICENSE. " + by["Apache-2.0"][0] + " for details. " + by["Apache-2.0"][0], "Apache-2.0", 2),
        7: (" ".join([by["ISC"][0]] * 30), "ISC", 30),
    }
    frame = spark.createDataFrame([(d, t) for d, (t, _, _) in cases.items()], "doc_id long, text string")
    got = license_scan.scan(frame).collect()
    assert {r.doc_id: (r.licenses, r.n_passages) for r in got} == {d: (names, n) for d, (_, names, n) in cases.items()}
    path = str(tmp_path / "documents.parquet")
    frame.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted((*r[:4], r[4] or 0) for r in con.sql(license_scan.ORACLE_SQL).fetchall())
    assert sorted((r.doc_id, r.n_matches, r.n_passages, r.licenses, r.best_percent or 0) for r in got) == want


def test_sharding(spark, docs, rows, odd, clash, tmp_path):
    import zlib

    got = sharding.op9_virtual_slots(spark, SF).toPandas()
    text = {d: (t or "").encode() for d, t in rows}
    assert all((len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) == (r.size, r.text_crc32) for r in got.itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 40 and total.max() <= max(1.05 * total.mean(), got["size"].max() + total.min())
    for frame in (odd, clash):
        assert sharding.shard(frame, 3).count() == len(AWKWARD)
    assert sharding.shard(odd.limit(0), 3).count() == 0
    sizes = sharding.slot_sizes(sharding.records(docs, 512), 512)
    first = sharding.assign(sizes, 8)
    more = sharding.rebalance(first, sizes, 9)
    assert set(more[more != first]) == {8} and sizes["bytes"].groupby(more).sum().max() < 1.2 * sizes["bytes"].sum() / 9
    fewer = sharding.rebalance(first, sizes, 7)
    assert set(fewer) == set(range(7)) and (fewer[first < 7] == first[first < 7]).all()
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, 1, first, sizes)
    sharding.store_map(spark, path, 2, more, sizes)
    old, new = (sharding.load_map(spark, path, v).toPandas().set_index("virtual_slot")["shard"].sort_index() for v in (1, None))
    assert (old == first).all() and (new == more).all()


def test_classifier(spark, docs, odd, clash):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    large = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    machine = factorization.train(large, labels)
    held = factorization.classify(large.filter(factorization.fold(3) == 1), machine).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.93
    out = factorization.classify(odd, machine).collect()
    assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert factorization.classify(clash, machine).columns.count("score") == 1
    assert factorization.classify(odd.limit(0), machine).count() == 0
    none = factorization.train(odd, labels.limit(0))
    assert {r.score for r in factorization.classify(odd, none).collect()} == {0.5}


def test_factor_interactions_by_pairs():
    """The linear-time sum of interactions is that of all pairs."""
    rng = np.random.default_rng(2)
    m = factorization.Machine(np.zeros((0, 0)), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    r = factorization.Rows(np.array([1, 5, 9, 2, 3]), rng.random(5), np.array([0, 3, 3, 5]))
    z, _ = factorization._logits(m, r)
    for i, (a, b) in enumerate(zip(r.first, r.first[1:], strict=False)):
        x, v = r.index[a:b], r.value[a:b]
        pairs = sum(m.vectors[x[j]] @ m.vectors[x[k]] * v[j] * v[k] for j in range(len(x)) for k in range(j))
        assert z[i] == pytest.approx(m.bias + m.weights[x] @ v + pairs)


def test_pipeline(spark, docs, tmp_path):
    """run() is what the plain versions of its stages give, one after another."""
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, quality_rules.train(docs, labels)).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = [x for x, k in zip(rows, brute.near(rows, 5), strict=True) if k[3]]
    rows = [(d, w[5].decode("utf-8", "ignore")) for (d, _), w in zip(rows, brute.repeats(rows), strict=True)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, brute.without_hits(t, items)) for d, t in rows]
    model = Tokenizer.from_file(bpe.public_path())
    want = [(d, len(ids := model.encode(t, add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), len(t)) for d, t in rows]
    got = corpus_pipeline.run(spark, SF).collect()
    assert key((r.doc_id, r.n_tokens, r.ids_sha256, r.n_chars) for r in got) == key(want)


def test_stages_keep_callers_columns(spark, odd):
    """Columns named like results, maps and repeated rows go through the stages that return documents."""
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    map_ = F.create_map(F.lit("k"), F.col("doc_id"))
    wide = odd.select("*", *(F.lit("mine").alias(c) for c in RESULTS), map_.alias("m"), F.array(F.struct(map_.alias("deep"))).alias("x"), F.length("text").cast("long").alias("n_chars"))
    cut = decontaminate.remove_contamination(wide, items)
    assert cut.columns == wide.columns and cut.schema == wide.schema
    want = [(d, brute.without_hits(t, [(1, "a b c d e f")])) for d, t in AWKWARD]
    got = cut.collect()
    assert key((r.doc_id, r.text) for r in got) == key(want)
    assert all(r[c] == "mine" for r in got for c in RESULTS) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    left = minhash_forest.drop_near_duplicates(wide)
    assert left.columns == wide.columns and sum(r.doc_id == 7 for r in left.collect()) == 1


def test_registered():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 14))} and set(registry.oracle_sql()) <= names
