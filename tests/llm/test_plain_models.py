"""Models that SQL cannot express against plain, document-by-document versions of their scoring."""

import math
import os

import numpy as np
import pytest

from regseq.llm import docstats, factorization, language_mixture, quality_rules
from regseq.llm import textbytes as tb
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def one_text(text):
    return tb.text_bytes(__import__("pyarrow").array([text or ""]))


def plain_em(likelihoods, members):
    """Proportions and log-likelihood of one document's words over some languages."""
    pi = [1 / len(members)] * len(members)
    for step in range(language_mixture.STEPS + 1):
        total, parts = 0.0, [0.0] * len(members)
        for word in likelihoods:
            r = [word[k] * p for k, p in zip(members, pi, strict=True)]
            s = max(sum(r), 1e-300)
            total += math.log(s)
            parts = [a + x / s for a, x in zip(parts, r, strict=True)]
        if step == language_mixture.STEPS:
            return pi, total
        pi = [a / len(likelihoods) for a in parts]


def plain_mixture(model, text):
    data, offsets = one_text(text)
    buckets, lo, hi = language_mixture._trigrams(data, offsets)
    k = len(model.languages)
    if not len(lo) or not any(map(str.isalpha, text or "")):
        return {}
    logs = [[sum(float(model.logs[j][b]) for b in buckets[a:z]) for j in range(k)] for a, z in zip(lo, hi, strict=True)]
    top = [max(w) for w in logs]
    words = [[math.exp(max(x - t, -60)) for x in w] for w, t in zip(logs, top, strict=True)]
    base = sum(top)
    single = [sum(w[j] for w in logs) for j in range(k)]
    pi, full = plain_em(words, range(k))
    price = language_mixture.PENALTY * 0.5 * math.log(max(len(words), 2))
    lead = max(range(k), key=lambda j: (single[j], pi[j]))
    order = [lead, *sorted((j for j in range(k) if j != lead), key=lambda j: -pi[j])]
    chosen, best = {lead: 1.0}, single[lead]
    if full + base - best > price:
        for size in range(2, k + 1):
            mixed, value = plain_em(words, order[:size])
            if value + base - best <= price:
                break
            chosen, best = dict(zip(order[:size], mixed, strict=True)), value + base
            if full + base - best <= price:
                break
    return {model.languages[j]: p for j, p in chosen.items() if p}


def test_language_mixtures(spark, docs):
    """Every document's language set and proportions are those of a plain expectation-maximisation."""
    model = language_mixture.train(docs.filter(language_mixture.fold(3) != 1))
    mixed = [(-1 - i, " ".join(x.text for x in docs.filter(f"lang = '{lang}'").orderBy("doc_id").limit(2).collect())[:900]) for i, lang in enumerate(("en", "fr"))]
    joined = [(-9, mixed[0][1] + " " + mixed[1][1])]
    odd = [(d, t) for d, t in AWKWARD if t is None or len(t) < 1000]
    extra = spark.createDataFrame([*mixed, *joined, *((1000 + i, t) for i, (_, t) in enumerate(odd))], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra).collect()
    got = {r.doc_id: r for r in language_mixture.identify(docs.select("doc_id", "text").union(extra), model).collect()}
    several = 0
    for r in rows:
        want, found = plain_mixture(model, r.text), got[r.doc_id]
        several += len(want) > 1
        assert set(found.proportions or {}) == set(want), r.doc_id
        for lang, p in want.items():
            assert found.proportions[lang] == pytest.approx(p, abs=1e-5)
        assert found.lang_pred == (max(want, key=lambda x: (round(want[x], 9), x)) if want else "und") or want and abs(want[found.lang_pred] - max(want.values())) < 1e-6
        assert found.score == pytest.approx(max(want.values(), default=0.0), abs=1e-5)
    assert several


def test_quality_verdicts_by_a_walk_through_the_trees(spark, docs):
    trees = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.select("doc_id", "text"), trees).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = docstats.feature_matrix(docstats.doc_stats(*one_text(r.text)))[0]
        logit = trees.base
        for root in trees.roots.tolist():
            at = root
            while trees.left[at] != at:
                at = int(trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at])
            logit += float(trees.value[at])
        n, *_, repeated = brute.quality_counts(r.text)
        failed = n < 50 or 100 * repeated > 50 * n
        score = 1 / (1 + math.exp(-logit))
        assert got[r.doc_id].base_failed == failed
        assert got[r.doc_id].quality_score == pytest.approx(score, abs=1e-9)
        assert got[r.doc_id].kept == (not failed and score >= quality_rules.THRESHOLD)


def test_classifier_scores_by_all_pairs(spark, docs):
    """The score of a document is its bias, its features' weights and every pair's product of vectors."""
    machine = factorization.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in factorization.classify(docs.select("doc_id", "text"), machine).collect()}
    short = [r for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 150]
    assert len(short) > 20
    for r in short:
        data, offsets = one_text(r.text)
        x = docstats.feature_matrix(docstats.doc_stats(data, offsets))
        row = factorization._rows(*factorization._words(data, offsets), x, machine.edges)
        at, value = row.index.tolist(), row.value.tolist()
        z = machine.bias + sum(machine.weights[i] * v for i, v in zip(at, value, strict=True))
        for a in range(len(at)):
            for b in range(a):
                z += float(np.dot(machine.vectors[at[a]], machine.vectors[at[b]])) * value[a] * value[b]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)
