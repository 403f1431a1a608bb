"""Closed-form tails against exact sums of fractions, and ranks against plain windows."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from regseq.operators import statistics


def binomial(n, k, p):
    p = Fraction(p)
    return float(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(max(k, 0), n + 1)))


def test_log_gamma(spark):
    xs = [1, 1.5, 2, 3, 10, 100.25, 1e4, 1e7]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1).select(statistics.log_gamma("x")).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-13)


def test_binomial_tails(spark):
    r = random.Random(1)
    rows = [(n, r.randrange(-1, n + 2), r.choice([0.0, 1.0, 0.5, 1 / 1024, 0.75, r.randrange(1, 4096) / 4096])) for _ in range(250) for n in [r.choice([1, 2, 7, 40, 150, 400])]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, n int, k int, p double")
    got = {x.i: x.p_value for x in statistics.binom_sf(df).collect()}
    for i, (n, k, p) in enumerate(rows):
        want = binomial(n, k, p)
        assert got[i] == pytest.approx(want, abs=1e-12, rel=1e-9), (n, k, p)


def test_binomial_tails_of_very_many_trials(spark):
    """Against the normal distribution's own digits far out, and the sum of both sides."""
    rows = [(10**6, 500_000, 0.5), (10**6, 499_000, 0.5), (10**7, 1_000, 1e-4), (10**6, 3, 1e-6)]
    df = spark.createDataFrame(rows, "n long, k long, p double")
    up = [x[0] for x in df.select(statistics.binomial_tail("n", "k", "p")).collect()]
    down = [x[0] for x in df.select(statistics.binomial_tail("n", "(n - k + 1)", "(1 - p)")).collect()]
    assert [a + b for a, b in zip(up, down, strict=True)] == pytest.approx([1] * 4, abs=1e-7)
    assert up[0] == pytest.approx(0.5 + math.comb(10**4, 5000) / 2**10001 / 10, abs=1e-6)
    assert up[3] == pytest.approx(1 - sum(math.exp(-1) / math.factorial(j) for j in range(3)), abs=1e-6)


def test_null_arguments_have_no_tail(spark):
    df = spark.createDataFrame([(None, 1, 0.5), (3, None, 0.5), (3, 1, None)], "n int, k int, p double")
    assert [x.p_value for x in statistics.binom_sf(df).collect()] == [None] * 3
    df = spark.createDataFrame([(None, 1, 2, 3), (1, 2, 3, None)], "q int, m int, n int, k int")
    assert [x.p_value for x in statistics.phyper(df, True).collect()] == [None] * 2


def test_hypergeometric_tails(spark):
    r = random.Random(2)
    rows = []
    for _ in range(300):
        m, n = (r.choice([0, 1, 5, 30, 200, 900]) for _ in range(2))
        k = r.randrange(0, m + n + 1)
        rows.append((r.randrange(-1, m + 2), m, n, k))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, q int, m int, n int, k int")
    got = {x.i: (x.lower, x.upper) for x in statistics.phyper(statistics.phyper(df, True, "lower"), False, "upper").collect()}
    for i, (q, m, n, k) in enumerate(rows):
        terms = {j: math.comb(m, j) * math.comb(n, k - j) for j in range(max(0, k - n), min(k, m) + 1)}
        whole = math.comb(m + n, k)
        want = [float(Fraction(sum(t for j, t in terms.items() if keep(j)), whole)) for keep in (lambda j: j <= q, lambda j: j >= q)]
        assert got[i] == pytest.approx(want, abs=1e-11, rel=1e-9), (q, m, n, k)


def test_many_tails_need_no_shuffle(spark):
    df = spark.range(100_000).select((F.lit(2000)).alias("n"), (F.col("id") % 2001).alias("k"), ((F.col("id") % 997) / 1000.0).alias("p"))
    out = statistics.binom_sf(df)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    assert out.agg(F.count_if((F.col("p_value") >= 0) & (F.col("p_value") <= 1))).first()[0] == 100_000


def hits(spark, n=400, groups=3, seed=4):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", None][:groups]), r.choice([r.random(), 0.25, 0.0, 1.0])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "hit_id int, motif string, pvalue double").repartition(5)


def test_qvalues(spark):
    rows, df = hits(spark)
    got = {x.hit_id: (x.rank, x.qvalue) for x in statistics.qvalues(df, ["motif"], 0.8).collect()}
    assert len(got) == len(rows)
    for motif in ("a", "b", None):
        own = sorted((p, i) for i, m, p in rows if m == motif)
        least = 1.0
        for rank in range(len(own), 0, -1):
            p, i = own[rank - 1]
            least = min(least, p * 0.8 * len(own) / rank)
            assert got[i] == (rank, pytest.approx(least))
    kept = statistics.qvalues(df, ["motif"], 0.8, 0.5).collect()
    assert {x.hit_id for x in kept} == {i for i, (_, q) in got.items() if q <= 0.5}


def normal_sf(z):
    return math.erfc(z / math.sqrt(2)) / 2


def test_overrep_poisbinom(spark):
    rows, df = hits(spark, 90, 2, 6)
    n, threshold = 50, 0.6
    got = {(x.motif, x.hit_id): x.test_p for x in statistics.overrep_poisbinom(df, n, threshold, ["motif"]).collect()}
    want = {}
    for motif in ("a", "b"):
        own = sorted((p, i) for i, m, p in rows if m == motif)
        tails = []
        for i in range(1, len(own) + 1):
            trials = [p for p, _ in own[:i]] + [own[i - 1][0]] * max(n - i, 0)
            mu, var, third = sum(trials), sum(p * (1 - p) for p in trials), sum(p * (1 - p) * (1 - 2 * p) for p in trials)
            sd = math.sqrt(max(var, 1e-300))
            z = (i + 0.5 - mu) / sd
            tails.append(min(1, max(0, normal_sf(z) + (third / sd**3 * (z * z - 1) * math.exp(-z * z / 2) / (6 * math.sqrt(2 * math.pi)) if var > 1e-100 else 0))))
        best = min(range(len(tails)), key=lambda i: (tails[i], i))
        if tails[best] < threshold:
            want |= {(motif, i): tails[best] for _, i in own[: best + 1]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("test", ["none", "binomial", "poisbinom", "qvalue"])
def test_overrepresented(spark, test):
    _, df = hits(spark, 120, 2, 7)
    presence = df.select("motif").union(spark.createDataFrame([("c",)], "motif string"))
    got = {x["motif"]: (x["count"], x["pvalue"]) for x in statistics.overrepresented(df, presence, test, 0.5, 40, by=["motif"]).collect()}
    kept = {"none": lambda: statistics.overrep_none(df, 0.5), "binomial": lambda: statistics.overrep_binomial(df, 40, 0.5, ["motif"]), "poisbinom": lambda: statistics.overrep_poisbinom(df, 40, 0.5, ["motif"]), "qvalue": lambda: statistics.qvalues(df, ["motif"], 1.0, 0.5)}[test]().collect()
    for m in ("a", "b", "c"):
        own = [x["pvalue"] for x in kept if x["motif"] == m]
        assert got[m] == (len(own), min(own, default=None))


def test_empty_tables(spark):
    _, df = hits(spark, 5)
    none = df.limit(0)
    assert statistics.qvalues(none, ["motif"]).count() == statistics.overrep_binomial(none, 5, 0.5, ["motif"]).count() == statistics.best_binomial(none, 5, "motif").count() == 0
