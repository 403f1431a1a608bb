"""Greedy choice by rounds against one walk through each group."""

import random

import pytest
from pyspark.sql import functions as F

from regseq.operators import conservation, topk
from regseq.operators.greedy import greedy


def plain(rows, widths, most=None):
    """rows: (group, rank key, parts)."""
    out = []
    for g in {r[0] for r in rows}:
        taken = []
        for r in sorted(r for r in rows if r[0] == g):
            spans = [(p, p + w) for p, w in zip(r[2], widths, strict=True)]
            if (most is None or len(taken) < most) and not any(a < z and b < y for t in taken for (b, z), in [[(p, p + w)] for p, w in zip(t[2], widths, strict=True)] for a, y in spans):
                taken.append(r)
        out += taken
    return sorted(out)


@pytest.mark.parametrize("block", [1, 25, 300, 1 << 16])
@pytest.mark.parametrize("widths", [(10,), (7, 4)])
def test_as_one_walk(spark, block, widths):
    r = random.Random(block)
    rows = [(r.choice("ab"), (r.randrange(30), i), tuple(r.randrange(-200, 400) + 20 * k for k in range(len(widths)))) for i in range(400)]
    df = spark.createDataFrame([(g, k[0], k[1], *p) for g, k, p in rows], ["g", "k", "i", *(f"p{i}" for i in range(len(widths)))]).repartition(5)
    parts = [(f"p{i}", w) for i, w in enumerate(widths)]
    for most in (None, 9):
        got = greedy(df, ["g"], [F.col("k"), F.col("i")], parts, most, "rank", block).collect()
        want = plain(rows, widths, most)
        assert sorted((x.g, (x.k, x.i), tuple(x[f"p{i}"] for i in range(len(widths)))) for x in got) == want
        assert [x["rank"] for g in "ab" for x in sorted((x for x in got if x.g == g), key=lambda x: (x.k, x.i))] == [n + 1 for g in "ab" for n in range(sum(w[0] == g for w in want))]


def test_a_chain_across_all_blocks(spark):
    """Each site is beaten by the one before it: every second one stays, however the blocks lie."""
    df = spark.createDataFrame([("g", i * 6, float(i)) for i in range(60)], "g string, site int, p double")
    got = greedy(df, ["g"], [F.col("p")], [("site", 10)], block=40)
    assert sorted(x.site for x in got.collect()) == [i * 6 for i in range(0, 60, 2)]


def test_repeated_and_unknown_rows(spark):
    rows = [("a", 5, "+", 0.1), ("a", 5, "+", 0.1), ("a", 5, "-", 0.1), (None, 5, "+", 0.1), ("a", None, "+", 0.0), ("a", 6, "+", 0.05), ("b", 5, "+", 1.0)]
    df = spark.createDataFrame(rows, "interval_idx string, site int, strand string, pvalue double")
    assert sorted(map(tuple, topk.top_sites(df, 2).collect())) == [("a", 1, 6, "+", 0.05), ("b", 1, 5, "+", 1.0)]
    assert topk.top_sites(df.limit(0), 2).collect() == []


def test_twenty_thousand_sites_of_one_interval(spark):
    df = spark.range(20_000).select(F.lit(1).alias("interval_idx"), (F.xxhash64("id") % 1_000_000).cast("int").alias("site"), F.lit("+").alias("strand"), F.rand(3).alias("pvalue")).cache()
    rows = [(1, (x.pvalue, x.site), (x.site,)) for x in df.collect()]
    got = topk.top_sites(df, 30)
    taken, tiles = [], {}
    for r in sorted(rows):
        at = r[2][0]
        if not any(abs(at - x) < 30 for t in (at // 30 - 1, at // 30, at // 30 + 1) for x in tiles.get(t, ())):
            tiles.setdefault(at // 30, []).append(at)
            taken.append(at)
    assert [x.site for x in sorted(got.collect(), key=lambda x: x["rank"])] == taken


def test_thin_partners_goes_by_centre_window(spark):
    rows = [("g", "s", 0, 10, 5, 0.0, 0.9, 1.0), ("g", "s", 0, 40, 5, 0.0, 0.8, 1.0), ("g", "s", 1, 40, 5, 0.0, 0.8, 1.0), ("g", "s", 0, 70, 5, 0.0, 0.7, 1.0), ("g", "t", 0, 40, 5, 0.0, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "gene_id string, species string, offset1 int, offset2 int, score int, repeat_ratio double, belief double, integrate double")
    got = sorted((x.species, x.offset1, x.offset2) for x in conservation.thin_partners(df, 60).collect())
    assert got == [("s", 0, 10), ("s", 0, 70), ("s", 1, 40), ("t", 0, 40)]
