"""Two-level running totals against plain windows, and how their work is spread."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from regseq.operators import scan


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    rows = [(None if k == 9 else f"k{k}", r.choice([None, *range(40)]), r.choice([None, r.random(), float("nan")]), i) for i in range(3000) for k in [r.choice([0, 0, 0, 0, 1, 2, 9])]]
    return spark.createDataFrame(rows, "key string, v long, x double, id long").cache()


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("keys", [["key"], []])
def test_as_a_window(spark, table, before, down, keys):
    order = [F.col("v").desc() if down else F.col("v"), F.col("id").desc() if down else F.col("id")]
    totals = {"a": ("sum", F.col("v")), "b": ("max", F.col("x")), "c": ("min", F.struct("x", "id")), "d": ("max", F.when(F.col("id") % 7 == 0, F.struct("id", "v")))}
    parts = scan.dealt(table, keys, order, 7)
    got = scan.scanned(parts, keys, order, totals, before)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    plain = {"sum": F.sum, "max": F.max, "min": F.min}
    want = table.withColumns({n: plain[k](e).over(w) for n, (k, e) in totals.items()})
    text = lambda df: sorted(map(str, df.select("id", "key", *totals).collect()))
    assert parts.select("__range").distinct().count() == 7
    assert text(got) == text(want)


def test_two_scans_of_one_deal(spark, table):
    parts = scan.dealt(table, ["key"], ["id"], 5)
    one = scan.scanned(parts, ["key"], ["id"], {"n": ("sum", F.lit(1))})
    two = scan.scanned(one, ["key"], ["id"], {"m": ("max", F.col("n"))}, before=True)
    assert two.filter("n > 1 and m <> n - 1 or n = 1 and m is not null").count() == 0


def test_backwards_over_the_same_ranges(spark, table):
    parts = scan.dealt(table, ["key"], ["id"], 7)
    got = scan.scanned(parts, ["key"], [F.desc("id")], {"n": ("sum", F.lit(1)), "m": ("min", F.col("x"))}, back=True)
    w = Window.partitionBy("key").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = table.withColumns({"n": F.count("*").over(w), "m": F.min("x").over(w)})
    text = lambda df: sorted(map(str, df.select("id", "key", "n", "m").collect()))
    assert text(got) == text(want)


def test_empty_table(spark, table):
    assert scan.ranked(table.limit(0), ["key"], ["id"]).collect() == []


def test_a_huge_group_is_spread(spark):
    """Five million rows of one group: every task of the scan has its share."""
    df = spark.range(5_000_000).select(F.lit("g").alias("key"), F.xxhash64("id").alias("v"), "id")
    parts = scan.dealt(df, ["key"], ["v", "id"], 16)
    out = scan.scanned(parts, ["key"], ["v", "id"], {"n": ("sum", F.lit(1).cast("long"))})
    shares = [r["count"] for r in out.groupBy("__range").count().collect()]
    assert len(shares) == 16 and max(shares) < 500_000
    assert out.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 5_000_000, 5_000_000)
    assert "hashpartitioning(__range" in out._jdf.queryExecution().toString()
