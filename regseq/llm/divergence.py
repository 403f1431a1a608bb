"""Source divergence audit by a frequent-pattern tree of term rows.

For each pair of sources of a language the audit sums |p - q| over all kept terms.  Most terms
occur in few sources, and a source's p of a term that it lacks is one value z, so the sum over
all V terms is taken as V |z_a - z_b| and corrected:

* for the terms of one source, whatever the other has: from sorted counts and running sums;
* for the terms of both: each term's row is its sources with their counts, in the order of the
  sources; rows with multiplicities go into a prefix tree, and a node corrects once for each of
  its ancestors, by its own multiplicity, for all terms that share the path.

The tree lies in ranges of sorted rows, one a task; where a range begins inside a shared path,
that path's nodes stand in both ranges with their parts of the multiplicity.  All sums are
whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regseq.llm.common import small_batches, stored

LEAST_DOCS = 30
TOP = 50
UNIT = 1_000_000_000
PRIOR = 5
#: Terms that a task counts before it hands them on.
HOLD = 1 << 18
#: Cells of term rows that the tree works on at once.
CELLS = 1 << 18

#: A-Z in lower case; what is no letter of A-Z, a-z and no byte beyond ASCII is a space.
_TERMS = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, counted in each task first."""
    small_batches(docs.sparkSession)

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in held.items():
            if n:
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(n), np.int32)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array([seen[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                words = text.as_py().translate(_TERMS).split()
                n.update(words)
                seen.update(set(words))
                size += len(n)
                if size > HOLD:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    clean = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return clean.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(n: str, total: str) -> Column:
    """1 + floor(UNIT n / total), exact: the product may need more than 64 bits."""
    return F.expr(f"1 + (cast({n} as decimal(28,0)) * {UNIT}) div {total}")


def _node_corrections(block: pa.Table, held: dict[tuple[str, str, str], int]) -> None:
    """Adds to `held`, by (lang, a, b), what the nodes of the tree of sorted rows correct, each with all its ancestors.

    Rows are (lang, path, mult).  A node is a row's place that the row before does not share;
    its multiplicity is that of all rows up to the next one that leaves its path.
    """
    path = block.column("path").combine_chunks()
    names = path.flatten().field("source").dictionary_encode()
    code = names.indices.to_numpy()
    words = names.dictionary.to_pylist()
    price, zero = (path.flatten().field(c).to_numpy() for c in ("p", "z"))
    mult = block.column("mult").to_numpy()
    size = path.value_lengths().to_numpy()
    first = np.cumsum(size) - size
    langs = block.column("lang").combine_chunks().dictionary_encode()
    lang = langs.indices.to_numpy()
    # Cells of the rows side by side, -1 behind a row's end.
    deep = int(size.max())
    inside = np.arange(deep) < size[:, None]
    place = np.where(inside, first[:, None] + np.arange(deep), 0)
    s, p, z = np.where(inside, code[place], -1), price[place], zero[place]
    same = (s[1:] == s[:-1]) & (p[1:] == p[:-1]) & inside[1:] & (lang[1:] == lang[:-1])[:, None]
    shared = np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])
    for d in range(1, deep):
        new = np.flatnonzero(shared <= d)
        weight = np.add.reduceat(mult, new)
        real = size[new] > d
        new, weight = new[real], weight[real]
        pa_, za, pn, zn = p[new, :d], z[new, :d], p[new, d : d + 1], z[new, d : d + 1]
        value = (np.abs(pa_ - pn) - np.abs(pa_ - zn) - np.abs(za - pn) + np.abs(za - zn)) * weight[:, None]
        pair = (lang[new][:, None] * len(words) + s[new, :d]) * len(words) + s[new, d : d + 1]
        keys, where = np.unique(pair.ravel(), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, where, value.ravel())
        for k, v in zip(keys.tolist(), sums.tolist(), strict=True):
            rest, b = divmod(k, len(words))
            own, a = divmod(rest, len(words))
            key = (langs.dictionary[own].as_py(), words[a], words[b])
            held[key] = held.get(key, 0) + v


def tree_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a before b, from term rows (lang, path of (source, p, z) by source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*((*k, v) for k, v in held.items()), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["lang", "a", "b", "value"])

        wait: list[pa.RecordBatch] = []
        cells = 0
        for b in batches:
            wait.append(b)
            cells += len(b.column("path").flatten())
            if cells > CELLS:
                _node_corrections(pa.Table.from_batches(wait), held)
                wait, cells = [], 0
            if len(held) > HOLD:
                yield out()
                held.clear()
        if wait and cells:
            _node_corrections(pa.Table.from_batches(wait), held)
        yield out()

    paths = rows.filter(F.size("path") > 1).groupBy("lang", "path").agg(F.count("*").alias("mult"))
    spread = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return spread.mapInArrow(run, "lang string, a string, b string, value long")


def single_corrections(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms of a add to the pair, as if b had none of them.

    The sum of |p - z_b| over a's terms is read off running counts and sums of a's distinct p in
    order; a source has as many as it has different counts.
    """
    marks = priced.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("at")).agg(F.count("*").alias("n")).select("lang", "a", F.lit(None).cast("string").alias("b"), "at", "n", F.lit(None).cast("long").alias("z"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("at"))
    # One row for each pair of sources of a language: the rows that the audit returns.
    asked = groups.select("lang", F.col("source").alias("a"), "z").join(other, "lang").filter("a <> b and z is not null").select("lang", "a", "b", "at", F.lit(0).cast("long").alias("n"), "z")
    whole = Window.partitionBy("lang", "a")
    up = whole.orderBy("at")
    both = marks.union(asked).withColumns({"c": F.sum("n").over(up), "s": F.sum(F.col("n") * F.col("at")).over(up), "ct": F.sum("n").over(whole), "st": F.sum(F.col("n") * F.col("at")).over(whole)})
    value = F.col("at") * (2 * F.col("c") - F.col("ct")) + F.col("st") - 2 * F.col("s") - F.col("ct") * F.abs(F.col("z") - F.col("at"))
    return both.filter("b is not null").select("lang", "a", "b", value.alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Null lang, source and text are ''.  A group without terms has the rows of part "pair" all
    the same; a language that keeps no term has the value 0 there.  Repeated rows count as
    often as they stand.  Columns beside lang, source and text are not read.  The empty table
    gives the empty table.
    """
    found = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("x")).filter(F.col("docs") >= least)
    kept = stored(found.select("lang", "term", "total", F.posexplode("x").alias("i", "x")).select("lang", "term", "total", (F.col("i") == 0).alias("first"), "x.source", "x.n"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    size = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("all"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = names.join(own, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["n", "v", "all"])
    groups = groups.select("lang", "source", "v", (F.col("n") + PRIOR * F.col("v")).alias("room"), (F.col("all") + PRIOR * F.col("v")).alias("whole"))
    groups = stored(groups.withColumn("z", F.when(F.col("v") > 0, _price(str(PRIOR), "room"))))
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", _price(f"n + {PRIOR}", "room"))

    q = _price(f"total + {PRIOR}", "whole")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    rows = priced.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("path"))
    shared = tree_corrections(rows)
    single = single_corrections(priced, groups)
    one = groups.select("lang", F.col("source").alias("a"), "z", "v")
    base = one.join(groups.select("lang", F.col("source").alias("b"), F.col("z").alias("y")), "lang").filter("a <> b").select("lang", "a", "b", F.coalesce(F.col("v") * F.abs(F.col("z") - F.col("y")), F.lit(0)).alias("value"))
    turned = lambda df: df.union(df.select("lang", "b", "a", "value"))
    pairs = base.union(turned(single)).union(turned(shared)).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(terms)


def op12_divergence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS big, count(*) OVER (PARTITION BY lang, source) AS v, sum(n) OVER (PARTITION BY lang) AS whole FROM f),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (big + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (whole + 5 * v) AS q FROM s),
w AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM x WHERE part = 'pair' OR rank <= 50
"""
