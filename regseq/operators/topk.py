"""Orders, top-k, greedy selection and seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regseq.functions.kernels import hidden_tiles
from regseq.operators import scan
from regseq.operators.graph import _cut
from regseq.operators.greedy import greedy
from regseq.operators.scan import prefix_scan


def ordered_sites(scores: DataFrame) -> DataFrame:
    """Sites of both strands and all intervals by p-value, equal ones by interval, site and strand."""
    return scores.orderBy("pvalue", "interval_idx", "site", "strand")


def top_sites(sites: DataFrame, width: int, n: int | None = None, by: str = "interval_idx") -> DataFrame:
    """Per interval the best sites that do not overlap, taken greedily by p-value (site and strand break ties)."""
    rows = sites.select(by, F.col("site").cast("int").alias("site"), "strand", F.col("pvalue").cast("double").alias("pvalue"))
    taken = greedy(rows, [by], [F.col("pvalue"), F.col("site"), F.col("strand")], [("site", width)], n, "rank")
    return taken.select(by, "rank", "site", "strand", "pvalue")


def sites_below(sites: DataFrame, p: float, width: int, by: str = "interval_idx") -> DataFrame:
    """All greedily chosen sites of a p-value up to p."""
    return top_sites(sites.filter(F.col("pvalue") <= p), width, None, by)


def top_pair_sites(pairs: DataFrame, width_a: int, width_b: int, n: int) -> DataFrame:
    """Per sequence the best n paired sites (seq_id, strand, pos_a, pos_b, score) of which neither part overlaps."""
    rows = pairs.select("seq_id", F.col("pos_a").cast("int").alias("pos_a"), F.col("pos_b").cast("int").alias("pos_b"), "strand", "score")
    taken = greedy(rows, ["seq_id"], [F.col(c) for c in ("score", "pos_a", "pos_b", "strand")], [("pos_a", width_a), ("pos_b", width_b)], n, "rank")
    return taken.select("seq_id", "rank", "pos_a", "pos_b", "strand", "score")


def top_pvalues(sites: DataFrame, n: int, by: str = "interval_idx") -> DataFrame:
    """The n lowest p-values of each group with their place; a group of fewer raises."""
    few = sites.groupBy(by).count().filter(F.col("count") < n).limit(1).collect()
    if few:
        raise ValueError(f"only {few[0]['count']} sites in {few[0][0]}")
    return scan.ranked(sites, [by], ["pvalue", "site", "strand"]).filter(F.col("rank") <= n)


def best_site(scores: DataFrame, by: str = "interval_idx") -> DataFrame:
    """Highest score of each group; the first site of equal ones."""
    best = F.max(F.struct("score", (-F.col("site")).alias("m"), "strand")).alias("b")
    return scores.groupBy(by).agg(best).select(by, (-F.col("b.m")).alias("site"), "b.strand", "b.score")


def nearest_motifs(distances: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))
    return distances.withColumn("rank", rank).filter(F.col("rank") <= n)


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def last_n(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(n)


def _hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sample_ids(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows that the seed fixes."""
    return df.orderBy(_hash(seed, key), key).limit(n)


#: Bases of a tile, whose running counts of hidden bases are one row.
TILE = 1 << 10
#: Draws of a partition, about, and the least number of stretches that all sequences are cut into for the search.
DRAWS, STRETCHES = 1 << 17, 1 << 16


def _draws(lengths: DataFrame, tries: int, seed: int, total: int) -> DataFrame:
    """(id, length, k, x): places below the total, by hash.  Ids may lie in one file: they are dealt out first."""
    parts = -(-lengths.count() * tries // DRAWS)
    spread = lengths.repartition(parts, "id") if parts > 1 else lengths
    x = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("k").cast("string"))), 1, 12), 16, 10).cast("long") % max(total, 1)
    return spread.filter("length > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(tries)))).select("id", F.col("length").cast("int").alias("length"), "k", x.alias("x"))


def _rank(i: int, x: Column, own: bool) -> Column:
    """Hidden bases of column i before place x of a tile, or up to it if the place's own base counts."""
    b = (x % 64).cast("int")
    ones = F.lit(-1).cast("long")
    mask = F.call_function("shiftrightunsigned", ones, 63 - b) if own else F.bitwise_not(F.call_function("shiftleft", ones, b))
    word = F.floor(x / 64).cast("int")
    return F.get(f"before{i}", word) + F.bit_count(F.get(f"bits{i}", word).bitwiseAND(mask))


def random_intervals(lengths: DataFrame, seqs: DataFrame, tries: int, max_n: float, seed: int, max_rep: float | None = None) -> DataFrame:
    """For each (id, length) an interval of that length on seqs (id, seq[, masked_seq]), where N makes up
    at most max_n of it and, if max_rep is given, at most that percentage is hidden by masked_seq alone.

    `tries` candidates are drawn by hash over the sequences' joined lengths in id order; the
    first that is wholly inside a sequence and clear enough counts, and an id with none has no
    row.  Sequences are read once, and what is written of them is a bit for each base, with
    running counts.  Running lengths go by ranges; a draw meets the sequences of its stretch of
    the joined lengths, two on average, and then one tile, or two where it crosses a bound: no
    task holds all sequences, and no sequence is copied for each draw.  A masked sequence that is
    null hides nothing.
    """
    columns = ["seq"] + (["masked_seq"] if max_rep is not None else [])
    tiles = _cut(hidden_tiles(seqs.withColumn("masked_seq", F.coalesce("masked_seq", "seq")) if max_rep is not None else seqs, columns, TILE).withColumnRenamed("id", "chrom"))
    ends = prefix_scan(tiles.filter("t = 0").select("chrom", "size"), [], ["chrom"], {"at": ("sum", F.col("size"))}, before=True).withColumn("at", F.coalesce("at", F.lit(0)))
    total, n = ends.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # As many stretches as sequences at least: draws are even, so the pairs stay in proportion to them, however lengths differ.
    stretch = max(1, total // max(n, STRETCHES))
    of = lambda x: F.floor(x / stretch).cast("long")
    places = ends.withColumn("s", F.explode(F.sequence(of(F.col("at")), of(F.col("at") + F.col("size") - 1))))
    met = _draws(lengths, tries, seed, total).withColumn("s", of(F.col("x"))).join(places, "s").withColumn("lo", F.col("x") - F.col("at")).withColumn("hi", F.col("lo") + F.col("length"))
    inside = met.filter("lo >= 0 and hi <= size").select("id", "k", "length", "chrom", "lo", "hi")
    lo, last = F.col("lo"), F.col("hi") - 1
    tile = lambda x: F.floor(x / TILE).cast("long")
    looked = inside.withColumn("t", F.explode(F.array_distinct(F.array(tile(lo), tile(last))))).join(tiles.drop("size"), ["chrom", "t"])
    # What lies up to the interval's end less what lies before its start, each read off its own tile.
    part = lambda i: F.when(F.col("t") == tile(last), _rank(i, last % TILE, True)).otherwise(0) - F.when(F.col("t") == tile(lo), _rank(i, lo % TILE, False)).otherwise(0)
    sides = looked.select("id", "k", "length", "chrom", "lo", "hi", *(part(i).alias(f"n{i}") for i in range(len(columns))))
    # One shuffle by id serves both groupings.
    shares = sides.repartition("id").groupBy("id", "k", "length", "chrom", "lo", "hi").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(columns))))
    good = shares.filter(F.col("n0") <= max_n * F.col("length"))
    if max_rep is not None:
        good = good.filter(100.0 * (F.col("n1") - F.col("n0")) <= max_rep * F.col("length"))
    return good.groupBy("id").agg(F.min(F.struct("k", "chrom", "lo", "hi")).alias("b")).select("id", "b.chrom", "b.lo", "b.hi")


def pseudo_orthologs(orthologs: DataFrame, seed: int) -> DataFrame:
    """The same genes and partners, as often each, in pairs that the seed fixes: a control without relation.

    Ranks are per species of the partner, so that a partner stays in its species.
    """
    own = Window.partitionBy("species").orderBy(_hash(seed, "query_gene", "target_gene"), "query_gene", "target_gene")
    other = Window.partitionBy("species").orderBy(_hash(seed + 1, "target_gene", "query_gene"), "target_gene", "query_gene")
    a = orthologs.select("species", "query_gene", F.row_number().over(own).alias("r"))
    b = orthologs.select("species", "target_gene", F.row_number().over(other).alias("r"))
    return a.join(b, ["species", "r"]).select("species", "query_gene", "target_gene")


def random_orthologs(source: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    """Each source id with one target, by its hash modulo the number of targets in id order."""
    n = target.count()
    ranked = prefix_scan(target.select(F.col("id").alias("ortholog")), [], ["ortholog"], {"r": ("sum", F.lit(1).cast("long"))}).withColumn("r", F.col("r") - 1)
    draw = F.conv(F.substring(_hash(seed, "id"), 1, 12), 16, 10).cast("long") % max(n, 1)
    return source.select("id", draw.alias("r")).join(ranked, "r").select("id", "ortholog")
