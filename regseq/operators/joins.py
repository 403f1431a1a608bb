"""Joins: gene tables, orthologs, overlaps, paired sites, shared k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regseq.functions.kernels import distinct_kmers, kmer_table
from regseq.functions.sequence import revcomp
from regseq.operators.graph import _cut

TILE = 10_000


def gene_lookup(promoters: DataFrame, utr5: DataFrame, utr3: DataFrame) -> DataFrame:
    """Promoters with the bounds of their genes' UTRs, null where a gene has none."""
    part = lambda df, tag: df.select("species", F.col("name"), F.col("lo").alias(f"{tag}_lo"), F.col("hi").alias(f"{tag}_hi"))
    return promoters.join(part(utr5, "utr5"), ["species", "name"], "left").join(part(utr3, "utr3"), ["species", "name"], "left")


def comparison_pairs(seqs: DataFrame, orthologs: DataFrame) -> DataFrame:
    """Each centre gene's sequence beside that of each ortholog: (pair_id, gene_id, species, partner, seq1, seq2).

    Repeated sequences and orthologs count once.  pair_id names both species, so that an id
    that two species use stands for two genes.
    """
    once = seqs.select("gene_id", "species", "seq").distinct()
    one = once.select(F.col("gene_id").alias("query_gene"), F.col("species").alias("__own"), F.col("seq").alias("seq1"))
    two = once.select(F.col("gene_id").alias("target_gene"), "species", F.col("seq").alias("seq2"))
    rows = orthologs.select("query_gene", "target_gene").distinct().join(one, "query_gene").join(two, "target_gene")
    return rows.select(F.concat_ws("|", "query_gene", "__own", "species", "target_gene").alias("pair_id"), F.col("query_gene").alias("gene_id"), "species", F.col("target_gene").alias("partner"), "seq1", "seq2")


def n_best_hits(hits: DataFrame, n: int = 1) -> DataFrame:
    """The n hits of the lowest significance of each query in each target database, equal ones by target.

    Hits of a sequence on itself in its own database do not count.  An unknown significance is 100.
    """
    own = (F.col("query") == F.col("target")) & (F.col("query_db") == F.col("target_db"))
    scored = hits.filter(~own).withColumn("significance", F.coalesce("significance", F.lit(100.0)))
    rank = F.row_number().over(Window.partitionBy("query", "query_db", "target_db").orderBy("significance", "target"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def best_hits(hits: DataFrame) -> DataFrame:
    """As n_best_hits(hits, 1), by a partial aggregation, so that a query of very many hits is no hot group."""
    own = (F.col("query") == F.col("target")) & (F.col("query_db") == F.col("target_db"))
    scored = hits.filter(~own).withColumn("significance", F.coalesce("significance", F.lit(100.0)))
    return scored.groupBy("query", "query_db", "target_db").agg(F.min(F.struct("significance", "target")).alias("b")).select("query", "query_db", "target_db", "b.target", "b.significance")


def reciprocal_best_hits(hits: DataFrame) -> DataFrame:
    """(a, b, weight): each is the other's best hit; weight is the geometric mean of the two significances."""
    best = best_hits(hits)
    there = best.select(F.col("query").alias("a"), F.col("target").alias("b"), F.col("query_db").alias("db_a"), F.col("target_db").alias("db_b"), F.col("significance").alias("w1"))
    back = best.select(F.col("query").alias("b"), F.col("target").alias("a"), F.col("query_db").alias("db_b"), F.col("target_db").alias("db_a"), F.col("significance").alias("w2"))
    return there.join(back, ["a", "b", "db_a", "db_b"]).select("a", "b", "db_a", "db_b", F.sqrt(F.col("w1") * F.col("w2")).alias("weight"))


def ortholog_mapping(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every id with its partner or "not found"; pairs are (a, b)."""
    return ids.select(F.col("id").alias("a")).distinct().join(pairs.select("a", "b"), "a", "left").select(F.col("a").alias("id"), F.coalesce("b", F.lit("not found")).alias("ortholog"))


def _tiles(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumn("__t", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor(F.greatest(F.col("hi") - 1, F.col("lo")) / tile))))


def overlap_join(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of intervals (id, chrom, lo, hi) that share a base: (id_a, id_b, chrom, lo, hi) of the shared stretch.

    Both sides are dealt to tiles of a chromosome, which makes an equi-join; a pair is made
    in the tile where its shared stretch begins, so only once.
    """
    x = _tiles(a.select(F.col("id").alias("id_a"), "chrom", "lo", "hi"), tile).withColumnsRenamed({"lo": "lo_a", "hi": "hi_a"})
    y = _tiles(b.select(F.col("id").alias("id_b"), "chrom", "lo", "hi"), tile).withColumnsRenamed({"lo": "lo_b", "hi": "hi_b"})
    lo, hi = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    return x.join(y, ["chrom", "__t"]).filter((lo < hi) & (F.floor(lo / tile) == F.col("__t"))).select("id_a", "id_b", "chrom", lo.alias("lo"), hi.alias("hi"))


def overlapping(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Intervals of a that share a base with one of b."""
    merged = b.select("chrom", "lo", "hi")
    x = _tiles(a.select("id", "chrom", "lo", "hi"), tile)
    y = _tiles(merged, tile).withColumnsRenamed({"lo": "lo_b", "hi": "hi_b"})
    hits = x.join(y, (x["chrom"] == y["chrom"]) & (x["__t"] == y["__t"]) & (x["lo"] < y["hi_b"]) & (y["lo_b"] < x["hi"]), "left_semi")
    return a.join(hits.select("id").distinct(), "id", "left_semi")


def sets_overlap(a: DataFrame, b: DataFrame) -> bool:
    return not overlapping(a, b).isEmpty()


def motif_proteins(motifs: DataFrame, factor_map: DataFrame) -> DataFrame:
    """Motifs with the accessions of their factors, which are known by their first six letters."""
    rows = motifs.select("motif_id", F.explode("factors").alias("factor")).withColumn("factor", F.substring("factor", 1, 6))
    return rows.join(factor_map, "factor").select("motif_id", "factor", "accession")


def pair_thresholds(pairs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """pairs (sp1, sp2, ...) with the thresholds a and b of the two species, in either order."""
    table = thresholds.select(F.least("sp_lo", "sp_hi").alias("sp_lo"), F.greatest("sp_lo", "sp_hi").alias("sp_hi"), "a", "b")
    return pairs.withColumns({"sp_lo": F.least("sp1", "sp2"), "sp_hi": F.greatest("sp1", "sp2")}).join(table, ["sp_lo", "sp_hi"], "left").drop("sp_lo", "sp_hi")


def pair_sites(a: DataFrame, b: DataFrame, width: int, min_spacing: int, max_spacing: int) -> DataFrame:
    """Best right-hand partner of each site of a: (seq_id, strand, pos_a, pos_b, score).

    A partner starts min_spacing to max_spacing bases behind the site's end.  With spacing rank
    m (1 for the closest allowed) the score is min(p1 (1 - (1 - p2)^m), p2 (1 - (1 - p1)^m)).
    Positions are dealt to tiles of the spacing range; a site meets two tiles.
    """
    tile = max_spacing - min_spacing + 1
    first = F.col("pos_a") + width + min_spacing
    x = a.select("seq_id", "strand", F.col("pos").alias("pos_a"), F.col("pvalue").alias("p1"))
    x = x.withColumn("__t", F.explode(F.array_distinct(F.array(F.floor(first / tile), F.floor((first + tile - 1) / tile)))))
    y = b.select("seq_id", "strand", F.col("pos").alias("pos_b"), F.col("pvalue").alias("p2"), F.floor(F.col("pos") / tile).alias("__t"))
    m = F.col("pos_b") - first + 1
    score = F.least(F.col("p1") * (1 - F.pow(1 - F.col("p2"), m)), F.col("p2") * (1 - F.pow(1 - F.col("p1"), m)))
    rows = x.join(y, ["seq_id", "strand", "__t"]).filter((m >= 1) & (m <= tile)).withColumn("score", score)
    best = rows.groupBy("seq_id", "strand", "pos_a").agg(F.min(F.struct("score", "pos_b")).alias("b"))
    return best.select("seq_id", "strand", "pos_a", "b.pos_b", "b.score")


def combine_motifs(presence: DataFrame, fraction: float, compat: bool = False) -> DataFrame:
    """Presences of factors seen in at least `fraction` of the sequences of a group; compat: in more than (1 + n) of that share."""
    total = presence.groupBy("group_id").agg(F.countDistinct("seq_id").alias("n"))
    seen = presence.groupBy("group_id", "motif").agg(F.countDistinct("seq_id").alias("k")).join(total, "group_id")
    good = F.col("k") > (1 + F.col("n")) * fraction if compat else F.col("k") >= F.col("n") * fraction
    return presence.join(seen.filter(good).select("group_id", "motif"), ["group_id", "motif"], "left_semi")


#: Orthologs of one family that one task of the join meets at most, on average.
FAMILY = 1000


def orthologs_from_homology(members: DataFrame, species: str, pattern: str = ".*") -> DataFrame:
    """(gene_id, ortholog, ortholog_species) of one species, from members (homology_id, gene_id, species).

    Each pair comes once, also where two genes share several families: it is made in the least
    of these only, so that the pairs themselves are neither shuffled nor compared.  Orthologs of
    a large family are dealt to salts, each of which meets all its genes.
    """
    known = members.filter("homology_id is not null and gene_id is not null")
    sides = lambda rows, *by: rows.groupBy(*by).agg(F.sort_array(F.collect_set("homology_id")).alias("__f"))
    x = sides(known.filter(F.col("species") == species), "gene_id").withColumn("homology_id", F.explode("__f"))
    y = sides(known.filter((F.col("species") != species) & F.col("species").rlike(pattern)), F.col("gene_id").alias("ortholog"), F.col("species").alias("ortholog_species")).withColumn("homology_id", F.explode("__f"))
    salts = y.groupBy("homology_id").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("__salts"))
    x = x.join(salts, "homology_id").withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    y = y.join(salts, "homology_id").withColumn("__s", F.pmod(F.xxhash64("ortholog", "ortholog_species"), "__salts").cast("int"))
    # Few bytes in, many rows out: a fixed number of partitions, which are not coalesced by their size.
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.sparkSession.sparkContext.defaultParallelism)
    several = lambda f: F.when(F.size(f) > 1, F.col(f))
    x = x.select("homology_id", "__s", "gene_id", several("__f").alias("__fx")).repartition(parts, "homology_id", "__s")
    y = y.select("homology_id", "__s", "ortholog", "ortholog_species", several("__f").alias("__fy")).repartition(parts, "homology_id", "__s")
    least = F.col("__fx").isNull() | F.col("__fy").isNull() | (F.array_min(F.array_intersect("__fx", "__fy")) == F.col("homology_id"))
    return x.join(y.hint("shuffle_merge"), ["homology_id", "__s"]).filter((F.col("gene_id") != F.col("ortholog")) & least).select("gene_id", "ortholog", "ortholog_species")


#: Targets of one k-mer that one task of the join meets at most, on average.
KMER_TARGETS = 1000


def _postings(kmers: DataFrame, tag: str) -> DataFrame:
    """(kmer, tag): the ids that hold each k-mer, as two hashes of them all and their number."""
    marks = F.struct(F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"), F.count("*").alias("n"))
    return kmers.groupBy("kmer").agg(marks.alias(tag))


def _shared_kmers(x: DataFrame, y: DataFrame) -> DataFrame:
    """(query, target, shared, score) of distinct k-mers x and y (id, n, kmer).

    K-mers that the same queries and the same targets hold, as those of one shared passage are,
    count as one with a weight.  K-mers of many targets are dealt to salts by target.
    """
    classes = _postings(x, "of_x").join(_postings(y, "of_y"), "kmer").groupBy("of_x", "of_y").agg(F.min("kmer").alias("kmer"), F.count("*").alias("weight"))
    salts = classes.select("kmer", "weight", F.ceil(F.col("of_y.n") / KMER_TARGETS).cast("int").alias("salts"))
    x = x.join(salts, "kmer").select(F.col("id").alias("query"), F.col("n").alias("n_query"), "kmer", "weight", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    y = y.join(salts, "kmer").select(F.col("id").alias("target"), F.col("n").alias("n_target"), "kmer", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"))
    score = F.col("shared") / F.least("n_query", "n_target")
    return x.join(y, ["kmer", "salt"]).groupBy("query", "target", "n_query", "n_target").agg(F.sum("weight").alias("shared")).select("query", "target", "shared", score.alias("score"))


def kmer_hits(a: DataFrame, b: DataFrame, k: int, min_shared: int) -> DataFrame:
    """(query, target, shared, score): shared distinct k-mers over the smaller set; an id names one sequence.

    All k-mers count; equal sequences are compared once.  A table of bits, of one size whatever
    the input, tells the scan of b which k-mers a may have; only these leave it, and the joins
    behind are exact.
    """
    cls = F.md5("seq")
    one = lambda s: s.select(cls.alias("id"), "seq")
    x = distinct_kmers(one(a), k, slots=True)
    table = kmer_table(x.select("slot"))
    x = _cut(x.drop("slot").dropDuplicates(["id", "kmer"]))
    y = _cut(distinct_kmers(one(b), k, table).dropDuplicates(["id", "kmer"]))
    met = _shared_kmers(x, y).filter(F.col("shared") >= min_shared).withColumnsRenamed({"query": "cls_a", "target": "cls_b"})
    ids = lambda s, name, key: s.select(F.col("id").alias(name), cls.alias(key)).distinct()
    return met.join(ids(a, "query", "cls_a"), "cls_a").join(ids(b, "target", "cls_b"), "cls_b").select("query", "target", "shared", "score")


def extract_sequence(intervals: DataFrame, seqs: DataFrame, tile: int = 1 << 16) -> DataFrame:
    """intervals (name, chrom, lo, hi, strand) with their bases, turned to their strand; those beyond the sequence are left out.

    Sequences are cut into tiles, so that no chromosome is one row of the join; an interval
    gathers the few tiles it touches.
    """
    # Tiles are cut from bytes, where a slice costs its own width.
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(tile))
    cuts = F.transform(F.array(F.col("seq").cast("binary")), lambda whole: F.transform(starts, lambda i: F.struct((i / tile).cast("long").alias("t"), whole.substr(i + 1, F.lit(tile)).cast("string").alias("s"))))
    seqs = seqs.join(intervals.select(F.col("chrom").alias("id")).distinct(), "id", "left_semi")
    tiles = seqs.select(F.col("id").alias("chrom"), F.length("seq").alias("size"), F.inline(F.get(cuts, 0)))
    wanted = intervals.filter("lo >= 0 and lo < hi").withColumn("t", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor((F.col("hi") - 1) / tile))))
    joined = wanted.join(tiles, ["chrom", "t"]).filter("hi <= size")
    whole = joined.groupBy(*intervals.columns).agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["s"]), "").substr((F.col("lo") - F.col("p")[0]["t"] * tile + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    return whole.select(*intervals.columns, F.when(F.col("strand") == "-", revcomp(text)).otherwise(text).alias("seq"))


