"""Aggregations over annotation, sequences, window pairs and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regseq.functions.kernels import gram_counts, position_counts


def cds_span(gff: DataFrame) -> DataFrame:
    """(gene_id, lo, hi) of all CDS lines of each gene; gff has gene_id (sweeps.assign_gene), start and end 1-based and closed."""
    return gff.filter("type = 'CDS' and gene_id is not null").groupBy("gene_id").agg((F.min("start") - 1).alias("lo"), F.max("end").alias("hi"))


def utrs(genes: DataFrame, cds: DataFrame) -> DataFrame:
    """(gene_id, utr5_lo, utr5_hi, utr3_lo, utr3_hi): what lies before and behind the coding bases."""
    rows = genes.join(cds.select("gene_id", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi")), "gene_id")
    plus = F.col("strand") == "+"
    return rows.select("gene_id", F.when(plus, F.col("lo")).otherwise(F.col("c_hi")).alias("utr5_lo"), F.when(plus, F.col("c_lo")).otherwise(F.col("hi")).alias("utr5_hi"), F.when(plus, F.col("c_hi")).otherwise(F.col("lo")).alias("utr3_lo"), F.when(plus, F.col("hi")).otherwise(F.col("c_lo")).alias("utr3_hi"))


def count_matrix(aligned: DataFrame) -> DataFrame:
    """(motif_id, pos, A, C, G, T) from aligned sequences (motif_id, seq); unequal lengths of one motif raise."""
    length = F.length("seq")
    bad = aligned.groupBy("motif_id").agg(F.min(length).alias("a"), F.max(length).alias("b")).filter("a <> b").limit(1).collect()
    if bad:
        raise ValueError(f"sequences of unequal length in motif {bad[0]['motif_id']}")
    return position_counts(aligned).groupBy("motif_id", "pos").agg(*(F.sum(b).alias(b) for b in "ACGT"))


def profiles(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, offset, score): the best score of each offset of either sequence."""
    side = lambda n: pairs.select("pair_id", F.lit(n).alias("side"), F.col(f"offset{n}").alias("offset"), "score")
    return side(1).union(side(2)).groupBy("pair_id", "side", "offset").agg(F.max("score").alias("score"))


def alignmax(pair_ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best score of every pair, 0 for those without window pairs."""
    best = pairs.groupBy("pair_id").agg(F.max("score").alias("score"))
    return pair_ids.select("pair_id").distinct().join(best, "pair_id", "left").select("pair_id", F.coalesce("score", F.lit(0)).alias("score"))


def score_histogram(pairs: DataFrame, width: int, bins: int) -> DataFrame:
    """(bin, n) of the scores 0 to width: bin i begins at score int((width + 1) * i / bins)."""
    spine = pairs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # The last bin whose beginning is not above the score.
    bin_ = F.least(F.floor(((F.floor("score") + 1) * bins - 1) / (width + 1)), F.lit(bins - 1)).cast("int")
    counts = pairs.filter(F.col("score").between(0, width)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def markov_model(seqs: DataFrame, order: int) -> DataFrame:
    """(context, base, n, p): how bases follow `order` bases; only A, C, G, T, never across sequences."""
    gram, n = F.col("gram"), F.sum("n").alias("n")
    counts = gram_counts(seqs, order + 1).groupBy("gram").agg(n).select(gram.substr(1, order).alias("context"), gram.substr(order + 1, 1).alias("base"), "n")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("context")))


def region_counts(modules: DataFrame, conservation: float) -> DataFrame:
    return modules.groupBy("gene_id").agg(F.countDistinct("bundle_id").alias("n_sets"), F.count("*").alias("n_modules"), F.count_if(F.col("conservation") >= conservation).alias("n_conserved"))


def motif_presence(hits: DataFrame, presence: DataFrame, keep: int = 100) -> DataFrame:
    """Presence over a set of sequences: summed counts, names, and the lowest `keep` p-values of each motif."""
    base = presence.groupBy("motif").agg(F.sum("count").alias("count"), F.sum("collected_scores").alias("collected_scores"), F.array_join(F.array_sort(F.collect_set("seq_id")), ",").alias("sequences"))
    rank = F.row_number().over(Window.partitionBy("motif").orderBy("pvalue", "seq_id"))
    low = hits.withColumn("__r", rank).filter(F.col("__r") <= keep).groupBy("motif").agg(F.sort_array(F.collect_list("pvalue")).alias("pvalues"))
    return base.join(low, "motif", "left")


def molecule_likelihood(df: DataFrame) -> DataFrame:
    return df.groupBy("molecule").agg(F.max("likelihood").alias("likelihood"))


def compact_sequences(seqs: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of each identity, the first loaded; annotations of all its rows, each once.  Unequal texts of one identity raise."""
    bad = seqs.groupBy("identity").agg(F.countDistinct("seq").alias("n")).filter("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"different sequences of identity {bad[0]['identity']}")
    one = seqs.groupBy("identity").agg(F.min_by("description", "load_order").alias("description"), F.min_by("seq", "load_order").alias("seq"), F.min("load_order").alias("load_order"))
    first = annotations.groupBy("identity", "annotation_id").agg(F.min_by("type", "load_order").alias("type"), F.min_by("lo", "load_order").alias("lo"), F.min_by("hi", "load_order").alias("hi"))
    return one, first


def merge_genes(genes: DataFrame) -> DataFrame:
    """One row of each accession with all metadata; of a key's values the first loaded counts."""
    flat = genes.select("accession", "load_order", F.explode(F.map_entries("metadata")).alias("e")).select("accession", "load_order", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    best = flat.groupBy("accession", "k").agg(F.min_by("v", "load_order").alias("v"))
    merged = best.groupBy("accession").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    return genes.select("accession").distinct().join(merged, "accession", "left")


def possible_sites(intervals: DataFrame, width: int) -> DataFrame:
    """Places on both strands where a motif of `width` bases fits."""
    return intervals.agg(F.coalesce(F.sum(2 * F.greatest(F.col("hi") - F.col("lo") - width + 1, F.lit(0))), F.lit(0)).cast("long").alias("sites"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Directed (src, dst): bidirectional edges both ways."""
    return edges.select("src", "dst").union(edges.filter("bidir").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def out_degree(edges: DataFrame) -> DataFrame:
    return symmetric(edges).distinct().groupBy("src").agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
