"""Filters, predicates and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regseq.functions.sequence import count_n

#: Biotypes that are kinds of pseudogenes, and of RNA genes.
PSEUDOGENES = (
    "pseudogene", "snoRNA-pseudogene", "scRNA-pseudogene", "snRNA_pseudogene", "scRNA_pseudogene", "snoRNA_pseudogene", "rRNA_pseudogene",
    "Mt_tRNA_pseudogene", "tRNA_pseudogene", "miRNA_pseudogene", "misc_RNA_pseudogene", "polymorphic_pseudogene", "unprocessed_pseudogene", "processed_pseudogene",
)
RNA_GENES = ("snRNA", "miRNA", "misc_RNA", "snoRNA", "rRNA")


def gene_lines(gff: DataFrame) -> DataFrame:
    return gff.filter(F.col("type") == "gene")


def min_length(df: DataFrame, width: int) -> DataFrame:
    return df.filter(F.length("seq") >= width)


def size_guard(pairs: DataFrame, most: int = 20000) -> DataFrame:
    """pairs with `ok`: are the two sequences no larger together than most * most."""
    return pairs.withColumn("ok", F.length("seq1").cast("long") * F.length("seq2") <= F.lit(most * most).cast("long"))


def threshold_regions(modules: DataFrame, least: float) -> DataFrame:
    """Module sets whose centre (species_idx 0) has a belief of at least `least`."""
    good = modules.filter((F.col("species_idx") == 0) & (F.col("belief") >= least)).select("gene_id", "bundle_id").distinct()
    return modules.join(good, ["gene_id", "bundle_id"], "left_semi")


def filter_by_db(modules: DataFrame, databases: list[str]) -> DataFrame:
    return modules.filter(F.col("db").isin(databases))


def neighbour_eligible(genes: DataFrame, pseudogenes: bool = False, rna: bool = False) -> DataFrame:
    """Genes that count as neighbours; pseudogenes and RNA genes do if the flags say so."""
    out = genes if pseudogenes else genes.filter(~F.coalesce("biotype", F.lit("")).isin(*PSEUDOGENES))
    return out if rna else out.filter(~F.coalesce("biotype", F.lit("")).isin(*RNA_GENES))


def annotations(df: DataFrame, kind: str | None = None, ids: list[str] | None = None, predicate: Column | None = None) -> DataFrame:
    """Annotations of a type, with one of the ids, and for which the predicate holds."""
    for test in (F.col("type") == kind if kind is not None else None, F.col("id").isin(ids) if ids is not None else None, predicate):
        df = df.filter(test) if test is not None else df
    return df


def real_accessions(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("accession").startswith("__"))


def significant_sites(df: DataFrame, cutoff: float) -> DataFrame:
    return df.filter(F.col("score") > cutoff)


def check_dna(seqs: DataFrame) -> DataFrame:
    """(ok, n_bad): do all sequences have IUPAC letters only."""
    bad = F.col("seq").rlike("[^ATGCRYSWKMDHBVNatgcryswkmdhbvn]")
    return seqs.agg(F.coalesce(F.bool_and(~bad), F.lit(True)).alias("ok"), F.count_if(bad).alias("n_bad"))


def check_protein(seqs: DataFrame) -> DataFrame:
    """(ok, n_bad): is no sequence of over 100 letters made of A, C, G, T and N for more than 90 %."""
    dna = F.length("seq") - F.length(F.translate(F.upper("seq"), "ACGTN", ""))
    bad = (F.length("seq") > 100) & (10 * dna > 9 * F.length("seq"))
    return seqs.agg(F.coalesce(F.bool_and(~bad), F.lit(True)).alias("ok"), F.count_if(bad).alias("n_bad"))


def total_length(df: DataFrame, by: str | None = None) -> DataFrame:
    """Bases of intervals (lo, hi), in all or by a column."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).cast("long").alias("total"), F.count("*").alias("n"))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (a null counts as broken)."""
    return df.agg(*(F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()))


def standard_rules() -> dict[str, Column]:
    return {"bad_strand": F.col("strand").isin("+", "-"), "bad_probability": F.col("pvalue").between(0, 1), "bad_window": F.col("window").between(10, 500), "bad_order": F.col("lo") <= F.col("hi")}


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys found twice or more."""
    return df.groupBy(key).count().filter("count > 1").withColumnRenamed("count", "n")


def single_database(df: DataFrame) -> DataFrame:
    return df.agg((F.countDistinct("db") <= 1).alias("single"), F.countDistinct("db").alias("n_db"))


def db_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("db").agg(F.countDistinct("gene_id").alias("n_genes"), F.count("*").alias("n_sequences"), F.sum(F.length("seq")).alias("bases"), F.sum(count_n("seq")).alias("hidden"))
