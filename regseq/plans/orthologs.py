"""Reciprocal best hits: two sets of sequences to an ortholog table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regseq.functions.sequence import gene_from_description
from regseq.operators import joins


def search_orthologs(a: DataFrame, b: DataFrame, k: int = 8, min_shared: int = 3) -> DataFrame:
    """(query_protein, target_protein, target_gene, query_gene); a and b have id, description and seq.

    Similarity is the share of k-mers, so 1 - score stands in for a significance.
    """
    there = joins.kmer_hits(a, b, k, min_shared).select("query", "target", (1 - F.col("score")).alias("significance"), F.lit("a").alias("query_db"), F.lit("b").alias("target_db"))
    back = joins.kmer_hits(b, a, k, min_shared).select("query", "target", (1 - F.col("score")).alias("significance"), F.lit("b").alias("query_db"), F.lit("a").alias("target_db"))
    pairs = joins.reciprocal_best_hits(there.union(back)).filter("db_a = 'a'").select(F.col("a").alias("query_protein"), F.col("b").alias("target_protein"))
    gene = lambda df, key, name: df.select(F.col("id").alias(key), gene_from_description("description").alias(name))
    rows = gene(a, "query_protein", "query_gene").join(pairs, "query_protein", "left").join(gene(b, "target_protein", "target_gene"), "target_protein", "left")
    return rows.select("query_protein", "target_protein", "target_gene", "query_gene")
