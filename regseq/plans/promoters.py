"""Promoter extraction: annotation and sequences to trimmed promoters with their bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regseq.functions.sequence import gff_attribute
from regseq.operators import aggregates, joins, quality, sweeps


def gene_bed(gff: DataFrame, prefix: str) -> DataFrame:
    """(name, chrom, lo, hi, strand) of gene lines; start - 1 makes the closed 1-based bounds half-open.
    Gene lines without the attribute raise."""
    rows = quality.gene_lines(gff).withColumn("name", gff_attribute("attributes", prefix))
    lost = rows.filter("name is null").select("attributes").limit(5).collect()
    if lost:
        raise ValueError(f"gene lines without {prefix}: {[r[0] for r in lost]}")
    return rows.select("name", F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("lo"), F.col("end").alias("hi"), "strand")


def extract_promoters(gff: DataFrame, seqs: DataFrame, prefix: str, length: int, to_cds: bool = False, trim: bool = True, kick: bool = True) -> DataFrame:
    """(name, chrom, lo, hi, strand, seq): flanks of genes, drawn on to the coding bases, cut back at other genes, one piece a gene."""
    genes = gene_bed(gff, prefix)
    out = sweeps.flank(genes, seqs.select("id", F.length("seq").alias("length")), length).select("name", "chrom", "lo", "hi", "strand")
    if to_cds:
        spans = aggregates.cds_span(sweeps.assign_gene(gff, gff_attribute("attributes", prefix)))
        out = sweeps.extend_to_cds(out, spans.withColumnRenamed("gene_id", "name"))
    if trim:
        out = sweeps.trim_overlaps(out, genes, kick)
    return joins.extract_sequence(sweeps.nearest_piece(out.select("name", "chrom", "lo", "hi", "strand")), seqs)
