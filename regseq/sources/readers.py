"""Readers.  Schemas are explicit, and rows that do not fit are counted, not lost in silence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GFF = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, seq), one row a record; wrapped lines are joined and blank lines dropped."""
    record = F.regexp_replace(F.col("value"), "\r", "")
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(record, "^>", "").alias("record")).filter(F.trim("record") != "")
    head = F.substring_index("record", "\n", 1)
    body = F.when(F.instr("record", "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise(F.lit(""))
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), F.regexp_replace(body, r"\s", "").alias("seq"))


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns and line_no, which ascends in file order; comment lines are left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GFF)
    order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return rows.select("*", order.alias("line_no"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, lo, hi, name, score, strand) of lines of six fields or more, split at white space."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") >= 6)
    names = [("chrom", "string"), ("lo", "int"), ("hi", "int"), ("name", "string"), ("score", "string"), ("strand", "string")]
    return rows.select(*(F.col("p").getItem(k).cast(t).alias(n) for k, (n, t) in enumerate(names)))


def bed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """How many lines read_bed leaves out."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.agg(F.count_if(F.size(F.split(F.trim("value"), r"\s+")) < 6).alias("rejected"), F.count("*").alias("lines"))


def read_orthologs(spark: SparkSession, path: str) -> DataFrame:
    """Four columns; a gene "unknown" is the protein's id up to its first dot; rows without a partner ("none") go."""
    rows = spark.read.csv(path, sep="\t", schema="query_protein string, target_protein string, target_gene string, query_gene string")
    return fill_unknown(rows).filter(F.col("target_protein") != "none")


def fill_unknown(orthologs: DataFrame) -> DataFrame:
    gene = lambda gene, protein: F.when(F.col(gene) == "unknown", F.substring_index(protein, ".", 1)).otherwise(F.col(gene)).alias(gene)
    return orthologs.select("query_protein", "target_protein", gene("target_gene", "target_protein"), gene("query_gene", "query_protein"))


def read_hits(spark: SparkSession, path: str, max_hits: int) -> DataFrame:
    """(query, target) of tab-separated hits, without queries of more than max_hits hits."""
    return limit_hits(spark.read.csv(path, sep="\t", schema="query string, target string"), max_hits)


def limit_hits(hits: DataFrame, max_hits: int) -> DataFrame:
    return hits.withColumn("__n", F.count("*").over(Window.partitionBy("query"))).filter(F.col("__n") <= max_hits).drop("__n")


def read_chip_loci(spark: SparkSession, path: str) -> DataFrame:
    """(region, position, gene_id, strand): three columns, all on the positive strand."""
    return spark.read.csv(path, sep="\t", schema="region string, position int, gene_id string").withColumn("strand", F.lit("+"))


def read_factor_map(spark: SparkSession, path: str) -> DataFrame:
    """(factor, accession) without factors that have none; the first line is a header."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="factor string, accession string")
    return rows.withColumn("accession", F.trim("accession")).filter("accession is not null and accession not in ('', 'NONE')")


def intervals_from_fasta(seqs: DataFrame, ids: DataFrame | None = None, length: int | None = None) -> DataFrame:
    """(id, lo, hi, seq): whole records, or the last `length` bases, of all records or the listed ids."""
    rows = seqs.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else seqs
    size = F.length("seq")
    lo = F.greatest(size - length, F.lit(0)) if length is not None else F.lit(0)
    return rows.select("id", lo.alias("lo"), size.alias("hi"), F.col("seq").substr(lo + 1, size).alias("seq"))


def chrom_sizes(seqs: DataFrame) -> DataFrame:
    return seqs.select("id", F.length("seq").alias("length"))
