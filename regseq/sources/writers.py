"""Writers: each builds its lines as columns and leaves the files to Spark's tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fasta_lines(df: DataFrame, details: bool = False) -> DataFrame:
    """One row a record: `>label(five:three)` and the sequence; details adds database, conservation and belief."""
    text = [F.format_string(">%s(%d:%d)", F.col("label"), F.col("five"), F.col("three"))]
    if details:
        text += [F.concat(F.lit("dbname="), F.col("db")), F.concat(F.lit("conservation="), F.col("conservation").cast("string")), F.concat(F.lit("belief_score="), F.col("belief").cast("string"))]
    return df.select(F.concat_ws("\n", F.concat_ws(" ", *text), "seq").alias("value"))


def write_fasta(df: DataFrame, path: str, details: bool = False) -> None:
    fasta_lines(df, details).write.text(path)


def write_bed(df: DataFrame, path: str) -> None:
    df.select("chrom", "lo", "hi", "name", "score", "strand").write.csv(path, sep="\t")


def write_orthologs(df: DataFrame, path: str) -> None:
    ortholog_rows(df).write.csv(path, sep="\t")


def ortholog_rows(df: DataFrame) -> DataFrame:
    """Missing partners are "none", missing genes "unknown"."""
    return df.select("query_protein", F.coalesce("target_protein", F.lit("none")).alias("target_protein"), F.when(F.col("target_protein").isNull(), "none").otherwise(F.coalesce("target_gene", F.lit("unknown"))).alias("target_gene"), F.coalesce("query_gene", F.lit("unknown")).alias("query_gene"))


def _shown(column: str) -> Column:
    """A field of text; an unknown value is an empty field and not one field less."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _place(df: DataFrame) -> list[Column]:
    """The order of a gene's elements: by bundle, the centre's own stretch first, then by species, partner and start."""
    return [F.col("bundle_id").alias("bundle_id"), (F.col("species") != "centre").alias("other"), F.col("species"), F.col("partner") if "partner" in df.columns else F.lit("").alias("partner"), F.col("start")]


def _partners(df: DataFrame) -> DataFrame:
    """(gene_id, species, partner) of the elements but for the centre genes' own."""
    return df.filter((F.col("species") != "centre") & F.col("partner").isNotNull()).select("gene_id", "species", "partner").distinct()


def cns_tabular(df: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """One line a centre gene: the gene, its partner genes, then sequence, conservation and belief of each element.

    Every field is followed by a tab.  Elements come by bundle, the centre's own stretch
    (species "centre") first; the centre is no partner of itself.  comparisons (gene_id,
    species, partner) names all partners, with elements or without; else those of the elements.
    """
    fields = F.concat(*(x for c in ("seq", "conservation", "belief") for x in (_shown(c), F.lit("\t"))))
    rows = df.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct(*_place(df), fields.alias("text")))).alias("e"))
    partners = (comparisons if comparisons is not None else _partners(df)).groupBy("gene_id").agg(F.array_sort(F.collect_set("partner")).alias("p"))
    both = partners.join(rows, "gene_id", "full")
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    return both.select(F.concat("gene_id", F.lit("\t"), text("p", lambda x: F.concat(x, F.lit("\t"))), text("e", lambda x: x["text"])).alias("value"))


def write_cns_tabular(df: DataFrame, path: str, comparisons: DataFrame | None = None) -> None:
    cns_tabular(df, comparisons).write.text(path)


def cns_blocks(df: DataFrame, comparisons: DataFrame | None = None) -> DataFrame:
    """One row a centre gene, a field a line, in nested blocks.

    --PairStart, the gene and its strand, and of each comparison species, partner gene, its
    strand and best window score; --RemoStart; for each bundle --InnerStart, its elements and
    --InnerEnd; --RemoEnd and --PairEnd.  An element is "--Organism: " and its species,
    sequence, strand, the positions of its 5' and 3' ends, conservation, belief and repeat ratio.

    df are elements with their place on the region (lo, hi, strand); without it they lie on
    their own sequence.  Positions count from 1 and belong to the element.  comparisons:
    (gene_id, gene_strand, species, partner, partner_strand, alignmax), also of genes without
    elements; else the partners of the elements, and what is unknown is an empty line.
    """
    placed = "lo" in df.columns
    lo, hi = (F.col("lo"), F.col("hi")) if placed else (F.col("start"), F.col("end") + 1)
    strand = F.col("strand") if placed else F.lit("+")
    more = {"__strand": strand, "__five": F.when(strand == "-", hi).otherwise(lo + 1), "__three": F.when(strand == "-", lo + 1).otherwise(hi)}
    known = df.withColumns(more | ({} if "repeat_ratio" in df.columns else {"repeat_ratio": F.lit(None).cast("double")}))
    line = F.concat_ws("\n", F.concat(F.lit("--Organism: "), _shown("species")), *(_shown(c) for c in ("seq", "__strand", "__five", "__three", "conservation", "belief", "repeat_ratio")))
    bundles = known.groupBy("gene_id", "bundle_id").agg(F.sort_array(F.collect_list(F.struct(*_place(df), line.alias("text")))).alias("e"))
    inner = F.concat_ws("\n", F.lit("--InnerStart"), F.array_join(F.transform("e", lambda x: x["text"]), "\n"), F.lit("--InnerEnd"))
    inner = bundles.groupBy("gene_id").agg(F.sort_array(F.collect_list(F.struct("bundle_id", inner.alias("text")))).alias("b"))
    if comparisons is None:
        comparisons = _partners(df).withColumns({c: F.lit(None).cast("string") for c in ("gene_strand", "partner_strand", "alignmax")})
    pair = F.concat_ws("\n", *(_shown(c) for c in ("species", "partner", "partner_strand", "alignmax")))
    pairs = comparisons.groupBy("gene_id").agg(F.min("gene_strand").alias("gene_strand"), F.sort_array(F.collect_set(F.struct("species", "partner", pair.alias("text")))).alias("p"))
    rows = pairs.join(inner, "gene_id", "full")
    lines = lambda c: F.coalesce(F.transform(c, lambda x: x["text"]), F.array().cast("array<string>"))
    whole = F.concat(F.array(F.lit("--PairStart"), "gene_id", _shown("gene_strand")), lines("p"), F.array(F.lit("--RemoStart")), lines("b"), F.array(F.lit("--RemoEnd"), F.lit("--PairEnd")))
    return rows.select(F.array_join(whole, "\n").alias("value"))


def write_cns_blocks(df: DataFrame, path: str, comparisons: DataFrame | None = None) -> None:
    cns_blocks(df, comparisons).write.text(path)


def alignmax_lines(pairs: DataFrame) -> DataFrame:
    """Best score of each pair."""
    return pairs.groupBy("pair_id").agg(F.max("score").alias("score")).select(F.concat_ws("\t", "pair_id", F.col("score").cast("string")).alias("value"))


def write_alignmax(pairs: DataFrame, path: str) -> None:
    alignmax_lines(pairs).write.text(path)


def cns_fasta(df: DataFrame) -> DataFrame:
    """(gene_id, number of the bundle in its gene, records)."""
    numbered = df.withColumn("n", F.dense_rank().over(Window.partitionBy("gene_id").orderBy("bundle_id")))
    record = F.struct("species", "start", F.format_string(">%s(%d:%d)\n%s", "species", "start", "end", "seq").alias("text"))
    return numbered.groupBy("gene_id", "n").agg(F.sort_array(F.collect_list(record)).alias("r")).select("gene_id", "n", F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("value"))


def write_cns_fasta(df: DataFrame, path: str) -> None:
    cns_fasta(df).write.partitionBy("gene_id", "n").text(path)


def report_regions(df: DataFrame, conservation: float, species: str | None = None) -> DataFrame:
    """Sets, modules, and modules of at least `conservation`, by gene; of one species if it is named."""
    rows = df.filter(F.col("species") == species) if species is not None else df
    return rows.groupBy("gene_id").agg(F.countDistinct("bundle_id").alias("n_sets"), F.count("*").alias("n_modules"), F.count_if(F.col("conservation") >= conservation).alias("n_conserved"), F.max("belief").alias("best_belief"))


def bundle_table(df: DataFrame, seqs: DataFrame) -> DataFrame:
    """Elements with the stretches of their partner's sequence that they cover, masked and not, for inspection.

    seqs: (gene_id, species, seq, masked_seq).  The centre's own stretch is of the centre gene,
    which is its partner, and shows the centre's species; it has no target.
    """
    piece = lambda c: F.col(c).substr(F.col("start") + 1, F.col("end") - F.col("start") + 1)
    texts = seqs.select(F.col("gene_id").alias("partner"), F.col("species").alias("__species"), F.col("seq").alias("__seq"), F.col("masked_seq").alias("__masked"))
    own = F.col("species") == "centre"
    target = lambda c: F.when(~own, F.col(c)).alias(c)
    return df.join(texts, "partner").filter(own | (F.col("species") == F.col("__species"))).select("gene_id", "bundle_id", F.col("__species").alias("species"), "partner", "start", "end", target("target_start"), target("target_end"), "conservation", "repeat_ratio", "belief", piece("__masked").alias("masked_piece"), piece("__seq").alias("piece"))
