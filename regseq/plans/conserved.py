"""Conserved regions of several species: promoters and orthologs to scored, bundled regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regseq.functions.sequence import mask_iupac
from regseq.operators import conservation as c
from regseq.operators import joins, quality, sweeps, topk
from regseq.operators.graph import _cut


def conserved_regions(seqs: DataFrame, orthologs: DataFrame, width: int = c.WIDTH, low: int = c.LOW, high: int = c.HIGH, least: float = c.BELIEF, tolerance: int = c.TOLERANCE, pseudo_seed: int | None = None, centre: bool = False) -> DataFrame:
    """Elements (gene_id, bundle_id, species, partner, start, end, target_start, target_end, conservation,
    belief, integrate, repeat_ratio, seq, bundle_conservation, max_all).

    seqs: (gene_id, species, seq, masked_seq); orthologs: (query_gene, target_gene).  With a
    pseudo_seed the partners are permuted within their species, as a control.  Each partner gene
    is a comparison of its own, also where two are of one species.  centre=True adds the centre
    gene's own stretch of each bundle as species "centre", with itself as partner and no
    conservation.  Repeated rows of either table count once.  A gene_id of several species or
    of several sequences is ambiguous and raises; so do pairs beyond the size limit.
    """
    seqs = seqs.select("gene_id", "species", "seq", "masked_seq").distinct()
    unclear = seqs.groupBy("gene_id").count().filter("count > 1").orderBy("gene_id").limit(5).collect()
    if unclear:
        raise ValueError(f"genes of several species or sequences: {[r[0] for r in unclear]}")
    clean = quality.min_length(seqs.withColumns({"seq": mask_iupac("seq"), "masked_seq": mask_iupac(F.coalesce("masked_seq", "seq"))}), width)
    if pseudo_seed is not None:
        named = orthologs.join(seqs.select(F.col("gene_id").alias("target_gene"), "species"), "target_gene")
        orthologs = topk.pseudo_orthologs(named, pseudo_seed).select("query_gene", "target_gene")
    pairs = quality.size_guard(joins.comparison_pairs(clean, orthologs))
    large = pairs.filter("not ok").select("pair_id").limit(5).collect()
    if large:
        raise ValueError(f"pairs beyond the size limit: {[r[0] for r in large]}")
    # Repeats only lower a score, and one whose whole percentage is not above the lower threshold has no belief.
    cutoff = -(-(low + 1) * width // 100)
    masks = clean.select("gene_id", "masked_seq")
    both = pairs.join(masks.withColumnRenamed("masked_seq", "masked1"), "gene_id").join(masks.toDF("partner", "masked2"), "partner")
    names = pairs.select("pair_id", "gene_id", "species", "partner")
    keyed = c.merge_strands(both, width, cutoff, repeats=True).join(names, "pair_id")
    scored = c.score_pairs(keyed, width=width, low=low, high=high)
    # Every later step reads this; it is written once.
    thinned = _cut(c.thin_partners(scored, width))
    combined = _cut(c.combine_belief(thinned, least))
    bundles = c.assemble(combined, width, tolerance)
    elements = c.merge_elements(c.prune_partners(thinned, combined, least), bundles, width, tolerance)
    order = clean.select("species").distinct().withColumn("species_idx", F.col("species"))
    best = c.bundle_conservation(elements, order).withColumnRenamed("conservation", "bundle_conservation")
    none = lambda like: F.lit(None).cast(elements.schema[like].dataType).alias(like)
    own = c.centre_elements(combined, bundles, width).select(
        "gene_id", "bundle_id", F.lit("centre").alias("species"), F.col("gene_id").alias("partner"), "start", "end",
        F.col("start").alias("target_start"), F.col("end").alias("target_end"), none("conservation"), "belief", none("integrate"),
    )
    texts = clean.select(F.col("gene_id").alias("partner"), "seq", "masked_seq")
    rows = c.element_repeat_ratio(elements.unionByName(own) if centre else elements, texts).join(texts.select("partner", "seq"), "partner")
    piece = F.col("seq").substr(F.col("start") + 1, F.col("end") - F.col("start") + 1)
    return rows.withColumn("seq", piece).join(best, ["gene_id", "bundle_id"])


def regulatory_regions(genes: DataFrame, seqs: DataFrame, length: int, ids: DataFrame | None = None) -> DataFrame:
    """(gene_id, chrom, lo, hi, strand, seq): up to `length` bases before each gene, cut back at other genes.

    genes: (name, chrom, lo, hi, strand); seqs: (id, seq); ids: (name) of the wanted genes, all
    of the genome without it.  All genes cut regions back, wanted or not.
    """
    sizes = seqs.select("id", F.length("seq").alias("length"))
    wanted = genes if ids is None else genes.join(ids.select("name").distinct(), "name", "left_semi")
    flanks = sweeps.flank(wanted, sizes, length).select("name", "chrom", "lo", "hi", "strand")
    kept = sweeps.nearest_piece(sweeps.trim_overlaps(flanks, genes, True).select("name", "chrom", "lo", "hi", "strand"))
    return joins.extract_sequence(kept, seqs).withColumnRenamed("name", "gene_id")


def regions_of_orthologs(genes: DataFrame, seqs: DataFrame, orthologs: DataFrame, length: int, species: DataFrame, **parameters: object) -> DataFrame:
    """Conserved elements in the regions of genes and of their orthologs.

    orthologs: (query_gene, target_gene); species: (name, species) of every gene; parameters go
    to conserved_regions.
    """
    ids = orthologs.select(F.col("query_gene").alias("name")).union(orthologs.select("target_gene")).distinct()
    regions = regulatory_regions(genes, seqs, length, ids).join(species.withColumnRenamed("name", "gene_id"), "gene_id")
    return conserved_regions(regions.select("gene_id", "species", "seq", F.col("seq").alias("masked_seq")), orthologs, **parameters)
