"""Queries of interval operators on events, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from regseq.functions import sequence as s
from regseq.operators import aggregates, joins, quality, sets, sweeps, topk
from regseq.operators.graph import _cut
from regseq.plans import bindings as b
from regseq.plans.bindings import greedy_sql, with_views

_TRIM = """
SELECT p.chrom, p.name, p.strand,
  CASE WHEN strand = '+' THEN least(hi, greatest(lo, coalesce((SELECT max(g.hi) FROM g WHERE g.chrom = p.chrom AND g.lo < p.hi), lo))) ELSE lo END AS lo,
  CASE WHEN strand = '-' THEN greatest(lo, least(hi, coalesce((SELECT min(g.lo) FROM g WHERE g.chrom = p.chrom AND g.hi > p.lo), hi))) ELSE hi END AS hi
FROM p"""


def flagship_promoters(spark, d):
    iv = _cut(b.placed(spark, d))
    trimmed = sweeps.trim_overlaps(b.promoters(iv), b.genes(iv), kick=True).select("name", "chrom", "lo", "hi", "strand")
    return joins.extract_sequence(trimmed, b.seqs(spark, d))


def trim_overlaps(spark, d):
    iv = b.intervals(spark, d)
    return sweeps.trim_overlaps(b.promoters(iv), b.genes(iv))


def merge_intervals(spark, d):
    return sweeps.merge_intervals(b.intervals(spark, d))


def region_intervals(spark, d):
    return sweeps.region_intervals(b.intervals(spark, d).withColumnRenamed("type", "gene_id"))


def total_length(spark, d):
    return quality.total_length(sweeps.merge_intervals(b.intervals(spark, d)), "chrom")


def overlap_join(spark, d):
    iv = b.intervals(spark, d)
    return joins.overlap_join(b.promoters(iv), b.genes(iv))


def overlapping(spark, d):
    iv = b.intervals(spark, d)
    return joins.overlapping(b.promoters(iv), b.genes(iv)).select("id", "chrom", "lo", "hi")


def _loci(spark, d):
    return b.intervals(spark, d).select("chrom", F.col("lo").alias("position"), F.col("name").alias("gene_id"), "strand", "lo", "hi")


def neighbours(spark, d):
    return sweeps.neighbours_of(_loci(spark, d), b.intervals(spark, d))


_NEAR = """near AS (SELECT l.chrom, l.lo AS position, l.name AS gene_id, l.strand, l.lo, l.hi,
  (SELECT max({'at': g.hi, 'id': g.id}) FROM iv g WHERE g.chrom = l.chrom AND g.lo < l.lo AND g.id <> l.name) AS lft,
  (SELECT max({'at': -g.lo, 'id': g.id}) FROM iv g WHERE g.chrom = l.chrom AND g.hi > l.lo + 1 AND g.id <> l.name) AS rgt FROM iv l),
nb AS (SELECT *, lft.id AS left_id, greatest(position - lft.at, 0) AS left_distance, rgt.id AS right_id, greatest(-rgt.at - position - 1, 0) AS right_distance FROM near)"""


def core_promoter(spark, d):
    return sweeps.core_promoter(_loci(spark, d), b.intervals(spark, d), 1000, 200)


def stop_at_neighbour(spark, d):
    slices = _loci(spark, d).select("chrom", "position", "gene_id", (F.col("lo") - 500).alias("lo"), (F.col("lo") + 500).alias("hi"))
    return sweeps.stop_at_neighbour(slices, b.intervals(spark, d))


def locus_region(spark, d):
    iv = b.intervals(spark, d)
    sizes = iv.select(F.col("chrom").alias("id")).distinct().withColumn("length", F.lit(201000))
    return sweeps.locus_region(_loci(spark, d), iv, sizes, "upstream", 800, 100)


def flank(spark, d):
    return sweeps.flank(b.genes(b.placed(spark, d)).select("name", "chrom", "lo", "hi", "strand"), b.seqs(spark, d).select("id", F.length("seq").alias("length")), 300)


def nearest_piece(spark, d):
    return sweeps.nearest_piece(b.intervals(spark, d).select(F.concat_ws("/", "chrom", "strand").alias("name"), "strand", "lo", "hi"))


def assign_gene(spark, d):
    gff = b.intervals(spark, d).select(F.col("chrom").alias("seqid"), F.when(F.col("type") == "view", "gene").when(F.col("type") == "click", "CDS").otherwise(F.col("type")).alias("type"), (F.col("lo") + 1).cast("int").alias("start"), F.col("hi").cast("int").alias("end"), "strand", F.concat(F.lit("Name=x;ID=gene:"), F.col("name")).alias("attributes"), F.col("n").alias("line_no"))
    return sweeps.assign_gene(gff, s.gff_attribute("attributes", "ID=gene:"))


def gene_of_line(spark, d):
    return assign_gene(spark, d).select("seqid", "line_no", "type", "gene_id")


def cds_span(spark, d):
    return aggregates.cds_span(assign_gene(spark, d))


_GFF = "gff AS (SELECT chrom AS seqid, n AS line_no, CASE type WHEN 'view' THEN 'gene' WHEN 'click' THEN 'CDS' ELSE type END AS type, lo, hi, last_value(CASE WHEN type = 'view' THEN name END IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY n ROWS UNBOUNDED PRECEDING) AS gene_id FROM iv)"


def expand_sites(spark, d):
    return sweeps.expand_sites(b.intervals(spark, d), 100, 20)


def conserved_runs(spark, d):
    w = b.intervals(spark, d).select(F.col("chrom").alias("pair_id"), (F.col("lo") % 200).alias("offset"), F.col("value").alias("score"))
    return sweeps.conserved_runs(w, 5.0, 60)


def relative_location(spark, d):
    lo, hi = s.relative_location("lo", "hi", "strand", "5", -500, 400, F.lit(200000))
    return b.intervals(spark, d).select("name", lo.alias("lo"), hi.alias("hi"))


def interval_scalars(spark, d):
    lo, hi = s.expand("lo", "hi", "strand", 30, 7)
    a, z, t = s.site_interval(F.col("n") % 11, 8, F.when(F.col("n") % 3 == 0, "+").otherwise("-"), "lo", "hi", "strand")
    x, y = s.bundle_interval(F.col("n") % 13, F.col("n") % 13 + 20, "lo", "hi", "strand")
    return b.intervals(spark, d).select("name", lo.alias("lo"), hi.alias("hi"), a.alias("site_lo"), z.alias("site_hi"), t.alias("site_strand"), x.alias("bundle_lo"), y.alias("bundle_hi"), s.distance_to_locus("lo", "hi", F.lit(100000), "strand").alias("distance"), s.interval_length("lo", "hi").alias("length"))


def dedupe_names(spark, d):
    return sweeps.dedupe_names(b.intervals(spark, d).select(F.col("chrom").alias("name"), "n"), "n")


def possible_sites(spark, d):
    return aggregates.possible_sites(b.intervals(spark, d), 100)


def best_site(spark, d):
    return topk.best_site(b.intervals(spark, d).select(F.col("chrom").alias("interval_idx"), F.col("n").alias("site"), "strand", F.col("value").alias("score")))


def top_pvalues(spark, d):
    return topk.top_pvalues(b.pvalues(spark, d).select(F.col("motif").alias("interval_idx"), F.col("hit_id").alias("site"), F.lit("+").alias("strand"), "pvalue"), 20)


def top_sites(spark, d):
    sites = b.pvalues(spark, d).join(b.intervals(spark, d).select(F.col("n").alias("hit_id"), (F.col("lo") % 3000).cast("int").alias("site"), "strand"), "hit_id")
    return topk.top_sites(sites.select(F.col("seq_id").alias("interval_idx"), "site", "strand", "pvalue"), 60, 10)


def pair_sites(spark, d):
    rows = b.pvalues(spark, d).join(b.intervals(spark, d).select(F.col("n").alias("hit_id"), (F.col("lo") % 3000).alias("pos"), "strand"), "hit_id")
    part = lambda t: rows.filter(F.col("motif") == t).select("seq_id", "strand", "pos", "pvalue")
    out = joins.pair_sites(part("click"), part("view"), 8, 2, 60)
    return out.select("seq_id", "strand", "pos_a", "pos_b", F.round("score", 9).alias("score"))


def sample_events(spark, d):
    return topk.sample_ids(b.intervals(spark, d), 100, 7).select("id")


def intersect_names(spark, d):
    iv = b.intervals(spark, d)
    return sets.intersect_ids(b.genes(iv).select(F.col("chrom").alias("id")), b.promoters(iv).select(F.col("chrom").alias("id"), "name"))


def union_sets(spark, d):
    iv = b.intervals(spark, d)
    return sets.union_sets(b.genes(iv), b.promoters(iv), iv.filter("type = 'view'")).select("id", "type", "strand")


def duplicates(spark, d):
    return quality.duplicates(b.intervals(spark, d), "chrom")


def validate(spark, d):
    rows = b.intervals(spark, d).join(b.pvalues(spark, d).select(F.col("hit_id").alias("n"), "pvalue"), "n").withColumn("window", (F.col("n") % 600).cast("int"))
    return quality.validate(rows, quality.standard_rules())


_MERGE = """x AS (SELECT *, max(hi) OVER (PARTITION BY {k} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {t}),
y AS (SELECT *, sum(CASE WHEN m IS NULL OR lo >= m THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM x),
mg AS (SELECT {k}, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM y GROUP BY {k}, isl)"""
_SITES = "st AS (SELECT seq_id, motif, hit_id, pvalue, (hit_id * 7919) % 200000 % 3000 AS pos, CASE WHEN hit_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM pv)"

QUERIES = {
    "flagship_promoters": (flagship_promoters, with_views("seqs", "pl", "pl_genes", "pl_prom") + f", t AS ({_TRIM}) SELECT t.name, t.chrom, t.lo, t.hi, t.strand, CASE WHEN t.strand = '-' THEN reverse(translate(substring(seq, t.lo + 1, t.hi - t.lo), 'ACGTN', 'TGCAN')) ELSE substring(seq, t.lo + 1, t.hi - t.lo) END AS seq FROM t JOIN seqs ON t.chrom = seqs.id WHERE t.lo < t.hi AND t.hi <= length(seq)"),
    "win4_trim_overlaps": (trim_overlaps, with_views("iv", "iv_genes", "iv_prom") + _TRIM),
    "win10_merge_intervals": (merge_intervals, with_views("iv") + ", " + _MERGE.format(k="chrom, strand", t="iv") + " SELECT * FROM mg"),
    "win11_region_intervals": (region_intervals, with_views("iv") + ", z AS (SELECT *, type AS gene_id FROM iv), " + _MERGE.format(k="gene_id, chrom", t="z") + " SELECT * FROM mg"),
    "qc3_total_length": (total_length, with_views("iv") + ", " + _MERGE.format(k="chrom, strand", t="iv") + " SELECT chrom, sum(hi - lo)::BIGINT AS total, count(*) AS n FROM mg GROUP BY chrom"),
    "join7_overlap": (overlap_join, with_views("iv", "iv_genes", "iv_prom") + " SELECT p.id AS id_a, g.id AS id_b, p.chrom, greatest(p.lo, g.lo) AS lo, least(p.hi, g.hi) AS hi FROM p JOIN g ON p.chrom = g.chrom AND p.lo < g.hi AND g.lo < p.hi"),
    "join8_overlapping": (overlapping, with_views("iv", "iv_genes", "iv_prom") + " SELECT id, chrom, lo, hi FROM p WHERE EXISTS (SELECT 1 FROM g WHERE p.chrom = g.chrom AND p.lo < g.hi AND g.lo < p.hi)"),
    "win6_neighbours": (neighbours, with_views("iv") + ", " + _NEAR + " SELECT chrom, position, gene_id, left_id, left_distance, right_id, right_distance FROM nb"),
    "win8_core_promoter": (core_promoter, with_views("iv") + ", " + _NEAR + ", t AS (SELECT *, greatest(least(1000, coalesce(CASE WHEN strand = '+' THEN left_distance ELSE right_distance END, 1000)), 200) AS take FROM nb) SELECT chrom, position, gene_id, strand, CASE WHEN strand = '+' THEN greatest(position - take, 0) ELSE position + 1 END AS lo, CASE WHEN strand = '+' THEN position ELSE position + 1 + take END AS hi FROM t"),
    "win9_stop_at_neighbour": (stop_at_neighbour, with_views("iv") + ", " + _NEAR + ", t AS (SELECT *, greatest(lo - 500, coalesce(position - left_distance, lo - 500)) AS l, least(lo + 500, coalesce(position + 1 + right_distance, lo + 500)) AS h FROM nb) SELECT chrom, position, gene_id, least(l, h) AS lo, h AS hi FROM t"),
    "win7_locus_region": (locus_region, with_views("iv") + ", " + _NEAR + " SELECT chrom, position, gene_id, strand, 'upstream' AS kind, CASE WHEN strand = '+' THEN greatest(lo - least(greatest(least(800, coalesce(left_distance, 800)), 100), lo), 0) ELSE hi END AS lo, CASE WHEN strand = '+' THEN lo ELSE least(hi + least(greatest(least(800, coalesce(right_distance, 800)), 100), greatest(201000 - hi, 0)), 201000) END AS hi FROM nb"),
    "win2_flank": (flank, with_views("seqs", "pl", "pl_genes") + ", z AS (SELECT g.*, length(seq) AS size FROM g JOIN seqs ON g.chrom = seqs.id) SELECT name, chrom, strand, least(CASE WHEN strand = '+' THEN greatest(lo - 300, 0) ELSE hi END, size) AS lo, least(CASE WHEN strand = '+' THEN lo ELSE least(hi + 300, size) END, size) AS hi FROM z"),
    "win5_nearest_piece": (nearest_piece, with_views("iv") + " SELECT chrom || '/' || strand AS name, strand, lo, hi FROM iv QUALIFY row_number() OVER (PARTITION BY chrom, strand ORDER BY CASE WHEN strand = '+' THEN -lo ELSE lo END, hi) = 1"),
    "win1_assign_gene": (gene_of_line, with_views("iv") + f", {_GFF} SELECT seqid, line_no, type, gene_id FROM gff"),
    "agg1_cds_span": (cds_span, with_views("iv") + f", {_GFF} SELECT gene_id, min(lo)::INT AS lo, max(hi)::INT AS hi FROM gff WHERE type = 'CDS' AND gene_id IS NOT NULL GROUP BY gene_id"),
    "win12_expand_sites": (expand_sites, with_views("iv") + ", z AS (SELECT chrom, greatest(lo - CASE WHEN strand = '+' THEN 100 ELSE 20 END, 0) AS lo, hi + CASE WHEN strand = '+' THEN 20 ELSE 100 END AS hi FROM iv), " + _MERGE.format(k="chrom", t="z") + " SELECT * FROM mg"),
    "win13_conserved_runs": (conserved_runs, with_views("iv") + ", z AS (SELECT DISTINCT chrom AS pair_id, lo % 200 AS o FROM iv WHERE value >= 5.0), y AS (SELECT *, o - row_number() OVER (PARTITION BY pair_id ORDER BY o) AS g FROM z) SELECT pair_id, min(o) AS start, max(o) + 59 AS \"end\", count(*) AS n_windows FROM y GROUP BY pair_id, g"),
    "prj15_relative_location": (relative_location, with_views("iv") + ", z AS (SELECT name, CASE WHEN strand = '+' THEN lo - 500 ELSE hi + 500 - 400 END AS a FROM iv) SELECT name, least(greatest(a, 0), 200000) AS lo, least(greatest(a + 400, 0), 200000) AS hi FROM z"),
    "prj_interval_scalars": (interval_scalars, with_views("iv") + ", z AS (SELECT *, CASE WHEN strand = '+' THEN lo + n % 11 ELSE hi - n % 11 - 8 END AS a, CASE WHEN n % 3 = 0 THEN '+' ELSE '-' END AS ss FROM iv) SELECT name, CASE WHEN strand = '+' THEN lo - 30 ELSE lo - 7 END AS lo, CASE WHEN strand = '+' THEN hi + 7 ELSE hi + 30 END AS hi, a AS site_lo, a + 8 AS site_hi, CASE WHEN ss = strand THEN '+' ELSE '-' END AS site_strand, CASE WHEN strand = '+' THEN lo + n % 13 ELSE hi - n % 13 - 21 END AS bundle_lo, CASE WHEN strand = '+' THEN lo + n % 13 + 21 ELSE hi - n % 13 END AS bundle_hi, CASE WHEN strand = '+' THEN 100000 - hi ELSE lo - 100000 - 1 END AS distance, abs(lo - hi) + 1 AS length FROM z"),
    "win17_dedupe_names": (dedupe_names, with_views("iv") + ", z AS (SELECT chrom, n, row_number() OVER (PARTITION BY chrom ORDER BY n) AS r FROM iv) SELECT CASE WHEN r > 1 THEN chrom || '_' || r ELSE chrom END AS name, n FROM z"),
    "agg13_possible_sites": (possible_sites, with_views("iv") + " SELECT sum(2 * greatest(hi - lo - 100 + 1, 0))::BIGINT AS sites FROM iv"),
    "top6_best_site": (best_site, with_views("iv") + " SELECT chrom AS interval_idx, n AS site, strand, value AS score FROM iv QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY value DESC, n) = 1"),
    "top5_top_pvalues": (top_pvalues, with_views("pvalues") + " SELECT motif AS interval_idx, hit_id AS site, '+' AS strand, pvalue, row_number() OVER (PARTITION BY motif ORDER BY pvalue, hit_id)::INT AS rank FROM pv QUALIFY rank <= 20"),
    "top2_top_sites": (top_sites, greedy_sql(with_views("pvalues", "iv") + ", si AS (SELECT seq_id AS interval_idx, (lo % 3000)::INT AS site, strand, pvalue FROM pv JOIN iv ON iv.n = hit_id)", 60, 10, "si")),
    "join11_pair_sites": (pair_sites, with_views("pvalues") + f", {_SITES}, m AS (SELECT a.seq_id, a.strand, a.pos AS pos_a, b.pos AS pos_b, a.pvalue AS p1, b.pvalue AS p2, b.pos - (a.pos + 10) + 1 AS m FROM st a JOIN st b ON a.seq_id = b.seq_id AND a.strand = b.strand AND a.motif = 'click' AND b.motif = 'view' AND b.pos BETWEEN a.pos + 10 AND a.pos + 68), z AS (SELECT *, least(p1 * (1 - pow(1 - p2, m)), p2 * (1 - pow(1 - p1, m))) AS score FROM m) SELECT seq_id, strand, pos_a, pos_b, round(score, 9) AS score FROM z QUALIFY row_number() OVER (PARTITION BY seq_id, strand, pos_a ORDER BY score, pos_b) = 1"),
    "top9_sample_ids": (sample_events, with_views("iv") + " SELECT id FROM iv ORDER BY md5('7:' || id), id LIMIT 100"),
    "set2_intersect_ids": (intersect_names, with_views("iv", "iv_genes", "iv_prom") + " SELECT chrom AS id, name FROM p WHERE chrom IN (SELECT chrom FROM g)"),
    "set5_union_sets": (union_sets, with_views("iv") + " SELECT id, type, strand FROM iv UNION ALL SELECT id, type, strand FROM iv WHERE type = 'view'"),
    "qc5_duplicates": (duplicates, with_views("iv") + " SELECT chrom, count(*) AS n FROM iv GROUP BY chrom HAVING count(*) > 1"),
    "qc4_validate": (validate, with_views("iv") + ", z AS (SELECT n, ((n * 7919) % 9973 + 1) / 10000.0 AS p, n % 600 AS w FROM iv) SELECT 0::BIGINT AS bad_strand, count(*) FILTER (NOT p BETWEEN 0 AND 1) AS bad_probability, count(*) FILTER (NOT w BETWEEN 10 AND 500) AS bad_window, 0::BIGINT AS bad_order FROM z"),
}
