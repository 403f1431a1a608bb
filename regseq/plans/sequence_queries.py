"""Queries of sequence, motif and conservation operators on texts read as bases, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from regseq.functions import sequence as s
from regseq.operators import aggregates, conservation, joins, motifs, quality, topk
from regseq.plans import bindings as b
from regseq.plans import conserved, orthologs
from regseq.plans.bindings import with_views
from regseq.sources import readers, writers


def scalars(spark, d):
    q = b.seqs(spark, d)
    return q.select("id", F.md5(s.revcomp("seq")).alias("turned"), s.count_n("seq").alias("hidden"), F.round(s.repeat_ratio("seq", F.translate("seq", "N", "A")), 6).alias("ratio"), F.md5(s.mask_iupac(F.translate("seq", "T", "y"))).alias("masked"), s.safe_name(F.concat_ws(":", "id", "source")).alias("name"))


def shuffled(spark, d):
    return b.items(spark, d).select("id", s.shuffle_sequence("seq", 4).alias("seq"))


def p_scalars(spark, d):
    p = F.col("pvalue")
    return b.pvalues(spark, d).select("hit_id", F.round(s.neg_log10_p(p), 8).alias("nlog"), F.round(s.sampling_likelihood(p, 0.1), 8).alias("likely"))


def beliefs(spark, d):
    x, y = s.belief(F.col("l_quantity") + 50, F.col("l_discount") * 100 * F.col("l_linenumber"), 30, 70)
    return b.table(spark, d, "lineitem").select(F.round(x, 8).alias("belief"), F.round(y, 8).alias("integrate")).groupBy("belief", "integrate").agg(F.count("*").alias("n"))


def windows(spark, d):
    q = b.seqs(spark, d)
    return q.select("id", F.explode(s.windows("seq", 60, 20)).alias("w")).groupBy("id").agg(F.count("*").alias("n"), F.max("w.offset").alias("last"), F.sum(s.count_n("w.seq")).alias("hidden"))


def genome_files(spark, d):
    q = b.seqs(spark, d)
    return readers.chrom_sizes(q).join(readers.intervals_from_fasta(q, None, 500).select("id", "lo", F.md5("seq").alias("digest")), "id")


def fasta_lines(spark, d):
    return writers.fasta_lines(b.items(spark, d).select(F.col("id").alias("label"), F.lit(1).alias("five"), F.length("seq").alias("three"), "seq"))


def checks(spark, d):
    q = b.seqs(spark, d)
    dna, protein = quality.check_dna(q), quality.check_protein(q)
    return dna.select("ok", "n_bad", F.lit("dna").alias("kind")).union(protein.select("ok", "n_bad", F.lit("protein")))


def db_stats(spark, d):
    return quality.db_stats(b.seqs(spark, d).select(F.col("source").alias("db"), F.col("id").alias("gene_id"), "seq"))


def min_length(spark, d):
    return quality.min_length(b.seqs(spark, d), 1000).select("id", "source", F.md5("seq").alias("digest"))


def markov(spark, d):
    return aggregates.markov_model(b.seqs(spark, d), 2).withColumn("p", F.round("p", 9))


def counts(spark, d):
    return aggregates.count_matrix(b.aligned(spark, d))


def _freq(spark, d, kind="p/sqrt"):
    m = counts(spark, d)
    rows = m.select("motif_id", "pos", F.explode(F.array(*(F.struct(F.lit(x).alias("base"), F.col(x).cast("double").alias("count")) for x in "ACGT"))).alias("c"))
    return motifs.frequencies(rows.select("motif_id", "pos", "c.base", "c.count"), kind, 0.5)


def frequencies(spark, d):
    return _freq(spark, d).withColumn("freq", F.round("freq", 9))


def information(spark, d):
    return motifs.information_content(_freq(spark, d)).select("motif_id", "pos", F.round("ic", 8).alias("ic"), F.round("total", 7).alias("total"))


def entropies(spark, d):
    return motifs.entropy(_freq(spark, d, "p")).select("motif_id", "pos", F.round("entropy", 8).alias("entropy"), F.round("total", 7).alias("total"))


def turned(spark, d):
    return motifs.motif_revcomp(_freq(spark, d)).select("motif_id", "pos", "base", F.round("freq", 9).alias("freq"))


def consensus(spark, d):
    m = counts(spark, d)
    rows = m.select("motif_id", "pos", F.explode(F.array(*(F.struct(F.lit(x).alias("base"), F.col(x).cast("double").alias("freq")) for x in "ACGT"))).alias("c"))
    return motifs.consensus(rows.select("motif_id", "pos", "c.base", "c.freq"))


def distances(spark, d):
    return motifs.motif_distances(_freq(spark, d)).select("a", "b", F.round("distance", 7).alias("distance"))


def nearest(spark, d):
    return topk.nearest_motifs(distances(spark, d), 3)


def clusters(spark, d):
    freq = _freq(spark, d)
    found = motifs.cluster_motifs(motifs.motif_distances(freq), 0.35)
    return found.join(motifs.representatives(found, freq).withColumnRenamed("motif_id", "representative"), "cluster_id")


def scan(spark, d):
    found = motifs.scan(b.items(spark, d), _freq(spark, d), least=0.5)
    return found.withColumn("score", F.round("score", 6))


def scan_p(spark, d):
    found = motifs.scan(b.items(spark, d), _freq(spark, d))
    return motifs.empirical_p(found.filter("score >= 1"), found).withColumns({"score": F.round("score", 6), "pvalue": F.round("pvalue", 9)})


def site_stats(spark, d):
    found = motifs.scan(b.items(spark, d), _freq(spark, d), least=0.5).withColumn("width", F.lit(12)).withColumnRenamed("id", "seq_id")
    return motifs.motif_site_stats(found, b.items(spark, d)).withColumns({"ratio": F.round("ratio", 6), "scaled": F.round("scaled", 6)})


def _pairs(spark, d):
    i = b.items(spark, d)
    return i.select("n", F.col("seq").alias("seq1")).join(i.select((F.col("n") - 1).alias("n"), F.col("seq").alias("seq2")), "n").select(F.col("n").cast("string").alias("pair_id"), "seq1", "seq2")


def window_pairs(spark, d):
    return conservation.window_pair_scores(_pairs(spark, d), 20, 9)


def both_strands(spark, d):
    return conservation.merge_strands(_pairs(spark, d), 20, 10)


def profiles(spark, d):
    return aggregates.profiles(window_pairs(spark, d))


def alignmax(spark, d):
    return aggregates.alignmax(_pairs(spark, d), window_pairs(spark, d))


def histogram(spark, d):
    return aggregates.score_histogram(window_pairs(spark, d), 20, 7)


def region_input(spark, d):
    """Every item as a gene of one of four species, with the three that follow it as orthologs."""
    i = b.items(spark, d)
    seqs = i.select(F.col("id").alias("gene_id"), F.concat(F.lit("s"), (F.col("n") % 4).cast("string")).alias("species"), "seq", F.regexp_replace("seq", "AAAAA", "NNNNN").alias("masked_seq"))
    return seqs, i.select(F.col("id").alias("query_gene"), F.explode(F.array(*(F.concat(F.lit("b"), (F.col("n") + k).cast("string")) for k in (1, 2, 3)))).alias("target_gene"))


def regions(spark, d):
    return conserved.conserved_regions(*region_input(spark, d), 20, 40, 75, 0.05, 5, centre=True)


def set_profiles(spark, d):
    i = b.items(spark, d).select((F.col("n") / 3).cast("int").cast("string").alias("set_id"), "id", "seq")
    return conservation.conservation_profiles(i, 20, 10)


def kmer_hits(spark, d):
    out = joins.kmer_hits(b.items(spark, d), b.seqs(spark, d), 14, 5)
    return out.withColumn("score", F.round("score", 9))


def search(spark, d):
    i = b.items(spark, d).select("id", F.concat(F.lit("x gene:"), F.col("id")).alias("description"), "seq")
    return writers.ortholog_rows(orthologs.search_orthologs(i, i.select(F.concat(F.lit("t"), F.col("id")).alias("id"), "description", "seq"), 8, 3))


_COUNTS = "cm AS (SELECT motif_id, pos, count(*) FILTER (b = 'A') AS A, count(*) FILTER (b = 'C') AS C, count(*) FILTER (b = 'G') AS G, count(*) FILTER (b = 'T') AS T FROM (SELECT motif_id, unnest(range(0, 12)) AS pos, seq, substring(seq, pos::INT + 1, 1) AS b FROM aligned) GROUP BY motif_id, pos)"
_LONG = "lc AS (SELECT motif_id, pos, 'A' AS base, A::DOUBLE AS c FROM cm UNION ALL SELECT motif_id, pos, 'C', C FROM cm UNION ALL SELECT motif_id, pos, 'G', G FROM cm UNION ALL SELECT motif_id, pos, 'T', T FROM cm)"
_FREQ = _COUNTS + ", " + _LONG + ", n AS (SELECT *, sum(c) OVER (PARTITION BY motif_id, pos) AS n FROM lc), fr AS (SELECT motif_id, pos, base, c AS count, (c + {pc}) / (n + 4 * {pc}) AS freq FROM n)"
_F = with_views("seqs", "aligned") + ", " + _FREQ.format(pc="(0.5 / sqrt(n))")
_W = with_views("items") + ", pr AS (SELECT a.n::VARCHAR AS pair_id, a.seq AS seq1, b.seq AS seq2 FROM items a JOIN items b ON b.n = a.n + 1)"
_CELLS = "c{t} AS (SELECT pair_id, x, y, (substring(seq1, x::INT + 1, 1) = substring({s}, y::INT + 1, 1) AND substring(seq1, x::INT + 1, 1) <> 'N')::INT AS m FROM (SELECT *, unnest(range(0, length(seq2))) AS y FROM (SELECT *, unnest(range(0, length(seq1))) AS x FROM pr))), w{t} AS (SELECT pair_id, x AS offset1, y AS offset2, sum(m) OVER d AS score, count(*) OVER d AS k FROM c{t} WINDOW d AS (PARTITION BY pair_id, x - y ORDER BY x ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), s{t} AS (SELECT pair_id, offset1, offset2, score::INT AS score FROM w{t} WHERE k = 20 AND score >= {c})"
_ONE = _W + ", " + _CELLS.format(t="", s="seq2", c=9)
_ODDS = "md AS (SELECT motif_id, pos, base, log2(freq / 0.25) AS o FROM fr), it AS (SELECT id, seq, '+' AS strand FROM items UNION ALL SELECT id, reverse(translate(seq, 'ACGTN', 'TGCAN')), '-' FROM items), sc AS (SELECT id, motif_id, p - pos AS site_, strand, sum(o) AS score, len FROM (SELECT id, strand, length(seq) AS len, unnest(range(0, length(seq))) AS p, substring(seq, p::INT + 1, 1) AS base FROM it) z JOIN md USING (base) WHERE p - pos >= 0 AND p - pos <= len - 12 GROUP BY ALL)"

_SCAN = with_views("seqs", "aligned", "items") + ", " + _FREQ.format(pc="(0.5 / sqrt(n))") + ", " + _ODDS
_DISTANCES = _F + ", a4 AS (SELECT motif_id, 0 AS r, pos, base, freq FROM fr UNION ALL SELECT motif_id, 1, 11 - pos, translate(base, 'ACGT', 'TGCA'), freq FROM fr), pad AS (SELECT * FROM (VALUES ('A', 0.32), ('C', 0.18), ('G', 0.18), ('T', 0.32)) v(base, pf)), grid AS (SELECT a, b, r, sh, i, pad.base, pf FROM (SELECT x.motif_id AS a, y.motif_id AS b FROM (SELECT DISTINCT motif_id FROM fr) x, (SELECT DISTINCT motif_id FROM fr) y WHERE a < b), (SELECT unnest([0, 1]) AS r), (SELECT unnest(range(-11, 12)) AS sh), (SELECT unnest(range(-11, 24)) AS i), pad WHERE i >= least(0, sh) AND i < greatest(12, 12 + sh)), v AS (SELECT g.a, g.b, g.r, g.sh, coalesce(p.freq, pf) AS p, coalesce(q.freq, pf) AS q FROM grid g LEFT JOIN a4 p ON p.motif_id = g.a AND p.r = 0 AND p.pos = g.i AND p.base = g.base LEFT JOIN a4 q ON q.motif_id = g.b AND q.r = g.r AND q.pos = g.i - g.sh AND q.base = g.base), s AS (SELECT a, b, sum((p - q) * (log2(p) - log2(q)) / 2) AS d FROM v GROUP BY a, b, r, sh)"
_KMERS = "{t} AS (SELECT DISTINCT id, substring(seq, i::INT + 1, {k}) AS k FROM (SELECT id, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM {of}))"

QUERIES = {
    "prj_sequence_scalars": (scalars, with_views("seqs") + " SELECT id, md5(reverse(translate(seq, 'ACGTN', 'TGCAN'))) AS turned, (length(seq) - length(replace(seq, 'N', '')))::INT AS hidden, CASE WHEN length(seq) > 0 THEN round(100.0 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq), 6) END::DOUBLE AS ratio, md5(replace(translate(seq, 'T', 'N'), 'N', 'N')) AS masked, id || '-' || source AS name FROM seqs"),
    "prj16_shuffle_sequence": (shuffled, with_views("items") + " SELECT id, string_agg(c, '' ORDER BY k, c) AS seq FROM (SELECT id, substring(seq, i::INT + 1, 1) AS c, md5('4:' || i) AS k FROM (SELECT id, seq, unnest(range(0, length(seq))) AS i FROM items)) GROUP BY id"),
    "prj17_p_scalars": (p_scalars, with_views("pvalues") + " SELECT hit_id, round(-log10(pvalue), 8) AS nlog, round(greatest(2 * (1 / (1 + pvalue) - 0.5), 0.1), 8) AS likely FROM pv"),
    "cns3_belief": (beliefs, "WITH z AS (SELECT floor(l_quantity + 50) AS s, floor(l_discount * 100 * l_linenumber) AS r FROM lineitem), y AS (SELECT CASE WHEN s >= r THEN least(100.0, CASE WHEN r < 100 THEN least(1.5, 100.0 / greatest(100 - r, 1)) ELSE 1.5 END * (s - r)) ELSE 0 END AS i FROM z), x AS (SELECT round(CASE WHEN i <= 30 THEN 0 WHEN i >= 70 THEN 1 ELSE 1 / (1 + exp(5 - 10 * (i - 30) / 40)) END, 8) AS belief, round(i, 8) AS integrate FROM y) SELECT belief::DOUBLE AS belief, integrate::DOUBLE AS integrate, count(*) AS n FROM x GROUP BY ALL"),
    "prj11_windows": (windows, with_views("seqs") + ", z AS (SELECT id, seq, unnest(range(0, length(seq) - 59, 20)) AS o FROM seqs) SELECT id, count(*) AS n, max(o)::INT AS last, sum(60 - length(replace(substring(seq, o::INT + 1, 60), 'N', '')))::BIGINT AS hidden FROM z GROUP BY id"),
    "src8_genome_files": (genome_files, with_views("seqs") + " SELECT id, length(seq)::INT AS length, greatest(length(seq) - 500, 0)::INT AS lo, md5(right(seq, 500)) AS digest FROM seqs"),
    "snk1_fasta_lines": (fasta_lines, with_views("items") + " SELECT '>' || id || '(1:' || length(seq) || ')' || chr(10) || seq AS value FROM items"),
    "qc1_alphabet": (checks, with_views("seqs") + " SELECT true AS ok, 0::BIGINT AS n_bad, 'dna' AS kind UNION ALL SELECT count(*) FILTER (length(seq) > 100) = 0, count(*) FILTER (length(seq) > 100), 'protein' FROM seqs"),
    "qc7_db_stats": (db_stats, with_views("seqs") + " SELECT source AS db, count(DISTINCT id) AS n_genes, count(*) AS n_sequences, sum(length(seq))::BIGINT AS bases, sum(length(seq) - length(replace(seq, 'N', '')))::BIGINT AS hidden FROM seqs GROUP BY source"),
    "flt2_min_length": (min_length, with_views("seqs") + " SELECT id, source, md5(seq) AS digest FROM seqs WHERE length(seq) >= 1000"),
    "agg7_markov_model": (markov, with_views("seqs") + ", g AS (SELECT substring(seq, i::INT + 1, 3) AS g FROM (SELECT seq, unnest(range(0, length(seq) - 2)) AS i FROM seqs)), c AS (SELECT substring(g, 1, 2) AS context, substring(g, 3, 1) AS base, count(*) AS n FROM g WHERE NOT contains(g, 'N') GROUP BY ALL) SELECT context, base, n, round(n / sum(n) OVER (PARTITION BY context), 9)::DOUBLE AS p FROM c"),
    "agg3_count_matrix": (counts, with_views("seqs", "aligned") + f", {_COUNTS} SELECT motif_id, pos::INT AS pos, A, C, G, T FROM cm"),
    "mot1_frequencies": (frequencies, _F + " SELECT motif_id, pos::INT AS pos, base, count, round(freq, 9) AS freq FROM fr"),
    "mot2_information": (information, _F + ", z AS (SELECT motif_id, pos::INT AS pos, 2 + sum(CASE WHEN freq > 0 THEN freq * log2(freq) ELSE 0 END) AS ic FROM fr GROUP BY ALL) SELECT motif_id, pos, round(ic, 8) AS ic, round(sum(ic) OVER (PARTITION BY motif_id), 7) AS total FROM z"),
    "mot3_entropy": (entropies, with_views("seqs", "aligned") + ", " + _FREQ.format(pc="0.5") + ", z AS (SELECT motif_id, pos::INT AS pos, -sum(CASE WHEN freq > 0 THEN freq * log2(freq) ELSE 0 END) AS e FROM fr GROUP BY ALL) SELECT motif_id, pos, round(e, 8) AS entropy, round(sum(e) OVER (PARTITION BY motif_id), 7) AS total FROM z"),
    "mot4_reverse_complement": (turned, _F + " SELECT motif_id, (11 - pos)::INT AS pos, translate(base, 'ACGT', 'TGCA') AS base, round(freq, 9) AS freq FROM fr"),
    "mot5_consensus": (consensus, with_views("seqs", "aligned") + f", {_COUNTS}, {_LONG}, t AS (SELECT motif_id, pos, string_agg(base, '' ORDER BY base) AS b FROM (SELECT * FROM lc QUALIFY c = max(c) OVER (PARTITION BY motif_id, pos)) GROUP BY motif_id, pos) SELECT motif_id, string_agg(CASE WHEN length(b) = 1 THEN b WHEN b = 'GT' THEN 'K' WHEN b = 'AC' THEN 'M' WHEN b = 'AG' THEN 'R' WHEN b = 'CG' THEN 'S' WHEN b = 'AT' THEN 'W' WHEN b = 'CT' THEN 'Y' ELSE 'N' END, '' ORDER BY pos) AS consensus FROM t GROUP BY motif_id"),
    "mot7_distances": (distances, _DISTANCES + " SELECT a, b, round(min(d), 7) AS distance FROM s GROUP BY a, b"),
    "top7_nearest_motifs": (nearest, _DISTANCES + ", ds AS (SELECT a, b, round(min(d), 7) AS distance FROM s GROUP BY a, b) SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b)::INT AS rank FROM ds QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 3"),
    "mot8_clusters": (clusters, None),
    "mot10_scan": (scan, _SCAN + " SELECT id, motif_id, CASE WHEN strand = '-' THEN len - 12 - site_ ELSE site_ END::INT AS site, strand, round(score, 6) AS score FROM sc WHERE score >= 0.5"),
    "mot11_empirical_p": (scan_p, _SCAN + ", bn AS (SELECT motif_id, floor(score / 0.01)::BIGINT AS bin, count(*) AS n FROM sc GROUP BY ALL), tl AS (SELECT motif_id, bin, (sum(n) OVER (PARTITION BY motif_id ORDER BY bin DESC) + 1) / (sum(n) OVER (PARTITION BY motif_id) + 1) AS pvalue FROM bn) SELECT id, motif_id, CASE WHEN strand = '-' THEN len - 12 - site_ ELSE site_ END::INT AS site, strand, round(score, 6) AS score, round(pvalue, 9)::DOUBLE AS pvalue FROM (SELECT *, floor(score / 0.01)::BIGINT AS bin FROM sc WHERE score >= 1) JOIN tl USING (motif_id, bin)"),
    "mot14_site_stats": (site_stats, _SCAN + ", f AS (SELECT id AS seq_id, motif_id, CASE WHEN strand = '-' THEN len - 12 - site_ ELSE site_ END AS site, len FROM sc WHERE score >= 0.5) SELECT motif_id, seq_id, site::INT AS site, round(count(*) OVER m / nq, 6)::DOUBLE AS ratio, round(site / (len - 11) * ((SELECT max(length(seq)) FROM items) - 11), 6) AS scaled FROM f JOIN (SELECT motif_id, count(DISTINCT seq_id) AS nq FROM f GROUP BY 1) USING (motif_id) WINDOW m AS (PARTITION BY motif_id)"),
    "cns1_window_pairs": (window_pairs, _ONE + " SELECT pair_id, offset1::INT AS offset1, offset2::INT AS offset2, score FROM s"),
    "cns2_merge_strands": (both_strands, _W + ", " + _CELLS.format(t="f", s="seq2", c=10) + ", " + _CELLS.format(t="r", s="reverse(translate(seq2, 'ACGTN', 'TGCAN'))", c=10) + " SELECT pair_id, offset1::INT AS offset1, offset2::INT AS offset2, max(score) AS score FROM (SELECT * FROM sf UNION ALL SELECT pair_id, offset1, length(seq2) - offset2 - 20, score FROM sr JOIN pr USING (pair_id)) GROUP BY ALL"),
    "agg4_profiles": (profiles, _ONE + " SELECT pair_id, side, o::INT AS offset, max(score) AS score FROM (SELECT pair_id, 1 AS side, offset1 AS o, score FROM s UNION ALL SELECT pair_id, 2, offset2, score FROM s) GROUP BY ALL"),
    "agg5_alignmax": (alignmax, _ONE + " SELECT pair_id, coalesce(max(score), 0) AS score FROM pr LEFT JOIN s USING (pair_id) GROUP BY pair_id"),
    "agg6_histogram": (histogram, _ONE + ", bn AS (SELECT unnest(range(0, 7)) AS b), rg AS (SELECT b, floor(21 * b / 7.0) AS low, CASE WHEN b = 6 THEN 999 ELSE floor(21 * (b + 1) / 7.0) END AS high FROM bn) SELECT b::INT AS bin, count(score) AS n FROM rg LEFT JOIN s ON score >= low AND score < high GROUP BY b"),
    "cns13_conserved_regions": (regions, None),
    "cns14_profiles": (set_profiles, with_views("items") + ", st AS (SELECT n // 3 AS set_id, id, seq FROM items), pr AS (SELECT x.set_id || '|' || x.id || '|' || y.id AS pair_id, x.seq AS seq1, y.seq AS seq2 FROM st x JOIN st y ON x.set_id = y.set_id AND x.id < y.id), " + _CELLS.format(t="f", s="seq2", c=10) + ", " + _CELLS.format(t="r", s="reverse(translate(seq2, 'ACGTN', 'TGCAN'))", c=10) + ", b2 AS (SELECT * FROM sf UNION ALL SELECT pair_id, offset1, length(seq2) - offset2 - 20, score FROM sr JOIN pr USING (pair_id)) SELECT pair_id, side, o::INT AS offset, max(score) AS score FROM (SELECT pair_id, 1 AS side, offset1 AS o, score FROM b2 UNION ALL SELECT pair_id, 2, offset2, score FROM b2) GROUP BY ALL"),
    "join14_kmer_hits": (kmer_hits, with_views("seqs", "items") + ", " + _KMERS.format(k=14, t="y", of="seqs") + ", " + _KMERS.format(k=14, t="x", of="items") + ", sh AS (SELECT x.id AS query, y.id AS target, count(*) AS shared FROM x JOIN y USING (k) GROUP BY ALL HAVING count(*) >= 5), nx AS (SELECT id AS query, count(*) AS a FROM x GROUP BY id), ny AS (SELECT id AS target, count(*) AS b FROM y GROUP BY id) SELECT query, target, shared, round(shared / least(a, b), 9)::DOUBLE AS score FROM sh JOIN nx USING (query) JOIN ny USING (target)"),
    "rbh_search": (search, with_views("items") + ", " + _KMERS.format(k=8, t="x", of="items") + ", z AS (SELECT id, count(*) AS n FROM x GROUP BY id), sh AS (SELECT p.id AS q, r.id AS t, 1 - count(*) / least(any_value(zp.n), any_value(zr.n)) AS s FROM x p JOIN x r USING (k) JOIN z zp ON zp.id = p.id JOIN z zr ON zr.id = r.id GROUP BY ALL HAVING count(*) >= 3), there AS (SELECT q, t FROM sh QUALIFY row_number() OVER (PARTITION BY q ORDER BY s, 't' || t) = 1), back AS (SELECT q AS t, t AS q FROM sh QUALIFY row_number() OVER (PARTITION BY q ORDER BY s, t) = 1) SELECT id AS query_protein, CASE WHEN b.t IS NULL THEN 'none' ELSE 't' || b.t END AS target_protein, coalesce(b.t, 'none') AS target_gene, id AS query_gene FROM items LEFT JOIN (SELECT * FROM there JOIN back USING (q, t)) b ON b.q = id"),
}
