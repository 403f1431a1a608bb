"""Queries of statistics on events and parts, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from regseq.operators import motifs, quality, statistics
from regseq.plans import bindings as b
from regseq.plans.bindings import greedy_sql, with_views

_SF = "CASE WHEN k <= 0 THEN 1.0 WHEN k > n THEN 0.0 ELSE least(1.0, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))) FROM (SELECT unnest(range(k::BIGINT, n::BIGINT + 1)) AS j))) END"

#: As _SF, but tails of p beyond (k + 1) / (n + 3) are 1 less the lower sum, as in binomial_tail: a long sum near 1 is off
#: by more than such tails differ, so the least of them would be left to rounding.
_SF_SIDED = "CASE WHEN k <= 0 THEN 1.0 WHEN k > n THEN 0.0 ELSE (SELECT least(1.0, greatest(0.0, CASE WHEN p > (k + 1) / (n + 3)::DOUBLE THEN 1 - sum(t) ELSE sum(t) END)) FROM (SELECT exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)) AS t FROM (SELECT unnest(CASE WHEN p > (k + 1) / (n + 3)::DOUBLE THEN range(0::BIGINT, k::BIGINT) ELSE range(k::BIGINT, n::BIGINT + 1) END) AS j))) END"


def _most(df, by):
    return int(df.groupBy(by).count().agg(F.max("count")).first()[0] or 0)


def strand_bias(spark, d):
    iv = b.intervals(spark, d).withColumnRenamed("chrom", "motif_id")
    return statistics.strand_bias(iv).withColumn("p_value", F.round("p_value", 7))


def best_binomial(spark, d):
    pv = b.pvalues(spark, d).withColumnRenamed("seq_id", "group_id")
    n = 2 * _most(pv, "group_id")
    return statistics.best_binomial(pv, n).withColumn("p_value", F.round("p_value", 7))


def phyper(spark, d):
    """Do the parts of a brand fall among the large ones: one row a brand, both tails."""
    p = b.table(spark, d, "part")
    total = p.agg(F.count("*").alias("t"), F.count_if(F.col("p_size") > 25).alias("m"))
    rows = p.groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("k"), F.count_if(F.col("p_size") > 25).alias("q")).join(F.broadcast(total), F.lit(True))
    rows = rows.withColumn("n", F.col("t") - F.col("m"))
    return statistics.phyper(statistics.phyper(rows, False, "upper"), True, "lower").select("key", "q", "k", F.round("upper", 7).alias("upper"), F.round("lower", 7).alias("lower"))


def enrichment(spark, d):
    p = b.table(spark, d, "part")
    calls = b.table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_returnflag").alias("pattern"), F.col("l_partkey").alias("gene_id"))
    out = statistics.cluster_enrichment(p.select(F.col("p_partkey").alias("gene_id")), calls, p.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").alias("gene_id")))
    return out.withColumn("p_value", F.round("p_value", 6))


def ks(spark, d):
    v = b.pvalues(spark, d).select(F.col("seq_id").alias("group_id"), F.col("pvalue").alias("value"))
    # In one select a lambda would see the rounded d under d's name.
    out = statistics.ks_uniform(v, 50).withColumn("p_value", statistics.ks_pvalue(F.col("d"), F.col("n")))
    return out.select("group_id", F.round("d", 9).alias("d"), "n", F.round("p_value", 7).alias("p_value"))


def qvalues(spark, d):
    return statistics.qvalues(b.pvalues(spark, d), ["motif"]).select("hit_id", "rank", F.round("qvalue", 8).alias("qvalue"))


def storey(spark, d):
    return statistics.storey_pi0(b.pvalues(spark, d), ["motif"]).withColumn("pi0", F.round("pi0", 9))


def overrep_none(spark, d):
    return statistics.overrep_none(b.pvalues(spark, d), 0.01)


def overrep_binomial(spark, d):
    pv = b.pvalues(spark, d)
    n = 2 * _most(pv, "seq_id")
    return statistics.overrep_binomial(pv, n, 0.9, ["seq_id"]).select("seq_id", "hit_id", "rank")


def overrep_poisbinom(spark, d):
    return statistics.overrep_poisbinom(b.pvalues(spark, d), 200, 0.9, ["seq_id"]).select("seq_id", "hit_id", "rank", F.round("test_p", 6).alias("test_p"))


def overrepresented(spark, d):
    pv = b.pvalues(spark, d)
    return statistics.overrepresented(pv, pv, "qvalue", 0.95)


def significant(spark, d):
    return quality.significant_sites(b.intervals(spark, d).select("id", F.col("value").alias("score")), 100.0)


def motif_in_sequences(spark, d):
    rows = b.pvalues(spark, d).join(b.intervals(spark, d).select(F.col("n").alias("hit_id"), (F.col("lo") % 3000).cast("int").alias("site"), "strand"), "hit_id")
    sites = rows.select(F.col("seq_id").alias("interval_idx"), "site", "strand", "pvalue")
    n = 2 * _most(sites, "interval_idx")
    return motifs.motif_in_sequences(sites, 30, n).withColumn("p_value", F.round("p_value", 7))


#: P(X > z) of the normal distribution as in the operator, for columns z and t.
_NORMAL = "(CASE WHEN z >= 0 THEN nt ELSE 1 - nt END)"
_POISBINOM = "m AS (SELECT *, sum(pvalue) OVER w + greatest(200 - rank, 0) * pvalue AS mu, sum(pvalue * (1 - pvalue)) OVER w + greatest(200 - rank, 0) * pvalue * (1 - pvalue) AS var, sum(pvalue * (1 - pvalue) * (1 - 2 * pvalue)) OVER w + greatest(200 - rank, 0) * pvalue * (1 - pvalue) * (1 - 2 * pvalue) AS third FROM r WINDOW w AS (PARTITION BY seq_id ORDER BY rank ROWS UNBOUNDED PRECEDING)), z AS (SELECT *, (rank + 0.5::DOUBLE - mu) / sqrt(var) AS z, third / pow(sqrt(var), 3) AS skew FROM m), y AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t, exp(-z * z / 2) / sqrt(2 * pi()) AS dens FROM z), x AS (SELECT *, dens * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS nt FROM y), v AS (SELECT seq_id, hit_id, rank, least(1.0::DOUBLE, greatest(0.0::DOUBLE, " + _NORMAL + " + skew * (z * z - 1) * dens / 6)) AS v FROM x), bst AS (SELECT seq_id, arg_min(rank, (v, rank)) AS best, min(v) AS v FROM v GROUP BY seq_id HAVING min(v) < 0.9) SELECT seq_id, hit_id, rank::INT AS rank, round(bst.v, 6) AS test_p FROM r JOIN bst USING (seq_id) WHERE rank <= best"
_QVALUES = "r AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY seq_id, motif) AS m FROM pv WINDOW w AS (PARTITION BY seq_id, motif ORDER BY pvalue, hit_id)), q AS (SELECT *, least(1.0::DOUBLE, min(pvalue * m / rank) OVER (PARTITION BY seq_id, motif ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r), k AS (SELECT seq_id, motif, count(*) AS n, min(pvalue) AS p FROM q WHERE q <= 0.95 GROUP BY ALL) SELECT seq_id, motif, 'qvalue' AS test, coalesce(n, 0) AS count, p AS pvalue FROM (SELECT DISTINCT seq_id, motif FROM pv) LEFT JOIN k USING (seq_id, motif)"
_SITES = with_views("pvalues", "iv") + ", si AS (SELECT seq_id AS interval_idx, (lo % 3000)::INT AS site, strand, pvalue FROM pv JOIN iv ON iv.n = hit_id)"
_IN_SEQUENCES = greedy_sql(_SITES, 30, 1 << 30, "si").removesuffix("SELECT interval_idx, rank, site, strand, pvalue FROM ch") + f", mm AS (SELECT 2 * max(c) AS n FROM (SELECT count(*) AS c FROM si GROUP BY interval_idx)), zz AS (SELECT interval_idx, pvalue AS p, row_number() OVER (PARTITION BY interval_idx ORDER BY pvalue) AS k, n FROM ch, mm), tt AS (SELECT interval_idx, k, {_SF_SIDED} AS v FROM zz) SELECT interval_idx, round(min(v), 7)::DOUBLE AS p_value, arg_min(k, (v, k))::INT AS index FROM tt GROUP BY interval_idx"

_R = "r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY pvalue, hit_id) AS rank FROM pv)"

QUERIES = {
    "sta7_strand_bias": (strand_bias, with_views("iv") + f", z AS (SELECT chrom AS motif_id, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus, count(*) AS n, greatest(plus, minus) AS k, 0.5 AS p FROM iv GROUP BY chrom) SELECT motif_id, plus, minus, round({_SF}, 7)::DOUBLE AS p_value FROM z"),
    "sta2_best_binomial": (best_binomial, with_views("pvalues") + f", m AS (SELECT 2 * max(c) AS n FROM (SELECT count(*) AS c FROM pv GROUP BY seq_id)), z AS (SELECT seq_id AS group_id, pvalue AS p, row_number() OVER (PARTITION BY seq_id ORDER BY pvalue) AS k, n FROM pv, m), t AS (SELECT group_id, k, {_SF} AS v FROM z) SELECT group_id, round(min(v), 7)::DOUBLE AS p_value, arg_min(k, (v, k))::INT AS index FROM t GROUP BY group_id"),
    "sta3_phyper": (phyper, "WITH t AS (SELECT count(*) AS t, count(*) FILTER (p_size > 25) AS m FROM part), z AS (SELECT p_brand AS key, count(*) AS k, count(*) FILTER (p_size > 25) AS q FROM part GROUP BY p_brand), y AS (SELECT key, k, q, m, t - m AS n, unnest(range(greatest(0, k - (t - m)), least(k, m) + 1)) AS j FROM z, t), x AS (SELECT *, exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(n + 1) - lgamma(k - j + 1) - lgamma(n - k + j + 1) - lgamma(m + n + 1) + lgamma(k + 1) + lgamma(m + n - k + 1)) AS v FROM y) SELECT key, q, k, round(least(1.0, coalesce(sum(v) FILTER (j >= q), 0)), 7)::DOUBLE AS upper, round(least(1.0, coalesce(sum(v) FILTER (j <= q), 0)), 7)::DOUBLE AS lower FROM x GROUP BY ALL"),
    "sta4_cluster_enrichment": (enrichment, "WITH c AS (SELECT DISTINCT l_returnflag AS pattern, l_partkey AS g FROM lineitem WHERE l_quantity >= 49 AND l_partkey IN (SELECT p_partkey FROM part)), kk AS (SELECT pattern, count(*) AS k FROM c GROUP BY ALL), mm AS (SELECT p_brand AS cluster_id, count(DISTINCT p_partkey) AS m FROM part GROUP BY ALL), qq AS (SELECT pattern, p_brand AS cluster_id, count(*) AS q FROM c JOIN part ON g = p_partkey GROUP BY ALL), z AS (SELECT pattern, cluster_id, coalesce(q, 0) AS q, m, (SELECT count(*) FROM part) - m AS n, k FROM kk CROSS JOIN mm LEFT JOIN qq USING (pattern, cluster_id)), x AS (SELECT *, unnest(range(greatest(q, k - n, 0), least(k, m) + 1)) AS j FROM z) SELECT pattern, cluster_id, q, m, n, k, round(least(1.0, sum(exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(n + 1) - lgamma(k - j + 1) - lgamma(n - k + j + 1) - lgamma(m + n + 1) + lgamma(k + 1) + lgamma(m + n - k + 1)))), 6)::DOUBLE AS p_value FROM x GROUP BY ALL"),
    "sta5_ks_uniform": (ks, with_views("pvalues") + ", g AS (SELECT DISTINCT seq_id, unnest(range(0, 51)) AS i FROM pv), f AS (SELECT g.seq_id, i, count(*) FILTER (round(pvalue * 50, 9) <= i) / count(*)::DOUBLE AS f, count(*) AS n FROM g JOIN pv USING (seq_id) GROUP BY ALL), d AS (SELECT seq_id, max(abs(f - i / 50.0)) AS d, max(n) AS n FROM f GROUP BY seq_id), s AS (SELECT *, n * d * d AS s FROM d) SELECT seq_id AS group_id, round(d, 9)::DOUBLE AS d, n, round(CASE WHEN s > " + f"{statistics.KS_LARGE} OR (s > {statistics.KS_MIDDLE} AND n > {statistics.KS_MANY}) THEN 2 * exp(-({statistics.KS_TAIL[0]} + {statistics.KS_TAIL[1]} / sqrt(n) + {statistics.KS_TAIL[2]} / n) * s)" + " ELSE least(1.0, greatest(0.0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * s)) FROM (SELECT unnest(range(1, 21)) AS k)))) END, 7)::DOUBLE AS p_value FROM s"),
    "sta11_qvalues": (qvalues, with_views("pvalues") + ", " + _R.format(k="motif") + ", q AS (SELECT *, pvalue * count(*) OVER (PARTITION BY motif) / rank AS v FROM r) SELECT hit_id, rank::INT AS rank, round(least(1.0, min(v) OVER (PARTITION BY motif ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 8)::DOUBLE AS qvalue FROM q"),
    "sta11_storey_pi0": (storey, with_views("pvalues") + " SELECT motif, round(least(1.0, count(*) FILTER (pvalue > 0.5) / (count(*) * 0.5)), 9)::DOUBLE AS pi0 FROM pv GROUP BY motif"),
    "sta8_overrep_none": (overrep_none, with_views("pvalues") + " SELECT * FROM pv WHERE pvalue < 0.01"),
    "sta9_overrep_binomial": (overrep_binomial, with_views("pvalues") + ", m AS (SELECT 2 * max(c) AS n FROM (SELECT count(*) AS c FROM pv GROUP BY seq_id)), " + _R.format(k="seq_id") + f", z AS (SELECT seq_id, hit_id, rank, rank + 1 AS k, pvalue AS p, n FROM r, m), t AS (SELECT *, {_SF} AS v FROM z), bst AS (SELECT seq_id, arg_min(rank, (v, rank)) AS best, min(v) AS v FROM t GROUP BY seq_id) SELECT seq_id, hit_id, rank::INT AS rank FROM r JOIN bst USING (seq_id) WHERE rank <= best AND v < 0.9"),
    "sta10_overrep_poisbinom": (overrep_poisbinom, with_views("pvalues") + ", " + _R.format(k="seq_id") + ", " + _POISBINOM),
    "sta12_overrepresented": (overrepresented, with_views("pvalues") + ", " + _QVALUES),
    "flt9_significant_sites": (significant, with_views("iv") + " SELECT id, value AS score FROM iv WHERE value > 100"),
    "mot12_motif_in_sequences": (motif_in_sequences, _IN_SEQUENCES),
}
