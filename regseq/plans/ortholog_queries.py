"""Queries of ortholog and graph operators on order lines, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from regseq.operators import aggregates, graph, joins, topk
from regseq.plans import bindings as b
from regseq.plans.bindings import with_views
from regseq.sources import readers, writers

_BEST = "best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query, query_db, target_db ORDER BY significance, target) = 1)"
_RBH = f"{_BEST}, rbh AS (SELECT x.query AS a, x.target AS b, x.query_db AS db_a, x.target_db AS db_b, sqrt(x.significance * y.significance) AS weight FROM best x JOIN best y ON x.query = y.target AND x.target = y.query AND x.query_db = y.target_db AND x.target_db = y.query_db)"


def best_hits(spark, d):
    return joins.best_hits(b.hits(spark, d))


def n_best_hits(spark, d):
    return joins.n_best_hits(b.hits(spark, d), 3)


def rbh(spark, d):
    return joins.reciprocal_best_hits(b.hits(spark, d)).withColumn("weight", F.round("weight", 4))


def ortholog_mapping(spark, d):
    ids = b.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return joins.ortholog_mapping(ids, joins.reciprocal_best_hits(b.hits(spark, d)))


def limit_hits(spark, d):
    return readers.limit_hits(b.hits(spark, d).filter("query_db = 'supplier'").select("query", "target"), 620)


def ortholog_table(spark, d):
    ids = b.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("query_protein"), F.col("p_brand").alias("query_gene"))
    pairs = joins.reciprocal_best_hits(b.hits(spark, d)).select(F.col("a").alias("query_protein"), F.col("b").alias("target_protein"))
    return writers.ortholog_rows(ids.join(pairs, "query_protein", "left").withColumn("target_gene", F.lit(None).cast("string")))


def fill_unknown(spark, d):
    p = b.table(spark, d, "part")
    name = F.concat(F.col("p_brand"), F.lit("."), F.col("p_partkey").cast("string"))
    gene = F.when(F.col("p_size") % 2 == 0, "unknown").otherwise(F.col("p_type"))
    return readers.fill_unknown(p.select(name.alias("query_protein"), F.concat(F.lit("t."), name).alias("target_protein"), gene.alias("target_gene"), gene.alias("query_gene")))


def pseudo_orthologs(spark, d):
    rows = b.hits(spark, d).filter("query_db = 'part'").select(F.expr("right(target, 1)").alias("species"), F.col("query").alias("query_gene"), F.col("target").alias("target_gene"))
    return topk.pseudo_orthologs(rows, 5)


def random_orthologs(spark, d):
    p, s = b.table(spark, d, "part"), b.table(spark, d, "supplier")
    return topk.random_orthologs(p.select(F.col("p_partkey").cast("string").alias("id")), s.select(F.col("s_suppkey").alias("id")), 3)


def homology(spark, d):
    s = b.table(spark, d, "supplier").select(F.col("s_nationkey").alias("homology_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene_id"), F.lit("supplier").alias("species"))
    c = b.table(spark, d, "customer").select(F.col("c_nationkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("customer "), F.col("c_mktsegment")))
    return joins.orthologs_from_homology(s.union(c), "supplier", "^customer (A|B)")


def links(spark, d):
    return graph.links(b.edges(spark, d))


def out_degree(spark, d):
    return aggregates.out_degree(b.edges(spark, d))


def neighbour_lists(spark, d):
    return aggregates.neighbours(b.edges(spark, d)).select("src", F.size("neighbours").cast("long").alias("n"), F.md5(F.array_join("neighbours", ",")).alias("digest"))


def edge_lengths(spark, d):
    rows = b.edges(spark, d).groupBy("src", "dst").agg(F.collect_list("weight").alias("weights"))
    return graph.edge_lengths(rows).select("src", "dst", F.round("length", 6).alias("length"))


def merged_networks(spark, d):
    o, c, n = b.table(spark, d, "orders"), b.table(spark, d, "customer"), b.table(spark, d, "lineitem").count()
    # Dealt once by their keys: both networks come from one shuffle, and are merged where they lie.
    e = b.spread(b.edges(spark, d), n, "src", "dst", "bidir").groupBy("src", "dst", "bidir").agg(F.max("weight").alias("most"), F.min("weight").alias("least"))
    first, second = (e.select("src", "dst", "bidir", F.create_map(F.lit("w"), w).alias("attrs")) for w in ("most", "least"))
    id_ = lambda key: F.concat(F.lit("c"), F.col(key).cast("string")).alias("id")
    n1 = b.spread(c.select(id_("c_custkey"), F.lit("customer").alias("type"), F.create_map(F.lit("k"), F.col("c_mktsegment")).alias("attrs")), n, "id")
    n2 = b.spread(o.select(id_("o_custkey")), n, "id").distinct().select("id", F.lit("buyer").alias("type"), F.create_map(F.lit("k"), F.lit("x")).alias("attrs"))
    nodes, edges = graph.merge_networks(n1, first, n2, second)
    return nodes.select("id", "type", F.col("attrs")["k"].alias("k")).unionByName(edges.select(F.concat_ws(">", "src", "dst", F.col("bidir").cast("string")).alias("id"), F.lit("edge").alias("type"), F.col("attrs")["w"].cast("int").cast("string").alias("k")))


def candidate_network(spark, d):
    seeds = b.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.candidate_network(seeds, b.hits(spark, d), 2, 2)


def clean_orthology(spark, d):
    pairs = joins.reciprocal_best_hits(b.hits(spark, d)).filter("db_a = 'part'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(True).alias("bidir"))
    ids = b.hits(spark, d).select(F.col("query").alias("id")).distinct()
    near = F.when(F.col("id").startswith("p"), F.array(F.concat(F.lit("p"), (F.substring("id", 2, 9).cast("int") + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    nodes, edges = graph.clean_orthology(ids.withColumn("nearest_genes", near), pairs)
    return edges


def synteny(spark, d):
    s = b.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene_id"), F.concat(F.lit("S"), F.floor(F.col("s_suppkey") / 3).cast("string")).alias("region_id"))
    p = b.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 3).cast("string")))
    pairs = joins.reciprocal_best_hits(b.hits(spark, d)).filter("db_a = 'part'").select("a", "b")
    return graph.synteny_closure(b.table(spark, d, "nation").select(F.concat(F.lit("s"), (F.col("n_nationkey") % 5).cast("string")).alias("id")), s.union(p), pairs)


def add_orthologs(spark, d):
    nodes = b.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    more = homology(spark, d)
    return graph.add_orthologs(nodes, b.edges(spark, d), more, ["customer BUILDING"], once=True)[1]


QUERIES = {
    "join3_best_hits": (best_hits, with_views("hits") + f", {_BEST} SELECT * FROM best"),
    "join4_n_best_hits": (n_best_hits, with_views("hits") + " SELECT *, row_number() OVER (PARTITION BY query, query_db, target_db ORDER BY significance, target)::INT AS rank FROM hits QUALIFY rank <= 3"),
    "join5_reciprocal_best_hits": (rbh, with_views("hits") + f", {_RBH} SELECT a, b, db_a, db_b, round(weight, 4) AS weight FROM rbh"),
    "join6_ortholog_mapping": (ortholog_mapping, with_views("hits") + f", {_RBH} SELECT DISTINCT 'p' || p_partkey AS id, coalesce(b, 'not found') AS ortholog FROM part LEFT JOIN rbh ON a = 'p' || p_partkey"),
    "src5_limit_hits": (limit_hits, with_views("hits") + " SELECT query, target FROM hits WHERE query_db = 'supplier' QUALIFY count(*) OVER (PARTITION BY query) <= 620"),
    "snk3_ortholog_rows": (ortholog_table, with_views("hits") + f", {_RBH} SELECT 'p' || p_partkey AS query_protein, coalesce(b, 'none') AS target_protein, CASE WHEN b IS NULL THEN 'none' ELSE 'unknown' END AS target_gene, coalesce(p_brand, 'unknown') AS query_gene FROM part LEFT JOIN rbh ON a = 'p' || p_partkey"),
    "src4_fill_unknown": (fill_unknown, "WITH z AS (SELECT p_brand || '.' || p_partkey AS q, CASE WHEN p_size % 2 = 0 THEN 'unknown' ELSE p_type END AS g FROM part) SELECT q AS query_protein, 't.' || q AS target_protein, CASE WHEN g = 'unknown' THEN 't' ELSE g END AS target_gene, CASE WHEN g = 'unknown' THEN split_part(q, '.', 1) ELSE g END AS query_gene FROM z"),
    "top11_pseudo_orthologs": (pseudo_orthologs, with_views("hits") + ", o AS (SELECT right(target, 1) AS species, query, target FROM hits WHERE query_db = 'part'), x AS (SELECT species, query AS query_gene, row_number() OVER (PARTITION BY species ORDER BY md5('5:' || query || ':' || target), query, target) AS r FROM o), y AS (SELECT species, target AS target_gene, row_number() OVER (PARTITION BY species ORDER BY md5('6:' || target || ':' || query), target, query) AS r FROM o) SELECT species, query_gene, target_gene FROM x JOIN y USING (species, r)"),
    "top12_random_orthologs": (random_orthologs, "WITH n AS (SELECT count(*) AS n FROM supplier), t AS (SELECT s_suppkey AS ortholog, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier), s AS (SELECT p_partkey::VARCHAR AS id, ('0x' || substring(md5('3:' || p_partkey), 1, 12))::BIGINT % n AS r FROM part, n) SELECT id, ortholog FROM s JOIN t USING (r)"),
    "join13_homology": (homology, "SELECT DISTINCT 's' || s_suppkey AS gene_id, 'c' || c_custkey AS ortholog, 'customer ' || c_mktsegment AS ortholog_species FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment[1] IN ('A', 'B')"),
    "gra1_links": (links, with_views("edges") + ", z AS (SELECT *, bool_or(bidir) OVER (PARTITION BY src, dst) AS b FROM edges) SELECT DISTINCT src, dst, bidir FROM z WHERE bidir OR NOT b"),
    "agg14_out_degree": (out_degree, with_views("edges") + ", z AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE bidir) SELECT src, count(*) AS degree FROM z GROUP BY src"),
    "agg14_neighbours": (neighbour_lists, with_views("edges") + ", z AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges WHERE bidir) SELECT src, count(*) AS n, md5(string_agg(dst, ',' ORDER BY dst)) AS digest FROM z GROUP BY src"),
    "gra7_edge_lengths": (edge_lengths, with_views("edges") + ", z AS (SELECT src, dst, ln(sqrt(sum(weight * weight))) AS x FROM edges GROUP BY ALL), m AS (SELECT min(x) AS lo, max(x) AS hi FROM z) SELECT src, dst, round(CASE WHEN hi > lo THEN 10 * (x - lo) / (hi - lo) ELSE 5 END, 6) AS length FROM z, m"),
    "gra2_merge_networks": (merged_networks, with_views("edges") + ", n AS (SELECT 'c' || c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'buyer' ELSE 'customer' END AS type, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'x' ELSE c_mktsegment END AS k FROM customer UNION ALL SELECT DISTINCT 'c' || o_custkey, 'buyer', 'x' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) SELECT * FROM n UNION ALL SELECT src || '>' || dst || '>' || bidir, 'edge', max(weight)::INT::VARCHAR FROM edges GROUP BY src, dst, bidir"),
    "gra3_candidate_network": (candidate_network, with_views("hits") + ", bst AS (SELECT query AS src, target AS dst, row_number() OVER (PARTITION BY query ORDER BY significance, target) AS r FROM hits), sd AS (SELECT 's' || s_suppkey AS src FROM supplier), one AS (SELECT src, dst FROM bst WHERE r <= 2 AND src IN (SELECT src FROM sd)) SELECT src, dst, 1 AS level FROM one UNION ALL SELECT src, dst, 2 FROM bst WHERE r <= 2 AND src IN (SELECT dst FROM one) AND src NOT IN (SELECT src FROM sd)"),
    "gra4_clean_orthology": (clean_orthology, with_views("hits") + f", {_RBH}, e AS (SELECT a AS src, b AS dst FROM rbh WHERE db_a = 'part'), c AS (SELECT src AS id FROM e UNION SELECT dst FROM e), nr AS (SELECT id, 'p' || (substring(id, 2)::INT + 1) AS near FROM c WHERE id LIKE 'p%' AND id IN (SELECT query FROM hits)) SELECT src, dst, true AS bidir FROM e UNION SELECT id, near, false FROM nr"),
    "gra5_synteny_closure": (synteny, with_views("hits").replace("WITH ", "WITH RECURSIVE ", 1) + f", {_RBH}, rg AS (SELECT 's' || s_suppkey AS id, 'S' || (s_suppkey // 3) AS region FROM supplier UNION ALL SELECT 'p' || p_partkey, 'P' || (p_partkey // 3) FROM part), near AS (SELECT DISTINCT x.id, y.id AS to_ FROM rg x JOIN rg y USING (region)), o AS (SELECT a, b FROM rbh WHERE db_a = 'part' UNION SELECT b, a FROM rbh WHERE db_a = 'part'), e AS (SELECT id, to_ FROM near UNION SELECT near.id, o.b FROM near JOIN o ON o.a = near.to_), reach(id, level) USING KEY (id) AS (SELECT DISTINCT 's' || (n_nationkey % 5), 0 FROM nation UNION SELECT e.to_, min(reach.level) + 1 FROM reach JOIN e ON e.id = reach.id WHERE e.to_ NOT IN (SELECT id FROM recurring.reach) GROUP BY e.to_) SELECT id, level::INT AS level FROM reach"),
    "gra6_add_orthologs": (add_orthologs, with_views("edges") + ", e AS (SELECT DISTINCT src, dst, bidir FROM edges UNION SELECT DISTINCT 's' || s_suppkey, 'c' || c_custkey, true FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING') SELECT src, dst, bidir FROM e"),
}
