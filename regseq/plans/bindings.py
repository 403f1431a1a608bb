"""Views of the given tables as sequences, intervals, hits and sites, in Spark and in DuckDB.

The tables hold no genomes; letters become bases, events intervals, and order lines hits.
Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AS_BASES = "ACGTACGTANCGTACGNTACGTANCN"

GENE_TYPES = ("view", "signup", "purchase")

#: Rows of a partition, about, and how many partitions of these make a table large.
PART_ROWS, LARGE = 1 << 18, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows, dealt by the keys into partitions of about PART_ROWS, so that a task's memory does not
    grow with the table, whatever the session's number of partitions; a table that is not large stays as it is."""
    parts = -(-rows // PART_ROWS)
    return df if parts <= LARGE else df.repartition(parts, *keys)


def _bases(text: str) -> Column:
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, AS_BASES)


_BASES_SQL = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{AS_BASES}')"


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, lang, seq) of every document."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "source", "lang", _bases("text").alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, seq) of every benchmark item; n numbers them."""
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("item_id").alias("n"), _bases("text").alias("seq"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, id, name, chrom, lo, hi, strand, type, value): an event is an interval on its user's chromosome."""
    n = F.col("event_id")
    lo = (n * 7919) % 200000
    return table(spark, sf_dir, "events").select(
        n.alias("n"), F.concat(F.lit("e"), n.cast("string")).alias("id"), F.concat(F.lit("e"), n.cast("string")).alias("name"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chrom"),
        lo.alias("lo"), (lo + 50 + (n * 31) % 900).alias("hi"), F.when(n % 2 == 0, "+").otherwise("-").alias("strand"), F.col("event_type").alias("type"), "value",
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As intervals, but dealt over all documents as chromosomes and over their whole lengths."""
    n = F.col("n")
    # Dealt out first: behind a join, each event would read its document's letters again.
    size = seqs(spark, sf_dir).select(F.col("id").alias("chrom"), F.length("seq").alias("__size")).repartition("chrom")
    dealt = intervals(spark, sf_dir).withColumn("chrom", F.concat(F.lit("d"), (n % table(spark, sf_dir, "documents").count()).cast("string")))
    lo = (n * 7919) % F.greatest(F.col("__size") - 200, F.lit(1))
    return dealt.join(size, "chrom").withColumns({"lo": lo, "hi": lo + 20 + (n * 31) % 180}).drop("__size")


def genes(df: DataFrame) -> DataFrame:
    return df.filter(F.col("type").isin(*GENE_TYPES))


def promoters(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("type").isin(*GENE_TYPES))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, query_db, target, target_db, significance): parts hit suppliers and the other way round."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("there"), F.min(F.col("l_extendedprice") * F.col("l_quantity")).alias("back"))
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    there = pairs.select(part.alias("query"), F.lit("part").alias("query_db"), supplier.alias("target"), F.lit("supplier").alias("target_db"), F.col("there").alias("significance"))
    return there.union(pairs.select(supplier, F.lit("supplier"), part, F.lit("part"), F.col("back")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, bidir): customers and suppliers that trade, bidirectional if an urgent order is among it."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # Both sides in one number of partitions, which the join uses as they are.
    n = lines.count()
    orders, lines = spread(orders, n, "o_orderkey"), spread(lines, n, "l_orderkey")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), (F.col("o_orderpriority") == "1-URGENT").alias("bidir"), F.col("l_quantity").alias("weight"))


def pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hit_id, seq_id, motif, pvalue) of every event."""
    n = F.col("n")
    return intervals(spark, sf_dir).select(n.alias("hit_id"), F.col("chrom").alias("seq_id"), F.col("type").alias("motif"), (((n * 7919) % 9973 + 1) / 10000.0).alias("pvalue"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(motif_id, seq): the twelve bases behind every GAT of each document, by source."""
    return seqs(spark, sf_dir).select(F.col("source").alias("motif_id"), F.explode(F.regexp_extract_all("seq", F.lit("GAT([ACGTN]{12})"), 1)).alias("seq"))


_TYPES = ", ".join(f"'{t}'" for t in GENE_TYPES)
#: The same views for DuckDB, to stand in WITH.
SQL = {
    "seqs": f"seqs AS (SELECT 'd' || doc_id AS id, source, lang, {_BASES_SQL} AS seq FROM documents)",
    "items": f"items AS (SELECT 'b' || item_id AS id, item_id AS n, {_BASES_SQL} AS seq FROM benchmark)",
    "iv": "iv AS (SELECT event_id AS n, 'e' || event_id AS id, 'e' || event_id AS name, 'c' || user_id AS chrom, (event_id * 7919) % 200000 AS lo, (event_id * 7919) % 200000 + 50 + (event_id * 31) % 900 AS hi, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_type AS type, value FROM events)",
    "pl": "p0 AS (SELECT event_id AS n, 'd' || (event_id % (SELECT count(*) FROM documents)) AS chrom, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_type AS type FROM events), pl AS (SELECT n, 'e' || n AS id, 'e' || n AS name, chrom, (n * 7919) % greatest(length(seq) - 200, 1) AS lo, (n * 7919) % greatest(length(seq) - 200, 1) + 20 + (n * 31) % 180 AS hi, strand, type FROM p0 JOIN seqs ON seqs.id = chrom)",
    "iv_genes": f"g AS (SELECT * FROM iv WHERE type IN ({_TYPES}))",
    "iv_prom": f"p AS (SELECT * FROM iv WHERE type NOT IN ({_TYPES}))",
    "pl_genes": f"g AS (SELECT * FROM pl WHERE type IN ({_TYPES}))",
    "pl_prom": f"p AS (SELECT * FROM pl WHERE type NOT IN ({_TYPES}))",
    "hits": "pairs AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS there, min(l_extendedprice * l_quantity) AS back FROM lineitem GROUP BY ALL), hits AS (SELECT 'p' || l_partkey AS query, 'part' AS query_db, 's' || l_suppkey AS target, 'supplier' AS target_db, there AS significance FROM pairs UNION ALL SELECT 's' || l_suppkey, 'supplier', 'p' || l_partkey, 'part', back FROM pairs)",
    "edges": "edges AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, o_orderpriority = '1-URGENT' AS bidir, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "pvalues": "pv AS (SELECT event_id AS hit_id, 'c' || user_id AS seq_id, event_type AS motif, ((event_id * 7919) % 9973 + 1) / 10000.0::DOUBLE AS pvalue FROM events)",
    "aligned": "aligned AS (SELECT source AS motif_id, unnest(regexp_extract_all(seq, 'GAT([ACGTN]{12})', 1)) AS seq FROM seqs)",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)


#: Greedy choice as a recursion along the rank: `taken` holds the sites so far.
_GREEDY = "od AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY interval_idx ORDER BY pvalue, site, strand) AS r FROM {t}), gr AS (SELECT interval_idx, 0::BIGINT AS r, []::INT[] AS taken, false AS took FROM od GROUP BY 1 UNION ALL SELECT interval_idx, r, CASE WHEN t THEN list_append(taken, site) ELSE taken END, t FROM (SELECT gr.taken, od.*, len(list_filter(gr.taken, lambda x: abs(x - od.site) < {w})) = 0 AND len(gr.taken) < {n} AS t FROM gr JOIN od ON od.interval_idx = gr.interval_idx AND od.r = gr.r + 1)), ch AS (SELECT interval_idx, row_number() OVER (PARTITION BY interval_idx ORDER BY r)::INT AS rank, site, strand, pvalue FROM gr JOIN od USING (interval_idx, r) WHERE took)"


def greedy_sql(views: str, width: int, n: int, of: str) -> str:
    """The sites of table `of` (interval_idx, site, strand, pvalue) that are chosen greedily, n of an interval at most."""
    return views.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _GREEDY.format(t=of, w=width, n=n) + " SELECT interval_idx, rank, site, strand, pvalue FROM ch"
