"""Ortholog and neighbour graphs: nodes (id, type, attrs) and edges (src, dst, bidir, attrs)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a loop's state, in the folder that spark.checkpoint.dir names."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        top = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = f"/tmp/regseq-{uuid.uuid4().hex}"
        sc.setCheckpointDir(top)
    return df.checkpoint()


def links(edges: DataFrame) -> DataFrame:
    """Each link once: a bidirectional one in canonical order, a directed one only if no bidirectional one has its ends."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    canon = edges.select(F.when(F.col("bidir"), low).otherwise(F.col("src")).alias("src"), F.when(F.col("bidir"), high).otherwise(F.col("dst")).alias("dst"), "bidir", low.alias("__l"), high.alias("__h"))
    both = F.max("bidir").over(Window.partitionBy("__l", "__h"))
    return canon.withColumn("__b", both).filter("bidir or not __b").select("src", "dst", "bidir").distinct()


def merge_networks(nodes1: DataFrame, edges1: DataFrame, nodes2: DataFrame, edges2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union: of a node in both the second's attributes count, of a link in both the first's."""
    tagged = lambda a, b: a.withColumn("__p", F.lit(1)).unionByName(b.withColumn("__p", F.lit(2)))
    nodes = tagged(nodes1, nodes2).groupBy("id").agg(F.max_by("type", "__p").alias("type"), F.max_by("attrs", "__p").alias("attrs"))
    edges = tagged(edges1, edges2).groupBy("src", "dst", "bidir").agg(F.min_by("attrs", "__p").alias("attrs"))
    return nodes, edges


def _kept_by(df: DataFrame, key: str) -> DataFrame:
    """df written once in partitions of its key, which joins on the key then use as they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _cut(df.repartition(parts, key))


def _walk(seeds: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int | None = None) -> DataFrame:
    """(id, level) of all that steps lead to from the seeds, up to `depth` levels or until nothing is new.

    step gives the ids (id) next to a frontier (id).  A round writes its frontier only; the
    frontiers so far are joined into one table every few rounds, so that plans stay short.
    """
    frontier = _cut(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    seen, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        found = step(frontier.select("id")).distinct().join(seen, "id", "left_anti")
        frontier = _cut(found.select("id", F.lit(level).alias("level")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if level % 8 == 0:
            seen = _kept_by(seen, "id")
    return seen


def candidate_network(seeds: DataFrame, hits: DataFrame, n: int, depth: int) -> DataFrame:
    """(src, dst, level): best n hits from the seeds on, `depth` levels far; each node is followed once."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("significance", "target"))
    best = _kept_by(hits.withColumn("__r", rank).filter(F.col("__r") <= n).select(F.col("query").alias("src"), F.col("target").alias("dst")), "src")
    reached = _walk(seeds, lambda f: best.join(f.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")), depth - 1)
    return best.join(reached.select(F.col("id").alias("src"), (F.col("level") + 1).alias("level")), "src").filter(F.col("level") <= depth).select("src", "dst", "level")


def clean_orthology(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a reciprocal link and those they name as nearest genes; links between kept nodes, and to nearest genes."""
    mutual = edges.filter("bidir").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    core = nodes.join(mutual, "id", "left_semi")
    near = core.select("id", F.explode_outer("nearest_genes").alias("near")).filter("near is not null")
    kept = core.select("id").union(near.select(F.col("near").alias("id"))).distinct()
    inner = edges.select("src", "dst", "bidir").join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "bidir")
    return nodes.join(kept, "id", "left_semi"), inner.union(near.select(F.col("id").alias("src"), F.col("near").alias("dst"), F.lit(False).alias("bidir"))).distinct()


def synteny_closure(seeds: DataFrame, region_genes: DataFrame, orthologs: DataFrame) -> DataFrame:
    """(id, level): genes reached from the seeds by going to all genes of a gene's region and on to
    their orthologs, until nothing is new, however many hops that takes."""
    beside = _kept_by(region_genes.select(F.col("gene_id").alias("id"), "region_id").distinct(), "id")
    members = _kept_by(region_genes.select("region_id", F.col("gene_id").alias("near")).distinct(), "region_id")
    there = _kept_by(orthologs.select(F.col("a").alias("near"), F.col("b").alias("id")).union(orthologs.select(F.col("b").alias("near"), F.col("a").alias("id"))).distinct(), "near")

    def step(frontier: DataFrame) -> DataFrame:
        regions = beside.join(frontier, "id", "left_semi").select("region_id").distinct()
        near = members.join(regions, "region_id", "left_semi").select("near").distinct()
        return near.select(F.col("near").alias("id")).union(there.join(near, "near", "left_semi").select("id"))

    return _walk(seeds, step)


def add_orthologs(nodes: DataFrame, edges: DataFrame, orthologs: DataFrame, species: list[str], once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Network with the orthologs (gene_id, ortholog, ortholog_species) of its nodes in the species.

    once: orthologs name each pair of ids in these species once.  The new links are then not
    shuffled: links that the network has already, few as a rule, are taken out of them.
    """
    own = nodes.select(F.col("id").alias("gene_id")).distinct()
    new = orthologs.filter(F.col("ortholog_species").isin(species)).join(own, "gene_id", "left_semi")
    found = new.select(F.col("gene_id").alias("src"), F.col("ortholog").alias("dst"), F.lit(True).alias("bidir"))
    ids = nodes.select("id").union(new.select(F.col("ortholog").alias("id"))).distinct()
    had = edges.select("src", "dst", "bidir")
    if not once:
        return ids, had.union(found).distinct()
    both = _cut(had.filter("bidir").join(own.withColumnRenamed("gene_id", "src"), "src", "left_semi").select("src", "dst").distinct())
    return ids, had.distinct().union(found if both.isEmpty() else found.join(both, ["src", "dst"], "left_anti"))


def edge_lengths(edges: DataFrame) -> DataFrame:
    """edges (src, dst, weights) with length: the log of the root of the summed squares, scaled to 0 to 10; 5 if all are equal."""
    raw = F.log(F.sqrt(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)))
    rows = edges.withColumn("__x", raw)
    bounds = rows.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    joined = rows.join(F.broadcast(bounds), F.lit(True))
    return joined.withColumn("length", F.when(F.col("__hi") > F.col("__lo"), 10 * (F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(5.0))).drop("__x", "__lo", "__hi")
