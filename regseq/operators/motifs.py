"""Motifs: long tables (motif_id, pos, base, count or freq), their measures, distances and scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regseq.functions.kernels import motif_scores
from regseq.functions.sequence import site_interval
from regseq.operators.graph import _cut
from regseq.operators.statistics import best_binomial
from regseq.operators.topk import top_sites

BASES = "ACGT"
#: What lies beyond a motif's ends when two are compared.
OVERHANG = {"A": 0.32, "C": 0.18, "G": 0.18, "T": 0.32}
#: Two-way ties.
IUPAC = {"GT": "K", "AC": "M", "AG": "R", "CG": "S", "AT": "W", "CT": "Y"}
TINY = 1e-9
#: Motifs that one scan takes.
MAX_MOTIFS = 20_000


def frequencies(counts: DataFrame, kind: str = "p", p: float = 1.0) -> DataFrame:
    """counts with freq = (count + c) / (n + 4 c); the pseudocount c is p, p / n ("p/n") or p / sqrt(n) ("p/sqrt")."""
    n = F.sum("count").over(Window.partitionBy("motif_id", "pos"))
    c = {"p": F.lit(p), "p/n": p / F.col("__n"), "p/sqrt": p / F.sqrt("__n")}[kind]
    return counts.withColumn("__n", n).withColumn("freq", (F.col("count") + c) / (F.col("__n") + 4 * c)).drop("__n")


def _flog(f: str) -> Column:
    return F.when(F.col(f) > 0, F.col(f) * F.log2(f)).otherwise(F.lit(0.0))


def information_content(freq: DataFrame) -> DataFrame:
    """(motif_id, pos, ic, total): 2 + sum f log2 f of each position, and of the motif."""
    per = freq.groupBy("motif_id", "pos").agg((2 + F.sum(_flog("freq"))).alias("ic"))
    return per.withColumn("total", F.sum("ic").over(Window.partitionBy("motif_id")))


def ic_matrix(freq: DataFrame) -> DataFrame:
    """freq with value = freq times its position's information."""
    return freq.join(information_content(freq).select("motif_id", "pos", "ic"), ["motif_id", "pos"]).withColumn("value", F.col("freq") * F.col("ic"))


def entropy(freq: DataFrame) -> DataFrame:
    per = freq.groupBy("motif_id", "pos").agg((-F.sum(_flog("freq"))).alias("entropy"))
    return per.withColumn("total", F.sum("entropy").over(Window.partitionBy("motif_id")))


def motif_revcomp(freq: DataFrame) -> DataFrame:
    length = F.max("pos").over(Window.partitionBy("motif_id"))
    return freq.withColumn("__l", length).withColumns({"pos": F.col("__l") - F.col("pos"), "base": F.translate("base", "ACGT", "TGCA")}).drop("__l")


def consensus(freq: DataFrame) -> DataFrame:
    """(motif_id, consensus): the largest base of each position, IUPAC letters for two-way ties, else N."""
    top = F.max("freq").over(Window.partitionBy("motif_id", "pos"))
    best = freq.withColumn("__m", top).filter(F.col("freq") == F.col("__m")).groupBy("motif_id", "pos").agg(F.array_join(F.array_sort(F.collect_set("base")), "").alias("b"))
    letter = F.when(F.length("b") == 1, F.col("b"))
    for pair, code in IUPAC.items():
        letter = letter.when(F.col("b") == pair, code)
    rows = best.select("motif_id", "pos", letter.otherwise("N").alias("c"))
    return rows.groupBy("motif_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "").alias("consensus"))


def kl(p: DataFrame, q: DataFrame) -> DataFrame:
    """(kl) of two motifs of one length, zeros counting as 1e-9."""
    full = lambda df, name: df.select("pos", "base", F.when(F.col("freq") > 0, F.col("freq")).otherwise(TINY).alias(name))
    return full(p, "p").join(full(q, "q"), ["pos", "base"]).agg(F.sum(F.col("p") * F.log2(F.col("p") / F.col("q"))).alias("kl"))


def compact(freq: DataFrame) -> DataFrame:
    """(motif_id, m): one row a motif, m an array of (A, C, G, T) for each position."""
    cell = lambda b: F.coalesce(F.max(F.when(F.col("base") == b, F.col("freq"))), F.lit(0.0))
    rows = freq.groupBy("motif_id", "pos").agg(F.array(*(cell(b) for b in BASES)).alias("f"))
    return rows.groupBy("motif_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("m"))


def _least_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of motifs x (i, n, 4) and y (j, m, 4) the least distance over all shifts that let them share a position.

    A position pair costs half of p log p + q log q - p log q - q log p; the mixed terms of all
    pairs come from two matrix products, and a shift's are a diagonal of them.  Positions that
    overhang cost what they cost against OVERHANG.
    """
    pad = np.array([OVERHANG[b] for b in BASES])

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        v = np.where(v > 0, v, TINY)
        log = np.log2(v)
        sums = lambda a: np.concatenate([np.zeros((len(a), 1)), np.cumsum(a, axis=1)], axis=1)
        return v, log, sums((v * log).sum(axis=2) / 2), sums(((v - pad) * (log - np.log2(pad))).sum(axis=2) / 2)

    (p, lp, hp, op), (q, lq, hq, oq) = parts(x), parts(y)
    (i, n, _), (j, m, _) = x.shape, y.shape
    mixed = (p.reshape(-1, 4) @ lq.reshape(-1, 4).T + lp.reshape(-1, 4) @ q.reshape(-1, 4).T).reshape(i, n, j, m) / 2
    best = np.full((i, j), np.inf)
    for s in range(1 - m, n):
        # Positions lo to hi of x lie over positions lo - s to hi - s of y.
        lo, hi = max(0, s), min(n, m + s)
        k = np.arange(lo, hi)
        # The two index arrays bring the shared positions to the front.
        shared = mixed[:, k, :, k - s].sum(axis=0)
        own = (hp[:, hi] - hp[:, lo] + op[:, lo] + op[:, n] - op[:, hi])[:, None]
        other = (hq[:, hi - s] - hq[:, lo - s] + oq[:, lo - s] + oq[:, m] - oq[:, hi - s])[None, :]
        np.minimum(best, own + other - shared, out=best)
    return best


#: Motifs of a block of the grid of pairs, about.
GRID = 128


def motif_distances(freq: DataFrame, turned: bool = True) -> DataFrame:
    """(a, b, distance) of every two motifs, a < b: the least over shifts, and over b's reverse complement,
    of the mean of both Kullback-Leibler directions, overhanging positions against OVERHANG.

    Every pair is a row of the result.  Motifs are dealt into blocks of about GRID; each block
    pair is one group, whose motifs meet in matrix products, and no pair is made by a join.
    """
    one = _cut(compact(freq).filter("motif_id is not null"))
    blocks = -(-one.count() // GRID) or 1
    own = F.pmod(F.xxhash64("motif_id"), F.lit(blocks)).cast("int")
    dealt = one.withColumn("__own", own).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("motif_id", "m", "__own", F.least("__own", "__o").alias("__i"), F.greatest("__own", "__o").alias("__j"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        values = [np.array([list(row) for row in m], float) for m in group["m"]]
        ids, side = group["motif_id"].tolist(), (group["__own"] == group["__i"]).to_numpy()
        alone = group["__i"].iloc[0] == group["__j"].iloc[0]
        size = np.array([len(v) for v in values])
        left, right = np.flatnonzero(side), np.arange(len(ids)) if alone else np.flatnonzero(~side)
        found = []
        for n in np.unique(size[left]):
            for k in np.unique(size[right]):
                a, b = left[size[left] == n], right[size[right] == k]
                x, y = np.stack([values[t] for t in a]), np.stack([values[t] for t in b])
                d = _least_distances(x, y)
                if turned:
                    d = np.minimum(d, _least_distances(x, y[:, ::-1, ::-1]))
                r, c = np.nonzero(a[:, None] < b[None, :]) if alone else np.indices(d.shape).reshape(2, -1)
                found += zip([ids[t] for t in a[r]], [ids[t] for t in b[c]], d[r, c].tolist(), strict=True)
        return pd.DataFrame(found, columns=["a", "b", "distance"])

    kind = freq.schema["motif_id"].dataType.simpleString()
    rows = dealt.groupBy("__i", "__j").applyInPandas(meet, f"a {kind}, b {kind}, distance double")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def cluster_motifs(distances: DataFrame, threshold: float) -> DataFrame:
    """(motif_id, cluster_id) by average linkage up to the threshold; a cluster is named by its least motif.

    A table holds, for every two clusters, the sum of their motifs' distances and their number.
    Each round merges all pairs of clusters that are each other's nearest (average linkage is
    reducible, so this gives the clusters of one merge at a time), and adds up the rows of
    merged clusters only; the others stay as they are.  There are as many rounds as it takes.
    """
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = _cut(distances.select(F.explode(both).alias("x"), F.col("distance").alias("s"), F.lit(1).cast("long").alias("w")).select("x.*", "s", "w"))
    now = _cut(pairs.select(F.col("a").alias("motif_id")).distinct().withColumn("cluster_id", F.col("motif_id")))
    while True:
        # Both directions of a pair see one rounded value, so that nearest is mutual.
        key = F.struct(F.round(F.col("s") / F.col("w"), 9).alias("d"), F.least("a", "b").alias("l"), F.greatest("a", "b").alias("h"))
        near = pairs.groupBy("a").agg(F.min(key).alias("k")).filter(F.col("k.d") <= threshold)
        merged = _cut(near.groupBy("k.l", "k.h").count().filter("count = 2").select("l", "h"))
        if merged.isEmpty():
            return now
        new = merged.select(F.explode(F.array("l", "h")).alias("old"), F.col("l").alias("new"))
        named = pairs.join(new.toDF("a", "na"), "a", "left").join(new.toDF("b", "nb"), "b", "left")
        still = named.filter("na is null and nb is null").select("a", "b", "s", "w")
        moved = named.filter("na is not null or nb is not null").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "s", "w").filter("a <> b")
        pairs = _cut(still.union(moved.groupBy("a", "b").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))))
        now = _cut(now.join(new.toDF("cluster_id", "to"), "cluster_id", "left").select("motif_id", F.coalesce("to", "cluster_id").alias("cluster_id")))


def representatives(clusters: DataFrame, freq: DataFrame) -> DataFrame:
    """(cluster_id, motif_id) of the highest entropy per position; the first id of equal ones."""
    per = entropy(freq).groupBy("motif_id").agg((F.sum("entropy") / F.count("*")).alias("e"))
    order = F.struct(F.round("e", 9).alias("e"), F.col("motif_id"))
    rows = clusters.join(per, "motif_id").groupBy("cluster_id").agg(F.max("e").alias("__top"), F.collect_list(order).alias("o"))
    top = F.array_max(F.transform("o", lambda x: x["e"]))
    return rows.select("cluster_id", F.array_min(F.transform(F.filter("o", lambda x: x["e"] == top), lambda x: x["motif_id"])).alias("motif_id"))


def scan(seqs: DataFrame, freq: DataFrame, background: dict[str, float] | None = None, least: float | None = None) -> DataFrame:
    """(id, motif_id, site, strand, score): log-odds of each window against the background on both strands.

    A base that is not A, C, G or T adds 0.  Motifs, at most MAX_MOTIFS, go to all tasks as
    arrays; `least` drops lower scores in the scan.
    """
    background = background or dict.fromkeys(BASES, 0.25)
    rows = freq.groupBy("motif_id").agg(F.collect_list(F.struct("pos", "base", "freq")).alias("c")).limit(MAX_MOTIFS + 1).collect()
    if len(rows) > MAX_MOTIFS:
        raise ValueError(f"more than {MAX_MOTIFS} motifs")
    tables = []
    for r in sorted(rows, key=lambda r: r["motif_id"]):
        value = np.zeros((max(c["pos"] for c in r["c"]) + 1, 4))
        for c in r["c"]:
            value[c["pos"], BASES.index(c["base"])] = c["freq"]
        tables.append((r["motif_id"], np.log2(np.where(value > 0, value, TINY) / [background[b] for b in BASES])))
    return motif_scores(seqs, tables, freq.schema["motif_id"].dataType, least)


def empirical_p(scores: DataFrame, background: DataFrame, step: float = 0.01) -> DataFrame:
    """scores with pvalue: the share of background scores of the motif in the same bin or above; (0 + 1) / (n + 1) at the least.

    Both sides meet as bins: an as-of join by one running sum over the bins, not over scores.
    """
    bin_ = F.floor(F.col("score") / step).cast("long").alias("bin")
    counts = background.select("motif_id", bin_).groupBy("motif_id", "bin").agg(F.count("*").alias("n"))
    wanted = scores.select("motif_id", bin_).distinct().withColumn("n", F.lit(0).cast("long"))
    bins = counts.unionByName(wanted).groupBy("motif_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("motif_id").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = bins.withColumn("above", F.sum("n").over(down)).withColumn("total", F.sum("n").over(Window.partitionBy("motif_id")))
    p = (F.col("above") + 1) / (F.col("total") + 1)
    return scores.withColumn("bin", F.floor(F.col("score") / step).cast("long")).join(tail.select("motif_id", "bin", p.alias("pvalue")), ["motif_id", "bin"]).drop("bin")


def motif_in_sequences(sites: DataFrame, width: int, n_sites: int) -> DataFrame:
    """Per interval: the least binomial tail over its greedily chosen sites, and how many sites give it."""
    chosen = top_sites(sites, width).select(F.col("interval_idx").alias("group_id"), "pvalue")
    return best_binomial(chosen, n_sites).withColumnRenamed("group_id", "interval_idx")


def hits_to_annotations(hits: DataFrame, seqs: DataFrame) -> DataFrame:
    """Hits (seq_id, motif, site, strand, width is per row) as annotations on the region of their sequence."""
    rows = hits.withColumnRenamed("strand", "__s").join(seqs.select("seq_id", "chrom", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("strand").alias("__g")), "seq_id")
    lo, hi, strand = site_interval("site", F.col("width"), "__s", "__lo", "__hi", "__g")
    return rows.select("seq_id", F.col("motif").alias("description"), F.lit("motif_hit").alias("type"), "chrom", lo.alias("lo"), hi.alias("hi"), strand.alias("strand"))


def motif_site_stats(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(motif_id, seq_id, site, ratio, scaled): sites per sequence that has any, and positions scaled to the longest sequence."""
    size = seqs.select(F.col("id").alias("seq_id"), F.length("seq").alias("n"))
    longest = seqs.agg(F.max(F.length("seq")).alias("longest"))
    rows = sites.join(size, "seq_id").join(F.broadcast(longest), F.lit(True))
    per = sites.groupBy("motif_id").agg((F.count("*") / F.countDistinct("seq_id")).alias("ratio"))
    scaled = F.col("site") / (F.col("n") - F.col("width") + 1) * (F.col("longest") - F.col("width") + 1)
    return rows.join(per, "motif_id").select("motif_id", "seq_id", "site", "ratio", scaled.alias("scaled"))


def scan_input(seqs: DataFrame) -> DataFrame:
    """Sequences, repeat-masked where that is known."""
    return seqs.withColumn("seq", F.coalesce("masked_seq", "seq")).drop("masked_seq")
