"""Windows and interval sweeps: sorted passes in place of range joins.

All intervals are half-open [lo, hi) with chrom and strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regseq.functions.sequence import expand
from regseq.operators.graph import _cut
from regseq.operators.scan import dealt, prefix_scan, scanned


def assign_gene(gff: DataFrame, gene: Column) -> DataFrame:
    """Each line with the gene of the nearest gene line above it on its sequence."""
    above = F.when((F.col("type") == "gene") & gene.isNotNull(), F.struct("line_no", gene.alias("gene")))
    found = prefix_scan(gff, ["seqid"], ["line_no"], {"__g": ("max", above)})
    return found.withColumn("gene_id", F.col("__g.gene")).drop("__g")


def flank(genes: DataFrame, sizes: DataFrame, length: int) -> DataFrame:
    """The `length` bases before each gene, in reading direction, cut at the sequence's ends."""
    joined = genes.join(sizes.select(F.col("id").alias("chrom"), F.col("length").alias("__size")), "chrom")
    plus = F.col("strand") == "+"
    lo = F.when(plus, F.greatest(F.col("lo") - length, F.lit(0))).otherwise(F.col("hi"))
    hi = F.when(plus, F.col("lo")).otherwise(F.least(F.col("hi") + length, F.col("__size")))
    return joined.withColumns({"lo": F.least(lo, "__size"), "hi": F.least(hi, "__size")}).drop("__size")


def extend_to_cds(promoters: DataFrame, cds: DataFrame) -> DataFrame:
    """Promoters drawn on through the 5' UTR to the first coding base; without a CDS as they were."""
    joined = promoters.join(cds.select("name", F.col("lo").alias("__lo"), F.col("hi").alias("__hi")), "name", "left")
    plus = F.col("strand") == "+"
    hi = F.when(plus & F.col("__lo").isNotNull(), F.greatest("hi", "__lo")).otherwise(F.col("hi"))
    lo = F.when(~plus & F.col("__hi").isNotNull(), F.least("lo", "__hi")).otherwise(F.col("lo"))
    return joined.withColumns({"lo": lo, "hi": hi}).drop("__lo", "__hi").select(promoters.columns)


def trim_overlaps(promoters: DataFrame, genes: DataFrame, kick: bool = False) -> DataFrame:
    """Promoters cut back at gene bodies.

    On "+": lo = min(hi, max(lo, the highest end of the genes that start before hi)); on "-" the
    mirror image.  kick drops promoters that are then empty.  One sort of both tables and a
    running maximum (minimum) each way, over ranges of a chromosome; no range join.
    """
    rows = promoters.withColumn("__p", F.lit(True)).select("chrom", "lo", "hi", "strand", "name", "__p")
    both = rows.unionByName(genes.select("chrom", "lo", "hi", F.lit(None).cast("string").alias("strand"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("__p")))
    # Written once: ranges are drawn from a sample first, and the tables may be costly.
    both = _cut(both)
    gene = ~F.col("__p")
    # Genes that start before a promoter's end: at one key promoters come first.
    up = [F.when(gene, F.col("lo")).otherwise(F.col("hi")), gene]
    down = [F.when(gene, F.col("hi")).otherwise(F.col("lo")).desc(), gene]
    swept = prefix_scan(both, ["chrom"], up, {"__end": ("max", F.when(gene, F.col("hi")))}, before=True)
    swept = prefix_scan(swept, ["chrom"], down, {"__start": ("min", F.when(gene, F.col("lo")))}, before=True).filter("__p")
    plus = F.col("strand") == "+"
    lo = F.when(plus & F.col("__end").isNotNull(), F.least("hi", F.greatest("lo", "__end"))).otherwise(F.col("lo"))
    hi = F.when(~plus & F.col("__start").isNotNull(), F.greatest("lo", F.least("hi", "__start"))).otherwise(F.col("hi"))
    out = swept.select("chrom", lo.alias("lo"), hi.alias("hi"), "name", "strand")
    return out.filter("lo < hi") if kick else out


def nearest_piece(promoters: DataFrame) -> DataFrame:
    """Of pieces of one name the one next to the start site: the last on "+", the first on "-"."""
    order = F.when(F.col("strand") == "+", -F.col("lo")).otherwise(F.col("lo"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(order, "hi"))
    return promoters.withColumn("__r", rank).filter("__r = 1").drop("__r")


def neighbours_of(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """Nearest gene on either side of each locus (chrom, position, gene_id): id and distance, at least 0.

    Left is the gene that ends last of those that start before the position; right the one that
    starts first of those that end behind it.  The locus's own gene does not count: each
    sweep carries the best gene and the best of another id.
    """
    gene = F.col("__gene")
    both = loci.select("chrom", "position", "gene_id", F.lit(False).alias("__gene"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).unionByName(
        genes.select("chrom", F.lit(None).cast("long").alias("position"), F.col("id").alias("gene_id"), F.lit(True).alias("__gene"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    )
    both = _cut(both)
    sides = {
        "__l": ([F.when(gene, F.col("lo")).otherwise(F.col("position")), gene], F.when(gene, F.struct(F.col("hi").alias("at"), F.col("gene_id").alias("id")))),
        "__r": ([F.when(gene, F.col("hi")).otherwise(F.col("position") + 1).desc(), gene], F.when(gene, F.struct((-F.col("lo")).alias("at"), F.col("gene_id").alias("id")))),
    }
    swept = both
    for side, (order, reach) in sides.items():
        parts = scanned(dealt(swept, ["chrom"], order), ["chrom"], order, {f"{side}1": ("max", reach)}, before=True)
        # The second best so far is the highest of what each gene and the best before it both reach.
        second = F.when(gene & F.col(f"{side}1").isNotNull(), F.least(f"{side}1", reach))
        swept = scanned(parts, ["chrom"], order, {f"{side}2": ("max", second)}, before=True).drop("__range")
    swept = swept.filter(~gene)

    def pick(best: str, second: str) -> Column:
        return F.when(F.col(best)["id"] == F.col("gene_id"), F.when(F.col(second)["id"] != F.col("gene_id"), F.col(second))).otherwise(F.col(best))

    swept = swept.withColumns({"__l": pick("__l1", "__l2"), "__r": pick("__r1", "__r2")})
    return swept.select(
        "chrom", "position", "gene_id",
        F.col("__l")["id"].alias("left_id"), F.greatest(F.col("position") - F.col("__l")["at"], F.lit(0)).alias("left_distance"),
        F.col("__r")["id"].alias("right_id"), F.greatest(-F.col("__r")["at"] - F.col("position") - 1, F.lit(0)).alias("right_distance"),
    )


def _reach(distance: str, cap: int, least: int, room: Column) -> Column:
    """Bases to take on one side: up to the cap, the neighbour and the sequence's end; not below the minimum but for the end."""
    return F.least(F.greatest(F.least(F.lit(cap), F.coalesce(distance, F.lit(cap))), F.lit(least)), room)


def locus_region(loci: DataFrame, genes: DataFrame, sizes: DataFrame, kind: str, cap: int = 5000, least: int = 200) -> DataFrame:
    """Region (lo, hi) of each locus (chrom, position, gene_id, strand, lo, hi of its gene):
    upstream, downstream, gene, upstream+gene, gene+downstream or all."""
    if kind not in ("upstream", "downstream", "gene", "upstream+gene", "gene+downstream", "all"):
        raise ValueError(kind)
    near = neighbours_of(loci, genes).dropDuplicates(["chrom", "position", "gene_id"])
    rows = loci.join(near, ["chrom", "position", "gene_id"]).join(sizes.select(F.col("id").alias("chrom"), F.col("length").alias("__size")), "chrom")
    left = F.greatest(F.col("lo") - _reach("left_distance", cap, least, F.col("lo")), F.lit(0))
    right = F.least(F.col("hi") + _reach("right_distance", cap, least, F.greatest(F.col("__size") - F.col("hi"), F.lit(0))), F.col("__size"))
    plus = F.col("strand") == "+"
    up, gene, down = kind in ("upstream", "upstream+gene", "all"), "gene" in kind or kind == "all", kind in ("downstream", "gene+downstream", "all")
    lo = F.when(plus, left if up else F.col("lo") if gene else F.col("hi")).otherwise(left if down else F.col("lo") if gene else F.col("hi"))
    hi = F.when(plus, right if down else F.col("hi") if gene else F.col("lo")).otherwise(right if up else F.col("hi") if gene else F.col("lo"))
    return rows.select("chrom", "position", "gene_id", "strand", F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))


def core_promoter(loci: DataFrame, genes: DataFrame, length: int, least: int = 200, stop: bool = True) -> DataFrame:
    """`length` bases before each locus, cut at the neighbour if stop, but at least `least`; never below 0."""
    rows = loci.join(neighbours_of(loci, genes).dropDuplicates(["chrom", "position", "gene_id"]), ["chrom", "position", "gene_id"])
    plus = F.col("strand") == "+"
    distance = F.when(plus, F.col("left_distance")).otherwise(F.col("right_distance"))
    take = F.greatest(F.least(F.lit(length), F.coalesce(distance, F.lit(length))), F.lit(least)) if stop else F.lit(length)
    lo = F.when(plus, F.greatest(F.col("position") - take, F.lit(0))).otherwise(F.col("position") + 1)
    hi = F.when(plus, F.col("position")).otherwise(F.col("position") + 1 + take)
    return rows.select("chrom", "position", "gene_id", "strand", lo.alias("lo"), hi.alias("hi"))


def stop_at_neighbour(slices: DataFrame, genes: DataFrame) -> DataFrame:
    """Slices (chrom, lo, hi, gene_id, position) cut where the neighbours of their locus begin."""
    near = neighbours_of(slices.select("chrom", "position", "gene_id"), genes).dropDuplicates(["chrom", "position", "gene_id"])
    rows = slices.join(near, ["chrom", "position", "gene_id"])
    lo = F.greatest("lo", F.coalesce(F.col("position") - F.col("left_distance"), F.col("lo")))
    hi = F.least("hi", F.coalesce(F.col("position") + 1 + F.col("right_distance"), F.col("hi")))
    return rows.select("chrom", "position", "gene_id", F.least(lo, hi).alias("lo"), hi.alias("hi"))


def islands(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """df with island: intervals of one key are of one island while they start no more than `gap` past the end so far.

    gap 0 joins intervals that touch; -1 asks for a shared base.
    """
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    # Of equal intervals the one that begins an island comes first.
    running = Window.partitionBy(*keys).orderBy("lo", "hi", F.desc("__new")).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__end", F.max("hi").over(before))
    marked = marked.withColumn("__new", F.when(F.col("__end").isNull() | (F.col("lo") > F.col("__end") + gap), 1).otherwise(0))
    return marked.withColumn("island", F.sum("__new").over(running)).drop("__new", "__end")


def merge_intervals(df: DataFrame, keys: list[str] | None = None, to_positive: bool = False) -> DataFrame:
    """Disjoint intervals: those that share a base become one, by chrom and strand (or the keys); n counts them.
    to_positive puts all on the positive strand first."""
    if to_positive:
        df = df.withColumn("strand", F.lit("+"))
    keys = keys or ["chrom", "strand"]
    return islands(df, keys, -1).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).drop("island")


def region_intervals(modules: DataFrame, by_gene: bool = True) -> DataFrame:
    """The modules of regions as disjoint intervals, for each gene or over all."""
    return merge_intervals(modules, ["gene_id", "chrom"] if by_gene else ["chrom"])


def expand_sites(sites: DataFrame, up: int, down: int) -> DataFrame:
    """Sites grown by flanks, and merged."""
    lo, hi = expand("lo", "hi", "strand", up, down)
    return merge_intervals(sites.withColumns({"lo": F.greatest(lo, F.lit(0)), "hi": hi}), ["chrom"])


def mask_sites(intervals: DataFrame, sites: DataFrame) -> DataFrame:
    """intervals (id, lo, seq) with the bases of their sites (id, lo, hi, on the same region) turned to N."""
    inside = sites.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("__s"))
    rows = intervals.join(inside, "id", "left")
    put = lambda acc, s: F.overlay(acc, F.repeat(F.lit("N"), F.least(s["hi"] - F.col("lo"), F.length(acc)) - F.greatest(s["lo"] - F.col("lo"), F.lit(0))), F.greatest(s["lo"] - F.col("lo"), F.lit(0)) + 1)
    hit = F.filter(F.coalesce("__s", F.array().cast("array<struct<lo:int,hi:int>>")), lambda s: (s["hi"] > F.col("lo")) & (s["lo"] < F.col("lo") + F.length("seq")))
    return rows.withColumn("seq", F.aggregate(hit, F.col("seq"), put)).drop("__s")


def conserved_runs(windows: DataFrame, threshold: float, width: int) -> DataFrame:
    """Runs of successive windows (pair_id, offset, score) of at least the threshold: [first, last + width - 1], closed."""
    good = windows.filter(F.col("score") >= threshold).select("pair_id", "offset").distinct()
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("offset"))
    return good.withColumn("__g", F.col("offset") - rank).groupBy("pair_id", "__g").agg(F.min("offset").alias("start"), (F.max("offset") + width - 1).alias("end"), F.count("*").alias("n_windows")).drop("__g")


def match_runs(runs1: DataFrame, runs2: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """Window pairs' runs that point from one region of sequence 1 into one of sequence 2, as offsets on both."""
    inside = lambda r, tag, off: r.select("pair_id", F.col("start").alias(f"start{tag}"), F.explode(F.sequence("start", F.col("end") - width + 1)).alias(off))
    joined = pairs.join(inside(runs1, 1, "offset1"), ["pair_id", "offset1"]).join(inside(runs2, 2, "offset2"), ["pair_id", "offset2"])
    rank = F.dense_rank().over(Window.partitionBy("pair_id", "start1", "start2").orderBy("offset1"))
    keyed = joined.withColumn("__g", F.col("offset1") - rank)
    return keyed.groupBy("pair_id", "start1", "start2", "__g").agg(F.min("offset1").alias("from1"), (F.max("offset1") + width - 1).alias("to1"), F.min("offset2").alias("from2"), (F.max("offset2") + width - 1).alias("to2"), F.count("*").alias("n")).drop("__g")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Overlapping regions of a gene as one, with their matches' offsets taken from the lower bound."""
    joined = islands(runs, ["gene_id", "chrom"], -1)
    low = joined.withColumn("__lo", F.min("lo").over(Window.partitionBy("gene_id", "chrom", "island")))
    match = F.struct((F.col("lo") - F.col("__lo")).alias("offset"), F.col("match").alias("match"))
    return low.groupBy("gene_id", "chrom", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(match)).alias("matches")).drop("island")


def mask_profile(profile: DataFrame, windows: DataFrame, cap: float) -> DataFrame:
    """Profile scores (id, offset, score), 0 where the window's repeat ratio exceeds the cap."""
    joined = profile.join(windows.select("id", "offset", "repeat_ratio"), ["id", "offset"], "left")
    return joined.withColumn("score", F.when(F.col("repeat_ratio") > cap, F.lit(0).cast(profile.schema["score"].dataType)).otherwise(F.col("score"))).drop("repeat_ratio")


def dedupe_names(df: DataFrame, order: str) -> DataFrame:
    """Second and later rows of a name get the suffixes _2, _3, ..."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return df.withColumn("__r", rank).withColumn("name", F.when(F.col("__r") > 1, F.concat_ws("_", "name", F.col("__r").cast("string"))).otherwise(F.col("name"))).drop("__r")


