"""Conserved windows of gene pairs, and the bundles that several species' windows make up.

Defaults: windows of 60 bases, thresholds 78 and 100, tolerance 20, belief 0.05.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.functions.ranks import Shares, letters, window_matches
from regseq.functions.sequence import belief, bundle_interval, repeat_ratio
from regseq.operators.greedy import greedy
from regseq.operators.sweeps import islands

WIDTH = 60
LOW, HIGH = 78, 100
TOLERANCE = 20
BELIEF = 0.05
#: Window pairs that a task looks at in one strip of sequence 1.
STRIP = 1 << 22
#: Names of sequences that are sent to all tasks at most.
BROADCAST_ROWS = 200_000


def _turned(seq: np.ndarray) -> np.ndarray:
    """The reverse complement of letters."""
    swap = np.arange(256, dtype=np.uint8)
    for a, b in zip(b"ACGTacgtNn", b"TGCAtgcaNn", strict=True):
        swap[a] = b
    return swap[seq[::-1]]


def _best_of_strands(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window pair once, with its better score."""
    i, j, score = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((-score, i * size + j))
    i, j, score = i[order], j[order], score[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return i[new], j[new], score[new]


def _window_pairs(pairs: DataFrame, width: int, cutoff: int, strands: bool, repeats: bool) -> DataFrame:
    """(pair_id, offset1, offset2, score[, repeat_ratio]) by one kernel over each pair's sequences.

    A task holds one pair at a time and works on strips of its grid.
    """
    names = ["pair_id", "offset1", "offset2", "score", *(["repeat_ratio"] if repeats else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b, *masked = (batch.column(c)[row].as_py() for c in ("seq1", "seq2", *(("masked1", "masked2") if repeats else ())))
                if a is None or b is None or len(a) < width or len(b) < width:
                    continue
                x, y = letters(a), letters(b)
                shares = [Shares(m, s) for m, s in zip(masked, (a, b), strict=True)] if repeats else []
                rows = max(64, STRIP // len(y))
                for at in range(0, len(x) - width + 1, rows):
                    strip = x[at : at + rows + width - 1]
                    parts = list(window_matches(strip, y, width, cutoff))
                    if strands:
                        parts += [(i, len(y) - j - width, score) for i, j, score in window_matches(strip, _turned(y), width, cutoff)]
                    if not parts:
                        continue
                    i, j, score = _best_of_strands(parts, len(y)) if strands else (np.concatenate([p[k] for p in parts]) for k in range(3))
                    i = i + at
                    cols = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(score)]
                    if repeats:
                        cols.append(pa.array(np.maximum(shares[0](i, width), shares[1](j, width))))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("pair_id")[row].as_py()] * len(i), pa.string()), *cols], names=names)

    more = ["masked1", "masked2"] if repeats else []
    return pairs.select("pair_id", "seq1", "seq2", *more).mapInArrow(run, "pair_id string, offset1 int, offset2 int, score int" + (", repeat_ratio double" if repeats else ""))


def window_pair_scores(pairs: DataFrame, width: int = WIDTH, cutoff: int = 0) -> DataFrame:
    """(pair_id, offset1, offset2, score): equal bases of every two windows of a pair's sequences,
    of at least the cutoff.  N equals nothing.  Null sequences and those shorter than a window have none.
    """
    return _window_pairs(pairs, width, cutoff, False, False)


def merge_strands(pairs: DataFrame, width: int = WIDTH, cutoff: int = 0, repeats: bool = False) -> DataFrame:
    """Scores against both strands of sequence 2, the better one of each window pair; a pair_id names one pair.

    With repeats, pairs have masked1 and masked2 too, and rows the larger repeat ratio of the two windows.
    """
    return _window_pairs(pairs, width, cutoff, True, repeats)


def window_repeats(seqs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(gene_id, species, offset, repeat_ratio) of all windows; seqs has seq and masked_seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                seq, masked = (batch.column(c)[row].as_py() for c in ("seq", "masked_seq"))
                at = np.arange(max(0, len(seq or "") - width + 1))
                if len(at):
                    own = [batch.column(c).take(pa.array(np.full(len(at), row))) for c in ("gene_id", "species")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(Shares(masked, seq)(at, width))], names=["gene_id", "species", "offset", "repeat_ratio"])

    kinds = [T.StructField(c, seqs.schema[c].dataType) for c in ("gene_id", "species")]
    schema = T.StructType([*kinds, T.StructField("offset", T.IntegerType()), T.StructField("repeat_ratio", T.DoubleType())])
    return seqs.select("gene_id", "species", "seq", "masked_seq").mapInArrow(run, schema)


def _comparison(df: DataFrame) -> list[str]:
    """The columns that name one comparison of a centre gene: the species, and the partner gene where it is given."""
    return [c for c in ("species", "partner") if c in df.columns]


def score_pairs(pairs: DataFrame, repeats1: DataFrame | None = None, repeats2: DataFrame | None = None, width: int = WIDTH, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Window pairs with their belief and integrated score, where belief is above 0.

    pairs: (gene_id, species[, partner], offset1, offset2, score), with repeat_ratio if the
    kernel that scored them knew it; else repeats1: (gene_id, offset, repeat_ratio), repeats2:
    (partner, offset, repeat_ratio), or (gene_id, species, offset, repeat_ratio) without
    partners, and the larger ratio of the two windows counts.
    """
    who = _comparison(pairs)
    rows = pairs
    if "repeat_ratio" not in pairs.columns:
        theirs = ["partner"] if "partner" in repeats2.columns else ["gene_id", "species"]
        one = repeats1.select("gene_id", F.col("offset").alias("offset1"), F.col("repeat_ratio").alias("__r1"))
        two = repeats2.select(*theirs, F.col("offset").alias("offset2"), F.col("repeat_ratio").alias("__r2"))
        rows = pairs.join(one, ["gene_id", "offset1"], "left").join(two, [*theirs, "offset2"], "left")
        rows = rows.withColumn("repeat_ratio", F.greatest(F.coalesce("__r1", F.lit(0.0)), F.coalesce("__r2", F.lit(0.0))))
    b, integrate = belief(100.0 * F.col("score") / width, "repeat_ratio", low, high)
    return rows.withColumns({"belief": b, "integrate": integrate}).filter("belief > 0").select("gene_id", *who, "offset1", "offset2", "score", "repeat_ratio", "belief", "integrate")


def thin_partners(scored: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of the partner windows of a centre window in a comparison those that no better one overlaps
    (belief, then integrated score, then the lower offset)."""
    who = _comparison(scored)
    rows = scored.select("gene_id", *who, "offset1", F.col("offset2").cast("int").alias("offset2"), "score", "repeat_ratio", "belief", "integrate")
    order = [-F.col("belief"), -F.col("integrate"), F.col("offset2"), F.col("score"), F.col("repeat_ratio")]
    return greedy(rows, ["gene_id", *who, "offset1"], order, [("offset2", width)])


def combine_belief(thinned: DataFrame, least: float = BELIEF) -> DataFrame:
    """(gene_id, offset1, belief, maxima) of the centre windows whose combined belief 1 - prod(1 - best of a
    comparison) is not below `least`; maxima is (species[, partner], best) of each."""
    who = _comparison(thinned)
    best = thinned.groupBy("gene_id", "offset1", *who).agg(F.max("belief").alias("best"))
    rows = best.groupBy("gene_id", "offset1").agg(F.sort_array(F.collect_list(F.struct(*who, "best"))).alias("maxima"))
    rows = rows.withColumn("belief", 1 - F.aggregate("maxima", F.lit(1.0), lambda a, x: a * (1 - x["best"])))
    return rows.filter(F.col("belief") >= least).select("gene_id", "offset1", "belief", "maxima")


def prune_partners(thinned: DataFrame, combined: DataFrame, least: float = BELIEF) -> DataFrame:
    """Partner windows whose own belief, with the other comparisons' best, is not below `least`."""
    who = _comparison(thinned)
    rows = thinned.join(combined.select("gene_id", "offset1", "maxima", F.col("belief").alias("centre_belief")), ["gene_id", "offset1"])
    others = F.filter("maxima", lambda x: ~reduce(Column.__and__, (x[c] == F.col(c) for c in who)))
    left = F.aggregate(others, F.lit(1.0), lambda a, x: a * (1 - x["best"]))
    return rows.filter(1 - left * (1 - F.col("belief")) >= least).drop("maxima")


def assemble(centres: DataFrame, width: int = WIDTH, tolerance: int = TOLERANCE) -> DataFrame:
    """(gene_id, offset1, bundle_id): centre windows join a bundle while they start within the tolerance of its end."""
    rows = centres.select("gene_id", "offset1", F.col("offset1").alias("lo"), (F.col("offset1") + width - 1).alias("hi"))
    return islands(rows, ["gene_id"], tolerance).select("gene_id", "offset1", F.col("island").alias("bundle_id"))


def merge_elements(pruned: DataFrame, bundles: DataFrame, width: int = WIDTH, tolerance: int = TOLERANCE) -> DataFrame:
    """Elements of a comparison in a bundle, those within the tolerance as one (closed bounds)."""
    who = _comparison(pruned)
    rows = pruned.join(bundles, ["gene_id", "offset1"]).withColumns({"lo": F.col("offset2"), "hi": F.col("offset2") + width - 1})
    rows = islands(rows, ["gene_id", "bundle_id", *who], tolerance)
    return rows.groupBy("gene_id", "bundle_id", *who, "island").agg(
        F.min("lo").alias("start"), F.max("hi").alias("end"), F.min("offset1").alias("target_start"), (F.max("offset1") + width - 1).alias("target_end"),
        F.max("score").alias("conservation"), F.max("belief").alias("belief"), F.max("integrate").alias("integrate"),
    ).drop("island")


def centre_elements(combined: DataFrame, bundles: DataFrame, width: int = WIDTH) -> DataFrame:
    """The centre sequence's stretch of each bundle."""
    rows = combined.join(bundles, ["gene_id", "offset1"])
    return rows.groupBy("gene_id", "bundle_id").agg(F.min("offset1").alias("start"), (F.max("offset1") + width - 1).alias("end"), F.max("belief").alias("belief"))


def bundle_conservation(elements: DataFrame, species_order: DataFrame) -> DataFrame:
    """(gene_id, bundle_id, conservation, max_all): the best of the first species that has elements, and of all."""
    rows = elements.join(species_order, "species")
    first = F.min("species_idx").over(Window.partitionBy("gene_id", "bundle_id"))
    return rows.withColumn("__f", first).groupBy("gene_id", "bundle_id").agg(F.max(F.when(F.col("species_idx") == F.col("__f"), F.col("conservation"))).alias("conservation"), F.max("conservation").alias("max_all"))


def _reached(elements: DataFrame, seqs: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """seqs that elements name (where these are few enough to be sent out), each column cut behind the last end of all
    elements: no more of a sequence goes through the join than an element can reach."""
    ends = elements.agg(F.min("start").alias("__least"), F.max("end").alias("__last"))
    upto = lambda c: F.when(F.col("__least") >= 0, F.col(c).substr(F.lit(1), F.greatest(F.col("__last") + 1, F.lit(0)).cast("int"))).otherwise(F.col(c))
    short = seqs.join(F.broadcast(ends), F.lit(True)).withColumns({c: upto(c) for c in columns}).drop("__least", "__last")
    ids = elements.select(*on).distinct()
    return short.join(F.broadcast(ids), on, "left_semi") if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else short


def element_repeat_ratio(elements: DataFrame, seqs: DataFrame) -> DataFrame:
    """Elements with the repeat ratio of their final stretch; seqs: (gene_id or partner, species, seq, masked_seq)."""
    cut = lambda c: F.col(c).substr(F.col("start") + 1, F.col("end") - F.col("start") + 1)
    on = [c for c in ("gene_id", "species", "partner") if c in elements.columns and c in seqs.columns]
    joined = elements.join(_reached(elements, seqs.select(*on, "seq", "masked_seq"), on, ["seq", "masked_seq"]), on)
    return joined.withColumn("repeat_ratio", repeat_ratio(cut("masked_seq"), cut("seq"))).drop("seq", "masked_seq")


def bundles_to_modules(elements: DataFrame, intervals: DataFrame) -> DataFrame:
    """Elements with their place on the region and their bases; intervals: (gene_id or partner, species, chrom, lo, hi, strand, seq)."""
    on = [c for c in ("gene_id", "species", "partner") if c in elements.columns and c in intervals.columns]
    places = intervals.select(*on, "chrom", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "strand", "seq")
    rows = elements.drop("chrom", "lo", "hi", "strand", "seq").join(_reached(elements, places, on, ["seq"]), on)
    lo, hi = bundle_interval("start", "end", "__lo", "__hi", "strand")
    piece = F.col("seq").substr(F.col("start") + 1, F.col("end") - F.col("start") + 1)
    return rows.withColumns({"lo": lo, "hi": hi, "seq": piece}).drop("__lo", "__hi")


def conservation_profiles(intervals: DataFrame, width: int, cutoff: int, centre: str | None = None) -> DataFrame:
    """(pair_id, side, offset, score): best scores along both sequences, for all pairs of a set or the centre with each other."""
    a = intervals.select("set_id", F.col("id").alias("id1"), F.col("seq").alias("seq1"))
    b = intervals.select("set_id", F.col("id").alias("id2"), F.col("seq").alias("seq2"))
    pick = (F.col("id1") == centre) & (F.col("id2") != centre) if centre is not None else F.col("id1") < F.col("id2")
    pairs = a.join(b, "set_id").filter(pick).select(F.concat_ws("|", "set_id", "id1", "id2").alias("pair_id"), "seq1", "seq2")
    scores = merge_strands(pairs, width, cutoff)
    side = lambda n: scores.select("pair_id", F.lit(n).alias("side"), F.col(f"offset{n}").alias("offset"), "score")
    return side(1).union(side(2)).groupBy("pair_id", "side", "offset").agg(F.max("score").alias("score"))
