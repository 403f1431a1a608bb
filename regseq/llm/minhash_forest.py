"""MinHash near-duplicates by an LSH forest: sorted signature orders and their neighbours.

1. One pass over the texts gives each document its set of word shingles' 128-bit key (equal
   sets are one class, so copies never meet as pairs) and VALUES MinHash values.
2. Each tree sorts the classes by the signature, started at another hash function.  Classes
   with a common prefix of BASE_DEPTH values are a region.  A region of more than REGION (first
   FIRST_REGION) classes is cut deeper, one value at a time, until its parts are small (adaptive depth);
   the neighbours in the order, whose common prefixes are longest, stay candidates beyond
   those cuts.  The order is range-partitioned, so one region may lie in many tasks.
3. A pair of a region becomes a candidate if as many values of its signatures agree as
   cannot be missed at the wanted similarity.  First every class is held against its PARTNERS
   likeliest candidates only, these are confirmed on the full sets, and components are
   formed; then every candidate pair that still joins two components, by signatures of
   VALUES values, is confirmed.  A pair is left out only if its ends are already in one
   component, so no link is lost, and a group of m near copies costs some m pairs, not m * m.
4. Classes of regions that had to be cut, or in the first step that a border between tasks may
   have cut, are not left to the parts: after the first step they take part in the second in any
   case; in the second a border divides large regions only, and their classes are joined
   exactly, by the rarest of their shingles (a pair that is similar enough shares one of so few
   that size bounds give, the prefix filter).
Components are built by distributed stars; class keys, links and components never
come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import small_batches, stored
from regseq.llm.components import components

TREES = 20
BASE_DEPTH = 3
#: Values that estimate similarity: of all classes, and of those with candidates.  The orders
#: begin with the first TREES * BASE_DEPTH of them.
FIRST_VALUES, VALUES = 96, 512
#: Classes of one region that are compared with each other, before and after most are in components.
FIRST_REGION, REGION = 256, 4096
#: Beyond the cuts of a large region, so many next neighbours in the order are compared.
NEIGHBOURS = 8
#: Candidates of a class that are confirmed first: of each tree, and of all.
TREE_PARTNERS, PARTNERS = 4, 12
#: Standard deviations below the wanted similarity at which an estimate rules a pair out (a chance of 3e-5).
CERTAIN = 4.0
#: Up to so many class representatives are broadcast to pick their documents; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Classes of one shingle that one task of the exact join meets at most, on average.
SHARERS = 1_000
#: Rows that a task holds at once, and pairs of which it compares signatures at once.
HOLD, CHUNK = 1 << 14, 1 << 12

_MULTIPLIERS = (tb.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(tb.BASE)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_KEY = 1 + 4 * BASE_DEPTH
_ORDERED = TREES * BASE_DEPTH


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of an uint8 matrix."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * w, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    data, _ = tb.text_bytes(column)
    return data.reshape(-1, width)


def _sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the documents, each document's ascending, and their bounds."""
    starts, ends = tb.spans(data, offsets, tb.NOT_SPACE)
    keys, at = tb.shingles(tb.word_hashes(data, starts, ends), np.searchsorted(starts, offsets), words)
    doc = tb.doc_of(np.searchsorted(starts, offsets))[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc = keys[new], doc[new]
    return keys, np.searchsorted(doc, np.arange(len(offsets)))


def _classes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128-bit keys of the sets, as an uint8 matrix."""
    a = tb.sums_by(tb.mix(keys), first, np.uint64)
    b = tb.sums_by(tb.mix(keys ^ np.uint64(tb.BASE)), first, np.uint64)
    return np.column_stack([tb.mix(a), tb.mix(b)]).astype(">u8").view(np.uint8).reshape(-1, 16)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, __text, n_shingles, cls, sig) of each row; cls and sig are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            keys, first = _sets(s.data, s.offsets, words)
            size = np.diff(first)
            order, low = np.zeros((len(size), _ORDERED), ">u4"), np.zeros((len(size), VALUES), np.uint8)
            some = np.flatnonzero(size)
            if len(some):
                short, starts = (keys >> np.uint64(32)).astype(np.uint32), first[:-1][some]
                for k in range(VALUES):
                    least = np.minimum.reduceat(short * _MULTIPLIERS[k], starts)
                    low[some, k] = (least >> np.uint32(8)).astype(np.uint8)
                    if k < _ORDERED:
                        order[some, k] = least
            sig = np.hstack([order.view(np.uint8).reshape(len(size), 4 * _ORDERED), low])
            none = pa.array(size == 0)
            cols = [_binary(_classes(keys, first)), _binary(sig)]
            cols = [pc.if_else(none, pa.scalar(None, pa.binary()), c) for c in cols]
            own = [s.batch.column(s.batch.schema.get_field_index(c)) for c in ("doc_id", "__text")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size.astype(np.int64)), *cols], names=["doc_id", "__text", "n_shingles", "cls", "sig"])

    return docs.select("doc_id", "__text", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("__text", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sig", T.BinaryType())]))


def _orders(classes: DataFrame, values: int, large: DataFrame | None = None) -> DataFrame:
    """(okey, cls, n, label, heads) for each tree, sorted by okey: tree, prefix, then one byte of each further value.

    heads: the prefixes in all trees.  large (region, large): if given, regions that are not among
    them are not divided between tasks, and rows carry `large`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sig = _matrix(b.column("sig"), 4 * _ORDERED + VALUES)
                heads, low = sig[:, : 4 * _ORDERED].reshape(-1, TREES, 4 * BASE_DEPTH), sig[:, 4 * _ORDERED : 4 * _ORDERED + values]
                rows = [np.hstack([np.full((len(sig), 1), t, np.uint8), heads[:, t], np.roll(low, -(t + 1) * BASE_DEPTH, axis=1)]) for t in range(TREES)]
                rest = [b.column("cls"), b.column("n"), b.column("label"), _binary(sig[:, : 4 * _ORDERED])]
                rest = [pa.chunked_array([c] * TREES).combine_chunks() for c in rest]
                yield pa.RecordBatch.from_arrays([_binary(np.vstack(rows)), *rest], names=["okey", "cls", "n", "label", "heads"])

    rows = classes.select("cls", "n", "label", "sig").mapInArrow(run, "okey binary, cls binary, n long, label binary, heads binary")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if large is None:
        return rows.repartitionByRange(parts, "okey", "cls").sortWithinPartitions("okey", "cls")
    # A region stays whole in one task, unless it is large: then its order is dealt out.
    rows = rows.withColumn("region", F.substring("okey", 1, _KEY)).join(large, "region", "left")
    rows = rows.withColumn("large", F.coalesce("large", F.lit(False)))
    dealt = F.when(F.col("large"), F.col("okey")).otherwise(F.lit(b""))
    return rows.repartitionByRange(parts, "region", dealt).sortWithinPartitions("okey", "cls").drop("region")


def _large_regions(classes: DataFrame, most: int) -> DataFrame:
    """(region, large) of the regions of more than `most` classes, in any tree."""
    keys = (F.concat(F.lit(bytes([t])), F.substring("sig", 4 * BASE_DEPTH * t + 1, 4 * BASE_DEPTH)) for t in range(TREES))
    sizes = classes.select(F.explode(F.array(*keys)).alias("region")).groupBy("region").count()
    found = stored(sizes.filter(F.col("count") > most).select("region", F.lit(True).alias("large")))
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def _regions(okey: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the base regions, and of the parts that large regions are cut into."""
    n = len(okey)
    base = np.zeros(n, np.int64)
    differ = okey[1:] != okey[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), okey.shape[1])
    base[1:] = np.cumsum(lcp < _KEY)
    part = base.copy()
    for depth in range(_KEY + 1, okey.shape[1] + 1):
        size = np.bincount(part)
        large = size[part] > most
        if not large.any():
            break
        cut = np.zeros(n, bool)
        cut[1:] = (part[1:] != part[:-1]) | (large[1:] & (lcp < depth))
        part = np.cumsum(cut)
    return base, part


def _near(okey: np.ndarray, n: np.ndarray, label: np.ndarray, heads: np.ndarray | None, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one region whose signatures agree well enough and whose labels differ, and how many values agree.

    heads (rows, trees, bytes): pairs that are in one region of an earlier tree are left to it.
    """
    base, part = _regions(okey, most)
    sketch = okey[:, _KEY:]
    values, s = sketch.shape[1], percent / 100
    least = (s - CERTAIN * (s * (1 - s) / values) ** 0.5) * values
    rows = np.arange(len(okey))
    found: list[tuple[np.ndarray, ...]] = [(rows[:0], rows[:0], rows[:0])]
    for step in range(1, most + 1):
        rows = rows[rows + step < len(okey)]
        rows = rows[base[rows] == base[rows + step]]
        if not len(rows):
            break
        a = rows if step <= NEIGHBOURS else rows[part[rows] == part[rows + step]]
        b = a + step
        fit = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[fit], b[fit]
        for at in range(0, len(a), CHUNK):
            x, y = a[at : at + CHUNK], b[at : at + CHUNK]
            same = (sketch[x] == sketch[y]).sum(axis=1)
            good = same >= least
            if heads is not None and good.any():
                x, y, same = x[good], y[good], same[good]
                # The first tree in which the prefixes are equal; there is one, this tree.
                good = (heads[x] == heads[y]).all(axis=2).argmax(axis=1) == okey[x, 0]
            found.append((x[good], y[good], same[good]))
    a, b, same = (np.concatenate(c) for c in zip(*found, strict=True))
    return a, b, same


def _held(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Sorted rows in portions that end with a base region; of a region of over HOLD rows, with overlaps of REGION rows."""
    kept: list[pa.RecordBatch] = []
    count = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        count += b.num_rows
        if count < HOLD:
            continue
        whole = joined()
        okey = _matrix(whole.column("okey"), width)
        new = np.flatnonzero((okey[1:, :_KEY] != okey[:-1, :_KEY]).any(axis=1))
        if len(new):
            cut = int(new[-1]) + 1
            yield okey[:cut], whole.slice(0, cut)
            kept = [whole.slice(cut)]
        else:
            yield okey, whole
            kept = [whole.slice(len(okey) - REGION)]
        count = kept[0].num_rows
    if count:
        whole = joined()
        yield _matrix(whole.column("okey"), width), whole
    tb.give_back()


def _candidates(classes: DataFrame, percent: int, first: bool) -> DataFrame:
    """Of classes (cls, n, sig, label): candidate pairs (cls, other) of different labels.

    first: (cls, other, score) with TREE_PARTNERS likeliest candidates of each class and tree,
    both ways.  Else all candidate pairs, each in the first tree that has it in one region.  Where other is null, cls was not
    held against its whole region.
    """
    values, most = (FIRST_VALUES, FIRST_REGION) if first else (VALUES, REGION)

    def prefix(column: pa.Array) -> np.ndarray:
        return _matrix(column, 16)[:, :8].copy().view(">u8").reshape(-1).astype(np.uint64)

    def flagged(cls: pa.Array, which: np.ndarray) -> pa.RecordBatch:
        cls = cls.filter(pa.array(which)).unique()
        return pa.RecordBatch.from_arrays([cls, pa.nulls(len(cls), pa.binary()), pa.array(np.full(len(cls), -1, np.int32))], names=["cls", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for okey, rows in _held(batches, _KEY + values):
            # Regions that are too large, and in the first step those at the borders of the task's range, are not whole.
            base = np.cumsum(np.concatenate([[False], (okey[1:, :_KEY] != okey[:-1, :_KEY]).any(axis=1)]))
            partly = np.bincount(base)[base] > most if first else rows.column("large").to_numpy(zero_copy_only=False)
            if first and last is None:
                partly |= base == 0
            yield flagged(rows.column("cls"), partly)
            last = rows.column("cls").filter(pa.array(base == base[-1]))
            rank = prefix(rows.column("cls"))
            heads = None if first else _matrix(rows.column("heads"), 4 * _ORDERED).reshape(-1, TREES, 4 * BASE_DEPTH)
            a, b, score = _near(okey, rows.column("n").to_numpy(), prefix(rows.column("label")), heads, percent, most)
            if not len(a):
                continue
            x, y, score = (np.concatenate([a, b]), np.concatenate([b, a]), np.tile(score, 2)) if first else (np.where(rank[a] < rank[b], b, a), np.where(rank[a] < rank[b], a, b), score)
            if first:
                order = np.lexsort((rank[y], -score, x))
                x, y, score = x[order], y[order], score[order]
                begin = np.flatnonzero(np.diff(x, prepend=-1))
                keep = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))) < TREE_PARTNERS
                x, y, score = x[keep], y[keep], score[keep]
            cls = rows.column("cls")
            yield pa.RecordBatch.from_arrays([cls.take(pa.array(x)), cls.take(pa.array(y)), pa.array(score.astype(np.int32))], names=["cls", "other", "score"])
        if first and last is not None:
            yield flagged(last, np.ones(len(last), bool))

    orders = _orders(classes, values, None if first else _large_regions(classes, most))
    return (orders.drop("heads") if first else orders).mapInArrow(run, "cls binary, other binary, score int")


def _full_sets(ends: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cls, keys) of the classes `ends`: their distinct shingles, ascending, 8 bytes each."""
    wanted = stored(classes.join(ends, "cls", "left_semi").select(F.col("rep").alias("__rep"), F.col("cls").alias("__cls")))
    bounded = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.select("doc_id", "text").join(bounded, F.col("doc_id").eqNullSafe(F.col("__rep"))).select("text", "__cls")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            keys, first = _sets(s.data, s.offsets, words)
            same = (_classes(keys, first) == _matrix(s.batch.column("__cls"), 16)).all(axis=1)
            out = pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(keys))])
            yield pa.RecordBatch.from_arrays([s.batch.column("__cls"), out], names=["cls", "keys"]).filter(pa.array(same))

    return rows.mapInArrow(sets, "cls binary, keys binary").dropDuplicates(["cls"])


def _exact_pairs(cut: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs (cls, other) of the classes `cut` that may be similar enough and whose labels differ.

    Shingles are ordered by how many of the classes have them; of n shingles, one of the first
    n - ceil(n * percent / 100) + 1 is shared.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                data, offsets = tb.text_bytes(part.column("keys"))
                n = np.diff(offsets) // 8
                of = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([part.column("cls").take(of), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(data.tobytes(), np.int64))], names=["cls", "n", "key"])

    held = stored(_full_sets(cut, classes, docs, words).mapInArrow(rows, "cls binary, n long, key long"))
    named = held.join(labels, "cls")
    by_label = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    # Keys of which all classes have one label lead to no pair.
    common = by_label.groupBy("key").agg(F.sum("m").alias("count"), F.count("*").alias("labels"), F.max_by("label", F.struct("m", "label")).alias("heavy")).filter("count > 1")
    place = F.row_number().over(Window.partitionBy("cls").orderBy("count", "key"))
    alone = F.col("n") - F.count("*").over(Window.partitionBy("cls"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = named.join(common, "key").withColumn("place", place + alone).filter((F.col("place") <= reach) & (F.col("labels") > 1))
    # Classes of a shingle's most frequent label meet those of its other labels only; they are
    # dealt to salts, each of which meets all of the others.
    salts = F.ceil(F.col("count") / SHARERS).cast("int")
    x = rare.filter(F.col("label") != F.col("heavy")).select("key", "cls", "n", "place", "label", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    y = rare.select("key", F.col("cls").alias("other"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("label").alias("of_other"), (F.col("label") == F.col("heavy")).alias("lone"), F.pmod(F.xxhash64("cls"), salts).cast("int").alias("salt"))
    fit = (F.col("lone") | (F.col("cls") > F.col("other"))) & (F.col("label") != F.col("of_other"))
    # If this is the first shingle that both have, they share no more than those from here on.
    fit &= (1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at"))) * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    return x.join(y, ["key", "salt"]).filter(fit).select(F.greatest("cls", "other").alias("cls"), F.least("cls", "other").alias("other")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    ends = pairs.select("cls").union(pairs.select(F.col("other").alias("cls"))).distinct()
    have = _full_sets(ends, classes, docs, words)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["u", "v"]).filter(pa.array(good))
        tb.give_back()

    x = have.select(F.col("cls").alias("u"), F.col("keys").alias("x"))
    y = have.select(F.col("cls").alias("v"), F.col("keys").alias("y"))
    met = pairs.select(F.col("cls").alias("u"), F.col("other").alias("v")).join(x, "u").join(y, "v").select("u", "v", "x", "y")
    return met.mapInArrow(agree, "u binary, v binary")


def _resolved(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, __text, n_shingles, cls, root, component_id) of each row: its text's hash, class, and component."""
    small_batches(docs.sparkSession)
    signed = stored(signatures(docs.withColumn("__text", F.xxhash64("text")), words))
    classes = stored(signed.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    first = _candidates(classes.withColumn("label", F.col("cls")), percent, True).groupBy("cls")
    # A class without candidates is done with, unless a region of it was cut.
    best = stored(first.agg(F.slice(F.sort_array(F.collect_set(F.when(F.col("other").isNotNull(), F.struct("score", "other"))), asc=False), 1, PARTNERS).alias("p")))
    pairs = best.select("cls", F.explode("p").alias("x")).select(F.greatest("cls", "x.other").alias("cls"), F.least("cls", "x.other").alias("other"))
    roots = components(stored(_confirmed(stored(pairs.distinct()), classes, docs, words, percent)))
    labelled = lambda of: of.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")
    live = stored(labelled(classes.join(best.select("cls"), "cls", "left_semi").select("cls", "rep", "n", "sig")))
    met = stored(_candidates(live, percent, False).select("cls", "other").distinct())
    pairs = met.filter(F.col("other").isNotNull())
    cut = met.filter(F.col("other").isNull()).select("cls")
    for exact in (False, True):
        if exact:
            # By the labels that the second step has left.
            pairs = stored(_exact_pairs(cut, labelled(live.select("cls")), classes, docs, words, percent))
        if pairs.isEmpty():
            continue
        more = stored(_confirmed(pairs, classes, docs, words, percent))
        if not more.isEmpty():
            # Components so far are stars, to which the new links are added.
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    merged = classes.select("cls", "rep").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    named = merged.join(merged.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("cls", "root", "component_id")
    return signed.drop("sig").join(named, "cls", "left")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...).

    Texts are linked if 100 * shared shingles >= percent * shingles of both.  component_id is
    the least doc_id that links lead to, the own included; kept: it is the own.  A text that is
    null or without words has no shingles and is linked with nothing.  Rows repeated as a whole
    get equal results.  A row without doc_id takes part in links; it is kept only if no row of
    its component has one.  Further columns of docs are not looked at.
    """
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return _resolved(docs, words, percent).select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, then of the least hash of the text.

    Only rows whose own text is a repeat go, whatever other rows have their doc_id; of rows with
    equal doc_id and text the one stays whose columns have the least hash.  Rows without words
    or without doc_id stay.
    """
    found = stored(_resolved(docs, words, percent).filter(F.col("doc_id").isNotNull() & F.col("cls").isNotNull()).select("doc_id", "__text", "root"))
    chosen = found.groupBy("root").agg(F.min(F.struct("doc_id", "__text")).alias("x")).select("root", "x.*")
    keys = ["doc_id", "__text"]
    gone = stored(found.join(chosen, ["root", *keys], "left_anti").select(keys).distinct())
    again = stored(found.groupBy(keys).count().filter("count > 1").join(gone, keys, "left_anti").select(keys))
    bounded = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    left = docs.withColumn("__text", F.xxhash64("text")).join(bounded(gone), keys, "left_anti")
    if not again.isEmpty():
        # A map has no hash; as text it has one.
        one = F.min_by(F.struct(*docs.columns), F.xxhash64(*(F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields)))
        once = left.join(bounded(again), keys, "left_semi").groupBy(keys).agg(one.alias("x")).select("x.*")
        return left.join(bounded(again), keys, "left_anti").select(docs.columns).unionByName(once)
    return left.select(docs.columns)


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


__all__ = ["drop_near_duplicates", "near_duplicates", "op3_minhash_forest"]
