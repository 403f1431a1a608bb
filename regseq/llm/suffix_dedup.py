"""Removal of byte strings of `length` bytes that start twice or more anywhere in the corpus.

No task could hold the suffix array of the corpus, so suffixes that can be equal are brought
together by content first:
1. Every window of `length` bytes picks its least GRAM-byte string (by hash, leftmost of
   equals) as its anchor.  Equal windows pick equal anchors.  Successive windows with one
   anchor are a run; its windows' bytes together are the run's piece.  There are about
   2 / (length - GRAM) runs a byte.
2. Runs are shuffled by their anchor's hash; anchors seen once are dropped.  Of equal
   pieces one row carries the bytes, and a second one tells that there are more.
3. The pieces of an anchor meet in one task, which sorts their suffixes in blocks of whole
   anchors (suffixes.py: deep-shallow sorting) and marks neighbours that share `length`
   bytes.  The pieces of an anchor of more than HOT_ROWS runs are cut into parts of PART
   windows and are dealt by the hash of the bytes that a part's windows share, so that one
   frequent passage does not load one task.
4. The marks go back to all runs of an equal piece, and from the runs to their documents.
Every comparison that removes a byte is made on bytes by the sort; hashes only bring
suffixes together, and name equal pieces and texts (64 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import out_schema, small_batches, stored
from regseq.llm.suffixes import repeated_suffixes

LENGTH = 200
GRAM = 48
#: Runs of one anchor beyond which its pieces are cut and dealt by content.
HOT_ROWS = 1 << 14
PART = 8
#: Bytes of pieces that one block of the sort holds, whole anchors only.
BLOCK_BYTES = 1 << 19
#: A text is scanned in segments of so many bytes; positions in them take 24 bits.
SEGMENT = 1 << 22
#: Ids of texts that are broadcast to pick them; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    cover = 1
    while cover * 2 <= width:
        x = np.minimum(x[:-cover], x[cover:])
        cover *= 2
    n = len(x) + cover - width
    return np.minimum(x[:n], x[width - cover : width - cover + n])


def _runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a segment: each run's first window, the anchor's distance from it, its windows, anchor hash and piece hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = tb.prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = tb.ranges(sums, at, at + GRAM)
    anchor = (_sliding_min((grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64), length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = True
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    # The last window of a text is followed by windows that are not in one text, if by any.
    starts = np.flatnonzero(ok[:-1] & (new | ~np.concatenate([[False], ok[:-2]])))
    last = np.flatnonzero(ok[:-1] & (np.concatenate([new[1:], [True]]) | ~ok[1:]))
    a = anchor[starts]
    return starts, a - starts, last - starts + 1, grams[a], tb.ranges(sums, starts, last + length)


def _row_id() -> Column:
    """64 bits that name a text of a document; rows repeated as a whole share it."""
    return F.xxhash64("doc_id", "text")


def _all_runs(docs: DataFrame, length: int) -> DataFrame:
    """(row, pn, fp, sh): text; first window, anchor's distance from it and number of windows, packed; anchor; piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            rows = s.batch.column(s.batch.schema.get_field_index("__row")).to_numpy()
            windows = len(s.data) - length + 1
            for at in range(0, max(windows, 0), SEGMENT):
                to = min(len(s.data), at + SEGMENT + length - 1)
                p, off, n, fp, sh = _runs(s.data[at:to], np.clip(s.offsets, at, to) - at, length)
                p = p + at
                doc = np.searchsorted(s.offsets, p, "right") - 1
                cols = [rows[doc], (p - s.offsets[doc]) << 16 | off << 8 | n, fp.view(np.int64), sh.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["__row", "pn", "fp", "sh"])

    return docs.select("__row", "text").mapInArrow(run, "__row long, pn long, fp long, sh long")


def _shared_anchors(runs: DataFrame) -> DataFrame:
    """Runs whose anchor is found twice or more, with rep: 1 if the row is to carry the piece's
    bytes, 2 if it tells that there are more of them, 0 for the rest; and hot."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = runs.repartition(parts, "fp").sortWithinPartitions("fp", "sh", "__row", "pn")

    def emit(t: np.ndarray, hot: bool, before: tuple[int, int]) -> tuple[pa.RecordBatch, tuple[int, int]]:
        """t: columns row, pn, fp, sh of whole anchors, or of a portion of a hot one.  before: piece and its rows so far."""
        fp, sh = t[2], t[3]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (sh[1:] != sh[:-1])
        begin = np.flatnonzero(new)
        k = np.arange(len(fp)) - np.repeat(begin, np.diff(np.append(begin, len(fp))))
        if hot and len(fp) and before[1] and sh[0] == before[0]:
            k[: begin[1] if len(begin) > 1 else len(fp)] += before[1]
        if hot:
            keep = np.ones(len(fp), bool)
            rep = np.where(k < 2, 1, 0)
        else:
            edge = np.ones(len(fp) + 1, bool)
            edge[1:-1] = fp[1:] != fp[:-1]
            keep = ~(edge[1:] & edge[:-1])
            rep = np.where(k == 0, 1, np.where(k == 1, 2, 0))
        cols = [pa.array(c[keep]) for c in t] + [pa.array(rep[keep].astype(np.int32)), pa.array(np.full(int(keep.sum()), hot))]
        return pa.RecordBatch.from_arrays(cols, names=["__row", "pn", "fp", "sh", "rep", "hot"]), (int(sh[-1]), int(min(k[-1] + 1, 2))) if len(sh) else before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        hot: int | None = None
        before = (0, 0)
        for b in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
            if hot is not None and held.shape[1]:
                end = int(np.searchsorted(held[2] != hot, True))
                out, before = emit(held[:, :end], True, before)
                yield out
                held = held[:, end:]
                hot = None if held.shape[1] else hot
            if held.shape[1] > HOT_ROWS:
                cut = int(np.searchsorted(held[2], held[2, -1]))
                if cut:
                    yield emit(held[:, :cut], False, (0, 0))[0]
                    held = held[:, cut:]
                if held.shape[1] > HOT_ROWS:
                    hot = int(held[2, 0])
                    out, before = emit(held, True, (0, 0))
                    yield out
                    held = held[:, :0]
        if held.shape[1]:
            yield emit(held, False, (0, 0))[0]

    return rows.mapInArrow(run, "__row long, pn long, fp long, sh long, rep int, hot boolean")


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with wanted (row, ...); few wanted rows first pick the texts that are shuffled."""
    if wanted.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(wanted.select("__row")), "__row", "left_semi")
    return docs.join(wanted.hint("shuffle_hash"), "__row")


def _pieces(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """(key, sh, first, bytes): pieces, or parts of them from window `first` on; bytes is null on rows that only count."""
    wanted = stored(shared.filter("rep = 1").groupBy("__row").agg(F.collect_list(F.struct("pn", "fp", "sh", "hot")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            runs = s.batch.column(s.batch.schema.get_field_index("runs"))
            doc = tb.doc_of(np.asarray(runs.offsets, np.int64))
            flat = runs.flatten()
            pn, fp, sh = (flat.field(k).to_numpy() for k in range(3))
            hot = flat.field(3).to_numpy(zero_copy_only=False)
            at, off, n = s.offsets[doc] + (pn >> 16), pn >> 8 & 255, pn & 255
            first = np.zeros(len(n), np.int64)
            key = fp
            if hot.any():
                # Equal windows lie equally far before the anchor, so a run is cut where that distance
                # passes a multiple of PART.  All windows of a part share the bytes from the start of
                # its last possible window to the end of its first.
                near, far = off - n + 1, off
                low = np.where(hot, near // PART, 0)
                parts = np.where(hot, far // PART - low + 1, 1)
                src = np.repeat(np.arange(len(n)), parts)
                part = low[src] + np.arange(len(src)) - np.repeat(np.cumsum(parts) - parts, parts)
                anchor, hot, sh = (at + off)[src], hot[src], sh[src]
                far_, near_ = np.minimum(far[src], part * PART + PART - 1), np.maximum(near[src], part * PART)
                first = np.where(hot, far[src] - far_, 0)
                n = np.where(hot, far_ - near_ + 1, n[src])
                at = at[src] + first
                core = np.where(hot, anchor - part * PART, at), np.where(hot, anchor - part * PART - PART + 1 + length, at)
                key = np.where(hot, tb.ranges(tb.prefix(s.data), *core).view(np.int64) ^ part, fp[src])
            size = n + length - 1
            bounds = np.concatenate([[0], np.cumsum(size)])
            for lo in range(0, len(n), 4096):
                hi = min(len(n), lo + 4096)
                base = bounds[lo]
                index = np.repeat(at[lo:hi] - (bounds[lo:hi] - base), size[lo:hi]) + np.arange(bounds[hi] - base)
                body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((bounds[lo : hi + 1] - base).astype(np.int32)), pa.py_buffer(s.data[index])])
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi]), pa.array(sh[lo:hi]), pa.array(first[lo:hi].astype(np.int32)), body], names=["key", "sh", "first", "bytes"])

    bodies = _picked(docs.select("__row", "text"), wanted).select("text", "runs").mapInArrow(run, "key long, sh long, first int, bytes binary")
    more = shared.filter("rep = 2 and not hot").select(F.col("fp").alias("key"), "sh", F.lit(0).alias("first"), F.lit(None).cast("binary").alias("bytes"))
    return bodies.unionByName(more)


def _marks(pieces: DataFrame, length: int) -> DataFrame:
    """(sh, first, bits): which windows of a piece, from `first` on, are found twice or more; pieces without any are left out."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.repartition(parts, "key").sortWithinPartitions("key", "sh", "first", F.col("bytes").isNull())

    def block(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, sh, first = (t.column(k).to_numpy() for k in ("key", "sh", "first"))
        body = t.column("bytes")
        null = body.is_null().to_numpy(zero_copy_only=False)
        data, offsets = tb.text_bytes(body)
        at = np.flatnonzero(~null)
        n = np.diff(offsets)[at] - length + 1
        bounds = np.concatenate([[0], np.cumsum(n)])
        starts = np.repeat(offsets[:-1][at] - bounds[:-1], n) + np.arange(bounds[-1])
        mark = repeated_suffixes(data, starts, length)
        # A row without bytes follows the piece that it counts.
        dup = np.zeros(len(null), bool)
        dup[:-1] = null[1:] & (sh[1:] == sh[:-1]) & (key[1:] == key[:-1])
        mark |= np.repeat(dup[at], n)
        some = np.flatnonzero(np.add.reduceat(mark, bounds[:-1]) > 0) if len(at) else at
        bits = [np.packbits(mark[bounds[i] : bounds[i + 1]]).tobytes() for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(sh[at[some]]), pa.array(first[at[some]]), pa.array(bits, pa.binary())], names=["sh", "first", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            for s in tb.slices([b], "bytes", BLOCK_BYTES):
                held.append(s.batch)
                size += len(s.data)
                if size < BLOCK_BYTES:
                    continue
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from block(t.slice(0, cut))
                held = [t.slice(cut)]
                size = len(tb.text_bytes(held[0].column("bytes"))[0])
        if held:
            yield from block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "sh long, first int, bits binary")


_RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), ("kept_text", T.StringType())]


def _spans(marks: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs, from a text's marks."""
    parts = []
    for m in marks:
        p, n = (m["pn"] >> 16) + m["first"], (m["pn"] & 255) - m["first"]
        parts.append(p + np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8))[: max(n, 0)]))
    starts = np.unique(np.concatenate(parts))
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256, the removed byte ranges and kept_text.

    A byte is removed if a string of `length` bytes that covers it starts twice or more in the
    corpus.  Null texts are empty; nothing is removed from texts of fewer bytes.  kept_text
    leaves out what remains of characters cut in two (kept_sha256 has them); with_text=False
    leaves the column out.  Rows repeated as a whole are repeats of each other.  Columns of
    docs with the names of results are replaced.
    """
    if length % 8 or length < GRAM + 8 or length - GRAM >= 255:
        raise ValueError("length: a multiple of 8 from 56 to 296")
    small_batches(docs.sparkSession)
    result = [x for x in _RESULT if with_text or x[0] != "kept_text"]
    base = docs.drop(*(k for k, _ in result)).withColumn("__row", _row_id())
    shared = stored(_shared_anchors(_all_runs(base, length)))
    marks = _marks(_pieces(base, shared, length), length)
    found = shared.select("__row", "pn", "sh").join(marks, "sh").groupBy("__row").agg(F.collect_list(F.struct("pn", "first", "bits")).alias("__marks"))
    # Rows repeated as a whole share the row id, so that each mark comes once for each of them; the spans are a union.
    found = stored(found)
    few = found.count() <= BROADCAST_ROWS
    flagged = base.join(F.broadcast(found.select("__row", F.lit(True).alias("__flag"))), "__row", "left") if few else base
    names = [c for c in base.columns if c != "__row"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            cols: dict[str, list] = {k: [] for k, _ in result}
            marked = s.batch.column(s.batch.schema.get_field_index("__marks")).to_pylist()
            for i, m in enumerate(marked):
                body = s.data[s.offsets[i] : s.offsets[i + 1]].tobytes()
                gone = _spans(m, length) if m else []
                kept = b"".join(body[a:b] for a, b in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(body)], strict=True))
                row = {"n_bytes": len(body), "n_removed": len(body) - len(kept), "n_spans": len(gone), "kept_sha256": hashlib.sha256(kept).hexdigest(), "removed": [{"start": x, "stop": y} for x, y in gone]}
                if with_text:
                    row["kept_text"] = kept.decode("utf-8", "ignore")
                for k in cols:
                    cols[k].append(row[k])
            types = {"removed": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept_sha256": pa.string(), "kept_text": pa.string()}
            yield tb.with_columns(s.batch.select(names), {k: pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()})

    schema = out_schema(base.select(names), result)
    if few:
        touched = flagged.filter("__flag").drop("__flag").join(found.hint("shuffle_hash"), "__row").drop("__row").mapInArrow(cut, schema)
        text = F.coalesce("text", F.lit(""))
        clean = {"n_bytes": F.octet_length(text).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.sha2(text, 256), "removed": F.array().cast(dict(_RESULT)["removed"]), "kept_text": text}
        rest = flagged.filter("__flag is null").select(*names, *(clean[k].alias(k) for k, _ in result))
        return touched.unionByName(rest)
    return flagged.join(found, "__row", "left").drop("__row").mapInArrow(cut, schema)


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated strings taken out of their texts; n_chars follows."""
    own = {c: f"__own_{c}" for c in docs.columns if c in dict(_RESULT)}
    cut = remove_repeats(docs.withColumnsRenamed(own), length)
    text = F.when(F.col("text").isNull(), None).otherwise(F.col("kept_text"))
    new = {"text": text} | {c: F.col(k) for c, k in own.items()}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select([new.get(c, F.col(c)).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, LENGTH, with_text=False).drop("text", "removed")
