"""Benchmark decontamination by an FM-index per shard of training text.

Each task cuts its documents into shards of a few megabytes and indexes a shard's words
(fm_index.py).  Words that no test phrase has cannot be in a match: they only part the
stretches of the index, and stretches shorter than the shortest phrase are left out.  All
phrases are searched backwards through the wavelet ranks in step, their occurrences located
by sampled positions, and their words merged into removal spans.

Test items come to the driver and are broadcast in blocks of at most BLOCK_BYTES of text,
one narrow pass over the documents for each block, so documents are never shuffled and a
larger benchmark means more passes, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regseq.llm import textbytes as tb
from regseq.llm.common import out_schema, small_batches
from regseq.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_COLUMNS = [("n_words", T.LongType()), ("hit_words", _SPANS), ("hit_bytes", _SPANS), ("item_ids", T.ArrayType(T.StringType()))]


class Phrases(NamedTuple):
    """The distinct windows of a block of items."""

    vocabulary: np.ndarray  # hashes of the words, ascending; word k + 1 has vocabulary[k]
    words: np.ndarray  # a row for each window, left-aligned
    lengths: np.ndarray
    first: np.ndarray  # bounds of each window's items in `items`
    items: np.ndarray  # indices of ids
    ids: np.ndarray


def phrases(table: pa.Table, window: int) -> Phrases:
    """From item_id (as text) and text; items without an id or without words have no windows."""
    rows = [(i, t) for i, t in zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True) if i is not None]
    data, offsets = tb.text_bytes(pa.array([t for _, t in rows], pa.large_string()))
    starts, ends = tb.spans(data, offsets, tb.ALNUM)
    first = np.searchsorted(starts, offsets)
    vocabulary, word = np.unique(tb.word_hashes(data, starts, ends), return_inverse=True)
    _, at = tb.shingles(vocabulary[word], first, window)
    doc = tb.doc_of(first)[at] if len(at) else at
    lengths = np.minimum(first[1:][doc] - at, window)
    table_ = np.zeros((len(at), window), np.int64)
    for k in range(window):
        have = k < lengths
        table_[have, k] = word[at[have] + k] + 1
    distinct, which = np.unique(table_, axis=0, return_inverse=True) if len(at) else (table_, at)
    pairs = np.unique(np.column_stack([which.reshape(-1), doc]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return Phrases(vocabulary, distinct, (distinct > 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1], np.array([str(i) for i, _ in rows], object))


def occurrences(p: Phrases, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard's words: indices of words at which a window begins, and the windows."""
    none = np.zeros(0, np.int64)
    if not len(p.lengths) or not len(hashes):
        return none, none
    at = np.minimum(np.searchsorted(p.vocabulary, hashes), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[at] == hashes, at + 1, 0)
    # Stretches of known words of one document, long enough for a phrase.
    edge = np.ones(len(symbol) + 1, bool)
    edge[1:-1] = (doc[1:] != doc[:-1]) | ((symbol[1:] > 0) != (symbol[:-1] > 0))
    cuts = np.flatnonzero(edge)
    begin, size = cuts[:-1], np.diff(cuts)
    keep = (symbol[begin] > 0) & (size >= p.lengths.min())
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return none, none
    # Each stretch is followed by a 0.
    bounds = np.concatenate([[0], np.cumsum(size + 1)])
    word = np.repeat(begin - bounds[:-1], size + 1) + np.arange(bounds[-1])
    sequence = symbol[np.minimum(word, len(symbol) - 1)]
    sequence[bounds[1:] - 1] = 0
    index = FMIndex(sequence, len(p.vocabulary))
    low, high = index.search(p.words, p.lengths)
    count = high - low
    window = np.repeat(np.arange(len(low)), count)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return word[index.locate(rows)], window


def _lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def _span_lists(start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> pa.ListArray:
    return _lists(pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], ["start", "stop"]), first)


def _search(batches: Iterator[pa.RecordBatch], p: Phrases, again: bool) -> Iterator[pa.RecordBatch]:
    for s in tb.slices(batches, "text", SHARD_BYTES):
        starts, ends = tb.spans(s.data, s.offsets, tb.ALNUM)
        first = np.searchsorted(starts, s.offsets)
        doc = tb.doc_of(first)
        at, window = occurrences(p, tb.word_hashes(s.data, starts, ends), doc)
        depth = np.bincount(at, minlength=len(doc) + 1) - np.bincount(at + p.lengths[window], minlength=len(doc) + 1)
        items = [(d, p.ids[i]) for d, i in _items(p, doc[at], window)]
        if again:
            spans = s.batch.column(s.batch.schema.get_field_index("hit_words"))
            owner = tb.doc_of(np.asarray(spans.offsets, np.int64))
            lo, hi = (spans.flatten().field(k).to_numpy() + first[owner] for k in range(2))
            depth += np.bincount(lo, minlength=len(depth)) - np.bincount(hi, minlength=len(depth))
            old = s.batch.column(s.batch.schema.get_field_index("item_ids"))
            items += zip(tb.doc_of(np.asarray(old.offsets, np.int64)).tolist(), old.flatten().to_pylist(), strict=True)
        items = sorted(set(items))
        hit = np.cumsum(depth)[: len(doc)] > 0
        edge = np.ones(len(hit) + 1, bool)
        edge[1:-1] = (hit[1:] != hit[:-1]) | (doc[1:] != doc[:-1])
        cuts = np.flatnonzero(edge) if len(hit) else np.zeros(1, np.int64)
        lo, hi = cuts[:-1][hit[cuts[:-1]]] if len(hit) else cuts[:0], cuts[1:][hit[cuts[:-1]]] if len(hit) else cuts[:0]
        bounds = np.searchsorted(doc[lo] if len(lo) else lo, np.arange(len(s.offsets)))
        owner = doc[lo] if len(lo) else lo
        yield tb.with_columns(s.batch, {
            "n_words": np.diff(first).astype(np.int64),
            "hit_words": _span_lists(lo - first[owner], hi - first[owner], bounds),
            "hit_bytes": _span_lists(starts[lo] - s.offsets[owner], ends[hi - 1] - s.offsets[owner], bounds),
            "item_ids": _lists(pa.array([i for _, i in items], pa.string()), np.searchsorted(np.array([d for d, _ in items], np.int64), np.arange(len(s.offsets)))),
        })


def _items(p: Phrases, doc: np.ndarray, window: np.ndarray) -> Iterator[tuple[int, int]]:
    """Distinct (document, item) pairs of the windows found."""
    if not len(doc):
        return iter(())
    both = np.unique(doc * len(p.lengths) + window)
    doc, window = both // len(p.lengths), both % len(p.lengths)
    count = p.first[window + 1] - p.first[window]
    item = p.items[np.repeat(p.first[window] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))]
    pairs = np.unique(np.repeat(doc, count) * len(p.ids) + item)
    return zip((pairs // len(p.ids)).tolist(), (pairs % len(p.ids)).tolist(), strict=True)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_words and hit_bytes (merged spans, by word and by byte) and item_ids (as text, ascending).

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  A window is
    `window` words of an item, or all of a shorter one.  Null texts have no words; items
    without an id or without words, and an empty table of items, hit nothing.  Items repeated
    under one id count once.  Rows keep their number; columns with the results' names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    schema = out_schema(docs, _COLUMNS)
    out = docs
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(phrases(part.toArrow(), window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0) -> Iterator[pa.RecordBatch]:
            for b in _search(batches, shared.value, again):
                yield b.select(schema.names)

        out = out.mapInArrow(run, schema)
    return out


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit spans cut out of their texts; n_chars follows.

    Rows and columns stay as they are, whatever their names and types; null texts stay null.
    """
    names, schema = docs.columns, docs.schema
    # The caller's columns go by numbers meanwhile, so that the operator's own have their names to themselves.
    private = [c if c == "text" else f"__{i}" for i, c in enumerate(names)]
    chars_at = private[names.index("n_chars")] if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in tb.slices(batches):
            spans = s.batch.column("hit_bytes").to_pylist()
            new = {"text": s.batch.column("text")}
            if any(spans):
                texts, chars = new["text"].to_pylist(), s.batch.column(chars_at).to_pylist() if chars_at else None
                for i, gone in enumerate(spans):
                    if gone:
                        body = texts[i].encode()
                        texts[i] = b"".join(body[a:b] for a, b in zip([0, *(x["stop"] for x in gone)], [*(x["start"] for x in gone), len(body)], strict=True)).decode()
                        if chars:
                            chars[i] = len(texts[i])
                new["text"] = pa.array(texts, new["text"].type)
                if chars:
                    new[chars_at] = pa.array(chars, s.batch.column(chars_at).type)
            yield tb.with_columns(s.batch.select(private), new).rename_columns(names)

    return contamination(docs.toDF(*private), items, window).mapInArrow(cut, schema)


def op2_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
